"""Distances between row vectors and a few centres.

A centre set is a model parameter (k rows). It is read once per step and sent to
the tasks in blocks, which are reduced inside the row; more than ``MAX_CENTER_VALUES``
numbers in all raise an error. Rows are never multiplied by centres.
The arithmetic runs on whole Arrow batches, since an expression over
k x d array elements is interpreted element by element.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_VALUES = 1_000_000
MAX_CENTER_VALUES = 50_000_000


def to_matrix(vectors: pd.Series) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def squared_distances(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """All squared distances of a batch, without building the difference tensor."""
    d2 = (
        (rows * rows).sum(axis=1)[:, None]
        - 2.0 * rows @ centers.T
        + (centers * centers).sum(axis=1)[None, :]
    )
    return np.maximum(d2, 0.0)


def center_blocks(centers: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Centres in id order as (ids, matrix) blocks of bounded size, up to ``MAX_CENTER_VALUES`` numbers in all."""
    ids: list[int] = []
    rows: list[list[float]] = []
    values = 0
    for row in centers.select("center_id", "center").orderBy("center_id").toLocalIterator():
        ids.append(row["center_id"])
        rows.append(row["center"])
        values += len(row["center"])
        if values > MAX_CENTER_VALUES:
            raise ValueError(f"centres hold more than {MAX_CENTER_VALUES} numbers")
        if len(rows) * len(rows[0]) >= BLOCK_VALUES:
            yield np.asarray(ids), np.asarray(rows, dtype=np.float64)
            ids, rows = [], []
    if rows:
        yield np.asarray(ids), np.asarray(rows, dtype=np.float64)


def center_matrix(centers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All centres at once, for operators whose result has one value per centre anyway."""
    blocks = list(center_blocks(centers))
    return np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])


def nearest_in_block(ids: np.ndarray, matrix: np.ndarray) -> Callable[[Column], Column]:
    @F.pandas_udf("struct<d2:double,cluster:int>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        if len(vectors) == 0:
            return pd.DataFrame({"d2": pd.Series(dtype=float), "cluster": pd.Series(dtype="int32")})
        d2 = np.round(squared_distances(to_matrix(vectors), matrix), 9)
        best = d2.argmin(axis=1)
        return pd.DataFrame(
            {"d2": d2[np.arange(len(best)), best], "cluster": ids[best].astype("int32")}
        )

    return nearest


def nearest_center(points: DataFrame, centers: DataFrame, vec: str = "vec") -> DataFrame:
    """Adds the nearest centre and its squared distance; ties go to the lowest id."""
    found = [
        nearest_in_block(ids, matrix)(F.col(vec)) for ids, matrix in center_blocks(centers)
    ]
    best = found[0] if len(found) == 1 else F.least(*found)
    return (
        points.withColumn("_best", best)
        .withColumn("cluster", F.col("_best.cluster"))
        .withColumn("d2", F.col("_best.d2"))
        .drop("_best")
    )
