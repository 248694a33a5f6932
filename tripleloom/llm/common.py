"""Helpers shared by the training-data operators.

Every operator is an Arrow map over slices of a scan, or such a map followed by
joins and aggregates of its narrow output. The functions travel to the executors
by value (see ``tripleloom/__init__.py``), so no executor needs the package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE = 256
SPACES = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def map_slices(
    df: DataFrame,
    inputs: list[str],
    make: Callable[[], Callable[..., list[list]]],
    added: str,
    keep: list[str] | None = None,
    rows: int = SLICE,
) -> DataFrame:
    """``df``'s columns ``keep`` beside new ones, row by row.

    ``make()`` runs once per task and gives a function of the input columns, as
    lists of at most ``rows`` values, that returns one list per column of
    ``added`` (a DDL string). Only ``keep`` and ``inputs`` are read. A kept column
    with the name of a new one is replaced by it.
    """
    new = StructType.fromDDL(added)
    replaced = {f.name.lower() for f in new.fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in replaced]
    schema = StructType([df.schema[c] for c in keep] + new.fields)
    arrow = to_arrow_schema(schema)
    places = {c: i for i, c in enumerate(dict.fromkeys([*keep, *inputs]))}
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                out = work(*[part.column(places[c]).to_pylist() for c in inputs])
                kept = [part.column(i).cast(arrow.field(i).type) for i in range(k)]
                made = [pa.array(x, arrow.field(k + j).type) for j, x in enumerate(out)]
                yield pa.RecordBatch.from_arrays(kept + made, schema=arrow)

    chosen = [F.col(f"`{c}`") for c in places]
    return df.select(*chosen).mapInArrow(run, schema)


def explode_slices(
    df: DataFrame,
    inputs: list[str],
    make: Callable[[], Callable[..., list[list]]],
    schema: str,
    rows: int = SLICE,
) -> DataFrame:
    """As ``map_slices``, but any number of rows may come out of a slice."""
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                out = work(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, arrow.field(j).type) for j, x in enumerate(out)], schema=arrow
                )

    return df.select(*[F.col(f"`{c}`") for c in inputs]).mapInArrow(run, fields)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null for null."""
    return F.crc32(F.col(f"`{column}`").cast("string").cast("binary")) % modulus


def sampled_labels(labels: DataFrame, label: str, keep: Column, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids, each with one label, chosen by hash.

    Rows without id or label are left out; an id with several labels takes the largest.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(limit)
    )


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int) -> DataFrame:
    """``text`` and ``label`` of the sampled rows. The sample is bounded by ``limit``, so its ids are broadcast."""
    ids = sampled_labels(labels, label, keep, limit)
    return documents.select("doc_id", "text").join(
        F.broadcast(ids), F.col("doc_id") == F.col("label_id")
    ).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last one is the intercept.

    ``ridge`` keeps separable or constant labels finite.
    """
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        g = a.T @ (p - y) / max(1, len(y)) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a / max(1, len(y)) + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-9:
            break
    return w
