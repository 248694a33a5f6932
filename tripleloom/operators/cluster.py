"""Clustering steps and loops.

Per-row results use Arrow batches with the centres in the task closure; what a
step needs from all rows is a sum per centre, added up inside each task first.
The driver only ever holds centres (k rows).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tripleloom.operators.aggregates import as_vector, column_sum
from tripleloom.operators.dense import (
    center_matrix,
    nearest_center,
    squared_distances,
    to_matrix,
)
from tripleloom.operators.distinct import unique_vectors
from tripleloom.operators.many_models import best_of, fit_many, fit_mixture, matrix_of
from tripleloom.session import cut_lineage


BLOCK_ROWS = 4096  # rows that a task works on at once
DIRECT = 256  # tasks whose shares the driver adds itself


def centers_frame(spark: SparkSession, ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
    rows = [(int(i), [float(x) for x in row]) for i, row in zip(ids, matrix)]
    return spark.createDataFrame(rows, "center_id int, center array<double>")


# --- soft assignment and self-training targets -------------------------------------------


def student_t(rows: np.ndarray, centers: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Row-normalised Student-t similarity and the inverse distance factor."""
    inverse = 1.0 / (1.0 + squared_distances(rows, centers) / alpha)
    q = inverse ** ((alpha + 1.0) / 2.0)
    return q / q.sum(axis=1, keepdims=True), inverse


def target(q: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    weight = q * q / frequency
    return weight / weight.sum(axis=1, keepdims=True)


def soft_assign(
    points: DataFrame, centers: DataFrame, vec: str = "vec", alpha: float = 1.0
) -> DataFrame:
    """Adds ``q``: similarity to each centre in id order, summing to one."""
    _, matrix = center_matrix(centers)

    @F.pandas_udf("array<double>")
    def similarity(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series(dtype=object)
        return pd.Series(list(student_t(to_matrix(vectors), matrix, alpha)[0]))

    return points.withColumn("q", similarity(F.col(vec)))


def target_distribution(df: DataFrame, q: str = "q") -> DataFrame:
    """Adds ``p``: squared similarity over the column sum, normalised per row."""
    sums = column_sum(df, q).select("total").scalar()
    weighted = df.select("*", sums.alias("_f")).withColumn(
        "_w", F.zip_with(q, "_f", lambda a, f: a * a / f)
    )
    total = F.aggregate("_w", F.lit(0.0), lambda acc, w: acc + w)
    return (
        weighted.withColumn("_s", total)
        .withColumn("p", F.transform("_w", lambda w: w / F.col("_s")))
        .drop("_f", "_w", "_s")
    )


def kl_rows(p: Column | str, q: Column | str) -> Column:
    terms = F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def kl_loss(df: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    return df.agg(F.avg(kl_rows(p, q)).alias("kl"))


def hard_assign(q: Column | str) -> Column:
    """Position of the largest value, the first one on ties."""
    q = F.col(q) if isinstance(q, str) else q
    return (F.array_position(q, F.array_max(q)) - 1).cast("int")


def own_distance(points: DataFrame, centers: DataFrame, vec: str = "vec", cluster: str = "cluster") -> DataFrame:
    """Adds ``dist``, the distance of each row to its own centre."""
    ids, matrix = center_matrix(centers)
    position = {int(c): i for i, c in enumerate(ids)}

    @F.pandas_udf("double")
    def distance(vectors: pd.Series, clusters: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series(dtype=float)
        own = matrix[[position[int(c)] for c in clusters]]
        return pd.Series(np.sqrt(((to_matrix(vectors) - own) ** 2).sum(axis=1)))

    return points.withColumn("dist", distance(F.col(vec), F.col(cluster)))


def closeness(
    points: DataFrame, centers: DataFrame, vec: str = "vec", cluster: str = "cluster", invert: bool = True
) -> DataFrame:
    """Adds ``score`` = 1 - d / max(d) in the latent space; d / max(d) for mixtures."""
    measured = own_distance(points, centers, vec, cluster)
    top = measured.agg(F.max("dist")).scalar()
    share = F.when(F.col("_top") > 0, F.col("dist") / F.col("_top")).otherwise(0.0)
    return (
        measured.select("*", top.alias("_top"))
        .withColumn("score", 1.0 - share if invert else share)
        .drop("_top")
    )


def label_change(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Fraction of rows whose cluster changed."""
    both = old.select(key, F.col("cluster").alias("_old")).join(
        new.select(key, F.col("cluster").alias("_new")), key
    )
    return both.agg(F.avg((F.col("_old") != F.col("_new")).cast("double")).alias("changed"))


# --- sums per centre ----------------------------------------------------------------------


def packed(points: DataFrame, vec: str) -> DataFrame:
    """The vectors alone, in binary blocks of at most ``BLOCK_ROWS`` rows: a loop then reads blocks instead of taking every
    row apart in every round. Rows without a vector are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                rows = matrix_of(batch.slice(at, BLOCK_ROWS).column(0))
                columns = [pa.array([rows.shape[1]], pa.int32()), pa.array([rows.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["_width", vec])

    return points.where(F.col(vec).isNotNull()).select(vec).mapInArrow(run, f"_width int, `{vec}` binary")


def kept(points: DataFrame, vec: str) -> DataFrame:
    """The ``packed`` vectors for the rounds of a loop: the tasks keep the blocks in the form that Python reads. ``.rdd.unpersist()`` frees them."""
    blocks = packed(points, vec)
    blocks.rdd.persist(StorageLevel.MEMORY_AND_DISK)
    return blocks


def center_sums(
    points: DataFrame, vec: str, step: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, float]], k: int
) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Adds up (k x d sums, k counts, one scalar) over all rows, given as vectors or ``packed``.

    ``step`` maps a block of rows to its share. Each task adds its blocks first. A round is one job without a plan or a shuffle: the
    driver adds one share of k x d numbers per task; beyond ``DIRECT`` tasks, tasks add up the shares of others before.
    """
    blocks = points if isinstance(points.schema[vec].dataType, BinaryType) else packed(points, vec)

    def add(a: tuple, b: tuple) -> tuple:
        return tuple(x + y for x, y in zip(a, b))

    def partial(rows: Iterator[tuple]) -> Iterator[tuple]:
        total = None
        for width, block in rows:
            matrix = np.frombuffer(block, dtype=np.float64).reshape(-1, width)
            share = (*step(matrix), len(matrix))
            total = share if total is None else add(total, share)
        if total is not None:
            yield total

    shares = blocks.rdd.mapPartitions(partial)
    found = shares.collect() if shares.getNumPartitions() <= DIRECT else [shares.treeReduce(add)]
    return reduce(add, found, (np.zeros((k, 1)), np.zeros(k), 0.0, 0))


def frequency(points: DataFrame, vec: str, matrix: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Column sums of the soft assignment."""

    def step(rows: np.ndarray):
        q, _ = student_t(rows, matrix, alpha)
        return np.zeros((len(matrix), 1)), q.sum(axis=0), 0.0

    return center_sums(points, vec, step, len(matrix))[1]


def refine_step(
    points: DataFrame, vec: str, matrix: np.ndarray, anchor: np.ndarray, freq: np.ndarray, alpha: float = 1.0
) -> tuple[np.ndarray, float, int]:
    """Direction of every centre (minus the gradient of the summed KL), the mean KL and the row count.

    The targets come from the centres of the last refresh (``anchor``, ``freq``) and are
    recomputed from the row, so they need no storage.
    """

    def step(rows: np.ndarray):
        p = target(student_t(rows, anchor, alpha)[0], freq)
        q, inverse = student_t(rows, matrix, alpha)
        pull = (alpha + 1.0) / alpha * (p - q) * inverse
        direction = pull.T @ rows - pull.sum(axis=0)[:, None] * matrix
        kl = float((p * np.log(np.maximum(p, 1e-300) / q)).sum())
        return direction, np.zeros(len(matrix)), kl

    direction, _, kl, n = center_sums(points, vec, step, len(matrix))
    return direction, kl / n, n


def refine_centers(
    points: DataFrame,
    centers: DataFrame,
    vec: str = "vec",
    iters: int = 300,
    update_interval: int = 140,
    tol: float = -1.0,
    rate: float = 1.0,
    alpha: float = 1.0,
) -> tuple[DataFrame, list[float]]:
    """Self-training: targets from the soft assignment, centres moved along the KL gradient.

    Returns the centres and the mean KL of each iteration. At a target refresh the share
    of changed labels is compared with ``tol``; a negative one never stops early.
    """
    points = kept(points, vec)
    ids, matrix = center_matrix(centers)
    anchor, freq, history = matrix, None, []
    for i in range(iters):
        if i % update_interval == 0:
            if freq is not None and _changed(points, vec, anchor, matrix) < tol:
                break
            anchor, freq = matrix, frequency(points, vec, matrix, alpha)
        direction, kl, n = refine_step(points, vec, matrix, anchor, freq, alpha)
        history.append(kl)
        matrix = matrix + rate * direction / n
    points.rdd.unpersist()
    return centers_frame(points.sparkSession, ids, matrix), history


def _changed(points: DataFrame, vec: str, old: np.ndarray, new: np.ndarray) -> float:
    def step(rows: np.ndarray):
        moved = squared_distances(rows, old).argmin(axis=1) != squared_distances(rows, new).argmin(axis=1)
        return np.zeros((1, 1)), np.zeros(1), float(moved.sum())

    _, _, moved, n = center_sums(points, vec, step, 1)
    return moved / n


def lloyd_step(points: DataFrame, vec: str, matrix: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, float]:
    """New centres (means of the members; an empty one stays) and the share of changed labels."""

    def step(rows: np.ndarray):
        now = np.round(squared_distances(rows, matrix), 9).argmin(axis=1)
        member = np.zeros((len(rows), len(matrix)))
        member[np.arange(len(rows)), now] = 1.0
        moved = float(len(rows))
        if before is not None:
            last = np.round(squared_distances(rows, before), 9).argmin(axis=1)
            moved = float((now != last).sum())
        return member.T @ rows, member.sum(axis=0), moved

    sums, counts, moved, n = center_sums(points, vec, step, len(matrix))
    means = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1.0)[:, None], matrix)
    return means, moved / n


def alternate_kmeans(
    points: DataFrame, centers: DataFrame, vec: str = "vec", max_epochs: int = 20, tol: float = 1e-3
) -> tuple[DataFrame, DataFrame]:
    """Assign, move, repeat until few labels change. Returns (rows with cluster, centres)."""
    blocks = kept(points, vec)
    ids, matrix = center_matrix(centers)
    before = None
    for _ in range(max_epochs):
        means, changed = lloyd_step(blocks, vec, matrix, before)
        if before is not None and changed < tol:
            break
        before, matrix = matrix, means
    found = centers_frame(points.sparkSession, ids, matrix)
    blocks.rdd.unpersist()
    return nearest_center(points, found, vec), found


def admm_update(
    state: DataFrame, ids: np.ndarray, matrix: np.ndarray, lam: float = 0.1, rho: float = 1.0
) -> DataFrame:
    """Row update: y = (lambda c + rho (f - u)) / (lambda + rho), then u += y - f."""
    position = {int(c): i for i, c in enumerate(ids)}

    @F.pandas_udf("struct<y:array<double>,u:array<double>>")
    def update(f: pd.Series, u: pd.Series, cluster: pd.Series) -> pd.DataFrame:
        if len(f) == 0:
            return pd.DataFrame({"y": pd.Series(dtype=object), "u": pd.Series(dtype=object)})
        own = matrix[[position[int(c)] for c in cluster]]
        fm, um = to_matrix(f), to_matrix(u)
        y = (lam * own + rho * (fm - um)) / (lam + rho)
        return pd.DataFrame({"y": list(y), "u": list(um + y - fm)})

    return state.withColumn("_s", update("f", "u", "cluster")).withColumn("y", F.col("_s.y")).withColumn(
        "u", F.col("_s.u")
    ).drop("_s")


def admm_centers(state: DataFrame, ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Mean of y over the members of each centre; an empty one stays."""
    means = state.groupBy("cluster").agg(
        vector_to_array(Summarizer.mean(as_vector("y"))).alias("m")
    ).collect()
    found = {r["cluster"]: np.array(r["m"]) for r in means}
    return np.stack([found.get(int(c), matrix[i]) for i, c in enumerate(ids)])


def admm_kmeans(
    points: DataFrame, centers: DataFrame, vec: str = "vec", lam: float = 0.1, rho: float = 1.0,
    max_epochs: int = 20, tol: float = 1e-3, checkpoint_every: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """Alternating directions: row state (y, u), centres as means of y, reassignment by y.

    The state is kept between epochs and its lineage cut by a reliable checkpoint.
    """
    ids, matrix = center_matrix(centers)
    start = nearest_center(points.withColumnRenamed(vec, "f"), centers, "f").drop("d2")
    zero = F.transform("f", lambda _: F.lit(0.0))
    state = start.withColumn("f", F.col("f").cast("array<double>")).withColumn("u", zero).withColumn(
        "y", zero
    ).persist()
    for epoch in range(1, max_epochs + 1):
        moved = admm_update(state, ids, matrix, lam, rho).persist()
        matrix = admm_centers(moved, ids, matrix)
        again = nearest_center(
            moved.withColumnRenamed("cluster", "_old"),
            centers_frame(points.sparkSession, ids, matrix), "y",
        ).drop("d2")
        again = cut_lineage(again) if epoch % checkpoint_every == 0 else again.persist()
        changed = again.agg(F.avg((F.col("cluster") != F.col("_old")).cast("double"))).first()[0]
        state.unpersist()
        moved.unpersist()
        state = again.drop("_old")
        if epoch > 1 and changed < tol:
            break
    return state, centers_frame(points.sparkSession, ids, matrix)


# --- models of the standard library -------------------------------------------------------


def kmeans(df: DataFrame, k: int, vec: str = "vec", n_init: int = 10, seed: int = 42) -> KMeansModel:
    """Best of several starts by training cost."""
    data = df.select(as_vector(vec).alias("features")).persist()
    models = [
        KMeans(k=k, seed=seed + i, initMode="k-means||", featuresCol="features").fit(data)
        for i in range(n_init)
    ]
    data.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost)


def model_centers(spark: SparkSession, model: KMeansModel) -> DataFrame:
    matrix = np.array(model.clusterCenters())
    return centers_frame(spark, np.arange(len(matrix)), matrix)


def kmeans_labels(df: DataFrame, model: KMeansModel, vec: str = "vec") -> DataFrame:
    labelled = df.withColumn(model.getFeaturesCol(), as_vector(vec))
    return model.transform(labelled).withColumnRenamed("prediction", "cluster").drop("features")


def gmm(df: DataFrame, k: int, vec: str = "vec", n_init: int = 5, seed: int = 42) -> DataFrame:
    """Means of a Gaussian mixture, the best of ``n_init`` fits, as centres."""
    data = cut_lineage(df.select(vec), "mixture")
    fitted, _ = fit_mixture(data, k, vec, n_init, seed)
    return centers_frame(df.sparkSession, np.arange(len(fitted.means)), fitted.means)


def fit_latent(df: DataFrame, d: int, vec: str = "vec") -> PCAModel:
    """Principal components, the optimum of a linear autoencoder."""
    data = df.select(as_vector(vec).alias("_features"))
    return PCA(k=d, inputCol="_features", outputCol="_code").fit(data)


def encode(model: PCAModel, df: DataFrame, vec: str = "vec", out: str = "latent") -> DataFrame:
    coded = model.transform(df.withColumn("_features", as_vector(vec)))
    return coded.withColumn(out, vector_to_array("_code")).drop("_features", "_code")


def latent(df: DataFrame, d: int, vec: str = "vec", out: str = "latent") -> DataFrame:
    """Low-dimensional code of a vector. A precomputed code column can take its place anywhere."""
    return encode(fit_latent(df, d, vec), df, vec, out)


def standard_stats(df: DataFrame, vec: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation of every position."""
    row = df.select(as_vector(vec).alias("_v")).agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")
    ).select("s.mean", "s.variance", "s.count").first()
    n = row["count"]
    variance = row["variance"].toArray() * ((n - 1) / n if n else 0.0)
    return row["mean"].toArray(), np.sqrt(variance)


def standardize(df: DataFrame, fitted_on: DataFrame | None = None, vec: str = "vec", out: str = "scaled") -> DataFrame:
    """Zero mean and unit variance per position; a constant position becomes 0."""
    mean, std = standard_stats(fitted_on if fitted_on is not None else df, vec)
    scale = np.where(std > 1e-12, std, 1.0)

    @F.pandas_udf("array<double>")
    def scaled(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series(dtype=object)
        return pd.Series(list((to_matrix(vectors) - mean) / scale))

    return df.withColumn(out, scaled(F.col(vec)))


def partial_init(
    df: DataFrame, part: str, subject: str = "subject_matr", relation: str = "relation_matr", obj: str = "object_matr"
) -> DataFrame:
    """Vectors for the start centres only: relation at its mean, or arguments at zero."""
    if part == "predicate":
        mean = df.select(as_vector(relation).alias("_v")).agg(
            vector_to_array(Summarizer.mean(F.col("_v")))
        )
        return df.select(*[c for c in df.columns if c != relation], mean.scalar().alias(relation))
    zeros = {c: F.array_repeat(F.lit(0.0), F.size(c)) for c in (subject, obj)}
    return df.withColumns(zeros)


def jitter(df: DataFrame, vec: str, key: str, sigma: float = 1e-6, seed: int = 42) -> DataFrame:
    """Adds a little normal noise that depends on the key only."""

    def unit(i: Column, side: int) -> Column:
        bits = F.pmod(F.xxhash64(F.col(key), i, F.lit(side), F.lit(seed)), F.lit(1 << 30))
        return (bits + 1) / F.lit(float((1 << 30) + 1))

    def noise(i: Column) -> Column:
        return F.sqrt(-2.0 * F.log(unit(i, 0))) * F.cos(2.0 * math.pi * unit(i, 1))

    return df.withColumn(vec, F.transform(vec, lambda x, i: x + sigma * noise(i)))


def init_centers(
    df: DataFrame, k: int, vec: str = "vec", key: str = "vec_id", n_init: int = 10, seed: int = 42
) -> DataFrame:
    """Unique rows, noise, then the centres of the best k-means start; all starts move in one scan per round."""
    unique = unique_vectors(df.select(key, F.col(vec).cast("array<double>").alias(vec)), vec, key)
    noisy = cut_lineage(jitter(unique, vec, key, seed=seed).select(vec), "starts")
    (best,) = best_of(fit_many(noisy, [k], vec, seeds=n_init, seed=seed))
    return centers_frame(df.sparkSession, np.arange(len(best.centers)), best.centers)


def seed_centers(centers: DataFrame, labelled: DataFrame, vec: str, order: str) -> DataFrame:
    """Centres 1..m replaced by the first labelled example of each seed group."""
    firsts = labelled.where(F.col("label") > 0).groupBy(F.col("label").alias("center_id")).agg(
        F.min_by(F.col(vec).cast("array<double>"), order).alias("_seed")
    )
    return centers.join(firsts, "center_id", "left").select(
        "center_id", F.coalesce("_seed", F.col("center").cast("array<double>")).alias("center")
    )


def seed_agreement(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """Share of same-label pairs of seeds that fell into one cluster, from counts only."""
    cells = df.where(F.col(label) > 0).groupBy(label, cluster).agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2.0
    rows = cells.groupBy(label).agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("together"))
    return rows.agg(
        F.sum("together").alias("together"),
        F.sum(pairs(F.col("n"))).alias("pairs"),
    ).withColumn("agreement", F.try_divide("together", "pairs"))


def supervised_loss(df: DataFrame, p: str = "p", q: str = "q", label: str = "label") -> DataFrame:
    """0.7 x squared error of the seeds to their one-hot label + 0.3 x KL of the rest."""
    is_seed = F.col(label) > 0
    errors = F.transform(
        q, lambda x, i: F.pow(x - F.when(i == F.col(label), 1.0).otherwise(0.0), F.lit(2.0))
    )
    mse = F.aggregate(errors, F.lit(0.0), lambda acc, x: acc + x) / F.size(q)
    return df.agg(
        F.avg(F.when(is_seed, mse)).alias("mse"),
        F.avg(F.when(~is_seed, kl_rows(p, q))).alias("kl"),
    ).withColumn("loss", 0.7 * F.col("mse") + 0.3 * F.col("kl"))
