"""Row numbers, hashes and repetition that never need one task for a whole group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tripleloom.session import cut_lineage

CHUNK = 100_000
GROUP_LIMIT = 1000


def hash_int(*parts: Column | str) -> Column:
    """A 60-bit integer from an MD5 of the parts: the same on every engine and every run."""
    text = F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


def hash_unit(*parts: Column | str) -> Column:
    """Uniform in [0, 1)."""
    return hash_int(*parts) / F.lit(float(1 << 60))


def range_count(df: DataFrame) -> int:
    """Ranges for a numbered order: a few per shuffle partition, within sane limits."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, min(4096, 2 * partitions))


def numbered(df: DataFrame, order: str, by: list[str] = (), name: str = "rn") -> DataFrame:
    """Exact ``row_number()`` by a unique order column, without a window over a whole group.

    The order is cut into ranges at a bounded sample of its values (the keys with
    the smallest hashes, so the cuts are the same on every run). Rows are
    numbered inside (group, range) and shifted by the sizes of the ranges before.
    The result does not depend on where the cuts fall.
    """
    ranges = range_count(df)
    step = math.isqrt(ranges)
    sample = (
        df.select(F.col(order).alias("_cut"))
        .orderBy(F.xxhash64("_cut"), "_cut")
        .limit(ranges - 1)
        .agg(F.array_sort(F.collect_list("_cut")).alias("_cuts"))
        .select(
            F.struct(
                "_cuts",
                F.filter("_cuts", lambda _, i: i % step == step - 1).alias("_coarse"),
            )
        )
    )

    def below(cuts: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c < F.col(order)))

    ranged = (
        df.select("*", sample.scalar().alias("_s"))
        .withColumn("_p", below(F.col("_s._coarse")) * step)
        .withColumn("_range", F.col("_p") + below(F.slice("_s._cuts", F.col("_p") + 1, step)))
        .drop("_s", "_p")
    )
    keys = [*by, "_range"]
    sizes = ranged.groupBy(*keys).agg(F.count("*").alias("_size"))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return (
        ranged.withColumn("_in", inside)
        .join(shifts, keys)
        .withColumn(name, F.col("_in") + F.col("_shift"))
        .drop("_in", "_shift", "_range")
    )


def placed(ordered: DataFrame, name: str = "place") -> DataFrame:
    """The place of every row of an ordered frame, from 1, in the order it really has.

    The rows are written in their order; a row's place is the rows of the partitions before plus its
    place in its own. One row per partition is all that crosses a shuffle.
    """
    marked = ordered.select("*", F.monotonically_increasing_id().alias("_id"))
    written = cut_lineage(marked, "ordered").withColumn("_part", F.shiftright("_id", 33))
    sizes = written.groupBy("_part").agg(F.count("*").alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return written.join(shifts, "_part").select(*ordered.columns, (inside + F.col("_shift") + 1).alias(name))


def repeat_rows(df: DataFrame, times: str, name: str = "i", chunk: int = CHUNK) -> DataFrame:
    """``times`` copies of each row numbered from 1, in bounded pieces spread over the tasks.

    The number of partitions is explicit, or adaptive execution would merge the few rows there are
    before they are repeated.
    """
    last = F.ceil(F.col(times) / chunk).cast("bigint")
    pieces = df.where(F.col(times) > 0).select(
        "*", F.explode(F.sequence(F.lit(1).cast("bigint"), last)).alias("_piece")
    )
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = pieces.repartition(partitions, *df.columns, "_piece")
    start = (F.col("_piece") - 1) * chunk + 1
    end = F.least(F.col("_piece") * chunk, F.col(times).cast("bigint"))
    return spread.select(*df.columns, F.explode(F.sequence(start, end)).alias(name))


def top_per_group(
    df: DataFrame, by: list[str], order: list[Column], n: int, salts: int = 32, name: str = "rn"
) -> DataFrame:
    """The first n rows of every group.

    For a small n the planner cuts every group before the shuffle. Beyond its
    limit the groups are cut in salted parts first, so a hot group never lands whole
    in one task.
    """
    window = W.partitionBy(*by).orderBy(*order)
    if n > GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        part = W.partitionBy(*by, "_salt").orderBy(*order)
        df = salted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n)
        df = df.drop("_rn", "_salt")
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
