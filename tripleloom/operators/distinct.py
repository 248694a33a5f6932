"""De-duplication and set operations with declared winners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tripleloom.functions.syntax import bind


def first_per_key(
    df: DataFrame, keys: list[str], order: list[str], payload: list[str] | None = None
) -> DataFrame:
    """One row per key: the one that comes first in the declared order.

    An aggregate instead of a numbered window, so that every task reduces a hot
    key to one candidate before the shuffle.
    """
    payload = payload if payload is not None else [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*payload), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in payload])


def distinct_pairs(df: DataFrame, order: list[str], payload: list[str] | None = None) -> DataFrame:
    """A hash leads the key: sorting then compares numbers instead of names that begin alike."""
    payload = payload if payload is not None else [c for c in df.columns if c not in ("subject", "object")]
    keyed = df.withColumn("_pair", F.xxhash64("subject", "object"))
    return first_per_key(keyed, ["_pair", "subject", "object"], order, payload).drop("_pair")


def distinct_triples(df: DataFrame, order: list[str], payload: list[str] | None = None) -> DataFrame:
    return first_per_key(df, ["subject", "relation", "object"], order, payload)


def distinct_structs(triples: Column) -> Column:
    """Whole-value distinct inside an array column."""
    return F.array_distinct(triples)


def drop_consecutive(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Drop a triple whose (object, subject) repeats the previous non-empty one of its sentence."""
    filled = df.where((F.col("object") != "") & (F.col("subject") != ""))
    window = W.partitionBy(*group).orderBy(*order)
    same = (F.lag("object").over(window) == F.col("object")) & (
        F.lag("subject").over(window) == F.col("subject")
    )
    return filled.withColumn("_same", F.coalesce(same, F.lit(False))).where("NOT _same").drop("_same")


def drop_consecutive_in_row(triples: Column) -> Column:
    """The same inside one sentence's array of triples."""
    filled = F.filter(triples, lambda t: (t["object"] != "") & (t["subject"] != ""))
    return bind(
        filled,
        lambda kept: F.filter(
            kept,
            lambda t, i: (i == 0)
            | (F.get(kept, i - 1)["object"] != t["object"])
            | (F.get(kept, i - 1)["subject"] != t["subject"]),
        ),
    )


def all_entities(df: DataFrame, subject: str, obj: str) -> DataFrame:
    """Distinct subjects and objects: both read in one scan."""
    return df.select(F.explode(F.array(subject, obj)).alias("entity")).distinct()


def unique_vectors(df: DataFrame, vec: str, key: str) -> DataFrame:
    """Unique vectors with the smallest id that carries them."""
    return df.groupBy(vec).agg(F.min(key).alias(key))


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys present on both sides, in numeric order."""
    return a.intersect(b).orderBy(F.col(a.columns[0]).cast("int"))


def union_parts(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
