"""Counts, profiles and cluster maps."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.text import format_triple
from tripleloom.operators.numbering import hash_int
from tripleloom.operators.windows import top_per_cluster


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    if n is None:
        return counts
    return counts.orderBy(F.col("n").desc(), col).limit(n)


def most_common_triples(df: DataFrame, n: int = 100) -> DataFrame:
    """Most frequent formatted triples, with the number of different ones."""
    text = df.select(
        format_triple(F.col("subject"), F.col("relation"), F.col("object"), F.col("score")).alias(
            "triple"
        )
    )
    counts = value_counts(text, "triple")
    return (
        counts.orderBy(F.col("n").desc(), "triple")
        .limit(n)
        .select("*", counts.agg(F.count("*")).scalar().alias("n_unique"))
    )


def property_to_cluster_max(matched: DataFrame) -> DataFrame:
    """Most frequent cluster of each property; the smallest id wins a tie."""
    counts = matched.groupBy("property_decoded", "cluster").agg(F.count("*").alias("n"))
    return counts.groupBy("property_decoded").agg(
        F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster"))).cast("string").alias("assigned")
    )


def property_to_cluster_random(matched: DataFrame, seed: int = 42) -> DataFrame:
    """One of the clusters of each property, by a seeded hash."""
    order = F.struct(
        hash_int(F.col("cluster").cast("string"), "property_decoded", F.lit(str(seed))), F.col("cluster")
    )
    return matched.groupBy("property_decoded").agg(
        F.min_by("cluster", order).cast("string").alias("assigned")
    )


def property_to_cluster_multi(matched: DataFrame) -> DataFrame:
    """All clusters of each property, space-joined (at most one entry per cluster)."""
    return matched.groupBy("property_decoded").agg(
        F.array_join(F.array_sort(F.collect_set("cluster")).cast("array<string>"), " ").alias("assigned")
    )


def assign_clusters(split: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cluster of each question's property; -1 where there is none."""
    return split.join(mapping, "property_decoded", "left").withColumn(
        "assigned_cluster", F.coalesce("assigned", F.lit("-1"))
    ).drop("assigned")


def cluster_profile(df: DataFrame) -> DataFrame:
    """Size and number of different relations per cluster, with the number of clusters."""
    profile = df.groupBy("cluster").agg(
        F.count("*").alias("n"), F.countDistinct("relation").alias("n_relations")
    )
    return profile.select(
        "*", df.select("cluster").distinct().agg(F.count("*")).scalar().alias("n_clusters")
    )


def score_histogram(df: DataFrame, bins: int, lo: float, hi: float) -> DataFrame:
    """Rows per equal-width bin of [lo, hi]; both ends take what lies outside."""
    raw = F.floor((F.col("score") - lo) / ((hi - lo) / bins))
    clipped = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(clipped.alias("bin")).agg(F.count("*").alias("n"))


def retention_report(before: DataFrame, after: DataFrame, by: str = "part") -> DataFrame:
    """Rows before and after, per split, and the percentage kept: one aggregate over both."""
    tagged = before.select(by, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select(by, F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    counts = tagged.groupBy(by).agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))
    return counts.withColumn(
        "percent_kept", F.round(F.try_divide(100.0 * F.col("n_after"), F.col("n_before")), 6)
    )


def as_vector(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return array_to_vector(col.cast("array<double>"))


def column_mean(df: DataFrame, vec: str = "vec", by: list[str] = ()) -> DataFrame:
    """Mean vector, overall or per group: partial sums of whole vectors in every task."""
    mean = vector_to_array(Summarizer.mean(F.col("_v"))).alias("mean")
    return df.withColumn("_v", as_vector(vec)).groupBy(*by).agg(mean)


def column_sum(df: DataFrame, vec: str, by: list[str] = ()) -> DataFrame:
    total = vector_to_array(Summarizer.sum(F.col("_v"))).alias("total")
    return df.withColumn("_v", as_vector(vec)).groupBy(*by).agg(total)


def predicate_counts(df: DataFrame) -> DataFrame:
    """Rows per (cluster, relation). Long form, as a cluster may have any number of relations."""
    return df.groupBy("cluster", "relation").agg(F.count("*").alias("n"))


def export_cluster_json(df: DataFrame, n: int = 999) -> DataFrame:
    """One JSON value per cluster: its best n rows and the relation counts among them.

    Groups are cut to n rows before they are collected.
    """
    top = top_per_cluster(df, n)
    item = F.struct("rn", "subject", "relation", "object", "score")
    per_cluster = top.groupBy("cluster").agg(F.array_sort(F.collect_list(item)).alias("items"))
    relations = F.array_sort(F.array_distinct(F.transform("items", lambda t: t["relation"])))
    predicates = F.map_from_arrays(
        relations,
        F.transform(
            relations, lambda r: F.size(F.filter("items", lambda t: t["relation"] == r)).cast("bigint")
        ),
    )
    rows = F.transform(
        "items",
        lambda t: F.concat(
            F.lit("["),
            F.array_join(
                F.transform(
                    F.array(t["subject"], t["relation"], t["object"]),
                    lambda s: F.concat(F.lit('"'), _json_escape(s), F.lit('"')),
                ),
                ",",
            ),
            F.lit(","),
            t["score"].cast("string"),
            F.lit("]"),
        ),
    )
    return per_cluster.select(
        "cluster",
        F.concat(
            F.lit('{"data":['),
            F.array_join(rows, ","),
            F.lit('],"predicates":'),
            F.to_json(predicates),
            F.lit("}"),
        ).alias("json"),
    )


def _json_escape(col: Column) -> Column:
    """Text as the inside of a JSON string, by way of the JSON writer."""
    quoted = F.to_json(F.struct(col.alias("s")))
    return F.substr(quoted, F.lit(7), F.length(quoted) - 8)
