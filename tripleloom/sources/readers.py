"""Sources. Schemas are declared; file names come from the scan's own metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom import schemas


TASK_SPLITS = 32
TASK_BYTES = 128 << 20


def _stem(name: str) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def read_text_docs(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """One row per text file: (doc_id, text); in name order on request, which sorts all texts.

    A scan gives every few small files a task of their own, and starting it costs more than reading them: a task reads
    more of them one after the other, up to ``TASK_BYTES``.
    """
    docs = spark.read.text(path, wholetext=True).select(
        _stem("_metadata.file_name").alias("doc_id"), F.col("value").alias("text")
    )
    splits, size = docs.rdd.getNumPartitions(), int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(4 * spark.sparkContext.defaultParallelism, splits // TASK_SPLITS, size // TASK_BYTES)
    docs = docs.coalesce(tasks) if splits > tasks else docs
    return docs.orderBy("doc_id") if ordered else docs


def read_annotations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Annotated sentences; each file is one document. Adds doc_id and sentence_id.

    With ``multi_line`` a file is one JSON array of sentences (the annotator's
    form); without it there is one sentence per line, which splits within large files.
    """
    rows = spark.read.schema(schemas.SENTENCE).json(path, multiLine=multi_line)
    return rows.select(_stem("_metadata.file_name").alias("doc_id"), *schemas.SENTENCE_FIELDS)


def read_gold(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Train, valid and test CSV files as one table with a ``part`` column."""
    parts = [
        spark.read.csv(path, header=True, enforceSchema=False, schema=schemas.GOLD, escape='"', multiLine=True)
        .withColumn("part", F.lit(part))
        for part, path in paths.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_cluster_json(spark: SparkSession, path: str, wholetext: bool = False) -> DataFrame:
    """Cluster dump to rows (cluster, rank, subject, relation, object, score).

    Accepts one JSON map for all clusters or one single-entry map per line.
    """
    raw = spark.read.text(path, wholetext=wholetext)
    parsed = raw.select(F.from_json("value", schemas.CLUSTER_DUMP).alias("m"))
    clusters = parsed.select(F.explode("m").alias("cluster", "body"))
    items = clusters.select("cluster", F.posexplode("body.data").alias("i", "t"))
    return items.select(
        F.col("cluster").cast("int").alias("cluster"),
        (F.col("i") + 1).alias("rank"),
        F.get("t", F.lit(0)).alias("subject"),
        F.get("t", F.lit(1)).alias("relation"),
        F.get("t", F.lit(2)).alias("object"),
        F.get("t", F.lit(3)).cast("double").alias("score"),
    )


def read_cluster_names(spark: SparkSession, path: str) -> DataFrame:
    """Cluster names with their raw example questions."""
    raw = spark.read.text(path, wholetext=True)
    return (
        raw.select(F.explode(F.from_json("value", schemas.CLUSTER_NAMES)).alias("cluster", "n"))
        .select(F.col("cluster").cast("int").alias("cluster"), "n.rel_type", "n.qa_examples")
    )


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word v1 v2 ...`` lines as (word, vec); a leading "count width" line is skipped."""
    parts = F.split(F.rtrim("value"), " ")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2)
    return rows.select(
        F.get("p", F.lit(0)).alias("word"),
        F.slice("p", F.lit(2), F.size("p") - 1).cast("array<float>").alias("vec"),
    )


def pending_only(inputs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(done.select(key), key, "left_anti")


def shard_inputs(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Adds the shard of each document, a stable hash of its id."""
    digest = F.substr(F.md5(F.col(key).cast("string")), F.lit(1), F.lit(8))
    return df.withColumn("shard", (F.conv(digest, 16, 10).cast("bigint") % n).cast("int"))


def filter_pages_by_category(
    pages: DataFrame, categories: DataFrame, key: str = "category", text: str = "text", min_len: int = 1
) -> DataFrame:
    """Pages of the listed categories with enough text."""
    return pages.where(F.length(text) >= min_len).join(
        categories.select(key).distinct(), key, "left_semi"
    )


def split_rejects(df: DataFrame, annotation: str = "annotation") -> tuple[DataFrame, DataFrame]:
    """(annotated, rejected) documents."""
    return df.where(F.col(annotation).isNotNull()), df.where(F.col(annotation).isNull())
