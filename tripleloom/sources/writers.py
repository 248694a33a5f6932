"""Sinks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Columnar files of a bounded number of rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated, no header, without the bookkeeping columns that start with ``_``."""
    kept = [c for c in df.columns if not c.startswith("_")]
    df.select(*kept).write.mode("overwrite").csv(path, sep="\t", header=False, emptyValue="")


def write_annotations(df: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = 50_000) -> None:
    """One sentence per line, compressed; a compressed file is not split, so files hold a bounded number of sentences.

    The field names stand beside every token, so the plain text is many times the size of the words.
    """
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).json(path, compression="gzip")


def write_text_docs(df: DataFrame, path: str, text: str = "text") -> None:
    """Every text as a file of its own, ended by a newline. A null text is written as an empty one.

    A file costs far more than its bytes, so the texts are dealt evenly over the cores. In a mounted folder, where Spark's writer
    starts programs to set the rights of every file and of its checksum, the tasks write the files themselves. In any other
    store Spark's writer does, and every task puts its own files in place instead of leaving them to the driver, which moves them one by one.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(text, F.lit("")).alias("value"))
    spread = rows.repartition(4 * spark.sparkContext.defaultParallelism)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file":
        writer = spread.write.mode("overwrite").option("maxRecordsPerFile", 1)
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return
    store.delete(folder, True)
    store.mkdirs(folder)
    spread.mapInArrow(text_files(store.makeQualified(folder).toUri().getPath()), "files bigint").agg(F.sum("files")).collect()
    store.create(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")).close()


def text_files(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the texts of a task to numbered files and gives their number. A repeated task replaces its own files, whole ones only."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, n = TaskContext.get(), 0
        for batch in batches:
            for value in batch.column(0):
                name = f"part-{context.partitionId():05d}-{n:09d}.txt"
                own = os.path.join(folder, f".{name}.{context.taskAttemptId()}")
                with open(own, "wb") as file:
                    file.write(value.as_buffer())
                    file.write(b"\n")
                os.replace(own, os.path.join(folder, name))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    return write


def write_cluster_json(exported: DataFrame, path: str) -> None:
    """One single-entry JSON map per line and cluster."""
    line = F.concat(F.lit('{"'), F.col("cluster").cast("string"), F.lit('":'), "json", F.lit("}"))
    exported.select(line.alias("value")).write.mode("overwrite").text(path)


def write_word_vectors(df: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", "word", F.array_join(F.col("vec").cast("array<string>"), " "))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def append_report(df: DataFrame, path: str) -> None:
    """Metrics of one more model under the same report path."""
    df.write.mode("append").json(path)
