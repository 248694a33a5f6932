"""Session set-up and the one place that decides where checkpoints go."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "tripleloom", **conf: str) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be lost together with the executor that wrote it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tripleloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


PARTITIONS = "spark.sql.shuffle.partitions"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, name: str = "stage", partitions: int = 0) -> DataFrame:
    """The rows written once as a table in the shared folder and read back.

    A lost executor then costs a re-read instead of a re-run, and later steps read only the
    columns they use. (A checkpoint of an unpersisted frame would compute it twice.) While the rows are written, shuffles
    have at least so many ``partitions``, of which adaptive execution joins the small ones. Nothing reads those shuffles
    once the table is there, so their files are removed then instead of lying beside the later steps. The session's own settings are put back.
    """
    conf, path = df.sparkSession.conf, scratch_path(df.sparkSession, name)
    own = {key: conf.get(key) for key in (PARTITIONS, CLEANUP)}
    try:
        if partitions > int(own[PARTITIONS]):
            conf.set(PARTITIONS, str(partitions))
        conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        for key, value in own.items():
            conf.set(key, value)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, for written hand-over tables."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
