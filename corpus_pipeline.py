"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but
the last return the columns of ``documents``. ``run`` writes every stage as Parquet in the
shared folder and reads it again, so a lost executor costs a re-read at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm.common import fresh, table
from tripleloom.llm.decontaminate import drop_leaking
from tripleloom.llm.hilbert_pack import pack_table
from tripleloom.llm.quality_crf import THRESHOLD, fit_quality, score_quality, training_rows
from tripleloom.llm.secret_scan import redact_secrets
from tripleloom.llm.simhash_pivots import drop_near_duplicates
from tripleloom.session import cut_lineage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at or above its threshold."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), training_rows())
    (score,) = fresh(docs, "quality")
    scored = score_quality(docs, model, name=score)
    return scored.where(F.col(score) >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_first_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates."""
    return drop_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by a mark."""
    return redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return pack_table(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_first_of_copies),
    ("decontamination", keep_uncontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

# A chain model, fingerprints by XXH64, alignment and a tokenizer: beyond SQL. See tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, from ``documents`` to the pieces of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
