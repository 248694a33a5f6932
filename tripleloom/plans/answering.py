"""Question answering end to end: gold pairs, predicted clusters, entities, answers, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.text import norm_key
from tripleloom.operators import aggregates, classify, filters, joins, qa
from tripleloom.operators.distinct import distinct_pairs
from tripleloom.session import cut_lineage


def normalized_gold(gold: DataFrame) -> DataFrame:
    return gold.select(
        "*",
        norm_key(F.col("subject_decoded")).alias("_subject"),
        norm_key(F.col("object_decoded")).alias("_object"),
    )


def normalized_triples(triples: DataFrame, order: list[str]) -> DataFrame:
    """Triples under their normalised keys, one per (subject, object)."""
    keyed = triples.withColumns(
        {c: norm_key(F.col(c)) for c in ("subject", "relation", "object")}
    )
    return distinct_pairs(keyed, order, ["relation", "score", "cluster"])


def gold_with_cluster(gold: DataFrame, triples: DataFrame) -> DataFrame:
    """Gold questions that have a cluster, with it."""
    return filters.with_cluster(joins.cluster_for_gold(normalized_gold(gold), triples))


def predict_by_classifier(matched: DataFrame, train_part: str = "train") -> DataFrame:
    """``pred`` is the cluster that a count classifier predicts from the question's text.

    It learns from the training part, where a question's label is the most frequent cluster of its property.
    """
    train = matched.where(F.col("part") == train_part)
    mapping = aggregates.property_to_cluster_max(train)
    labelled = aggregates.assign_clusters(train, mapping).select(
        "question", F.col("assigned_cluster").cast("int").alias("label")
    )
    best = classify.question_classifier_nb(classify.train_counts(labelled), matched)
    return matched.join(best.select("question", "pred").hint("merge"), "question")


def with_entity(questions: DataFrame) -> DataFrame:
    """Questions with the entity they mention, without those that mention none."""
    return filters.answerable(named_entity(questions))


def named_entity(questions: DataFrame) -> DataFrame:
    """All questions with the entity they mention, empty where they mention none."""
    entity = qa.question_entity(
        F.col("question"), F.col("subject_decoded"), F.col("object_decoded")
    )
    return questions.withColumn("entity", entity)


def question_table(gold: DataFrame, triples: DataFrame) -> DataFrame:
    """One row per answerable gold question, scored.

    The matched questions serve twice, for the classifier and for the answers. They are written with their entities: a
    filter on a computed column computes it again. The predictions are written before the answers are looked up, so that
    the shuffles of the two steps never lie on disk together.
    """
    matched = cut_lineage(named_entity(gold_with_cluster(gold, triples)), "matched")
    asked = cut_lineage(filters.answerable(predict_by_classifier(matched)), "asked")
    return qa.score_answers(asked, triples)
