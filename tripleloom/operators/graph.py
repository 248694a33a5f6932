"""Triple graph as node and edge tables, with pattern look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.operators.joins import contained_keys


def node_id(name: Column | str) -> Column:
    """Stable id of a node from its name. 128 bits: with 64, billions of names would collide."""
    return F.md5(name)


def build_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (subjects and objects, once each) and edges with type and probability.

    The id is a function of the name, so edges need no join with the nodes.
    """
    nodes = (
        triples.select(F.explode(F.array("subject", "object")).alias("name"))
        .distinct()
        .select(node_id("name").alias("id"), "name")
    )
    edges = triples.select(
        node_id("subject").alias("src"),
        node_id("object").alias("dst"),
        F.col("rel_type").alias("type"),
        "prob",
    )
    return nodes, edges


def graph_pattern(
    edges: DataFrame,
    subject: str | None = None,
    rel_type: str | None = None,
    obj: str | None = None,
) -> DataFrame:
    """Edges (subject, rel_type, object, prob) by any subset of bound values."""
    for column, value in (("subject", subject), ("rel_type", rel_type), ("object", obj)):
        if value is not None:
            edges = edges.where(F.col(column) == F.lit(value))
    return edges


def graph_patterns(edges: DataFrame, patterns: DataFrame, bound: list[str]) -> DataFrame:
    """The set form: one equi join on the bound columns."""
    return edges.join(patterns, bound)


def relation_triggers(questions: DataFrame, keywords: DataFrame) -> DataFrame:
    """Relation types with a keyword inside the lower-cased question, once each."""
    lowered = questions.withColumn("_q", F.lower("question"))
    keys = keywords.select(F.lower("keyword").alias("_k"), "rel_type").distinct()
    hits = contained_keys(lowered, "_q", keys, "_k")
    return hits.select(*questions.columns, "rel_type").distinct()


def execute_question(questions: DataFrame, edges: DataFrame, keywords: DataFrame) -> DataFrame:
    """Edges for each different (entity, triggered type): the entity as subject, then as object.

    Both roles share one equi join, on edges keyed by either end. Questions about one entity and
    type share its edges; ``relation_triggers`` says which question asks for which type.
    """
    asked = relation_triggers(questions, keywords).select("entity", "rel_type").distinct()
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("subject").alias("entity"), F.lit("subject").alias("role")),
                F.struct(F.col("object").alias("entity"), F.lit("object").alias("role")),
            )
        ),
        "subject", "rel_type", "object", "prob",
    )
    return asked.join(ends, ["entity", "rel_type"])
