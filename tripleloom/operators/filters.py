"""Predicates on triples. Array forms work inside the sentence row and never shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.vocab import ANCHOR_STOP_RELATIONS, LIGHT_VERBS


def is_anchored(triple: Column, mentions: Column) -> Column:
    """Some entity mention equals the subject or the object."""
    return F.exists(
        mentions, lambda m: (m["text"] == triple["subject"]) | (m["text"] == triple["object"])
    )


def anchor_any(triples: Column, mentions: Column) -> Column:
    return F.filter(triples, lambda t: is_anchored(t, mentions))


def anchor_entity(
    triples: Column,
    mentions: Column,
    stop: list[str] = ANCHOR_STOP_RELATIONS,
    min_len: int = 2,
) -> Column:
    return F.filter(
        triples,
        lambda t: (F.length(t["relation"]) >= min_len)
        & ~t["relation"].isin(*stop)
        & is_anchored(t, mentions),
    )


def _width(span: Column) -> Column:
    return F.get(span, F.lit(1)) - F.get(span, F.lit(0))


def anchor_both(triples: Column, mentions: Column, max_span: int = 3) -> Column:
    """Short spans, one mention inside the subject and one inside the object, no repeats."""

    def keep(t: Column) -> Column:
        short = (
            (_width(t["subjectSpan"]) <= max_span)
            & (_width(t["relationSpan"]) <= max_span)
            & (_width(t["objectSpan"]) <= max_span)
        )
        return (
            short
            & F.exists(mentions, lambda m: F.contains(t["subject"], m["text"]))
            & F.exists(mentions, lambda m: F.contains(t["object"], m["text"]))
        )

    return F.array_distinct(F.filter(triples, keep))


def anchor_both_joined(
    triples: Column, mentions: Column, max_span: int = 3, max_rel: int = 13
) -> Column:
    """Subject and object contained in the text of all mentions joined by a space."""
    joined = F.array_join(F.transform(mentions, lambda m: m["text"]), " ")
    return F.filter(
        triples,
        lambda t: (_width(t["subjectSpan"]) <= max_span)
        & (_width(t["relationSpan"]) <= max_rel)
        & (_width(t["objectSpan"]) <= max_span)
        & F.contains(joined, t["subject"])
        & F.contains(joined, t["object"]),
    )


def anchor_entity_table(
    triples: DataFrame,
    mentions: DataFrame,
    stop: list[str] = ANCHOR_STOP_RELATIONS,
    min_len: int = 2,
) -> DataFrame:
    """The same for triples and mentions in separate tables, both keyed by (doc_id, sent).

    Both arguments are tried through one key column, so the test stays an equi
    join; every triple survives at most once.
    """
    kept = triples.where((F.length("relation") >= min_len) & ~F.col("relation").isin(*stop))
    keyed = kept.select("*", F.explode(F.array_distinct(F.array("subject", "object"))).alias("text"))
    hits = keyed.join(
        mentions.select("doc_id", "sent", "text"), ["doc_id", "sent", "text"], "left_semi"
    )
    return hits.drop("text").dropDuplicates()


def nonempty_sentences(df: DataFrame, triples: str = "openie") -> DataFrame:
    return df.where(F.size(triples) > 0)


def phrase_len(df: DataFrame, max_words: int = 4) -> DataFrame:
    def words(name: str) -> Column:
        return F.size(F.filter(F.split(name, r"[ \t\n]+"), lambda w: w != ""))

    return df.where(
        (words("subject") <= max_words)
        & (words("object") <= max_words)
        & (words("relation") <= max_words)
    )


def drop_pronoun_light_verb(
    df: DataFrame, pos_subj: str = "pos_subj", pos_obj: str = "pos_obj", relation: str = "relation"
) -> DataFrame:
    return df.where(
        (F.trim(pos_subj) != "PRP")
        & (F.trim(pos_obj) != "PRP")
        & ~F.lower(F.trim(relation)).isin(*LIGHT_VERBS)
    )


def drop_untyped_pairs(df: DataFrame, obj: str = "obj_type", subj: str = "subj_type") -> DataFrame:
    return df.where(~((F.col(obj) == "O") & (F.col(subj) == "O")))


def min_chars(df: DataFrame, n: int = 3, stop: list[str] = ()) -> DataFrame:
    kept = df.where(
        (F.length("subject") >= n) & (F.length("relation") >= n) & (F.length("object") >= n)
    )
    return kept.where(~F.lower(F.trim("relation")).isin(*stop)) if stop else kept


def span_len(df: DataFrame, max_tokens: int = 4) -> DataFrame:
    """Span widths, the meaning the original check on the pair's length was after."""
    return df.where(
        (F.col("subj_end") - F.col("subj_start") <= max_tokens)
        & (F.col("rel_end") - F.col("rel_start") <= max_tokens)
        & (F.col("obj_end") - F.col("obj_start") <= max_tokens)
    )


def drop_garbage_relation(df: DataFrame, stop: list[str] = ()) -> DataFrame:
    kept = df.where(~F.col("relation").rlike(r"^[0-9]+$"))
    return kept.where(~F.col("relation").isin(*stop)) if stop else kept


def drop_untagged(df: DataFrame, pos_subj: str, pos_rel: str, pos_obj: str) -> DataFrame:
    """All three tag sets must be non-empty; an argument counts only with a name or a number."""

    def named(tags: str) -> Column:
        parts = F.split(tags, "_")
        return F.array_contains(parts, "NNP") | F.array_contains(parts, "CD")

    return df.where(named(pos_subj) & named(pos_obj) & (F.col(pos_rel) != ""))


def complete_surface(docs: DataFrame, triples: str = "triples") -> DataFrame:
    """Triples with all three surface forms; documents left empty are dropped."""

    def filled(part: Column) -> Column:
        return F.coalesce(part["surfaceform"], F.lit("")) != ""

    kept = F.filter(
        triples, lambda t: filled(t["subject"]) & filled(t["predicate"]) & filled(t["object"])
    )
    return docs.withColumn(triples, kept).where(F.size(triples) > 0)


def score_threshold(df: DataFrame, threshold: float = 1e-5) -> DataFrame:
    return df.where(F.col("score") > threshold)


def relation_contains(df: DataFrame, text: str) -> DataFrame:
    """Cluster counts of the triples whose relation contains a text."""
    return df.where(F.contains("relation", F.lit(text))).groupBy("cluster").agg(
        F.count("*").alias("n")
    )


def long_keywords(keywords: Column, min_len: int = 6) -> Column:
    """Map of relation type to trigger phrases without the short phrases."""
    return F.transform_values(
        keywords, lambda _, words: F.filter(words, lambda w: F.length(w) >= min_len)
    )


def title_stopwords(titles: DataFrame, title: str, stop: list[str]) -> DataFrame:
    """Drop titles that contain a stop word; the word list is a parameter, read inside the row."""
    hit = reduce(
        lambda a, b: a | b, [F.contains(F.lower(title), F.lit(w)) for w in stop], F.lit(False)
    )
    return titles.where(~hit)


def same_sentence_only(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    return df.where(F.col(sentence) > -1)


def with_cluster(df: DataFrame) -> DataFrame:
    return df.where(F.col("cluster").isNotNull())


def answerable(df: DataFrame, entity: str = "entity") -> DataFrame:
    return df.where(F.col(entity) != "")
