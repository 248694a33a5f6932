"""Sources and filters (S, F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.catalog.base import Tables, case, joined, sql_with
from tripleloom.catalog.syntax import KEY, quoted, sql_tags, sql_types
from tripleloom.functions import syntax
from tripleloom.functions.vocab import (
    ANCHOR_STOP_RELATIONS,
    GARBAGE_RELATIONS,
    LIGHT_VERBS,
)
from tripleloom.operators import aggregates, filters
from tripleloom.plans.features import span
from tripleloom.session import scratch_path
from tripleloom.sources import readers, writers

# --- sources and sinks --------------------------------------------------------------------


@case("s01_read_text_docs", "SELECT coalesce(text, '') AS text, true AS named FROM documents")
def _(t: Tables) -> DataFrame:
    """Every text written as a file of its own and read back whole, under the file's name."""
    path = scratch_path(t.spark, "texts")
    writers.write_text_docs(t.documents, path)
    back = readers.read_text_docs(t.spark, path)
    return back.select(
        F.regexp_replace("text", r"\n\z", "").alias("text"), F.startswith("doc_id", F.lit("part-")).alias("named")
    )


@case(
    "s02_read_annotations",
    sql_with(
        "SELECT array_to_string(list_transform(toks, lambda t: t.word), ' ') AS words, array_to_string(list_transform(toks, lambda t: t.pos), ' ') AS tags, "
        "array_to_string(list_transform(toks, lambda t: t.ner), ' ') AS types, array_to_string(list_transform(toks, lambda t: t.gov), ' ') AS governors FROM sents_v",
        "sents_v",
    ),
)
def _(t: Tables) -> DataFrame:
    """All sentences written as JSON lines and read back with the declared schema."""
    path = scratch_path(t.spark, "annotations")
    writers.write_annotations(t.sentences().drop("doc_id", "sent"), path)
    back = readers.read_annotations(t.spark, path, multi_line=False)
    return back.select(
        *[joined(f"tokens.{c}", " ").alias(name) for c, name in (("word", "words"), ("pos", "tags"), ("ner", "types"))],
        joined("basicDependencies.governor", " ").alias("governors"),
    )


@case(
    "s03_read_gold",
    sql_with("SELECT subject_decoded, object_decoded, property_decoded, question, part FROM questions_v", "questions_v"),
)
def _(t: Tables) -> DataFrame:
    """The three gold splits written as CSV and read back with their part tag."""
    empty = F.lit(None).cast("string")
    gold = t.questions().select(
        *[empty.alias(c) for c in ("subject_encoded", "property_encoded", "object_encoded")],
        "subject_decoded", "property_decoded", "object_decoded", "question", empty.alias("mapped_rel"), "part",
    )
    paths = {}
    for part in ("train", "valid", "test"):
        paths[part] = scratch_path(t.spark, f"gold-{part}")
        writers.write_csv(gold.where(F.col("part") == part).drop("part"), paths[part])
    return readers.read_gold(t.spark, paths).select(
        "subject_decoded", "object_decoded", "property_decoded", "question", "part"
    )


@case("s04_read_features", sql_with("SELECT * FROM pairs_v", "pairs_v"))
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "features")
    writers.write_features(t.pairs(), path)
    return readers.read_features(t.spark, path)


@case(
    "s05_write_features",
    sql_with("SELECT *, true AS bounded FROM triples_v", "triples_v"),
)
def _(t: Tables) -> DataFrame:
    """All rows come back, and no written file holds more of them than asked for."""
    path = scratch_path(t.spark, "chunked")
    writers.write_features(t.triples(), path, rows_per_file=5000)
    back = readers.read_features(t.spark, path)
    rows = back.select("*", F.col("_metadata.file_name").alias("file"))
    sizes = rows.groupBy("file").agg((F.count("*") <= 5000).alias("bounded"))
    return rows.join(sizes, "file").drop("file")


@case(
    "s06_write_tsv",
    sql_with("SELECT subject, relation, object FROM triples_v", "triples_v"),
)
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "tsv")
    rows = t.triples().select(F.col("doc_id").alias("_docid"), "subject", "relation", "object")
    writers.write_tsv(rows, path)
    return t.spark.read.csv(path, sep="\t", schema="subject string, relation string, object string")


TOP_SQL = (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, subject, relation, object) AS rn "
    "FROM pairs_v) x WHERE rn <= 999"
)


@case(
    "s07_export_cluster_json",
    sql_with(
        "SELECT cluster, '{\"data\":[' || data || '],\"predicates\":{' || predicates || '}}' AS json FROM "
        "(SELECT cluster, string_agg('[\"' || subject || '\",\"' || relation || '\",\"' || object || '\",' || CAST(score AS VARCHAR) || ']', ',' ORDER BY rn) AS data "
        "FROM top_v GROUP BY cluster) a JOIN (SELECT cluster, string_agg('\"' || relation || '\":' || n, ',' ORDER BY relation) AS predicates "
        "FROM (SELECT cluster, relation, count(*) AS n FROM top_v GROUP BY cluster, relation) b GROUP BY cluster) c USING (cluster)",
        "pairs_v", top_v=TOP_SQL,
    ),
)
def _(t: Tables) -> DataFrame:
    return aggregates.export_cluster_json(t.pairs())


@case(
    "s08_read_cluster_json",
    sql_with("SELECT cluster, CAST(rn AS INT) AS rank, subject, relation, object, score FROM top_v", "pairs_v", top_v=TOP_SQL),
)
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "clusters")
    writers.write_cluster_json(aggregates.export_cluster_json(t.pairs()), path)
    return readers.read_cluster_json(t.spark, path)


@case(
    "s09_pending_only",
    "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(t: Tables) -> DataFrame:
    """Documents that have no label yet."""
    return readers.pending_only(t.documents.select("doc_id", "lang", "n_chars"), t.labels)


@case(
    "s10_shard_inputs",
    "SELECT doc_id, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 16 AS INT) AS shard FROM documents",
)
def _(t: Tables) -> DataFrame:
    return readers.shard_inputs(t.documents.select("doc_id"), 16)


@case(
    "s11_read_word_vectors",
    "SELECT CAST(vec_id AS VARCHAR) AS word, CAST(len(embedding) AS INT) AS width, "
    "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings",
)
def _(t: Tables) -> DataFrame:
    """The vectors written as a word-vector text file and read back."""
    path = scratch_path(t.spark, "vectors")
    writers.write_word_vectors(
        t.embeddings.select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec")), path
    )
    total = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return readers.read_word_vectors(t.spark, path).select(
        "word", F.size("vec").alias("width"), F.round(total, 4).alias("total")
    )


@case(
    "s12_append_report",
    "SELECT CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n, 2 AS reports FROM embeddings GROUP BY label",
)
def _(t: Tables) -> DataFrame:
    """The same report appended twice, as for two models."""
    path = scratch_path(t.spark, "report")
    report = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    for model in ("a", "b"):
        writers.append_report(report.withColumn("model", F.lit(model)), path)
    back = t.spark.read.schema("label bigint, n bigint, model string").json(path)
    return back.groupBy("label", "n").agg(F.count("*").cast("int").alias("reports"))


@case(
    "s13_filter_pages_by_category",
    "SELECT doc_id, source FROM documents WHERE length(text) >= 1 AND source IN "
    "(SELECT d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)",
)
def _(t: Tables) -> DataFrame:
    """Documents whose source has a document labelled toxic."""
    listed = t.documents.join(t.labels.where("toxic = 1"), "doc_id").select("source")
    return readers.filter_pages_by_category(t.documents, listed, "source").select("doc_id", "source")


@case(
    "s14_reject_output",
    "SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'rejected' ELSE 'annotated' END AS state "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def _(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id").join(
        t.labels.select("doc_id", F.col("quality").alias("annotation")), "doc_id", "left"
    )
    good, bad = readers.split_rejects(docs)
    return good.select("doc_id", F.lit("annotated").alias("state")).unionByName(
        bad.select("doc_id", F.lit("rejected").alias("state"))
    )


# --- filters on the triples of a sentence ----------------------------------------------------

SPAN_ROW = "doc_id, sent, subject, relation, object"
MENTIONS = "list_transform(list_filter(toks, lambda t: t.ner <> 'O'), lambda t: t.word)"


def kept(t: Tables, triples) -> DataFrame:
    rows = t.sentences().select("doc_id", "sent", triples.alias("openie"))
    return filters.nonempty_sentences(rows).select(
        "doc_id", "sent", F.inline(F.transform("openie", lambda x: F.struct(x["subject"], x["relation"], x["object"])))
    ).toDF("doc_id", "sent", "subject", "relation", "object")


def mention_sql(condition: str) -> str:
    return sql_with(
        f"SELECT {SPAN_ROW} FROM (SELECT *, {MENTIONS} AS ms FROM spans_v) x WHERE {condition}", "spans_v"
    )


_ANCHORED = "(list_contains(ms, subject) OR list_contains(ms, object))"


@case("f01_anchor_entity", mention_sql(f"length(relation) >= 2 AND relation NOT IN ({quoted(ANCHOR_STOP_RELATIONS)}) AND {_ANCHORED}"))
def _(t: Tables) -> DataFrame:
    return kept(t, filters.anchor_entity(F.col("openie"), F.col("entitymentions")))


@case("f01_anchor_entity_table", mention_sql(f"length(relation) >= 2 AND relation NOT IN ({quoted(ANCHOR_STOP_RELATIONS)}) AND {_ANCHORED}"))
def _(t: Tables) -> DataFrame:
    """Triples and mentions as two tables."""
    s = t.sentences()
    triples = s.select(
        "doc_id", "sent", F.posexplode("openie").alias("tpos", "x")
    ).select("doc_id", "sent", "tpos", "x.subject", "x.relation", "x.object")
    mentions = s.select("doc_id", "sent", F.explode("entitymentions").alias("m")).select(
        "doc_id", "sent", F.col("m.text").alias("text")
    )
    return filters.anchor_entity_table(triples, mentions).drop("tpos")


_CONTAINED = (
    "len(list_filter(ms, lambda m: contains(subject, m))) > 0 AND len(list_filter(ms, lambda m: contains(object, m))) > 0"
)


@case("f02_anchor_both", mention_sql(f"obj_end - obj_start <= 3 AND subj_end - subj_start <= 3 AND rel_end - rel_start <= 3 AND {_CONTAINED}"))
def _(t: Tables) -> DataFrame:
    return kept(t, filters.anchor_both(F.col("openie"), F.col("entitymentions")))


@case(
    "f03_anchor_both_joined",
    mention_sql(
        "obj_end - obj_start <= 3 AND subj_end - subj_start <= 3 AND rel_end - rel_start <= 13 "
        "AND contains(array_to_string(ms, ' '), subject) AND contains(array_to_string(ms, ' '), object)"
    ),
)
def _(t: Tables) -> DataFrame:
    return kept(t, filters.anchor_both_joined(F.col("openie"), F.col("entitymentions")))


@case("f04_anchor_any", mention_sql(_ANCHORED))
def _(t: Tables) -> DataFrame:
    return kept(t, filters.anchor_any(F.col("openie"), F.col("entitymentions")))


@case("f05_nonempty_sentences", sql_with("SELECT doc_id, sent FROM sents_v WHERE n_tokens >= 9", "sents_v"))
def _(t: Tables) -> DataFrame:
    return filters.nonempty_sentences(t.sentences()).select("doc_id", "sent")


@case(
    "f06_phrase_len",
    sql_with(
        "SELECT doc_id, sent, tpos FROM spans_v WHERE len(string_split(subject, ' ')) <= 2 "
        "AND len(string_split(object, ' ')) <= 2 AND len(string_split(relation, ' ')) <= 2",
        "spans_v",
    ),
)
def _(t: Tables) -> DataFrame:
    """Objects of tpos 0 have three words."""
    return filters.phrase_len(t.spans(), 2).select(*KEY)


_LIGHT = quoted(LIGHT_VERBS)


def tagged(t: Tables) -> DataFrame:
    tokens = F.col("tokens")
    return t.spans().select(
        *KEY, "relation", "subject", "object",
        *[syntax.pos_of_span(tokens, *span(p)).alias(f"pos_{p}") for p in ("subj", "rel", "obj")],
        *[syntax.entity_type(tokens, *span(p)).alias(f"{p}_type") for p in ("subj", "obj")],
        *[f"{p}_{b}" for p in ("subj", "rel", "obj") for b in ("start", "end")],
    )


TAGGED_SQL = (
    "SELECT *, "
    + ", ".join(f"array_to_string({sql_tags('pos', p)}, '_') AS pos_{p}" for p in ("subj", "rel", "obj"))
    + f", {sql_types('subj')} AS subj_type, {sql_types('obj')} AS obj_type FROM spans_v"
)


def tagged_sql(condition: str) -> str:
    return sql_with(f"SELECT doc_id, sent, tpos FROM tagged_v WHERE {condition}", "spans_v", tagged_v=TAGGED_SQL)


@case("f07_drop_pronoun_light_verb", tagged_sql(f"pos_subj <> 'PRP' AND pos_obj <> 'PRP' AND lower(relation) NOT IN ({_LIGHT})"))
def _(t: Tables) -> DataFrame:
    return filters.drop_pronoun_light_verb(tagged(t)).select(*KEY)


@case("f08_drop_untyped_pairs", tagged_sql("NOT (subj_type = 'O' AND obj_type = 'O')"))
def _(t: Tables) -> DataFrame:
    return filters.drop_untyped_pairs(tagged(t)).select(*KEY)


@case(
    "f09_min_chars",
    tagged_sql(f"length(subject) >= 3 AND length(relation) >= 3 AND length(object) >= 3 AND lower(relation) NOT IN ({quoted(GARBAGE_RELATIONS)})"),
)
def _(t: Tables) -> DataFrame:
    return filters.min_chars(tagged(t), 3, GARBAGE_RELATIONS).select(*KEY)


@case("f10_span_len", tagged_sql("subj_end - subj_start <= 2 AND rel_end - rel_start <= 2 AND obj_end - obj_start <= 2"))
def _(t: Tables) -> DataFrame:
    return filters.span_len(tagged(t), 2).select(*KEY)


@case(
    "f11_drop_garbage_relation",
    tagged_sql(f"NOT regexp_matches(relation, '^[0-9]+$') AND relation NOT IN ({quoted(GARBAGE_RELATIONS)})"),
)
def _(t: Tables) -> DataFrame:
    return filters.drop_garbage_relation(tagged(t), GARBAGE_RELATIONS).select(*KEY)


_NAMED = "(list_contains(string_split({0}, '_'), 'NNP') OR list_contains(string_split({0}, '_'), 'CD'))"


@case("f12_drop_untagged", tagged_sql(f"{_NAMED.format('pos_subj')} AND {_NAMED.format('pos_obj')} AND pos_rel <> ''"))
def _(t: Tables) -> DataFrame:
    return filters.drop_untagged(tagged(t), "pos_subj", "pos_rel", "pos_obj").select(*KEY)


@case(
    "f13_complete_surface",
    sql_with(
        "SELECT doc_id, CAST(count(*) AS INT) AS n FROM triples_v WHERE score > 0 GROUP BY doc_id", "triples_v"
    ),
)
def _(t: Tables) -> DataFrame:
    """Triples nested per order; those of score 0 lose their predicate."""
    part = lambda c: F.struct(c.alias("surfaceform"))
    triple = F.struct(
        part(F.col("subject")).alias("subject"),
        part(F.when(F.col("score") > 0, F.col("relation"))).alias("predicate"),
        part(F.col("object")).alias("object"),
    )
    docs = t.triples().groupBy("doc_id").agg(F.collect_list(triple).alias("triples"))
    return filters.complete_surface(docs).select("doc_id", F.size("triples").alias("n"))


@case("f14_score_threshold", sql_with("SELECT subject, object, score FROM pairs_v WHERE score > 0.05", "pairs_v"))
def _(t: Tables) -> DataFrame:
    return filters.score_threshold(t.pairs(), 0.05).select("subject", "object", "score")


@case(
    "f15_relation_contains",
    sql_with("SELECT cluster, count(*) AS n FROM pairs_v WHERE contains(relation, 's') GROUP BY cluster", "pairs_v"),
)
def _(t: Tables) -> DataFrame:
    return filters.relation_contains(t.pairs(), "s")


@case(
    "f16_long_keywords",
    sql_with(
        "SELECT relation AS rel_type, coalesce(string_agg(object, '|' ORDER BY object) FILTER (length(object) >= 11), '') AS keywords "
        "FROM (SELECT DISTINCT relation, object FROM pairs_v) x GROUP BY relation",
        "pairs_v",
    ),
)
def _(t: Tables) -> DataFrame:
    """Objects as trigger phrases of their relation."""
    words = t.pairs().select("relation", "object").distinct().groupBy("relation").agg(
        F.array_sort(F.collect_list("object")).alias("words")
    )
    maps = words.select(filters.long_keywords(F.create_map("relation", "words"), 11).alias("m"))
    return maps.select(F.explode("m").alias("rel_type", "k")).select("rel_type", joined("k", "|").alias("keywords"))


@case(
    "f17_title_stopwords",
    "SELECT doc_id, n_chars FROM documents WHERE NOT (contains(lower(text), 'ed the') OR contains(lower(text), 'ion und') OR contains(lower(text), 'que'))",
)
def _(t: Tables) -> DataFrame:
    return filters.title_stopwords(t.documents, "text", ["ed the", "ion und", "que"]).select("doc_id", "n_chars")


@case("f18_same_sentence_only", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(t: Tables) -> DataFrame:
    """Documents located in the label table; -1 marks those that were not."""
    located = t.documents.join(t.labels, "doc_id", "left").withColumn("sentence", F.coalesce("quality", F.lit(-1)))
    return filters.same_sentence_only(located).select("doc_id", "n_chars")
