"""Inputs of the registered queries.

The driver tables hold no annotated sentences, gold questions or cluster
assignments, so those are derived here from whole tables: once with the
DataFrame API, once as common table expressions for the SQL check.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tripleloom.functions import syntax
from tripleloom.operators.distinct import distinct_pairs
from tripleloom.operators.dense import nearest_center
from tripleloom.plans.features import triple_rows
from tripleloom.session import cut_lineage


@dataclass(frozen=True)
class Case:
    """A registered query; ``sql`` is ``None`` where SQL cannot express it."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


CASES: dict[str, Case] = {}

TASK_ROWS = 250_000


def case(name: str, sql: str | None = None) -> Callable:
    """Registers a function of ``Tables`` under an operator's name."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        CASES[name] = Case(lambda spark, sf_dir: build(Tables(spark, sf_dir)), sql)
        return build

    return register


def joined(values: Column | str, sep: str = ",") -> Column:
    """An array as text, so that results compare as plain values."""
    values = F.col(values) if isinstance(values, str) else values
    return F.array_join(values.cast("array<string>"), sep)


class Tables:
    """Driver tables and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._stages: dict[str, DataFrame] = {}
        self._partitions: int | None = None

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def spread(self, name: str) -> DataFrame:
        """A table for work that is heavy per row. A scan of few splits is spread over the
        cores; one that already has a task per core is left alone.
        """
        df = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores)

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that a query uses more than once, written once per query."""
        if name not in self._stages:
            self._stages[name] = cut_lineage(build(), name, self.partitions())
        return self._stages[name]

    def partitions(self) -> int:
        """Shuffle partitions by the lines, the longest table, so that the rows of a task do not grow with it. The
        count comes from the files' footers.
        """
        if self._partitions is None:
            self._partitions = -(-self.lineitem.count() // TASK_ROWS)
        return self._partitions

    def triples(self) -> DataFrame:
        """One row per line item, read as (subject, relation, object).

        Orders meet their customers first and the lines last, so the lines are dealt by order once, for that
        join and for the window.
        """
        orders = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        lines = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).join(
            orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")
        )
        order = W.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_shipdate",
        )
        return lines.select(
            F.col("l_orderkey").alias("doc_id"),
            F.row_number().over(order).alias("pos"),
            F.lower(F.trim("c_name")).alias("subject"),
            F.lower("p_type").alias("relation"),
            F.lower("p_name").alias("object"),
            F.col("l_discount").alias("score"),
            (F.col("p_size") % 10).cast("int").alias("cluster"),
        )

    def pairs(self) -> DataFrame:
        """The first triple of every (subject, object)."""
        if "pairs" in self._stages:
            return self._stages["pairs"]
        return distinct_pairs(self.triples(), ["doc_id", "pos"], ["relation", "score", "cluster"])

    def questions(self) -> DataFrame:
        """Gold questions: every pair, every 14th customer with the roles reversed.

        Queries use the pairs again next to the questions, so they are written once.
        """
        self.stage("pairs", self.pairs)
        number = F.substr("subject", F.lit(10)).cast("int")
        reverse = number % 14 == 0
        return self.pairs().select(
            F.when(reverse, F.col("object")).otherwise(F.col("subject")).alias("subject_decoded"),
            F.when(reverse, F.col("subject")).otherwise(F.col("object")).alias("object_decoded"),
            F.col("relation").alias("property_decoded"),
            F.concat(F.lit("what "), "relation", F.lit(" item did "), "subject", F.lit(" order")).alias(
                "question"
            ),
            F.when(number % 10 < 6, "train").when(number % 10 < 8, "valid").otherwise("test").alias("part"),
        )

    def sentences(self, own_step: bool = True) -> DataFrame:
        """Annotated sentences of all documents, tagged by rule, built inside the row.

        The tokens are built in a step of their own, so that no filter or function on them builds them again. Where another
        generator follows, they can be a plain column, which is built only if something reads it, and after the filters.
        The governor of token i is i / 2 in even sentences and i / 3 in odd ones (which
        so have two roots); a sentence of nine tokens or more carries two triples.
        """
        split = self.spread("documents").select(
            "doc_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("sent", "body")
        )
        cleaned = F.regexp_replace("body", r"[^\p{L}\p{N} \t]", "")
        words = F.regexp_extract_all(cleaned, F.lit(r"[^ \t]+"), F.lit(0))
        # One-row generators keep the filters that follow from computing their input again.
        rows = split.select("doc_id", "sent", F.explode(F.array(words)).alias("words")).where(
            F.size("words") > 0
        )

        def token(word: Column, i: Column) -> Column:
            return syntax.bind(
                rule_pos(word),
                lambda pos: F.struct(
                    (i + 1).cast("int").alias("index"),
                    word.alias("word"),
                    word.alias("originalText"),
                    F.lower(word).alias("lemma"),
                    pos.alias("pos"),
                    rule_ner(word, pos).alias("ner"),
                ),
            )

        tagged = F.transform("words", token)
        built = rows.select(
            "doc_id", "sent", "words", (F.explode(F.array(tagged)) if own_step else tagged).alias("tokens")
        )
        step = F.lit(2) + F.col("sent") % 2
        tree = F.transform(
            F.sequence(F.lit(1), F.size("words")),
            lambda i: F.struct(
                F.call_function("div", i, step).cast("int").alias("governor"),
                i.alias("dependent"),
                F.lit("dep").alias("dep"),
            ),
        )

        def triple(spans: list[tuple[Column, Column]]) -> Column:
            texts = [
                F.array_join(syntax.span_of(F.col("words"), s, e), " ") for s, e in spans
            ]
            names = ("subject", "relation", "object")
            return F.struct(
                *[t.alias(n) for t, n in zip(texts, names)],
                *[F.array(s, e).alias(f"{n}Span") for (s, e), n in zip(spans, names)],
            )

        at = lambda i: F.lit(i)
        n = F.size("words")
        triples = F.array(
            triple([(at(0), at(2)), (at(3), at(4)), (n - 3, n)]),
            triple([(at(0), at(1)), (at(2), at(4)), (at(5), at(6))]),
        )
        mentions = F.transform(
            F.filter("tokens", lambda t: t["ner"] != "O"),
            lambda t: F.struct(t["word"].alias("text"), t["ner"].alias("ner")),
        )
        return built.select(
            "doc_id",
            "sent",
            "tokens",
            tree.alias("basicDependencies"),
            mentions.alias("entitymentions"),
            F.when(n >= 9, triples).otherwise(F.array()).alias("openie"),
        )

    def spans(self) -> DataFrame:
        """One row per triple: its tokens, spans and governor array."""
        return triple_rows(self.sentences(own_step=False))

    def centers(self) -> DataFrame:
        """One centre per label: its vector with the lowest id."""
        return (
            self.embeddings.groupBy(F.col("label").alias("center_id"))
            .agg(F.min_by("embedding", "vec_id").alias("center"))
        )

    def assigned(self) -> DataFrame:
        return nearest_center(
            self.embeddings.select("vec_id", "label", F.col("embedding").alias("vec")), self.centers()
        ).select("vec_id", "label", "cluster", "d2")


def rule_pos(word: Column) -> Column:
    """Part-of-speech tag by rule."""
    preps = ["above", "across", "after", "at", "by", "for", "from", "in", "into", "of", "on", "to",
             "under", "up"]
    prons = ["it", "he", "this"]
    # ":" follows "9" and "[" follows "Z": words are compared by their first letter without cutting it off.
    return (
        F.when((word >= "0") & (word < ":"), "CD")
        .when(F.lower(word).isin(preps + prons), F.when(F.lower(word).isin(prons), "PRP").otherwise("IN"))
        .when((word >= "A") & (word < "["), "NNP")
        .when(F.length(word) % 4 == 0, "VBD")
        .otherwise("NN")
    )


def rule_ner(word: Column, pos: Column) -> Column:
    """Entity type by rule."""
    size = F.length(word) % 3
    return (
        F.when(pos == "CD", "NUMBER")
        .when(pos != "NNP", "O")
        .when(size == 0, "PERSON")
        .when(size == 1, "ORGANIZATION")
        .otherwise("DURATION")
    )


VIEWS: dict[str, tuple[list[str], str]] = {
    "triples_v": (
        [],
        """SELECT l_orderkey AS doc_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INT) AS pos,
       lower(trim(c_name)) AS subject, lower(p_type) AS relation, lower(p_name) AS object,
       l_discount AS score, CAST(p_size % 10 AS INT) AS cluster
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
     JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""",
    ),
    "pairs_v": (
        ["triples_v"],
        """SELECT subject, relation, object, score, cluster FROM (
  SELECT *, row_number() OVER (PARTITION BY subject, object ORDER BY doc_id, pos) AS rn FROM triples_v) t
WHERE rn = 1""",
    ),
    "questions_v": (
        ["pairs_v"],
        """SELECT CASE WHEN n % 14 = 0 THEN object ELSE subject END AS subject_decoded,
       CASE WHEN n % 14 = 0 THEN subject ELSE object END AS object_decoded,
       relation AS property_decoded,
       concat('what ', relation, ' item did ', subject, ' order') AS question,
       CASE WHEN n % 10 < 6 THEN 'train' WHEN n % 10 < 8 THEN 'valid' ELSE 'test' END AS part
FROM (SELECT *, CAST(substr(subject, 10) AS INT) AS n FROM pairs_v) t""",
    ),
    "raw_tokens_v": (
        [],
        r"""SELECT doc_id, CAST(sent - 1 AS INT) AS sent, CAST(k - 1 AS INT) AS k, regexp_replace(tok, '[^\p{L}\p{N}]', '', 'g') AS word
FROM (SELECT doc_id, sent, unnest(toks) AS tok, generate_subscripts(toks, 1) AS k
      FROM (SELECT doc_id, sent, string_split_regex(s, '[ \t]+') AS toks
            FROM (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS sent
                  FROM (SELECT doc_id, string_split_regex(text, '[.!?\n]+') AS ss
                        FROM documents) a) b) c) d""",
    ),
    "tokens_v": (
        ["raw_tokens_v"],
        """SELECT doc_id, sent, idx, word, lower(word) AS lemma, pos,
       CASE WHEN pos = 'CD' THEN 'NUMBER' WHEN pos <> 'NNP' THEN 'O' WHEN length(word) % 3 = 0 THEN 'PERSON'
            WHEN length(word) % 3 = 1 THEN 'ORGANIZATION' ELSE 'DURATION' END AS ner,
       CAST(floor(idx / (2 + sent % 2)) AS INT) AS gov
FROM (SELECT doc_id, sent, word,
             CAST(row_number() OVER (PARTITION BY doc_id, sent ORDER BY k) AS INT) AS idx,
             CASE WHEN regexp_matches(word, '^[0-9]') THEN 'CD'
                  WHEN lower(word) IN ('above','across','after','at','by','for','from','in','into','of','on','to','under','up') THEN 'IN'
                  WHEN lower(word) IN ('it','he','this') THEN 'PRP'
                  WHEN regexp_matches(word, '^[A-Z]') THEN 'NNP'
                  WHEN length(word) % 4 = 0 THEN 'VBD' ELSE 'NN' END AS pos
      FROM raw_tokens_v WHERE word <> '') t""",
    ),
    "sents_v": (
        ["tokens_v"],
        """SELECT doc_id, sent, list({'word': word, 'lemma': lemma, 'pos': pos, 'ner': ner, 'gov': gov} ORDER BY idx) AS toks,
       count(*) AS n_tokens
FROM tokens_v GROUP BY doc_id, sent""",
    ),
    # One row per triple with its tokens as a list of structs, index = list position.
    "spans_v": (
        ["sents_v"],
        """SELECT *, array_to_string(list_transform(toks[subj_start+1:subj_end], lambda t: t.word), ' ') AS subject,
       array_to_string(list_transform(toks[rel_start+1:rel_end], lambda t: t.word), ' ') AS relation,
       array_to_string(list_transform(toks[obj_start+1:obj_end], lambda t: t.word), ' ') AS object
FROM (SELECT doc_id, sent, toks, CAST(n_tokens AS INT) AS n_tokens, 0 AS tpos, 0 AS subj_start, 2 AS subj_end, 3 AS rel_start,
             4 AS rel_end, CAST(n_tokens - 3 AS INT) AS obj_start, CAST(n_tokens AS INT) AS obj_end FROM sents_v WHERE n_tokens >= 9
      UNION ALL
      SELECT doc_id, sent, toks, CAST(n_tokens AS INT), 1, 0, 1, 2, 4, 5, 6 FROM sents_v WHERE n_tokens >= 9) t""",
    ),
    "heads_v": (
        ["spans_v"],
        """SELECT doc_id, sent, tpos,
       coalesce(list_filter(range(obj_start + 1, obj_end + 1), lambda i: toks[i].gov < obj_start + 1 OR toks[i].gov > obj_end)[1], obj_end) AS obj_head,
       coalesce(list_filter(range(subj_start + 1, subj_end + 1), lambda i: toks[i].gov < subj_start + 1 OR toks[i].gov > subj_end)[1], subj_end) AS subj_head
FROM spans_v""",
    ),
    "walk_v": (
        ["heads_v"],
        """SELECT doc_id, sent, tpos, 'o' AS side, obj_head AS node, [obj_head] AS path FROM heads_v
UNION ALL SELECT doc_id, sent, tpos, 's', subj_head, [subj_head] FROM heads_v
UNION ALL SELECT w.doc_id, w.sent, w.tpos, w.side, t.gov, list_append(w.path, t.gov)
FROM walk_v w JOIN tokens_v t ON w.doc_id = t.doc_id AND w.sent = t.sent AND w.node = t.idx WHERE t.gov > 0""",
    ),
    # Tree path from the object head to the subject head.
    "paths_v": (
        ["walk_v"],
        """SELECT doc_id, sent, tpos, CASE WHEN meet IS NULL THEN [] ELSE
       l[1:list_position(l, meet)] || list_reverse(r[1:list_position(r, meet) - 1]) END AS path
FROM (SELECT *, list_filter(l, lambda x: list_contains(r, x))[1] AS meet
      FROM (SELECT doc_id, sent, tpos, arg_max(CASE WHEN side = 'o' THEN path END, CASE WHEN side = 'o' THEN len(path) END) AS l,
                   arg_max(CASE WHEN side = 's' THEN path END, CASE WHEN side = 's' THEN len(path) END) AS r
            FROM walk_v GROUP BY doc_id, sent, tpos) a) b""",
    ),
    "centers_v": (
        [],
        """SELECT label AS center_id, embedding AS center FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) t WHERE rn = 1""",
    ),
    "assigned_v": (
        ["centers_v"],
        """SELECT vec_id, label, cluster, d2 FROM (
  SELECT vec_id, label, center_id AS cluster, d2, row_number() OVER (PARTITION BY vec_id ORDER BY d2, center_id) AS rn
  FROM (SELECT vec_id, label, center_id,
               round(list_sum(list_transform(list_zip(embedding, center), lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))), 9) AS d2
        FROM embeddings CROSS JOIN centers_v) t) u
WHERE rn = 1""",
    ),
}


def sql_with(body: str, *views: str, **extra: str) -> str:
    """``body`` preceded by the named views (and what they need) and by extra expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    recursive = lambda name, text: f" {name} " in text
    parts = [
        f"{name} AS {'' if recursive(name, text) else 'MATERIALIZED '}({text})"
        for name, text in [(n, VIEWS[n][1]) for n in ordered] + list(extra.items())
    ]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
