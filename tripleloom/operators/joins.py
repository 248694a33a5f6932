"""Joins between triples, gold questions, documents and category trees.

No join carries a broadcast hint: the planner broadcasts a side when its measured
size is below the session's limit and shuffles otherwise. Tables of questions and pairs that were
written and read back carry a merge hint: the planner takes their size on disk, where repeated texts
are stored once, for their size in memory.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tripleloom.functions.syntax import bind
from tripleloom.functions.text import last_uri_segment
from tripleloom.operators.distinct import first_per_key
from tripleloom.session import cut_lineage


def both_directions(df: DataFrame, first: str, second: str, *payload: str) -> DataFrame:
    """Each pair under its own key and under the reversed key, in one scan."""
    sides = F.array(
        F.struct(F.col(first).alias("k1"), F.col(second).alias("k2"), F.lit(0).alias("dir")),
        F.struct(F.col(second).alias("k1"), F.col(first).alias("k2"), F.lit(1).alias("dir")),
    )
    return df.select(F.inline(sides), *payload)


def cluster_for_gold(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Cluster and relation of each gold pair: forward key first, else the reversed one.

    One left join on a side that is unique per key, instead of two joins and a row-wise merge. A hash of the key leads it, so that
    sorting compares numbers instead of names that begin alike.
    """
    keyed = first_per_key(
        both_directions(pred, "subject", "object", "cluster", "relation").withColumn("k0", F.xxhash64("k1", "k2")),
        ["k0", "k1", "k2"],
        ["dir", "relation", "cluster"],
        ["cluster", "relation"],
    )
    same = (F.xxhash64("_subject", "_object") == F.col("k0")) & (F.col("_subject") == F.col("k1")) & (F.col("_object") == F.col("k2"))
    return gold.join(keyed.hint("merge"), same, "left").drop("k0", "k1", "k2")


def match_gold(gold: DataFrame, triples: DataFrame, mode: str = "forward") -> DataFrame:
    """Gold pairs found among the triples, with the forward and the reversed relation.

    ``forward`` keeps pairs found in their own direction, ``both`` also those found
    only reversed, whose property gets `` [REV]``.
    """
    keyed = (
        both_directions(triples, "subject", "object", "relation")
        .groupBy("k1", "k2")
        .agg(
            F.min(F.when(F.col("dir") == 0, F.col("relation"))).alias("relation"),
            F.min(F.when(F.col("dir") == 1, F.col("relation"))).alias("relation_inv"),
        )
    )
    if mode == "forward":
        keyed = keyed.where(F.col("relation").isNotNull())
    hits = gold.join(
        keyed.hint("merge"), (F.col("_subject") == F.col("k1")) & (F.col("_object") == F.col("k2"))
    ).drop("k1", "k2")
    return hits.withColumn(
        "property_decoded",
        F.when(F.col("relation").isNull(), F.concat("property_decoded", F.lit(" [REV]"))).otherwise(
            F.col("property_decoded")
        ),
    )


def remove_matched(gold: DataFrame, matched: DataFrame) -> DataFrame:
    return gold.join(matched.select("_subject", "_object"), ["_subject", "_object"], "left_anti")


def keep_valid_properties(gold: DataFrame, matched: DataFrame) -> DataFrame:
    return gold.join(
        matched.select("property_decoded").distinct(), "property_decoded", "left_semi"
    )


def removed_properties(gold: DataFrame, matched: DataFrame) -> DataFrame:
    """Counts of the properties that keep_valid_properties removes."""
    return (
        gold.groupBy("property_decoded")
        .agg(F.count("*").alias("n"))
        .join(matched.select("property_decoded").distinct(), "property_decoded", "left_anti")
    )


def docs_for_entities(docs: DataFrame, entity: str, gold: DataFrame, subject: str, obj: str) -> DataFrame:
    """Documents whose entity is a gold subject or object: one key list, one semi join."""
    keys = gold.select(F.explode(F.array(subject, obj)).alias(entity)).distinct()
    return docs.join(keys, entity, "left_semi")


def docs_with_annotation(docs: DataFrame, uri: str, annotations: DataFrame, key: str) -> DataFrame:
    return docs.withColumn("_key", last_uri_segment(F.col(uri))).join(
        annotations.withColumn("_key", F.col(key).cast("string")), "_key"
    ).drop("_key")


def name_clusters(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Triples of the named clusters with their ``rel_type``."""
    return triples.join(names.select("cluster", "rel_type"), "cluster")


def relation_keywords(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Surface relations of each relation type, one row each."""
    surface = triples.select("cluster", "relation").distinct()
    return name_clusters(surface, names).select("rel_type", F.col("relation").alias("keyword")).distinct()


def first_non_null(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """First non-empty value per key."""
    filled = df.where(F.coalesce(F.col(value), F.lit("")) != "")
    return filled.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def map_relation(gold: DataFrame, mapper: DataFrame) -> DataFrame:
    """Mapped relation name, else the property itself."""
    names = mapper.select("property_decoded", F.col("mapped_rel").alias("_mapped"))
    return gold.drop("mapped_rel").join(names, "property_decoded", "left").select(
        *[c for c in gold.columns if c != "mapped_rel"],
        F.coalesce("_mapped", "property_decoded").alias("mapped_rel"),
    )


def label_seeds(triples: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seed label of the exact triple, else 0; the last group wins."""
    keys = ["subject", "relation", "object"]
    labels = seeds.groupBy(*keys).agg(F.max("label").alias("label"))
    return triples.join(labels, keys, "left").withColumn(
        "label", F.coalesce("label", F.lit(0))
    )


def align_offsets(tokens: DataFrame, triples: DataFrame) -> DataFrame:
    """Locate both arguments of each triple in the first sentence of its document that has both.

    ``tokens`` has (doc_id, sent, idx, word, begin, end); ``triples`` has
    (doc_id, triple_id) and for subject and object a ``_text``, ``_begin`` and ``_end``,
    the offsets null where only the surface is known. Tokens and triples meet once, by document: tokens that
    are dealt by document already stay where they are, and a token is never sent once per offset or word.
    """
    own = [("doc_id", tokens), ("triple_id", triples), ("sent", tokens)]
    fields = [(name, df.schema[name].dataType) for name, df in own] + [(p, tokens.schema["idx"].dataType) for p in PLACES]
    schema = StructType([StructField(name, kind) for name, kind in fields])
    given = [f"{role}_{what}" for role in ("subject", "object") for what in ("text", "begin", "end")]
    words = tokens.where("doc_id IS NOT NULL").select("doc_id", "sent", "idx", "word", "begin", "end")
    wanted = triples.where("doc_id IS NOT NULL").select("doc_id", "triple_id", *given)
    types = to_arrow_schema(schema)
    locate = lambda left, right: pa.Table.from_pylist(_locate(left, right), schema=types)
    return words.groupBy("doc_id").cogroup(wanted.groupBy("doc_id")).applyInArrow(locate, schema)


PLACES = ("subject_first", "subject_last", "object_first", "object_last")


def _locate(tokens: pa.Table, triples: pa.Table) -> list[dict]:
    """The triples of one document, each in the first sentence with both arguments; first places win."""
    if not (tokens.num_rows and triples.num_rows):
        return []
    wanted = triples.to_pylist()
    surfaces = {t[f"{r}_text"] for t in wanted for r in ("subject", "object") if t[f"{r}_begin"] is None}
    begins = {t[f"{r}_begin"] for t in wanted for r in ("subject", "object")}
    ends = {t[f"{r}_end"] for t in wanted for r in ("subject", "object")}
    by_word, by_begin, by_end = ({} for _ in range(3))
    for sent, idx, word, begin, end in zip(*[tokens[c].to_pylist() for c in ("sent", "idx", "word", "begin", "end")]):
        if word is not None and word in surfaces:
            first = by_word.setdefault(word, {})
            first[sent] = min(idx, first.get(sent, idx))
        if begin is not None and begin in begins:
            by_begin.setdefault(begin, []).append((sent, idx))
        if end is not None and end in ends:
            by_end.setdefault(end, []).append((sent, idx))

    def hits(triple: dict, role: str) -> list[tuple]:
        """(sentence, first, last token) of the role."""
        begin, end = triple[f"{role}_begin"], triple[f"{role}_end"]
        if begin is None:
            return [(s, i, i) for s, i in by_word.get(triple[f"{role}_text"], {}).items()]
        pairs = [(s, i, z, j) for s, i in by_begin.get(begin, ()) for z, j in by_end.get(end, ())]
        return [(s, i, j) for s, i, z, j in pairs if s == z and i <= j]

    found: dict = {}
    for t in wanted:
        sides = found.setdefault(t["triple_id"], ({}, {}))
        for side, role in zip(sides, ("subject", "object")):
            for s, i, j in hits(t, role):
                known = side.get(s, (i, j))
                side[s] = (min(i, known[0]), min(j, known[1]))
    located = []
    for triple_id, (subject, obj) in found.items():
        sent = min(subject.keys() & obj.keys(), default=None)
        if sent is not None:
            located.append({"doc_id": wanted[0]["doc_id"], "triple_id": triple_id, "sent": sent, **dict(zip(PLACES, subject[sent] + obj[sent]))})
    return located


def expand_categories(roots: DataFrame, edges: DataFrame, max_depth: int = 4) -> DataFrame:
    """All sub-categories of the roots down to a depth, unique and sorted.

    The depth is a small constant, so the levels are unrolled into one lazy plan; each level is
    distinct, which keeps cyclic data finite.
    """
    level = roots.select(F.col("category"))
    found = level
    for _ in range(max_depth):
        level = (
            level.join(edges, F.col("category") == F.col("parent"))
            .select(F.col("child").alias("category"))
            .distinct()
        )
        found = found.unionByName(level)
    return found.distinct().orderBy("category")


GRAM = 64
NAME = 256  # letters up to which a text's runs are read from its start


def _grams(text: Column, lengths: Column) -> Column:
    """The different runs of letters of a text at the given lengths; the empty run is in every text."""
    letters = F.split(text, "")  # cut once, so that a run costs its own letters only

    def runs(count: Column, run: Callable[[Column, Column], Column]) -> Column:
        def of_length(n: Column) -> Column:
            starts = F.when(count >= n, F.sequence(F.lit(1), F.greatest(count - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
            return F.when(n == 0, F.array(F.lit(""))).otherwise(F.transform(starts, lambda i: run(i, n)))

        return F.array_distinct(F.flatten(F.transform(lengths, of_length)))

    # A name is short: reading it from its start for every run is far cheaper than taking it apart.
    short = runs(F.length(text), lambda i, n: F.substr(text, i, n))
    return F.when(F.length(text) <= NAME, short).otherwise(
        bind(letters, lambda cut: runs(F.size(cut), lambda i, n: F.array_join(F.slice(cut, i, n), "")))
    )


def contained_keys(df: DataFrame, text: str, keys: DataFrame, key: str, by: list[str] = ()) -> DataFrame:
    """Rows of ``df`` with every key that occurs inside their text (exact containment), for equal ``by``.

    Every key is looked up by one of its runs, the one that is in the fewest texts. A run is more than half the key long, a power
    of two of at most ``GRAM`` letters: numbered names share all their short runs with thousands of others, long ones with few. A
    key with a run in no text is dropped at once. Different texts give their different runs once, as narrow rows beside a
    hash of the text, and what shares a key's run is compared as a whole. The rows, the runs that some key has and what was found are written once. The empty key is inside every text, null texts and keys match nothing.
    """
    by = list(by)
    staged = cut_lineage(df.where(F.col(text).isNotNull()).withColumn("_id", F.md5(text)), "texts")
    texts = staged.select(*by, "_id", F.col(text).alias("_t")).distinct()
    names = keys.where(F.col(key).isNotNull()).select(*by, F.col(key).alias("_key")).distinct()
    half = F.pow(F.lit(2.0), F.length(F.bin(F.length("_key"))) - 1).cast("int")
    size = F.when(F.length("_key") == 0, F.lit(0)).otherwise(F.least(half, F.lit(GRAM)))
    # The powers of two up to GRAM and 0: eight different lengths at most.
    lengths = names.select(size.alias("_l")).distinct().agg(F.coalesce(F.array_sort(F.collect_list("_l")), F.array().cast("array<int>"))).scalar()
    runs = names.select(*by, "_key", _grams(F.col("_key"), F.array(size)).alias("_runs"))
    own = runs.select(*by, "_key", F.size("_runs").alias("_m"), F.explode("_runs").alias("_g"))
    have = texts.select("*", lengths.alias("_lengths")).select(*by, "_id", F.explode(_grams(F.col("_t"), F.col("_lengths"))).alias("_g"))
    have = cut_lineage(have.join(own.select(*by, "_g").distinct(), [*by, "_g"], "left_semi"), "runs")
    seen = have.groupBy("_g").agg(F.count("*").alias("_n"))
    need = own.join(seen, "_g")
    rarest = need.groupBy(*by, "_key").agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g"), (F.count("*") == F.max("_m")).alias("_all"))
    candidates = have.join(rarest.where("_all").drop("_all"), [*by, "_g"]).select(*by, "_id", "_key")
    pairs = candidates.join(texts, [*by, "_id"]).where(F.contains("_t", "_key"))
    found = cut_lineage(pairs.select(*by, "_id", F.col("_key").alias(key)), "found")
    return staged.hint("merge").join(found, [*by, "_id"]).select(*df.columns, key).join(keys, [*by, key])
