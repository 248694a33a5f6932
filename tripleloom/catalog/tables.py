"""Distinct and set operations, aggregates, metrics, windows (D, A, W)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.catalog.base import Tables, case, joined, sql_with
from tripleloom.catalog.joins import GOLD_COLUMNS, MATCHED_SQL, matched, sql_hash
from tripleloom.operators import aggregates, distinct, metrics, windows
from tripleloom.operators.joins import match_gold
from tripleloom.operators.numbering import placed
from tripleloom.plans import answering

# --- distinct and set operations ---------------------------------------------------------------


@case(
    "d01_drop_consecutive",
    sql_with(
        "SELECT doc_id, pos FROM (SELECT *, lag(object) OVER w AS po, lag(relation) OVER w AS pr FROM triples_v "
        "WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) x WHERE NOT coalesce(po = object AND pr = relation, false)",
        "triples_v",
    ),
)
def _(t: Tables) -> DataFrame:
    """An order has one subject, so relations take its place and repeats do occur."""
    rows = t.triples().select("doc_id", "pos", "object", F.col("relation").alias("subject"))
    return distinct.drop_consecutive(rows, ["doc_id"], ["pos"]).select("doc_id", "pos")


@case("d02_distinct_pairs", sql_with("SELECT * FROM pairs_v", "pairs_v"))
def _(t: Tables) -> DataFrame:
    return distinct.distinct_pairs(t.triples(), ["doc_id", "pos"], ["relation", "score", "cluster"])


@case(
    "d03_distinct_triples",
    sql_with(
        "SELECT subject, relation, object, score, cluster FROM (SELECT *, row_number() OVER (PARTITION BY subject, relation, object ORDER BY doc_id, pos) AS rn FROM triples_v) x WHERE rn = 1",
        "triples_v",
    ),
)
def _(t: Tables) -> DataFrame:
    return distinct.distinct_triples(t.triples(), ["doc_id", "pos"], ["score", "cluster"])


@case(
    "d04_distinct_structs",
    sql_with("SELECT DISTINCT subject, relation, object, score FROM triples_v", "triples_v"),
)
def _(t: Tables) -> DataFrame:
    """Within an order by the array form, across orders by a distinct. Written as a whole, so that the rows of a task do not grow
    with the lines in any of its shuffles.
    """
    triple = F.struct("subject", "relation", "object", "score")
    docs = t.triples().groupBy("doc_id").agg(F.collect_list(triple).alias("triples"))
    return t.stage("structs", lambda: docs.select(F.inline(distinct.distinct_structs(F.col("triples")))).distinct())


@case("d05_all_entities", sql_with("SELECT subject AS entity FROM triples_v UNION SELECT object FROM triples_v", "triples_v"))
def _(t: Tables) -> DataFrame:
    return distinct.all_entities(t.triples(), "subject", "object")


# The signs of the first eight dimensions make vectors that do repeat.
_SIGNS = "list_transform(embedding[1:8], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"


@case(
    "d06_unique_vectors",
    f"SELECT array_to_string({_SIGNS}, ',') AS vec, min(vec_id) AS vec_id FROM embeddings GROUP BY {_SIGNS}",
)
def _(t: Tables) -> DataFrame:
    signs = F.transform(F.slice("embedding", 1, 8), lambda x: F.when(x > 0, 1).otherwise(0))
    rows = t.embeddings.select("vec_id", signs.alias("vec"))
    return distinct.unique_vectors(rows, "vec", "vec_id").select(joined("vec").alias("vec"), "vec_id")


@case(
    "d07_common_keys",
    sql_with("SELECT CAST(cluster AS VARCHAR) AS key FROM pairs_v INTERSECT SELECT CAST(r_regionkey AS VARCHAR) FROM region", "pairs_v"),
)
def _(t: Tables) -> DataFrame:
    a = t.pairs().select(F.col("cluster").cast("string").alias("key"))
    return distinct.common_keys(a, t.region.select(F.col("r_regionkey").cast("string").alias("key")))


@case("d08_union_parts", sql_with(f"SELECT {', '.join(GOLD_COLUMNS)} FROM questions_v", "questions_v"))
def _(t: Tables) -> DataFrame:
    q = t.questions().select(*GOLD_COLUMNS)
    return distinct.union_parts([q.where(F.col("part") == p) for p in ("train", "valid", "test")])


# --- aggregates ---------------------------------------------------------------------------------


@case(
    "a01_value_counts",
    sql_with("SELECT subject, count(*) AS n FROM triples_v GROUP BY subject ORDER BY n DESC, subject LIMIT 100", "triples_v"),
)
def _(t: Tables) -> DataFrame:
    return aggregates.value_counts(t.triples(), "subject", 100)


_FORMATTED = "SELECT format('({})-[{}]->({}) <=> |{:.4f}|', subject, relation, object, score) AS triple FROM triples_v"


@case(
    "a02_most_common_triples",
    sql_with(
        "SELECT triple, count(*) AS n, (SELECT count(DISTINCT triple) FROM formatted_v) AS n_unique FROM formatted_v GROUP BY triple ORDER BY n DESC, triple LIMIT 100",
        "triples_v", formatted_v=_FORMATTED,
    ),
)
def _(t: Tables) -> DataFrame:
    return aggregates.most_common_triples(t.triples())


@case("a07_contingency", sql_with("SELECT label AS t, cluster AS p, count(*) AS n FROM assigned_v GROUP BY label, cluster", "assigned_v"))
def _(t: Tables) -> DataFrame:
    return metrics.contingency(t.assigned(), "label", "cluster")


# Scores compare the property of a gold question with its cluster, and vector labels with nearest centres.
def label_pairs(t: Tables) -> dict[str, DataFrame]:
    gold = matched(t)
    return {
        "gold": gold.select(F.col("property_decoded").alias("t"), F.col("cluster").alias("p")),
        "vectors": t.assigned().select(F.col("label").alias("t"), F.col("cluster").alias("p")),
    }


def both(t: Tables, score) -> DataFrame:
    parts = [score(df).withColumn("data", F.lit(name)) for name, df in label_pairs(t).items()]
    return distinct.union_parts(parts)


SCORE_VIEWS = dict(
    matched_v=MATCHED_SQL,
    labels_v="SELECT 'gold' AS data, property_decoded AS t, CAST(cluster AS VARCHAR) AS p FROM matched_v UNION ALL "
    "SELECT 'vectors', CAST(label AS VARCHAR), CAST(cluster AS VARCHAR) FROM assigned_v",
    cells_v="SELECT data, t, p, CAST(count(*) AS DOUBLE) AS n FROM labels_v GROUP BY data, t, p",
    t_v="SELECT data, t, sum(n) AS a FROM cells_v GROUP BY data, t",
    p_v="SELECT data, p, sum(n) AS b FROM cells_v GROUP BY data, p",
    n_v="SELECT data, sum(n) AS total FROM cells_v GROUP BY data",
    info_v="SELECT data, total, (SELECT -sum(a / total * ln(a / total)) FROM t_v WHERE t_v.data = n_v.data) AS ht, "
    "(SELECT -sum(b / total * ln(b / total)) FROM p_v WHERE p_v.data = n_v.data) AS hp, "
    "(SELECT sum(n / total * ln(n * total / (a * b))) FROM cells_v JOIN t_v USING (data, t) JOIN p_v USING (data, p) WHERE cells_v.data = n_v.data) AS mi FROM n_v",
)


def score_sql(body: str) -> str:
    return sql_with(body, "questions_v", "assigned_v", **SCORE_VIEWS)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select("data", *[F.round(n, 6).alias(n) for n in names])


@case(
    "a08_v_measure",
    score_sql(
        "SELECT data, round(mi / ht, 6) AS homogeneity, round(mi / hp, 6) AS completeness, round(2 * mi / (ht + hp), 6) AS v_measure FROM info_v"
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(both(t, lambda d: metrics.v_measure(d, "t", "p")), "homogeneity", "completeness", "v_measure")


@case("a09_nmi", score_sql("SELECT data, round(mi / ((ht + hp) / 2), 6) AS nmi FROM info_v"))
def _(t: Tables) -> DataFrame:
    return rounded(both(t, lambda d: metrics.nmi(d, "t", "p")), "nmi")


@case(
    "a10_ari",
    score_sql(
        "SELECT data, round((c - e) / ((ct + cp) / 2 - e), 6) AS ari FROM (SELECT data, c, ct, cp, ct * cp / (total * (total - 1) / 2) AS e FROM "
        "(SELECT data, total, (SELECT sum(n * (n - 1) / 2) FROM cells_v WHERE cells_v.data = n_v.data) AS c, "
        "(SELECT sum(a * (a - 1) / 2) FROM t_v WHERE t_v.data = n_v.data) AS ct, "
        "(SELECT sum(b * (b - 1) / 2) FROM p_v WHERE p_v.data = n_v.data) AS cp FROM n_v) x) y"
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(both(t, lambda d: metrics.ari(d, "t", "p")), "ari")


_EMI = (
    "SELECT data, sum(x / total * ln(total * x / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(total - a + 1) + lgamma(total - b + 1) "
    "- lgamma(total + 1) - lgamma(x + 1) - lgamma(a - x + 1) - lgamma(b - x + 1) - lgamma(total - a - b + x + 1))) AS emi FROM "
    "(SELECT data, a, b, total, CAST(unnest(range(CAST(greatest(1, a + b - total) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS DOUBLE) AS x "
    "FROM t_v JOIN p_v USING (data) JOIN n_v USING (data)) y GROUP BY data"
)


@case(
    "a11_ami",
    score_sql(f"SELECT data, round(emi, 6) AS emi, round((mi - emi) / ((ht + hp) / 2 - emi), 6) AS ami FROM info_v JOIN ({_EMI}) e USING (data)"),
)
def _(t: Tables) -> DataFrame:
    return rounded(both(t, lambda d: metrics.ami(d, "t", "p")), "emi", "ami")


def _assignment_sql() -> str:
    """Best one-to-one mapping of ten clusters to ten labels, label by label over used-cluster masks."""
    views = {"w_v": "SELECT label AS t, cluster AS p, count(*) AS n FROM assigned_v GROUP BY label, cluster"}
    previous = "(SELECT 0 AS mask, CAST(0 AS BIGINT) AS best)"
    for label in range(10):
        views[f"f{label}_v"] = (
            f"SELECT f.mask + (1 << c.p) AS mask, max(f.best + coalesce(w.n, 0)) AS best FROM {previous} f "
            "JOIN (SELECT CAST(unnest(range(0, 10)) AS INT) AS p) c ON (f.mask >> c.p) % 2 = 0 "
            f"LEFT JOIN w_v w ON w.t = {label} AND w.p = c.p GROUP BY 1"
        )
        previous = f"f{label}_v"
    return sql_with(
        f"SELECT max(best) AS matched, (SELECT count(*) FROM assigned_v) AS total, round(max(best) / (SELECT count(*) FROM assigned_v), 6) AS accuracy FROM {previous}",
        "assigned_v", **views,
    )


@case("a12_clustering_accuracy", _assignment_sql())
def _(t: Tables) -> DataFrame:
    found = metrics.clustering_accuracy(t.assigned(), "label", "cluster")
    return found.select("matched", "total", F.round("accuracy", 6).alias("accuracy"))


def report_sql(source: str, *views: str, **extra: str) -> str:
    """Precision, recall and F1 from label pairs (t, p)."""
    per = (
        "SELECT CAST(l AS VARCHAR) AS label, CASE WHEN np > 0 THEN hit / np ELSE 0 END AS precision, CASE WHEN nt > 0 THEN hit / nt ELSE 0 END AS recall, "
        "CASE WHEN np + nt > 0 THEN 2 * hit / (np + nt) ELSE 0 END AS f1, nt AS support, hit FROM (SELECT l, "
        "(SELECT count(*) FROM pairs_tp WHERE t = l) AS nt, (SELECT count(*) FROM pairs_tp WHERE p = l) AS np, "
        "(SELECT count(*) FROM pairs_tp WHERE p = l AND t = l) AS hit FROM (SELECT t AS l FROM pairs_tp UNION SELECT p FROM pairs_tp) u) v"
    )
    body = (
        "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM ("
        "SELECT label, precision, recall, f1, support FROM per_v UNION ALL "
        "SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM per_v UNION ALL "
        "SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per_v UNION ALL "
        "SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM per_v) z"
    )
    return sql_with(body, *views, **extra, pairs_tp=source, per_v=per)


def round_report(report: DataFrame) -> DataFrame:
    return report.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@case("a13_classification_report", report_sql("SELECT label AS t, cluster AS p FROM assigned_v", "assigned_v"))
def _(t: Tables) -> DataFrame:
    return round_report(metrics.classification_report(t.assigned(), "label", "cluster"))


@case(
    "a15_confusion_matrix",
    sql_with(
        "SELECT t, p, n, round(100 * n / total, 6) AS percent, CAST(ord AS INT) AS ord FROM cells_v JOIN (SELECT t, sum(n) AS total, "
        "row_number() OVER (ORDER BY round(100.0 * sum(CASE WHEN t = p THEN n ELSE 0 END) / sum(n), 9) DESC, t) AS ord FROM cells_v GROUP BY t) r USING (t)",
        "assigned_v", cells_v="SELECT label AS t, cluster AS p, count(*) AS n FROM assigned_v GROUP BY label, cluster",
    ),
)
def _(t: Tables) -> DataFrame:
    matrix = metrics.confusion_matrix(t.assigned(), "label", "cluster")
    return matrix.withColumn("percent", F.round("percent", 6))


_LISTS = (
    "SELECT list_filter(x.own, lambda v: list_contains(x.pred, v)) AS c1, list_filter(x.pred, lambda v: list_contains(x.own, v)) AS c2, own, pred FROM "
    "(SELECT m.assigned AS own, [(q.cluster + 1) % 10, (q.cluster + 2) % 10] AS pred FROM matched_v q JOIN multi_v m USING (property_decoded)) x"
)
_MULTI_LIST = (
    "SELECT property_decoded, list(cluster ORDER BY cluster) AS assigned FROM (SELECT DISTINCT property_decoded, cluster FROM matched_v WHERE cluster IS NOT NULL) x GROUP BY property_decoded"
)


def label_lists(t: Tables) -> DataFrame:
    """Assigned: the clusters of the property; predicted: the two after the question's own, which the property may lack."""
    gold = matched(t)
    mapping = aggregates.property_to_cluster_multi(gold.where("cluster IS NOT NULL"))
    return gold.join(mapping, "property_decoded").select(
        F.split("assigned", " ").cast("array<int>").alias("own"),
        F.array((F.col("cluster") + 1) % 10, (F.col("cluster") + 2) % 10).alias("pred"),
    )


@case(
    "a16_multilabel_overlap_eval",
    report_sql(
        "SELECT coalesce(c1[1], own[1]) AS t, coalesce(c2[1], pred[1]) AS p FROM lists_v",
        "questions_v", matched_v=MATCHED_SQL, multi_v=_MULTI_LIST, lists_v=_LISTS,
    ),
)
def _(t: Tables) -> DataFrame:
    return round_report(metrics.multilabel_overlap_eval(label_lists(t), "own", "pred"))


@case(
    "a17_precision_recall_at_k",
    sql_with(
        "SELECT count(*) AS n, round(sum(len(c1)) / sum(len(pred)), 6) AS precision_at_k, round(sum(len(c1)) / sum(len(own)), 6) AS recall_at_k FROM lists_v",
        "questions_v", matched_v=MATCHED_SQL, multi_v=_MULTI_LIST, lists_v=_LISTS,
    ),
)
def _(t: Tables) -> DataFrame:
    scores = metrics.precision_recall_at_k(label_lists(t), "own", "pred", 3)
    return scores.select("n", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k")])


@case(
    "a19_cluster_profile",
    sql_with(
        "SELECT cluster, count(*) AS n, count(DISTINCT relation) AS n_relations, (SELECT count(DISTINCT cluster) FROM pairs_v) AS n_clusters FROM pairs_v GROUP BY cluster",
        "pairs_v",
    ),
)
def _(t: Tables) -> DataFrame:
    return aggregates.cluster_profile(t.pairs())


@case(
    "a20_score_histogram",
    sql_with(
        "SELECT CAST(least(greatest(floor((score - 0.01) / ((0.09 - 0.01) / 7)), 0), 6) AS INT) AS bin, count(*) AS n FROM triples_v GROUP BY bin",
        "triples_v",
    ),
)
def _(t: Tables) -> DataFrame:
    return aggregates.score_histogram(t.triples(), 7, 0.01, 0.09)


@case(
    "a21_retention_report",
    sql_with(
        "SELECT q.part, count(*) AS n_before, count(p.subject) AS n_after, round(100.0 * count(p.subject) / count(*), 6) AS percent_kept FROM questions_v q "
        "LEFT JOIN pairs_v p ON q.subject_decoded = p.subject AND q.object_decoded = p.object GROUP BY q.part",
        "questions_v",
    ),
)
def _(t: Tables) -> DataFrame:
    gold = answering.normalized_gold(t.questions())
    return aggregates.retention_report(gold, match_gold(gold, t.pairs()))


_DIMS = "SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, 64)) AS dim FROM embeddings"


@case(
    "a22_column_mean",
    sql_with(
        "SELECT -1 AS label, CAST(dim AS INT) AS dim, round(avg(x), 6) AS mean FROM dims_v GROUP BY dim UNION ALL "
        "SELECT label, CAST(dim AS INT), round(avg(x), 6) FROM dims_v GROUP BY label, dim",
        dims_v=_DIMS,
    ),
)
def _(t: Tables) -> DataFrame:
    rows = t.embeddings.withColumnRenamed("embedding", "vec")
    whole = aggregates.column_mean(rows).select(F.lit(-1).alias("label"), "mean")
    means = whole.unionByName(aggregates.column_mean(rows, by=["label"]))
    return means.select("label", F.posexplode("mean").alias("dim", "mean")).withColumn("mean", F.round("mean", 6))


@case("a23_predicate_counts", sql_with("SELECT cluster, relation, count(*) AS n FROM triples_v GROUP BY cluster, relation", "triples_v"))
def _(t: Tables) -> DataFrame:
    return aggregates.predicate_counts(t.triples())


# --- windows and sampling -----------------------------------------------------------------------


@case(
    "w01_top_per_cluster",
    sql_with(
        "SELECT cluster, subject, relation, object, score, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, subject, relation, object) AS rn FROM pairs_v) x WHERE rn <= 999",
        "pairs_v",
    ),
)
def _(t: Tables) -> DataFrame:
    return windows.top_per_cluster(t.pairs(), 999)


@case(
    "w02_sample_per_cluster",
    sql_with(
        "SELECT cluster, subject, object FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY "
        + sql_hash("subject", "object", "'42'")
        + ", subject, object) AS rn FROM pairs_v) x WHERE rn <= 10",
        "pairs_v",
    ),
)
def _(t: Tables) -> DataFrame:
    return windows.sample_per_cluster(t.pairs(), ["subject", "object"], 10).select("cluster", "subject", "object")


@case(
    "w03_split_60_20_20",
    "SELECT doc_id, source, CASE WHEN no <= tr THEN 'train' WHEN no <= tr + floor((n - tr) / 2) THEN 'dev' ELSE 'test' END AS part FROM "
    "(SELECT doc_id, source, dense_rank() OVER (ORDER BY source) AS no, (SELECT count(DISTINCT source) FROM documents) AS n, "
    "floor(0.6 * (SELECT count(DISTINCT source) FROM documents)) AS tr FROM documents) x",
)
def _(t: Tables) -> DataFrame:
    """Document sources stand for files."""
    return windows.split_60_20_20(t.documents.select("doc_id", "source"), "source")


@case(
    "w04_shuffle_rows",
    "SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS place FROM (SELECT doc_id, "
    + sql_hash("CAST(doc_id AS VARCHAR)", "'42'")
    + " AS h FROM documents) x",
)
def _(t: Tables) -> DataFrame:
    """The place that each row really has in the shuffled output."""
    return placed(windows.shuffle_rows(t.documents.select("doc_id"), ["doc_id"]))


@case(
    "w05_sort_by_score",
    sql_with(
        "SELECT * FROM (SELECT 'score' AS list, subject, relation, object, score, cluster FROM pairs_v ORDER BY score DESC, subject, relation, object LIMIT 500) a "
        "UNION ALL SELECT * FROM (SELECT 'cluster', subject, relation, object, score, cluster FROM pairs_v ORDER BY cluster, subject, relation, object LIMIT 500) b",
        "pairs_v",
    ),
)
def _(t: Tables) -> DataFrame:
    columns = ["subject", "relation", "object", "score", "cluster"]
    first = windows.sort_by_score(t.pairs(), 500).select(F.lit("score").alias("list"), *columns)
    second = windows.sort_by_cluster(t.pairs(), 500).select(F.lit("cluster").alias("list"), *columns)
    return first.unionByName(second)


@case(
    "w06_oversample_to_second",
    sql_with(
        "SELECT 'original' AS kind, event_id, event_type FROM events UNION ALL SELECT 'drawn', event_id, event_type FROM "
        "(SELECT event_type, " + sql_hash("event_type", "CAST(i AS VARCHAR)", "'42'") + " % size + 1 AS rn FROM "
        "(SELECT event_type, size, unnest(range(1, t + 1)) AS i FROM sizes_v, t_v WHERE size < t) d) e JOIN "
        "(SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) p USING (event_type, rn)",
        sizes_v="SELECT event_type, count(*) AS size FROM events GROUP BY event_type",
        t_v="SELECT size AS t FROM sizes_v ORDER BY size DESC LIMIT 1 OFFSET 1",
    ),
)
def _(t: Tables) -> DataFrame:
    out = windows.oversample_to_second(t.events.select("event_id", "event_type"), "event_type", "event_id")
    return out.select(F.when(F.col("drawn"), "drawn").otherwise("original").alias("kind"), "event_id", "event_type")


def sql_unit(mark: str) -> str:
    return sql_hash("CAST(event_id AS VARCHAR)", f"'{mark}42'") + " / 1152921504606846976.0::DOUBLE"


@case(
    "w07_random_labels",
    "SELECT event_id, CAST(floor(u * 41) AS INT) AS cluster_uniform, CAST(floor(e / max(e) OVER () * 40) AS INT) AS cluster_exp FROM "
    f"(SELECT event_id, {sql_unit('u')} AS u, -0.4::DOUBLE * ln(1.0::DOUBLE - {sql_unit('e')}) AS e FROM events) x",
)
def _(t: Tables) -> DataFrame:
    drawn = windows.random_uniform_labels(t.events.select("event_id"), ["event_id"], 40)
    return windows.random_exp_labels(drawn, ["event_id"], 40).select("event_id", "cluster_uniform", "cluster_exp")


@case(
    "w08_interleave_labelled",
    sql_with(
        "SELECT vec_id, block, pos, false AS labelled FROM rows_v UNION ALL SELECT m.vec_id, b.block, b.size + m.i - 1, true FROM "
        "(SELECT block, count(*) AS size FROM rows_v GROUP BY block) b CROSS JOIN marks_v m",
        rows_v="SELECT vec_id, (no - 1) // 64 AS block, (no - 1) % 64 AS pos FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS no FROM embeddings WHERE label > 0) x",
        marks_v="SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings WHERE label = 0",
    ),
)
def _(t: Tables) -> DataFrame:
    """Vectors of label 0 play the labelled ones."""
    rows = t.embeddings.where("label > 0").select("vec_id")
    marks = t.embeddings.where("label = 0").select("vec_id")
    return windows.interleave_labelled(rows, marks, "vec_id", 64).select("vec_id", "block", "pos", "labelled")


@case("w09_split_labelled", "SELECT vec_id, CASE WHEN label > 0 THEN 'labelled' ELSE 'rest' END AS side FROM embeddings")
def _(t: Tables) -> DataFrame:
    marked, rest = windows.split_labelled(t.embeddings)
    return marked.select("vec_id", F.lit("labelled").alias("side")).unionByName(
        rest.select("vec_id", F.lit("rest").alias("side"))
    )
