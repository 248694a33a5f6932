"""Clustering, classifiers and streams (M, X)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.catalog.base import Tables, case, joined, sql_with
from tripleloom.catalog.bayes import nb_views
from tripleloom.catalog.joins import matched
from tripleloom.catalog.syntax import BASIC_COLUMNS, BASIC_SQL, plain_sql
from tripleloom.operators import classify, cluster, many_models, metrics
from tripleloom.operators.dense import center_matrix, nearest_center
from tripleloom.operators.distinct import union_parts
from tripleloom.plans import clustering, features
from tripleloom.session import scratch_path
from tripleloom.sources.writers import write_annotations
from tripleloom.streaming import jobs


def points(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.col("embedding").alias("vec"))


def per_center(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """An array with one value per centre, in long form."""
    return df.select(*keys, F.posexplode(column).alias("center_id", column)).withColumn(column, F.round(column, 6))


def d2(a: str, b: str) -> str:
    return (
        f"list_sum(list_transform(list_zip({a}, {b}), lambda z: power(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))"
    )


SOFT = dict(
    d_v=f"SELECT vec_id, label, center_id, {d2('embedding', 'center')} AS d FROM embeddings CROSS JOIN centers_v",
    q_v="SELECT vec_id, label, center_id, d, (1 / (1 + d)) / sum(1 / (1 + d)) OVER (PARTITION BY vec_id) AS q FROM d_v",
    f_v="SELECT center_id, sum(q) AS f FROM q_v GROUP BY center_id",
    p_v="SELECT vec_id, label, center_id, d, q, (q * q / f) / sum(q * q / f) OVER (PARTITION BY vec_id) AS p FROM q_v JOIN f_v USING (center_id)",
)


def soft_sql(body: str, **more: str) -> str:
    return sql_with(body, "centers_v", "assigned_v", **SOFT, **more)


@case("j20_nearest_center", sql_with("SELECT vec_id, label, cluster, round(d2, 6) AS d2 FROM assigned_v", "assigned_v"))
def _(t: Tables) -> DataFrame:
    return t.assigned().withColumn("d2", F.round("d2", 6))


# --- library models (checked by rows and unit tests) ---------------------------------------------


@case("m01_kmeans")
def _(t: Tables) -> DataFrame:
    model = cluster.kmeans(points(t), 10)
    return cluster.kmeans_labels(points(t), model).select("vec_id", "label", "cluster")


@case("m02_kmeans_sweep")
def _(t: Tables) -> DataFrame:
    """Every k from three starts: all parts of the vector, the arguments alone, the predicate alone."""
    starts = {part: cluster.partial_init(three_parts(t), part) for part in ("arguments", "predicate")}
    rows = points(t)
    for part, masked in starts.items():
        flat = clustering.with_single(masked).select("vec_id", F.col("vec").alias(part))
        rows = rows.join(flat, "vec_id")
    return clustering.kmeans_sweep(rows, "label", starts={"all": "vec", "arguments": "arguments", "predicate": "predicate"})


def three_models(t: Tables) -> list[np.ndarray]:
    """The given centres, and two smaller models: every second and every third of them."""
    _, matrix = center_matrix(t.centers())
    return [matrix[::step] for step in (1, 2, 3)]


_MODELS = dict(
    each_v="SELECT CAST(m AS INT) AS model, CAST(center_id // (m + 1) AS INT) AS center_id, center FROM centers_v, (SELECT unnest(range(0, 3)) AS m) WHERE center_id % (m + 1) = 0",
    near_v=f"SELECT model, vec_id, label, center_id, d, embedding FROM (SELECT model, vec_id, label, center_id, embedding, round({d2('embedding', 'center')}, 9) AS d, "
    f"row_number() OVER (PARTITION BY model, vec_id ORDER BY round({d2('embedding', 'center')}, 9), center_id) AS rn FROM embeddings CROSS JOIN each_v) x WHERE rn = 1",
)


@case(
    "m02_lloyd_step",
    sql_with(
        "SELECT model, center_id, CAST(dim AS INT) AS dim, count(*) AS n, round(sum(d), 4) AS cost, round(avg(z), 6) AS mean FROM (SELECT model, center_id, d, "
        "CAST(unnest(embedding) AS DOUBLE) AS z, unnest(range(0, 64)) AS dim FROM near_v) x GROUP BY model, center_id, dim",
        "centers_v", **_MODELS,
    ),
)
def _(t: Tables) -> DataFrame:
    """One round of three models at once."""
    sums = many_models.lloyd_sums(points(t), three_models(t))
    return sums.select("model", "center_id", F.posexplode("total").alias("dim", "s"), "n", F.round("cost", 4).alias("cost")).select(
        "model", "center_id", "dim", "n", "cost", F.round(F.col("s") / F.col("n"), 6).alias("mean")
    )


_H = "(SELECT model, -sum(n / m * ln(n / m)) AS h FROM (SELECT model, {0}, count(*)::DOUBLE AS n, (SELECT count(*) FROM embeddings)::DOUBLE AS m FROM near_v GROUP BY model, {0}) g GROUP BY model)"


@case(
    "m02_model_scores",
    sql_with(
        "SELECT model, round(2 * (t.h + p.h - j.h) / (t.h + p.h), 6) AS v_measure FROM "
        + _H.format("label") + " t JOIN " + _H.format("center_id") + " p USING (model) JOIN " + _H.format("label, center_id") + " j USING (model)",
        "centers_v", **_MODELS,
    ),
)
def _(t: Tables) -> DataFrame:
    """Three models scored from one contingency table."""
    table = many_models.contingencies(points(t), "label", three_models(t))
    return metrics.model_scores(table).select("model", F.round("v_measure", 6).alias("v_measure"))


def flat_points(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.slice("embedding", 1, 2).cast("array<double>").alias("vec"))


# Three components given in closed form, so that one step can be written out in two dimensions.
_MIX = [(0.5, -0.1, 0.0, 0.04, 0.01, 0.03), (0.3, 0.1, 0.1, 0.02, 0.0, 0.05), (0.2, 0.0, -0.15, 0.06, -0.02, 0.02)]
_EM = dict(
    mix_v="SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(f'{x}::DOUBLE' for x in m)})" for i, m in enumerate(_MIX)) + ") v(component, w, m1, m2, a, b, c)",
    x_v="SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings",
    den_v="SELECT vec_id, component, x, y, w * exp(-0.5 * (c * (x - m1) * (x - m1) - 2 * b * (x - m1) * (y - m2) + a * (y - m2) * (y - m2)) / (a * c - b * b)) "
    "/ (2 * pi() * sqrt(a * c - b * b)) AS f FROM x_v CROSS JOIN mix_v",
    share_v="SELECT vec_id, component, x, y, f / sum(f) OVER (PARTITION BY vec_id) AS r, ln(sum(f) OVER (PARTITION BY vec_id)) AS l FROM den_v",
    mean_v="SELECT component, sum(r) AS n, sum(r * x) / sum(r) AS m1, sum(r * y) / sum(r) AS m2, avg(l) AS score FROM share_v GROUP BY component",
)


@case(
    "m03_em_step",
    sql_with(
        "SELECT CAST(component AS INT) AS component, round(n / (SELECT count(*) FROM embeddings), 6) AS weight, round(any_value(m1), 6) AS m1, round(any_value(m2), 6) AS m2, "
        "round(sum(r * (x - m1) * (x - m1)) / n + 1e-6, 6) AS c11, round(sum(r * (x - m1) * (y - m2)) / n, 6) AS c12, round(sum(r * (y - m2) * (y - m2)) / n + 1e-6, 6) AS c22, "
        "round(any_value(score), 6) AS score FROM share_v JOIN mean_v USING (component) GROUP BY component, n",
        **_EM,
    ),
)
def _(t: Tables) -> DataFrame:
    """One step of a mixture of three components with full covariances."""
    flat = flat_points(t)
    given = many_models.Mixture(
        np.array([m[0] for m in _MIX]), np.array([m[1:3] for m in _MIX]), np.array([[[a, b], [b, c]] for *_, a, b, c in _MIX])
    )
    (m,) = many_models.em_round(flat, [given], flat.count())
    rows = [
        (i, *[round(float(x), 6) for x in (m.weights[i], *m.means[i], m.covariances[i][0, 0], m.covariances[i][0, 1], m.covariances[i][1, 1], m.score)])
        for i in range(len(_MIX))
    ]
    return t.spark.createDataFrame(rows, "component int, weight double, m1 double, m2 double, c11 double, c12 double, c22 double, score double")


@case("m03_gmm")
def _(t: Tables) -> DataFrame:
    """Mixture means as centres; closeness in its own, not inverted form."""
    reduced = cluster.latent(points(t), 8).drop("vec")
    means = cluster.gmm(reduced, 5, "latent")
    assigned = nearest_center(reduced, means, "latent")
    return cluster.closeness(assigned, means, "latent", invert=False).select("vec_id", "cluster", "score")


# --- soft assignment ----------------------------------------------------------------------------


@case("m04_soft_assign", soft_sql("SELECT vec_id, CAST(center_id AS INT) AS center_id, round(q, 6) AS q FROM q_v"))
def _(t: Tables) -> DataFrame:
    return per_center(cluster.soft_assign(points(t), t.centers()), "q", "vec_id")


def with_targets(t: Tables) -> DataFrame:
    return cluster.target_distribution(cluster.soft_assign(points(t), t.centers()))


@case("m05_target_distribution", soft_sql("SELECT vec_id, CAST(center_id AS INT) AS center_id, round(p, 6) AS p FROM p_v"))
def _(t: Tables) -> DataFrame:
    return per_center(with_targets(t), "p", "vec_id")


@case("m06_kl_loss", soft_sql("SELECT round(avg(kl), 6) AS kl FROM (SELECT vec_id, sum(p * ln(p / q)) AS kl FROM p_v GROUP BY vec_id) x"))
def _(t: Tables) -> DataFrame:
    return cluster.kl_loss(with_targets(t)).withColumn("kl", F.round("kl", 6))


@case(
    "m07_hard_assign",
    soft_sql("SELECT vec_id, CAST(center_id AS INT) AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, center_id) AS rn FROM q_v) x WHERE rn = 1"),
)
def _(t: Tables) -> DataFrame:
    soft = cluster.soft_assign(points(t), t.centers())
    return soft.select("vec_id", cluster.hard_assign("q").alias("cluster"))


@case(
    "m08_closeness",
    soft_sql("SELECT vec_id, cluster, round(1 - sqrt(d2) / (SELECT max(sqrt(d2)) FROM assigned_v), 6) AS score FROM assigned_v"),
)
def _(t: Tables) -> DataFrame:
    assigned = nearest_center(points(t), t.centers())
    scored = cluster.closeness(assigned, t.centers())
    return scored.select("vec_id", "cluster", F.round("score", 6).alias("score"))


@case(
    "m09_label_change",
    soft_sql("SELECT round(avg(CASE WHEN label <> cluster THEN 1.0 ELSE 0.0 END), 6) AS changed FROM assigned_v"),
)
def _(t: Tables) -> DataFrame:
    """From the label to the nearest centre."""
    old = t.embeddings.select("vec_id", F.col("label").alias("cluster"))
    return cluster.label_change(old, t.assigned(), "vec_id").withColumn("changed", F.round("changed", 6))


def matrix_frame(t: Tables, matrix: np.ndarray, name: str) -> DataFrame:
    frame = cluster.centers_frame(t.spark, np.arange(len(matrix)), matrix)
    return frame.select("center_id", F.posexplode("center").alias("dim", name)).withColumn(name, F.round(name, 6))


_PULL = (
    "SELECT CAST(center_id AS INT) AS center_id, CAST(dim AS INT) AS dim, round(sum(2 * (p - q) / (1 + d) * (z - c)), 6) AS direction FROM "
    "(SELECT center_id, p, q, d, CAST(unnest(embedding) AS DOUBLE) AS z, CAST(unnest(center) AS DOUBLE) AS c, unnest(range(0, 64)) AS dim "
    "FROM p_v JOIN embeddings USING (vec_id) JOIN centers_v USING (center_id)) x GROUP BY center_id, dim"
)


@case("m10_refine_step", soft_sql(_PULL))
def _(t: Tables) -> DataFrame:
    """One direction of every centre, targets from the same centres."""
    _, matrix = center_matrix(t.centers())
    freq = cluster.frequency(points(t), "vec", matrix)
    direction, _, _ = cluster.refine_step(points(t), "vec", matrix, matrix, freq)
    return matrix_frame(t, direction, "direction")


@case("m10_refine_centers")
def _(t: Tables) -> DataFrame:
    """The loop: mean KL per iteration."""
    _, history = cluster.refine_centers(points(t), t.centers())
    return t.spark.createDataFrame(list(enumerate(history)), "iteration int, kl double")


_MEANS = (
    "SELECT CAST(cluster AS INT) AS center_id, CAST(dim AS INT) AS dim, avg(z) AS m FROM (SELECT cluster, CAST(unnest(embedding) AS DOUBLE) AS z, "
    "unnest(range(0, 64)) AS dim FROM assigned_v JOIN embeddings USING (vec_id)) x GROUP BY cluster, dim"
)


@case("m11_lloyd_step", soft_sql(f"SELECT center_id, dim, round(m, 6) AS mean FROM ({_MEANS}) y"))
def _(t: Tables) -> DataFrame:
    _, matrix = center_matrix(t.centers())
    means, _ = cluster.lloyd_step(points(t), "vec", matrix, None)
    return matrix_frame(t, means, "mean")


@case("m11_alternate_kmeans")
def _(t: Tables) -> DataFrame:
    rows, _ = cluster.alternate_kmeans(points(t), t.centers())
    return rows.select("vec_id", "label", "cluster")


_ADMM = dict(
    y_v="SELECT vec_id, cluster, list_transform(list_zip(center, embedding), lambda z: (0.1::DOUBLE * z[1] + z[2]) / 1.1::DOUBLE) AS y, embedding FROM assigned_v JOIN embeddings USING (vec_id) JOIN centers_v ON cluster = center_id",
    c_v="SELECT cluster AS center_id, list(m ORDER BY dim) AS center FROM (SELECT cluster, dim, avg(v) AS m FROM (SELECT cluster, unnest(y) AS v, unnest(range(0, 64)) AS dim FROM y_v) x GROUP BY cluster, dim) z GROUP BY cluster",
    n_v=f"SELECT vec_id, c_v.center_id AS moved, y, embedding, row_number() OVER (PARTITION BY vec_id ORDER BY round({d2('y', 'c_v.center')}, 9), c_v.center_id) AS rn FROM y_v CROSS JOIN c_v",
)


@case(
    "m12_admm_step",
    soft_sql(
        "SELECT vec_id, CAST(moved AS INT) AS cluster, round(list_sum(y), 6) AS y, "
        "round(list_sum(list_transform(list_zip(y, embedding), lambda z: z[1] - CAST(z[2] AS DOUBLE))), 6) AS u FROM n_v WHERE rn = 1",
        **_ADMM,
    ),
)
def _(t: Tables) -> DataFrame:
    rows, _ = cluster.admm_kmeans(points(t).drop("label"), t.centers(), max_epochs=1)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6).alias(c)
    return rows.select("vec_id", "cluster", total("y"), total("u"))


@case("m12_admm_kmeans")
def _(t: Tables) -> DataFrame:
    rows, _ = cluster.admm_kmeans(points(t).drop("label"), t.centers())
    return rows.select("vec_id", "cluster")


@case(
    "m13_standardize",
    "SELECT vec_id, CAST(dim AS INT) AS dim, round((x - m) / s, 6) AS scaled FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, 64)) AS dim FROM embeddings) a "
    "JOIN (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, 64)) AS dim FROM embeddings WHERE label > 2) b GROUP BY dim) c USING (dim)",
)
def _(t: Tables) -> DataFrame:
    """Fitted on the rows without seed label, applied to all."""
    scaled = cluster.standardize(points(t), points(t).where("label > 2"))
    return scaled.select("vec_id", F.posexplode("scaled").alias("dim", "scaled")).withColumn("scaled", F.round("scaled", 6))


@case("m14_latent")
def _(t: Tables) -> DataFrame:
    code = cluster.latent(points(t), 8)
    return code.select("vec_id", F.posexplode("latent").alias("dim", "value"))


def three_parts(t: Tables) -> DataFrame:
    """A vector cut into subject, object and relation parts."""
    part = lambda start, size: F.slice("embedding", start, size)
    return t.embeddings.select(
        "vec_id", part(1, 20).alias("subject_matr"), part(21, 20).alias("object_matr"), part(41, 24).alias("relation_matr")
    )


def sql_part(a: int, b: int) -> str:
    return f"round(list_sum(list_transform(embedding[{a}:{b}], lambda x: CAST(x AS DOUBLE))), 4)"


@case(
    "m15_partial_init",
    f"SELECT 'arguments' AS part, vec_id, 0.0::DOUBLE AS s, 0.0::DOUBLE AS o, {sql_part(41, 64)} AS r FROM embeddings UNION ALL "
    f"SELECT 'predicate', vec_id, {sql_part(1, 20)}, {sql_part(21, 40)}, (SELECT round(sum(m), 4) FROM (SELECT dim, avg(x) AS m FROM "
    "(SELECT CAST(unnest(embedding[41:64]) AS DOUBLE) AS x, unnest(range(0, 24)) AS dim FROM embeddings) y GROUP BY dim) z) FROM embeddings",
)
def _(t: Tables) -> DataFrame:
    total = lambda c: F.round(F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 4)
    parts = [
        cluster.partial_init(three_parts(t), part).select(
            F.lit(part).alias("part"), "vec_id", total("subject_matr").alias("s"), total("object_matr").alias("o"),
            total("relation_matr").alias("r"),
        )
        for part in ("arguments", "predicate")
    ]
    return union_parts(parts)


@case("m16_init_centers")
def _(t: Tables) -> DataFrame:
    code = cluster.latent(points(t), 8).select("vec_id", "latent")
    centers = cluster.init_centers(code, 10, "latent", "vec_id")
    return centers.select("center_id", F.posexplode("center").alias("dim", "value"))


@case(
    "m17_seed_centers",
    sql_with(
        "SELECT CAST(c.center_id AS INT) AS center_id, round(list_sum(list_transform(coalesce(s.embedding, c.center), lambda x: CAST(x AS DOUBLE))), 4) AS total FROM centers_v c LEFT JOIN "
        "(SELECT label, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rn FROM embeddings WHERE label BETWEEN 1 AND 4) x WHERE rn = 1) s ON s.label = c.center_id",
        "centers_v",
    ),
)
def _(t: Tables) -> DataFrame:
    """Labels 1 to 4 are the seed groups, the highest id comes first."""
    labelled = points(t).where("label <= 4").withColumn("ord", -F.col("vec_id"))
    seeded = cluster.seed_centers(t.centers(), labelled, "vec", "ord")
    total = F.aggregate("center", F.lit(0.0), lambda a, x: a + x)
    return seeded.select(F.col("center_id").cast("int").alias("center_id"), F.round(total, 4).alias("total"))


@case(
    "m18_seed_agreement",
    sql_with(
        "SELECT sum(n * (n - 1) / 2) AS together, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM assigned_v WHERE label > 0 GROUP BY label) b) AS pairs, "
        "round(sum(n * (n - 1) / 2) / (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM assigned_v WHERE label > 0 GROUP BY label) b), 6) AS agreement FROM "
        "(SELECT count(*) AS n FROM assigned_v WHERE label > 0 GROUP BY label, cluster) a",
        "assigned_v",
    ),
)
def _(t: Tables) -> DataFrame:
    return cluster.seed_agreement(t.assigned()).withColumn("agreement", F.round("agreement", 6))


@case(
    "m19_supervised_loss",
    soft_sql(
        "SELECT round(mse, 6) AS mse, round(kl, 6) AS kl, round(0.7 * mse + 0.3 * kl, 6) AS loss FROM (SELECT "
        "(SELECT avg(e) FROM (SELECT vec_id, avg(power(q - CASE WHEN center_id = label THEN 1 ELSE 0 END, 2)) AS e FROM p_v WHERE label IN (1, 2) GROUP BY vec_id) x) AS mse, "
        "(SELECT avg(k) FROM (SELECT vec_id, sum(p * ln(p / q)) AS k FROM p_v WHERE label NOT IN (1, 2) GROUP BY vec_id) y) AS kl) z"
    ),
)
def _(t: Tables) -> DataFrame:
    """Labels 1 and 2 are seeds."""
    rows = with_targets(t).withColumn("label", F.when(F.col("label").isin(1, 2), F.col("label")).otherwise(0))
    return cluster.supervised_loss(rows).select(*[F.round(c, 6).alias(c) for c in ("mse", "kl", "loss")])


# --- question classifiers ---------------------------------------------------------------------


def training(t: Tables, part: str) -> DataFrame:
    gold = matched(t).where(F.col("part") == part)
    return gold.select("question", F.col("cluster").alias("label"))


@case("m20_question_classifier")
def _(t: Tables) -> DataFrame:
    model = classify.question_classifier(
        training(t, "train"), training(t, "valid")
    )
    return classify.classify(model, training(t, "test").select("question").distinct())


@case("m24_save_load_model")
def _(t: Tables) -> DataFrame:
    """A classifier saved, loaded and used."""
    model = classify.question_classifier(
        training(t, "train"), training(t, "valid")
    )
    path = scratch_path(t.spark, "models/clusters_10_max")
    classify.save_model(model, path)
    return classify.classify(classify.load_model(path), training(t, "test").select("question").distinct())


_PAIR_CLUSTER = (
    "SELECT q.question, p.cluster AS label FROM questions_v q JOIN pairs_v p ON (q.subject_decoded = p.subject AND q.object_decoded = p.object) WHERE q.part = '{0}' "
    "UNION ALL SELECT q.question, p.cluster FROM questions_v q JOIN pairs_v p ON (q.subject_decoded = p.object AND q.object_decoded = p.subject) WHERE q.part = '{0}'"
)
NB = nb_views(_PAIR_CLUSTER.format("train"), "SELECT DISTINCT question FROM questions_v WHERE part = 'test'")


def nb(t: Tables) -> tuple[classify.CountModel, DataFrame]:
    return classify.train_counts(training(t, "train")), training(t, "test")


@case(
    "m21_question_classifier_nb",
    sql_with("SELECT question, label AS pred, round(score, 6) AS score FROM rank_v WHERE rn = 1", "questions_v", **NB),
)
def _(t: Tables) -> DataFrame:
    model, test = nb(t)
    return classify.question_classifier_nb(model, test).withColumn("score", F.round("score", 6))


@case(
    "m22_predict_top_k",
    sql_with("SELECT question, CAST(rn AS INT) AS rank, label, round(proba, 6) AS proba FROM rank_v WHERE rn <= 5", "questions_v", **NB),
)
def _(t: Tables) -> DataFrame:
    model, test = nb(t)
    return classify.predict_top_k(model, test, 5).withColumn("proba", F.round("proba", 6))


_MULTI_TRAIN = (
    "SELECT q.question, x.label FROM questions_v q JOIN (SELECT DISTINCT relation, cluster AS label FROM pairs_v) x ON x.relation = q.property_decoded WHERE q.part = 'train'"
)


@case(
    "m23_train_multilabel",
    sql_with(
        "SELECT question, label AS pred, round(score, 6) AS score FROM rank_v WHERE rn = 1", "questions_v",
        **nb_views(_MULTI_TRAIN, "SELECT DISTINCT question FROM questions_v WHERE part = 'test'"),
    ),
)
def _(t: Tables) -> DataFrame:
    """Labels: all clusters that the property has."""
    lists = t.pairs().select(F.col("relation").alias("property_decoded"), "cluster").distinct()
    lists = lists.groupBy("property_decoded").agg(F.array_join(F.collect_set("cluster").cast("array<string>"), " ").alias("labels"))
    gold = t.questions().join(lists, "property_decoded")
    model = classify.train_multilabel(gold.where("part = 'train'"))
    found = classify.question_classifier_nb(model, t.questions().where("part = 'test'"))
    return found.withColumn("score", F.round("score", 6))


@case(
    "m25_score_new_data",
    sql_with(
        "SELECT vec_id, CAST(center_id AS INT) AS cluster, round(1 - sqrt(d) / max(sqrt(d)) OVER (), 6) AS score FROM "
        "(SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, center_id) AS rn FROM d_v) x WHERE rn = 1",
        "centers_v",
        d_v=f"SELECT vec_id, center_id, {d2('list_reverse(embedding)', 'center')} AS d FROM embeddings CROSS JOIN centers_v",
    ),
)
def _(t: Tables) -> DataFrame:
    """The other corpus: the same vectors read backwards."""
    other = t.embeddings.select("vec_id", F.reverse("embedding").alias("vec"))
    scored = clustering.score_new_data(other, t.centers())
    return scored.select("vec_id", F.col("cluster").cast("int").alias("cluster"), F.round("score", 6).alias("score"))


@case(
    "m26_embed_text",
    "SELECT doc_id, CAST(coalesce(len(embedding), 0) AS INT) AS width, coalesce(round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4), 0) AS total FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
)
def _(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = clustering.embed_text(t.documents.select("doc_id"), vectors)
    vec = F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>"))
    return rows.select(
        "doc_id", F.size(vec).alias("width"), F.round(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x), 4).alias("total")
    )


@case("m26_hashed_embedding")
def _(t: Tables) -> DataFrame:
    rows = clustering.hashed_embedding(t.spread("documents").select("doc_id", "text"), dim=64)
    return rows.select("doc_id", F.posexplode("embedding").alias("dim", "value"))


@case("m27_clusterize")
def _(t: Tables) -> DataFrame:
    """Documents to triples, vectors, codes, centres, clusters and scores."""
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    matrices = features.build_matrices(t.sentences(), vectors)
    return clustering.clusterize(matrices, k=10, partial_part="predicate")


# --- streams ------------------------------------------------------------------------------------


@case(
    "x01_stream_triples",
    sql_with(
        f"SELECT {', '.join(BASIC_COLUMNS)} FROM basic_v WHERE " + plain_sql().split(" WHERE ", 1)[1],
        "spans_v", "paths_v", basic_v=BASIC_SQL,
    ),
)
def _(t: Tables) -> DataFrame:
    """All sentences arrive as files in two runs; the second run takes only the new ones."""
    spark = t.spark
    source, sink, state = (scratch_path(spark, f"stream-{n}") for n in ("in", "out", "state"))
    rows = t.sentences()
    early = F.col("doc_id") % 2 == 0
    for arrived in (rows.where(early), rows.where(~early)):
        write_annotations(arrived, source, "append")
        jobs.stream_triples(spark, source, sink, state)
    return spark.read.parquet(sink).withColumn("dep_path", joined("dep_path")).select(*BASIC_COLUMNS)


@case(
    "x02_stream_distinct_pairs",
    sql_with("SELECT * FROM pairs_v", "pairs_v"),
)
def _(t: Tables) -> DataFrame:
    spark = t.spark
    source, sink, state = (scratch_path(spark, f"pairs-{n}") for n in ("in", "out", "state"))
    t.triples().write.parquet(source)
    schema = "doc_id bigint, pos int, subject string, relation string, object string, score double, cluster int"
    jobs.stream_distinct_pairs(spark, source, schema, sink, state, ["doc_id", "pos"], files_per_batch=3)
    return jobs.read_distinct_pairs(spark, sink, ["doc_id", "pos"]).select(
        "subject", "relation", "object", "score", "cluster"
    )


