import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tripleloom.operators import classify, cluster
from tripleloom.operators.dense import center_matrix, nearest_center, nearest_in_block
from tripleloom.session import cut_lineage, shared_dir


def frame(spark, rows, name="vec"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"id int, {name} array<double>")


def centers(spark, rows):
    return cluster.centers_frame(spark, np.arange(len(rows)), np.array(rows, float))


def test_soft_assign(spark):
    out = cluster.soft_assign(frame(spark, [(0, 0)]), centers(spark, [(0, 0), (3, 4), (1, 0)])).first()["q"]
    assert [round(x, 6) for x in out] == [0.65, 0.025, 0.325]


Q = [[0.7, 0.2, 0.1], [0.4, 0.4, 0.2], [0.1, 0.3, 0.6]]


def test_targets_and_loss(spark):
    out = cluster.target_distribution(frame(spark, Q, "q"))
    p = {r["id"]: [round(x, 6) for x in r["p"]] for r in out.collect()}
    assert p[0] == [0.88024, 0.095808, 0.023952]
    assert p[1] == [0.375, 0.5, 0.125]
    assert p[2] == [0.016393, 0.196721, 0.786885]
    assert round(cluster.kl_loss(out).first()[0], 5) == 0.07542
    hard = {r["id"]: r["c"] for r in out.select("id", cluster.hard_assign("q").alias("c")).collect()}
    assert hard == {0: 0, 1: 0, 2: 2}


def test_refine_step(spark):
    points = frame(spark, [(0, 0), (1, 0), (4, 0)])
    matrix = np.array([[0.0, 0.0], [3.0, 0.0]])
    freq = cluster.frequency(points, "vec", matrix)
    direction, kl, n = cluster.refine_step(points, "vec", matrix, matrix, freq)
    assert np.round(direction, 6).tolist() == [[0.062243, 0.0], [0.227313, 0.0]]
    assert (round(kl, 6), n) == (0.054095, 3)


def blobs(spark, n=60):
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(c, 0.3, (n, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    return frame(spark, rows)


def test_loops_find_separate_groups(spark):
    points = blobs(spark)
    start = centers(spark, [(1, 1), (5, 1), (1, 4)])
    refined, history = cluster.refine_centers(points, start, iters=6, update_interval=10)
    assert all(a >= b for a, b in zip(history, history[1:]))
    for rows in (
        cluster.alternate_kmeans(points, start)[0],
        cluster.admm_kmeans(points, start, max_epochs=4, checkpoint_every=2)[0],
        nearest_center(points, refined),
    ):
        found = {r["id"]: r["cluster"] for r in rows.collect()}
        groups = [{found[i] for i in range(g * 60, g * 60 + 60)} for g in range(3)]
        assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_loops_read_blocks_not_rows(spark, monkeypatch):
    points = blobs(spark).unionByName(spark.createDataFrame([(999, None)], "id int, vec array<double>"))
    matrix, freq = np.array([[1.0, 1.0], [5.0, 1.0], [1.0, 4.0]]), np.array([50.0, 60.0, 70.0])
    plain = cluster.refine_step(points, "vec", matrix, matrix, freq)
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 7)
    blocks = cluster.packed(points.coalesce(1), "vec")
    assert 26 <= blocks.count() < 60
    direction, kl, n = cluster.refine_step(blocks, "vec", matrix, matrix, freq)
    assert np.allclose(direction, plain[0]) and kl == pytest.approx(plain[1]) and n == plain[2] == 180
    seen, step = set(), cluster.refine_step
    monkeypatch.setattr(cluster, "refine_step", lambda df, *a: (seen.add(df.schema["vec"].dataType.typeName()), step(df, *a))[1])
    cluster.refine_centers(points, centers(spark, matrix), iters=2)
    assert seen == {"binary"}


def test_admm_row(spark):
    state = spark.createDataFrame([([2.0, 2.0], [0.5, -0.5], 0)], "f array<double>, u array<double>, cluster int")
    row = cluster.admm_update(state, np.array([0]), np.array([[1.0, 0.0]])).first()
    assert np.round(row["y"], 6).tolist() == [1.454545, 2.272727]
    assert np.round(row["u"], 6).tolist() == [-0.045455, -0.227273]


def test_nearest_ties_and_blocks(spark, monkeypatch):
    import tripleloom.operators.dense as dense

    points = frame(spark, [(0, 0), (9, 9), (2, 0)])
    grid = centers(spark, [(1, 0), (-1, 0), (3, 0), (9, 9), (8, 8)])
    whole = {r["id"]: (r["cluster"], r["d2"]) for r in nearest_center(points, grid).collect()}
    assert whole == {0: (0, 1.0), 1: (3, 0.0), 2: (0, 1.0)}
    monkeypatch.setattr(dense, "BLOCK_VALUES", 4)
    assert len(list(dense.center_blocks(grid))) == 3
    assert {r["id"]: (r["cluster"], r["d2"]) for r in nearest_center(points, grid).collect()} == whole
    assert callable(nearest_in_block(*center_matrix(grid)))


def test_standardize_constant_column(spark):
    out = cluster.standardize(frame(spark, [(1, 5), (3, 5)])).orderBy("id").collect()
    assert [list(r["scaled"]) for r in out] == [[-1.0, 0.0], [1.0, 0.0]]


def test_closeness_and_seeds(spark):
    points = frame(spark, [(0, 0), (3, 4)]).withColumn("cluster", F.lit(0))
    scored = cluster.closeness(points, centers(spark, [(0, 0)])).orderBy("id").collect()
    assert [r["score"] for r in scored] == [1.0, 0.0]
    seeds = spark.createDataFrame([(1, 2, [7.0, 7.0]), (1, 1, [8.0, 8.0]), (0, 0, [9.0, 9.0])], "label int, ord int, vec array<double>")
    moved = cluster.seed_centers(centers(spark, [(0, 0), (1, 1)]), seeds, "vec", "ord").orderBy("center_id").collect()
    assert [list(r["center"]) for r in moved] == [[0.0, 0.0], [8.0, 8.0]]


def test_count_model_and_unknown_text(spark):
    train = spark.createDataFrame([("where born", 1), ("where born here", 1), ("who wrote", 2)], "question string, label int")
    model = classify.train_counts(train)
    asked = spark.createDataFrame([("born where",), ("wrote",), ("zzz",)], "question string")
    best = {r["question"]: r["pred"] for r in classify.question_classifier_nb(model, asked).collect()}
    assert best == {"born where": 1, "wrote": 2, "zzz": 1}
    top = classify.predict_top_k(model, asked, 2)
    sums = [r[0] for r in top.groupBy("question").agg(F.sum("proba")).select("sum(proba)").collect()]
    assert all(s == pytest.approx(1) for s in sums)
    lists = spark.createDataFrame([("where born", "1 3"), ("who wrote", "2")], "question string, labels string")
    multi = classify.train_multilabel(lists)
    assert sorted(r["label"] for r in multi.labels.collect()) == [1, 2, 3]


def test_classifier_learns_and_survives_saving(spark, tmp_path):
    rows = [(f"where was {i} born", 1) for i in range(20)] + [(f"who wrote {i}", 2) for i in range(20)]
    data = spark.createDataFrame(rows, "question string, label int")
    model = classify.question_classifier(data, data, features=64, grid=(0.01,), max_iter=20)
    classify.save_model(model, str(tmp_path / "m"))
    again = classify.load_model(str(tmp_path / "m"))
    asked = spark.createDataFrame([("who wrote this",), ("where was ada born",)], "question string")
    assert {r["question"]: r["pred"] for r in classify.classify(again, asked).collect()} == {
        "who wrote this": "2", "where was ada born": "1",
    }


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_fits_read_counted_words_instead_of_texts(spark, monkeypatch):
    """Nothing is held in the session, and every pass of a fit reads labels and counts only."""
    written, held = [], set(spark.sparkContext._jsc.getPersistentRDDs())
    monkeypatch.setattr(classify, "cut_lineage", lambda df, name: written.append((name, cut_lineage(df, name))) or written[-1][1])
    rows = [(f"where was {i} born", 1) for i in range(6)] + [(f"who wrote {i}", 2) for i in range(6)] + [(None, 2)]
    data = spark.createDataFrame(rows, "question string, label int")
    model = classify.question_classifier(data.where("question IS NOT NULL"), data.limit(5), features=32, max_iter=5)
    assert [(name, df.columns, df.count()) for name, df in written] == [("fit_on", ["label", "features"], 12), ("tune_on", ["label", "features"], 5)]
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= held
    assert [type(s).__name__ for s in model.stages] == [
        "StringIndexerModel", "NGram", "HashingTF", "HashingTF", "VectorAssembler", "LogisticRegressionModel", "IndexToString",
    ]


def test_rounds_of_a_loop_need_no_plan(spark, monkeypatch):
    """Blocks are made once, a round adds one share per task, and shares of many tasks are added in tasks."""
    points = blobs(spark)
    matrix, freq = np.array([[1.0, 1.0], [5.0, 1.0], [1.0, 4.0]]), np.array([50.0, 60.0, 70.0])
    blocks = cluster.kept(points.repartition(5), "vec")
    direct = cluster.refine_step(blocks, "vec", matrix, matrix, freq)
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda *_: pytest.fail("the blocks are made again"))
    monkeypatch.setattr(DataFrame, "groupBy", lambda *_: pytest.fail("a round is planned"))
    monkeypatch.setattr(cluster, "DIRECT", 2)
    in_tasks = cluster.refine_step(blocks, "vec", matrix, matrix, freq)
    assert np.allclose(direct[0], in_tasks[0]) and direct[1] == pytest.approx(in_tasks[1]) and direct[2] == in_tasks[2] == 180
    blocks.rdd.unpersist()
