import itertools

import numpy as np
import pytest

from tripleloom.operators import metrics
from pyspark.sql import functions as F

TRUE = [0, 0, 0, 1, 1, 2]
PRED = [0, 0, 1, 1, 1, 2]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(list(zip(TRUE, PRED)), "t int, p int")


def test_golden(pairs):
    v = metrics.v_measure(pairs, "t", "p").first()
    assert [round(x, 6) for x in v] == [0.685331] * 3
    assert round(metrics.nmi(pairs, "t", "p").first()[0], 6) == 0.685331
    assert round(metrics.ari(pairs, "t", "p").first()[0], 6) == 0.318182
    ami = metrics.ami(pairs, "t", "p").first()
    assert (round(ami["emi"], 6), round(ami["ami"], 6)) == (0.470309, 0.411828)
    assert round(metrics.clustering_accuracy(pairs, "t", "p").first()["accuracy"], 6) == 0.833333


def test_identity_and_symmetry(pairs):
    same = pairs.select("t", F.col("t").alias("p"))
    assert metrics.v_measure(same, "t", "p").first()["v_measure"] == pytest.approx(1)
    assert metrics.ami(same, "t", "p").first()["ami"] == pytest.approx(1)
    assert metrics.ari(same, "t", "p").first()["ari"] == pytest.approx(1)
    there = metrics.v_measure(pairs, "t", "p").first()["v_measure"]
    assert metrics.v_measure(pairs, "p", "t").first()["v_measure"] == pytest.approx(there)


def test_ln_factorial(spark):
    from math import lgamma

    got = spark.range(0, 400).select("id", metrics.ln_factorial(F.col("id").cast("double")).alias("x")).collect()
    assert max(abs(r["x"] - lgamma(r["id"] + 1)) for r in got) < 1e-9


def brute_total(w):
    small = w if w.shape[0] <= w.shape[1] else w.T
    places = itertools.permutations(range(small.shape[1]), len(small))
    return max(sum(small[i, j] for i, j in enumerate(p)) for p in places)


def proof(rows, cols, weights, price):
    """The upper bound of the prices: no assignment has a larger total."""
    gains = {}
    for i, j, w in zip(rows, cols, weights):
        gains[i] = max(gains.get(i, 0), w - price[j])
    return sum(gains.values()) + sum(price.values())


def test_assignment_against_brute_force():
    rng = np.random.default_rng(1)
    for rows, cols in [(1, 1), (3, 3), (4, 6), (6, 4), (5, 5), (6, 6)] * 40:
        w = rng.integers(0, 9, (rows, cols)) * (rng.random((rows, cols)) < rng.random() + 0.2)
        i, j = (x.tolist() for x in np.nonzero(w))
        n = w[i, j].tolist()
        chosen, price = metrics.best_assignment(i, j, n)
        assert all(i[c] == row for row, c in chosen.items())
        assert len({j[c] for c in chosen.values()}) == len(chosen)
        assert sum(n[c] for c in chosen.values()) == brute_total(w) == proof(i, j, n, price)
        assert min(price.values(), default=0) >= 0
    assert metrics.best_assignment([], [], []) == ({}, {})


def sparse_cells(k, seed):
    """Labels that fall into a cluster of their own, mostly, and into five others."""
    rng = np.random.default_rng(seed)
    cells = {}
    for t in range(k):
        cells[t, int(rng.integers(k))] = int(rng.integers(20, 200))
        for p in rng.integers(k, size=5).tolist():
            cells.setdefault((t, p), int(rng.integers(1, 60)))
    return [t for t, _ in cells], [p for _, p in cells], list(cells.values())


def test_assignment_of_20000_labels_is_proved_by_its_prices():
    rows, cols, n = sparse_cells(20_000, 3)
    chosen, price = metrics.best_assignment(rows, cols, n)
    assert len({cols[c] for c in chosen.values()}) == len(chosen)
    assert sum(n[c] for c in chosen.values()) == proof(rows, cols, n, price)


@pytest.mark.parametrize("task_cells", [0, 10**6])
def test_accuracy_in_rounds_and_in_one_task(spark, task_cells):
    rng = np.random.default_rng(7)
    for k in (2, 5):
        w = rng.integers(0, 9, (k, k + 1))
        cells = [(int(t), f"c{p}") for t, p in zip(*np.nonzero(w)) for _ in range(w[t, p])]
        cells += [(None, "c0"), (1, None), (None, None)]
        found = metrics.clustering_accuracy(spark.createDataFrame(cells, "t int, p string"), "t", "p", task_cells).first()
        assert (found["matched"], found["total"]) == (brute_total(w), w.sum())
    empty = metrics.clustering_accuracy(spark.createDataFrame([], "t int, p string"), "t", "p", task_cells).first()
    assert tuple(empty) == (0, 0, None)


def test_accuracy_of_many_labels_settles_the_same_total(spark):
    rows, cols, n = sparse_cells(6_000, 4)
    chosen, _ = metrics.best_assignment(rows, cols, n)
    data = spark.createDataFrame(list(zip(rows, cols, n)), "t int, p int, n int")
    data = data.select("t", "p", F.explode(F.sequence(F.lit(1), "n")))
    found = metrics.clustering_accuracy(data, "t", "p", 1_000).first()
    assert (found["matched"], found["total"]) == (sum(n[c] for c in chosen.values()), sum(n))


def test_report(pairs):
    report = {r["label"]: r for r in metrics.classification_report(pairs, "t", "p").collect()}
    assert report["0"]["precision"] == 1 and report["0"]["recall"] == pytest.approx(2 / 3)
    assert report["1"]["f1"] == pytest.approx(0.8)
    assert report["accuracy"]["recall"] == pytest.approx(5 / 6)
    assert report["macro avg"]["support"] == 6


def test_shared_label(spark):
    df = spark.createDataFrame([([5, 3], [3, 5]), ([7], [2])], "own array<int>, other array<int>")
    assert [r[0] for r in df.select(metrics.shared_label(F.col("own"), F.col("other"))).collect()] == [5, 7]


def test_random_labels_score_near_zero(spark):
    from tripleloom.operators.windows import random_exp_labels, random_uniform_labels

    df = spark.range(4000).select("id", (F.col("id") % 5).alias("t"))
    drawn = random_exp_labels(random_uniform_labels(df, ["id"], 9), ["id"], 9)
    for column in ("cluster_uniform", "cluster_exp"):
        assert abs(metrics.ami(drawn, "t", column).first()["ami"]) < 0.02


def test_expected_information_in_blocks(spark):
    import math
    import random

    rng = random.Random(5)
    rows = [(rng.randrange(30) ** 2 // 30, rng.randrange(40) ** 2 // 40) for _ in range(600)]
    table = metrics.contingency(spark.createDataFrame(rows, "t int, p int"), "t", "p")
    n = len(rows)
    count = lambda i: [sum(r[i] == v for r in rows) for v in {r[i] for r in rows}]
    lf = math.lgamma
    want = 0.0
    for a in count(0):
        for b in count(1):
            for x in range(max(1, a + b - n), min(a, b) + 1):
                log_p = (lf(a + 1) + lf(b + 1) + lf(n - a + 1) + lf(n - b + 1) - lf(n + 1) - lf(x + 1) - lf(a - x + 1)
                         - lf(b - x + 1) - lf(n - a - b + x + 1))
                want += x / n * math.log(n * x / (a * b)) * math.exp(log_p)
    for block in (2, metrics.SIZE_BLOCK):
        assert metrics.expected_mutual_information(table, block).first()["emi"] == pytest.approx(want, rel=1e-9)
    empty = metrics.contingency(spark.createDataFrame([], "t int, p int"), "t", "p")
    assert metrics.expected_mutual_information(empty).first()["emi"] == 0
