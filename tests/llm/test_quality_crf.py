import itertools
import math
import random

import numpy as np
import pytest

from tripleloom.llm import quality_crf as Q
from tripleloom.llm.common import remainder


def test_marginals_against_all_labellings():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(1, 7)
        own = [rng.uniform(-2, 2) for _ in range(n)]
        steps = [rng.uniform(-1, 1) for _ in range(4)]
        total, good = 0.0, [0.0] * n
        for ys in itertools.product((0, 1), repeat=n):
            v = math.exp(sum(o for o, y in zip(own, ys) if y) + sum(steps[2 * a + b] for a, b in zip(ys, ys[1:])))
            total += v
            for i, y in enumerate(ys):
                good[i] += v * y
        assert Q.marginals(np.exp(np.array(own)), tuple(steps)) == pytest.approx([g / total for g in good], rel=1e-6)


def test_long_texts_are_learnt_from_whole():
    for n in (1, 255, 256, 257, 300, 10_000):
        chains = Q.chains_of([np.arange(n), np.arange(3)])
        assert max(map(len, chains)) <= Q.CHAIN_LINES and np.concatenate(chains).tolist() == [*range(n), 0, 1, 2]


def test_the_sample_is_bounded_in_rows_and_lines(spark):
    keep = remainder("doc_id", 4) != 2
    once = [(i, f"line {i}\n" * (i % 5 + 1)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    fit = lambda rows, **bounds: Q.fit_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels, keep, **bounds)
    assert fit(once) == fit(once + [once[3]] * 3000)
    assert fit(once, max_lines=1) == fit(once, max_labelled=1) != fit(once)


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    x = [rng.standard_normal((n, 3)).astype(np.float32) for n in (1, 4, 2)]
    y = [rng.integers(0, 2, len(a)) for a in x]
    xs, ys, mask = Q.padded(x, y)
    w, t = rng.standard_normal(4), rng.standard_normal((2, 2))
    value, gw, gt = Q.chain_gradient(xs, ys, mask, w, t)
    for i in range(4):
        d = np.zeros(4)
        d[i] = 1e-4
        assert (Q.chain_gradient(xs, ys, mask, w + d, t)[0] - value) / 1e-4 == pytest.approx(gw[i], abs=5e-3)
    for a, b in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[a, b] = 1e-4
        assert (Q.chain_gradient(xs, ys, mask, w, t + d)[0] - value) / 1e-4 == pytest.approx(gt[a, b], abs=5e-3)


def test_features_do_not_depend_on_the_batch():
    texts = ["One line.\nANOTHER!! LINE!!\n\nOne line.", None, "", "a | b | c\né è", "x"]
    x, weight, sizes = Q.line_features(texts)
    assert sizes.tolist() == [4, 1, 1, 2, 1]
    parts = [Q.line_features([t]) for t in texts]
    assert np.array_equal(x, np.concatenate([p[0] for p in parts])) and np.array_equal(weight, np.concatenate([p[1] for p in parts]))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "truth")
    rows = Q.op2_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    for truth in (0, 1):
        own = [r for r in rows if r.truth == truth]
        assert sum(r.predicted == truth for r in own) >= 0.97 * len(own)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_nulls_repeats_clashes_and_missing_labels(spark):
    df = spark.createDataFrame([(1, "A line.\n### ###", 1), (1, "A line.\n### ###", 1), (None, None, 2), (2, "", 3), (3, "w " * 50_000, 4)],
                               "doc_id long, text string, quality long")
    model = Q.QualityModel((0.1,) * (Q.FEATURES + 1), (0.1, -0.2, 0.0, 0.3), (1.0, 0.2))
    rows = Q.score_quality(df, model).collect()
    assert len(rows) == 5 and rows[0] == rows[1] and all(0 <= r.quality <= 1 for r in rows)
    assert rows[2].quality_lines == rows[3].quality_lines and len(rows[2].quality_lines) == 1
    assert Q.score_quality(df.limit(0), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    fitted = Q.fit_quality(df, none, remainder("doc_id", 4) != 2)
    assert all(r.quality == 0.5 for r in Q.score_quality(df, fitted).collect())
