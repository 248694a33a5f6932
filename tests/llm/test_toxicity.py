import random

import pytest

from tripleloom.llm import toxicity as X
from tripleloom.llm.common import remainder


def all_segments(values):
    """Maximal scoring segments by their definition: the best of the whole, then of what is left on either side."""
    def best(lo, hi):
        top = None
        for a in range(lo, hi):
            for b in range(a, hi):
                s = sum(values[a : b + 1])
                if s > 1e-12 and (top is None or s > top[0] + 1e-9 or (abs(s - top[0]) <= 1e-9 and b - a < top[2] - top[1])):
                    top = (s, a, b)
        return top

    def split(lo, hi):
        top = best(lo, hi) if lo < hi else None
        if top is None:
            return []
        s, a, b = top
        return split(lo, a) + [(a, b, s)] + split(b + 1, hi)

    return split(0, len(values))


def test_segments_against_the_definition():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(0, 14)
        own = {i: rng.uniform(0.2, 4) + rng.random() * 1e-3 for i in range(n) if rng.random() < 0.4}
        drift = rng.choice([0.1, 0.7, 1.5]) + rng.random() * 1e-3
        values = [own.get(i, -drift) for i in range(n)]
        found = sorted(X.maximal_segments(sorted(own.items()), drift))
        assert [f[:2] for f in found] == [f[:2] for f in all_segments(values)]
        assert [f[2] for f in found] == pytest.approx([f[2] for f in all_segments(values)])


def test_rate_solves_its_equation():
    rate = X.law_rate({"bad": 5.0, "odd": 2.0}, {"bad": 0, "odd": 50}, 10_000)
    p_bad, p_odd = 0.5 / 10_000, 50.5 / 10_000
    import math

    total = p_bad * math.exp(5 * rate) + p_odd * math.exp(2 * rate) + (1 - p_bad - p_odd) * math.exp(-X.DRIFT * rate)
    assert total == pytest.approx(1, abs=1e-3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = X.op1_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_passages_nulls_repeats_and_missing_labels(spark):
    model = X.ToxicityModel({"foul": 6.0}, 1.0, 0.01, (0.3, 1.0, 0.0, -1.0))
    text = "nice " * 20 + "foul foul " + "nice " * 20
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (None, ""), (3, "Foul")], "doc_id long, toxicity string").withColumnRenamed("toxicity", "text")
    rows = X.score_toxicity(df, model, keep=["doc_id"]).collect()
    found = [r for r in rows if r.doc_id == 1]
    assert len(rows) == 5 and found[0] == found[1] and text[found[0].passages[0].start : found[0].passages[0].end] == "foul foul"
    assert rows[2].passages == [] and rows[2].toxicity == rows[3].toxicity < found[0].toxicity
    clash = X.score_toxicity(df.withColumn("Passages", df.doc_id), model)
    assert [c.lower() for c in clash.columns].count("passages") == 1 and clash.count() == 5
    assert X.score_toxicity(df.limit(0), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    empty = X.fit_toxicity(df, none, remainder("doc_id", 5) != 0)
    assert all(r.toxicity == 0.5 for r in X.score_toxicity(df, empty, keep=["doc_id"]).collect())
    one = spark.createDataFrame([(1, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    assert X.fit_toxicity(df, one, remainder("doc_id", 5) >= 0).terms == {}


def test_an_id_that_repeats_gives_one_training_text(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i, f"word{i % 7} plain text {i}") for i in range(40)] + [(1, f"another text {i}") for i in range(500)] + [(2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    counted = X.counted_words
    monkeypatch.setattr(X, "counted_words", lambda sample: seen.append(sample.count()) or counted(sample))
    X.fit_toxicity(docs, labels, F.lit(True))
    assert seen == [40]
