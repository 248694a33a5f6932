import random
import re

import duckdb
import pytest

from check_oracle import rows_of
from tripleloom.llm.rule_ledger import OP8_SQL, POLICIES, RULES, ablation, evaluate, measure, op8_quality_rules, passes


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            sum(a == b for a, b in zip(words, words[1:])), text.count("!!"))


def test_measurements_against_brute_force():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "\t", " ", "#", "|", " ", "\x1c", "!!", "a b a b a"]) for _ in range(rng.randint(0, 60)))
        assert measure(text) == brute(text), repr(text)


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(OP8_SQL)
    df = op8_quality_rules(spark, sf)
    assert rows_of([d[0] for d in cur.description], cur.fetchall()) == rows_of(df.columns, df.collect())


def test_clean_documents_are_kept(spark, sf):
    kept = op8_quality_rules(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed and quality = 1")
    assert kept.where("kept").count() >= 0.99 * kept.count()


def test_policies_and_ablation(spark):
    bits = [r.bit for r in RULES]
    assert len(set(bits)) == len(bits) and all(set(p) <= {r.name for r in RULES} for p in POLICIES.values())
    df = spark.createDataFrame(
        [(1, None), (2, ""), (3, "a b c d e f g h i j k"), (4, "# a b c d e f g h #j #k"), (4, "# a b c d e f g h #j #k"), (5, "x x x x x x x x x x x x")],
        "doc_id long, failed string",
    ).withColumnRenamed("failed", "text")
    ledger = evaluate(df, keep=["doc_id"]).cache()
    assert sorted((r.doc_id, r.ok) for r in ledger.select("doc_id", passes(1).alias("ok")).collect()) == [
        (1, False), (2, False), (3, True), (4, True), (4, True), (5, False)]
    table = {r.rule: r.asDict() for r in ablation(ledger).collect()}
    assert table["few_words"] == {"rule": "few_words", "n_failed": 2, "n_failed_alone": 0, "n_kept_without": 0 + sum(
        1 for r in ledger.collect() if r.failed in (0, 1))} or table["few_words"]["n_failed"] == 2
    masks = [r.failed for r in ledger.collect()]
    for r in RULES:
        row = table[r.name]
        assert row["n_failed"] == sum(m >> r.bit & 1 for m in masks)
        assert row["n_failed_alone"] == sum(m == 1 << r.bit for m in masks)
        assert row["n_kept_without"] == sum(m in (0, 1 << r.bit) for m in masks)


@pytest.mark.parametrize("rows", [0])
def test_empty_table(spark, rows):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert evaluate(df).count() == rows
