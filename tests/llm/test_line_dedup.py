import hashlib
import random

import pytest

from tripleloom.llm import line_dedup as L
from tripleloom.llm.common import table

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """(doc_id, n_lines, n_dropped, kept text) of every (doc_id, text)."""
    low = lambda i: (i is None, i or 0)
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(BLANK).translate(LOWER)
            owner[k] = min(owner.get(k, i), i, key=low)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(k := x.strip(BLANK).translate(LOWER)) < 10 or owner[k] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def found(spark, rows, tmp_path, name):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return [tuple(r) for r in L.op11_line_dedup(spark, f"{tmp_path}/{name}").collect()]


def digest(rows):
    return sorted(((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in rows), key=repr)


@pytest.mark.parametrize("parts", ["1", "4", "37"])
def test_against_brute_force(spark, tmp_path, parts):
    draw = random.Random(3)
    pool = ["The common line of all", "  THE common line of ALL\t", "short", "", "ÄÖÜ äöü ß 12", "äöü ÄÖÜ ß 12", "\x0b padded line here \x0c", "exactly10c", "exactly9c",
            "東京東京東京東京東京", "東京東京東京東", "no break space ", *[f"line number {i} of many" for i in range(40)]]
    rows = [(i, "\n".join(draw.choices(pool, k=draw.randrange(1, 30)))) for i in range(120)]
    rows += [(200 + i, "one hot line here") for i in range(400)] + [(5, rows[5][1]), (5, "one hot line here"), (None, "one hot line here\nonly with null"), (None, "only with null"), (7, None), (8, ""), (9, "\n\n")]
    rows += [(1000, "\n".join(["one hot line here"] * 500 + ["own line, repeated"] * 3))]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert sorted(found(spark, rows, tmp_path, f"p{parts}"), key=repr) == digest(brute(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_texts_and_clashing_columns(spark):
    rows = [(2, "A line to share\nx", "d"), (1, "a line to share ", "e"), (3, None, "f"), (4, "a line to share", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string").selectExpr("*", "'q' AS keep", "1L AS ver", "0 AS pos", "1L AS h1")
    out = L.drop_repeated_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a line to share ", 2: "x", 3: None, 4: ""}
    assert L.drop_repeated_lines(df.limit(0)).count() == 0
    bits = L.keep_bitmaps(df).collect()
    assert {r.doc: L.kept(["a", "b", "c"], r.keep) for r in bits} == {2: ["b", "c"], 4: ["b", "c"]}


def test_given_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    out = [tuple(r) for r in L.op11_line_dedup(spark, sf).collect()]
    assert sorted(out, key=repr) == digest(brute(rows)) and sum(r[2] for r in out)
