import itertools
import random

from pyspark.sql import functions as F
import pytest

from tripleloom.catalog import CASES
from tripleloom.functions import syntax, vectors
from tripleloom.functions.vocab import PREPOSITIONS

HEAP = [i // 2 for i in range(1, 10)]


def path(spark, gov, i, j):
    df = spark.createDataFrame([(gov,)], "gov array<int>")
    return df.select(syntax.dep_path(F.col("gov"), F.lit(i), F.lit(j))).first()[0]


@pytest.mark.parametrize(
    "i, j, expected",
    [(9, 7, [9, 4, 2, 1, 3, 7]), (8, 2, [8, 4, 2]), (4, 4, [4]), (9, 5, [9, 4, 2, 5])],
)
def test_heap_paths(spark, i, j, expected):
    assert path(spark, HEAP, i, j) == expected


def test_two_roots_have_no_path(spark):
    assert path(spark, [0, 0, 1, 2], 3, 4) == []


def bfs_all(edges, a, b):
    """Shortest paths by brute force; the smallest of them."""
    near = {}
    for u, v in edges:
        if u > 0 and v > 0:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    level = [[s] for s in sorted(set(a))]
    while level:
        done = [p for p in level if p[-1] in b]
        if done:
            return min(done)
        level = [p + [v] for p in level for v in sorted(near.get(p[-1], ())) if v not in p]
    return []


def test_paths_between_sets_against_brute_force(spark):
    rng = random.Random(3)
    cases = []
    for _ in range(60):
        n = rng.randint(2, 8)
        edges = [(rng.randint(0, i), i) for i in range(1, n + 1)]
        edges += [(rng.randint(1, n), rng.randint(1, n)) for _ in range(rng.randint(0, 3))]
        a = rng.sample(range(1, n + 1), rng.randint(1, min(3, n)))
        b = rng.sample(range(1, n + 1), rng.randint(1, min(3, n)))
        cases.append((edges, a, b))
    df = spark.createDataFrame(
        [(i, [{"governor": g, "dependent": d} for g, d in e], a, b) for i, (e, a, b) in enumerate(cases)],
        "i int, e array<struct<governor:int,dependent:int>>, a array<int>, b array<int>",
    )
    out = df.select("i", syntax.dep_path_between_sets(F.col("e"), F.col("a"), F.col("b")).alias("p")).collect()
    for row in out:
        assert list(row["p"]) == bfs_all(*cases[row["i"]]), cases[row["i"]]


def test_paths_between_odd_sets(spark):
    schema = "i int, e array<struct<governor:int,dependent:int>>, a array<int>, b array<int>"
    chain = [(i, i + 1) for i in range(1, 300)]
    cases = [([], [1], [1]), ([], [1], [2]), (None, [3], [3]), (None, [1], [2]), ([(1, 2)], None, [1]), ([(1, 2)], [1], None), ([(1, 2)], [], [2]), (chain, [300], [1]),
             ([(1, 1)], [1], [1]), ([(0, 1), (0, 2)], [1], [2]), ([(1, 2), (1, 2)], [2], [1])]
    df = spark.createDataFrame([(i, e, a, b) for i, (e, a, b) in enumerate(cases)], schema)
    out = df.select("i", syntax.dep_path_between_sets(F.col("e"), F.col("a"), F.col("b")).alias("p"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for row in out.collect():
        assert list(row["p"]) == bfs_all(*[x or [] for x in cases[row["i"]]])


def collapse(tags):
    """Repeated substring replacement."""
    for key, new in (
        ("PERSON_PERSON", "PERSON"), ("ORGANIZATION_ORGANIZATION", "ORGANIZATION"), ("DURATION", "O"), ("O_O", "O"),
    ):
        while key in tags:
            tags = tags.replace(key, new)
    return tags


def test_entity_types(spark):
    tags = ["PERSON", "ORGANIZATION", "O", "DURATION", "CITY"]
    rows = ["_".join(c) for n in range(1, 5) for c in itertools.product(tags, repeat=n)]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    out = df.select("x", syntax.collapse_types(F.col("x")).alias("y")).collect()
    assert all(r["y"] == collapse(r["x"]) for r in out)
    assert collapse("PERSON_PERSON_O") == "PERSON_O" and collapse("O_ORGANIZATION") == "ORGANIZATION"


def sentence(spark, words, tags=None):
    tags = tags or ["NN"] * len(words)
    tokens = [
        {"index": i + 1, "word": w, "originalText": w, "lemma": w.lower(), "pos": p, "ner": "O"}
        for i, (w, p) in enumerate(zip(words, tags))
    ]
    schema = "tokens array<struct<index:int,word:string,originalText:string,lemma:string,pos:string,ner:string>>"
    return spark.createDataFrame([(tokens,)], schema)


def test_words_and_tags_between(spark):
    df = sentence(spark, ["Ada", "(Quickly", "wrote", "1843", "''", "the", "notes"], ["NNP", "RB", "VBD", "CD", "''", "DT", "NNS"])
    spans = ((F.lit(0), F.lit(1)), (F.lit(6), F.lit(7)))
    row = df.select(
        syntax.bow_between(F.col("tokens"), *spans).alias("bow"),
        syntax.bow_between(F.col("tokens"), *reversed(spans)).alias("back"),
        syntax.bow_between(F.col("tokens"), *spans, stop=["the"]).alias("nostop"),
        syntax.pos_between(F.col("tokens"), *spans).alias("pos"),
        syntax.pos_of_span(F.col("tokens"), F.lit(0), F.lit(3)).alias("span"),
        syntax.words_on_path(F.col("tokens"), F.array(*[F.lit(i) for i in (1, 3, 7)])).alias("words"),
        syntax.trigger(F.col("tokens"), F.array(*[F.lit(i) for i in (1, 3, 6, 7)])).alias("trigger"),
        syntax.lemmas_on_path(F.col("tokens"), F.array(*[F.lit(i) for i in (7, 3, 1)])).alias("lemmas"),
    ).first()
    assert row["bow"] == row["back"] == "quickly wrote the"
    assert row["nostop"] == "quickly wrote"
    assert row["pos"] == "RB_VBD_CD_''_DT"
    assert (row["span"], row["words"], row["trigger"], row["lemmas"]) == ("NNP_RB_VBD", "wrote", "wrote", "wrote notes")


def test_punctuation_tags_are_dropped(spark):
    df = sentence(spark, [",", "x", "."], [",", "NN", "."])
    assert df.select(syntax.pos_of_span(F.col("tokens"), F.lit(0), F.lit(3))).first()[0] == "NN"


def test_phrase_head(spark):
    df = spark.createDataFrame([([0, 3, 1, 3],)], "gov array<int>")
    heads = df.select(
        syntax.phrase_head(F.col("gov"), F.lit(1), F.lit(3)),
        syntax.phrase_head(F.col("gov"), F.lit(3), F.lit(4)),
    ).first()
    assert list(heads) == [3, 4]


def test_multi_hot(spark):
    df = spark.createDataFrame([("NNP_VBD", "")], "tags string, none string")
    row = df.select(
        vectors.pos_multihot(F.col("tags")).alias("a"),
        vectors.pos_multihot(F.col("none")).alias("b"),
        vectors.ner_multihot(F.lit("CITY_O_O_O_DATE")).alias("c"),
        vectors.prep_multihot(F.lit("Born ín Of")).alias("d"),
        vectors.positional_onehot(F.array(F.lit("b"), F.lit("z")), ["a", "b"]).alias("e"),
    ).first()
    assert sum(row["a"]) == 2 and row["a"][10] == 1 and row["a"][2] == 1
    assert row["b"][3] == 1 and sum(row["b"]) == 1
    assert sum(row["c"]) == 1
    assert [p for p, x in zip(PREPOSITIONS, row["d"]) if x] == ["in", "of"]
    assert row["e"] == [[0, 1], [0, 0], [0, 0]]


def test_paths_deeper_than_the_first_steps(spark):
    chain = list(range(0, 40))
    assert path(spark, chain, 40, 1) == list(range(40, 0, -1))
    assert path(spark, chain, 3, 30) == list(range(3, 31))
    assert path(spark, [2, 1], 1, 2) == [1, 2]


def test_heads_of_all_spans(spark):
    rng = random.Random(5)
    cases = [([rng.randint(0, 7) for _ in range(7)], a, b) for a in range(7) for b in range(a + 1, 8) for _ in range(3)]
    head = lambda g, a, b: next((i for i in range(a + 1, b + 1) if g[i - 1] < a + 1 or g[i - 1] > b), b)
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, g array<int>, a int, b int")
    got = df.orderBy("i").select(syntax.phrase_head(F.col("g"), F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [head(*c) for c in cases]


def test_governors_in_token_order(spark):
    kind = "array<struct<governor:int,dependent:int,dep:string>>"
    rows = [([(0, 2, "b"), (2, 1, "a"), (1, 3, "c")],), ([],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, f"d {kind}").select(syntax.governors(F.col("d"))).collect()]
    assert got == [[2, 0, 1], [], None]


@pytest.mark.parametrize("name", ["t11_dep_path", "t12_dep_path_between_sets", "t17_lemmas_on_path"])
def test_spans_do_no_work_twice(spark, sf, name):
    """Tokens are built only where they are read, after sentences without triples are gone; a head is sought once."""
    plan = CASES[name].run(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert ("originalText" in plan) == (name == "t17_lemmas_on_path")
    lines = plan.splitlines()
    built = [i for i, line in enumerate(lines) if "originalText" in line]
    assert len(built) <= 1
    gone = [i for i, line in enumerate(lines) if "Filter" in line and ">= 9" in line]
    assert gone and all(i < gone[-1] for i in built)
    assert plan.count("filter(sequence((obj_start") <= 1


def test_search_keeps_only_arcs_that_lead_on(spark):
    """No distance of every token is kept and rewritten per level."""
    df = spark.createDataFrame([([(i, i + 1) for i in range(1, 30)], [30], [2])], "e array<struct<governor:int,dependent:int>>, a array<int>, b array<int>")
    out = df.select(syntax.dep_path_between_sets(F.col("e"), F.col("a"), F.col("b")).alias("p"))
    assert "struct(dist" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert list(out.first()["p"]) == list(range(30, 1, -1))
