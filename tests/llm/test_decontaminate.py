import random

import numpy as np

from tripleloom.llm import decontaminate as D


def fits(window, text, budget):
    """Whether a stretch of the text is within the budget of the window, by plain dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row) <= budget


def brute(text, items):
    out = set()
    text = D.normalised(text)
    for number, item in items:
        item = D.normalised(item)
        w = min(D.WINDOW, len(item))
        if w >= D.Q and any(fits(item[s : s + w], text, D.budget_of(w)) for s in range(len(item) - w + 1)):
            out.add(number)
    return out


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("abcxyz ")
        elif kind == 1:
            chars.insert(at, rng.choice("abcxyz"))
        elif len(chars) > 1:
            del chars[at]
    return "".join(chars)


def test_against_brute_force():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["th", "er", "an", "on", "é", "re", "ti"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.choice([3, 6, 12, 20]))) for i in range(12)]
    find = D.finder(D.build_indexes(items))
    texts = []
    for _ in range(60):
        body = prose(rng.randint(0, 25))
        for _ in range(rng.randint(0, 2)):
            source = rng.choice(items)[1]
            cut = rng.randrange(max(1, len(source) - 50))
            body += rng.choice(["", " "]) + edited(rng, source[cut : cut + rng.randint(30, 120)].upper(), rng.randint(0, 9)) + "\n" + prose(4)
        texts.append(body)
    found = find(texts)
    for text, leaks in zip(texts, found):
        assert {n for n, *_ in leaks} == brute(text, items)


def test_exact_leaks_have_their_places():
    rng = random.Random(3)
    item = "".join(rng.choice("abcdefgh ") for _ in range(200)).strip()
    find = D.finder(D.build_indexes([(5, item)]))
    (leaks,) = find([f"Some   words {item.upper()} and more"])
    ((number, start, end),) = leaks
    assert number == 5 and D.normalised(f"Some   words {item.upper()} and more")[start:end] == D.normalised(item)


def test_alignment_counts_edits():
    window = D.code_points("abcdefghij" * 6)
    pad = D.BAND + D.budget_of(60)
    for text, good in [("abcdefghij" * 6, True), ("abcdefgXij" * 5 + "abcdefghij", True), ("abcdefgXij" * 6, False)]:
        strip = np.concatenate([D.code_points(text), np.full(pad, 7, np.uint32)])
        assert D.within_budget(window[None], strip[None], 5)[0] == good


def test_query_holds_all_exact_leaks(spark, sf):
    items = {r.item_id: D.normalised(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in D.op3_decontamination(spark, sf).collect()}
    exact = {(r.doc_id, i) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, t in items.items() if t in D.normalised(r.text)}
    assert exact and exact <= found and len(found) <= 1.2 * len(exact)


def test_blocks_nulls_repeats_and_empty_tables(spark):
    rng = random.Random(9)
    items = [(i, "".join(rng.choice("abcdefgh ") for _ in range(90))) for i in range(5)]
    bench = spark.createDataFrame([*items, items[0], (None, "x" * 90), (9, None), (10, "short")], "item_id long, text string")
    docs = spark.createDataFrame([(1, items[0][1]), (1, items[0][1]), (None, "zz " + items[1][1]), (2, None), (3, ""), (4, "q " * 5000)], "doc_id long, text string")
    docs = docs.withColumn("item_id", docs.doc_id)
    rows = sorted((str(r.doc_id), r.item_id) for r in D.find_leaks(docs, bench).collect())
    assert rows == [("1", 0), ("1", 0), ("None", 1)]
    assert len(list(D.benchmark_blocks(bench, block_chars=100))) > 1
    kept = D.drop_leaking(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert D.find_leaks(docs.limit(0), bench).count() == 0 and D.find_leaks(docs, bench.limit(0)).count() == 0
    assert D.drop_leaking(docs, bench.limit(0)).count() == 6


def test_runs_keep_memory_bounded_and_places_apart(monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf tonight"
    items = [(1, "a" * 100), (2, item)] + [(10 + i, "-" * 70 + f" item {i} has some words") for i in range(20)]
    between = " words that nobody else has said so far" * 5
    text = "intro " + item + between + " " + item + " end"
    texts = ["a" * 20_000, "b" * 300 + "-" * 200, text]
    whole = D.finder(D.build_indexes(items))(texts)
    assert whole[0] == [(1, 0, 20_000)]
    assert [n for n, *_ in whole[1]] == [10 + i for i in range(20)]
    assert [(n, text[s:e]) for n, s, e in whole[2]] == [(2, item), (2, item)]
    # The same in many small pieces.
    monkeypatch.setattr(D, "PAIRS", 500)
    assert D.finder(D.build_indexes(items))(texts) == whole
    monkeypatch.setattr(D, "PAIRS", 1_000_000)
    import tracemalloc

    find = D.finder(D.build_indexes(items[:1]))
    tracemalloc.start()
    assert find(["a" * 200_000]) == [[(1, 0, 200_000)]]
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
