import random
import re

import numpy as np
import xxhash

from tripleloom.llm import simhash_pivots as S


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprints():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["A", "b", "É", "é", " ", "\n", " ", "\x1f", "word "]) for _ in range(rng.randint(0, 40)))
        assert S.fingerprint(text) == brute_fingerprint(text)


def test_every_close_pair_shares_a_key():
    rng = random.Random(2)
    for groups in (S.GROUPS, S.FINE_GROUPS):
        masks = S.group_masks(groups)
        for _ in range(500):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), rng.randint(0, 2)):
                y ^= 1 << b
            pairs = [v - ((v >> 1) & S.LOW) for v in (x, y)]
            assert any(pairs[0] & m == pairs[1] & m for m in masks)


def planted(rng, centres, members):
    values = []
    for _ in range(centres):
        x = rng.getrandbits(64)
        for _ in range(members):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 3)):
                y ^= 1 << b
            values.append(y)
    return values


def test_small_and_large_buckets_link_alike():
    values = np.unique(np.array(planted(random.Random(3), 2, 700), np.uint64))
    assert len(values) > S.SMALL_BUCKET
    a, b = S.bucket_edges(values, S.pivots())
    root = {int(v): int(v) for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for u, v in zip(a.tolist(), b.tolist()):
        x, y = find(u), find(v)
        root[max(x, y)] = min(x, y)
    assert {v: find(v) for v in root} == brute_components(values.tolist())


def test_components_of_the_query(spark):
    rng = random.Random(4)
    values = planted(rng, 30, 40) + [rng.getrandbits(64) for _ in range(300)] + [0, 0, 3]
    chain = [0x0F0F << 20]
    for i in range(20):
        chain.append(chain[-1] ^ (3 << (2 * i)))
    values += chain
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "id long, fingerprint long")
    found = S.with_groups(df, "fingerprint", "grp").collect()
    truth = brute_components(values)
    groups, expected = {}, {}
    for r in found:
        groups.setdefault(r.grp, set()).add(r.id)
        expected.setdefault(truth[values[r.id]], set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    roots = brute_components(prints.values())
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    rows = S.op6_simhash(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == least[roots[prints[r.doc_id]]]


def test_dropping_keeps_one_of_each(spark):
    rows = [(3, "a b c d", 1), (3, "a b c d", 1), (None, "a b c d", 2), (1, None, 3), (None, "", 4), (None, "z y x w v", 5), (7, "q r s", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    out = S.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.row) for r in out.collect()) == [("1", 3), ("3", 1), ("7", 6), ("None", 5)]
    assert S.drop_near_duplicates(df.limit(0)).count() == 0
    assert S.component_ids(df.limit(0)).count() == 0
    assert S.component_ids(df).count() == len(rows)
