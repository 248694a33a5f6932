import hashlib
import random
import zlib

import pytest

from tripleloom.llm import prefix_trie as P
from tripleloom.llm.common import table


def brute(rows):
    """The contract's nodes of (conv_id, turn, role, text) rows, by plain dictionaries; ties are expected to be equal turns."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, children = {}, {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
            if d:
                children.setdefault(tuple(turns[: d - 1]), set()).add(tuple(turns[:d]))

    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        below = children.get(n, ())
        leaves[n] = sum(leaves[k] for k in below) or 1
        saved[n] = sum(saved[k] for k in below) + ((len(members[n]) - 1) * len(n[-1][1].encode().split()) if n else 0)
    out = []
    for n, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(full[c]) == len(n))
        out.append((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), len(children.get(n, ())), leaves[n], saved[n],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(df, **options):
    rebuilt = P.spliced(P.conversations(P.digested(df)))
    return [tuple(r) for r in P.prefix_trie(rebuilt, **options).collect()]


SCHEMA = "conv_id long, turn long, role string, text string"


def many():
    draw = random.Random(5)
    say = ["Hi", "hello  there\tyou", "", "tell me more please", "a b c d"]
    rows = []
    for c in draw.sample(range(700), 400):
        rows += [(c, t, draw.choice(["user", "assistant"]), draw.choice(say)) for t in range(draw.randrange(1, 7))]
    for c in range(1000, 1400):  # copies, a third of all
        rows += [(c, t, "user", f"the same turn {t}") for t in range(9)]
    rows += [(2000, t, "user", f"long {t // 3}") for t in range(200)] + [(2020, t, "user", f"long {t // 3}") for t in range(180)]
    rows += [(2040 + i, t, "user", "deep copy") for i in range(50) for t in range(60)]
    rows += [(3000, None, None, None), (3000, 1, None, "x"), (3007, None, "a", None), (None, 1, "user", "nobody"), (3001, 0, "user", "same"), (3001, 0, "user", "same")]
    return rows


@pytest.mark.parametrize("shards", [1, 2, 9, 60])
def test_against_brute_force(spark, monkeypatch, shards):
    monkeypatch.setattr(P, "PIECE_BYTES", 40)
    rows = many()
    got = nodes(spark.createDataFrame(rows, SCHEMA).repartition(5), shards=shards)
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_cut_splitters(spark, monkeypatch):
    monkeypatch.setattr(P, "SPLIT_TURNS", 3)
    rows = many()
    got = nodes(spark.createDataFrame(rows, SCHEMA), shards=25)
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_clashing_columns_and_empty_table(spark):
    rows = [(20, 1, "user", "b"), (20, 0, "user", "a"), (21, 0, "user", "a"), (22, 0, "user", "z z"), (23, 0, "user", "z z")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS digest", "1 AS words", "2 AS conv", "3 AS path", "4 AS shard")
    assert sorted(nodes(df), key=repr) == sorted(brute(rows), key=repr)
    assert nodes(df.limit(0)) == []


def test_given_conversations(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    out = P.op12_prefix_trie(spark, sf)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(brute(rows), key=repr)
