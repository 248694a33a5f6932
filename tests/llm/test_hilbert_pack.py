import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tripleloom.llm import hilbert_pack as H

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPEC = open(PATH, encoding="utf-8").read()


@pytest.fixture(scope="module")
def encoder():
    import json

    ranks = H.merge_ranks(json.loads(SPEC))
    assert ranks is not None
    return H.Encoder(SPEC, ranks, "<u2")


TEXTS = ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "a \nb", "\na", "don't we'll I'M", "x<|endoftext|>y", "日本 語", "a\tb", "12 3a4", "é" * 50, "A!! B!!\nC", " x", "a\x1cb"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_tokenizers(encoder, text):
    own = Tokenizer.from_str(SPEC)
    assert np.frombuffer(encoder.ids(text), "<u2").tolist() == own.encode(text, add_special_tokens=False).ids


def test_curve_visits_neighbours():
    side = 8
    points = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = H.hilbert_keys(points, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def verify(rows, texts, capacity):
    """``texts``: ids of every document, by key; documents of one key are told apart by their ids."""
    by_key, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_key[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for sequence in by_sequence.values():
        at = 0
        for r in sorted(sequence, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    assert by_key.keys() == texts.keys()
    for key, ids in texts.items():
        at = 0
        for r in sorted(by_key[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_query_round_trip(spark, sf):
    own = Tokenizer.from_str(SPEC)
    texts = {r.doc_id: own.encode(r.text, add_special_tokens=False).ids + [1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    verify(H.op10_hilbert_packing(spark, sf).collect(), texts, H.CAPACITY)


def test_nulls_repeats_clashes_and_many_tasks(spark):
    rows = [(None, None, "x"), (1, "", "y"), (2, "a b", "z"), (2, "a b", "z"), (3, "word " * 300, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    out = H.pack_documents(df, SPEC, capacity=64, part_ids=50).collect()
    assert sum(r.length for r in out) == 1 + 1 + 3 + 3 + sum(len(r.tokens) for r in out if r.doc_id == 3)
    assert all(r.length == len(r.tokens) for r in out)
    third = sorted((r.start, r.tokens) for r in out if r.doc_id == 3)
    assert [i for _, t in third for i in t] == Tokenizer.from_str(SPEC).encode("word " * 300, add_special_tokens=False).ids + [1]
    assert H.pack_documents(df.limit(0), SPEC).count() == 0
