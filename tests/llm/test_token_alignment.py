import hashlib
from collections import Counter

import pytest

from tripleloom.llm import token_alignment as T
from tripleloom.llm.common import table


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of every text, by the public libraries and byte ranges."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    spec, model = T.public_models()
    a_own = Tokenizer.from_str(spec)
    a_own.encode_special_tokens = True
    b_own = SentencePieceProcessor(model_proto=model)
    letters = T.byte_letters()
    parsed = []
    for text in texts:
        if not text:
            parsed.append(([], [], [], []))
            continue
        whole = (" " + text).encode()
        a = a_own.encode(" " + text, add_special_tokens=False).ids
        b = b_own.encode(text)
        a_bytes = [bytes(letters[c] for c in a_own.id_to_token(i)) for i in a]
        names = [b_own.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_own.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, names)]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            parsed.append(([], [], [], []))
            continue
        owner_a = [n for n, x in enumerate(a_bytes) for _ in x]
        owner_b = [n for n, x in enumerate(b_bytes) for _ in x]
        groups, left, right = [], [], []
        for at in range(len(whole)):
            if owner_a[at] not in left:
                left.append(owner_a[at])
            if owner_b[at] not in right:
                right.append(owner_b[at])
            last = at + 1 == len(whole)
            if last or (owner_a[at + 1] != owner_a[at] and owner_b[at + 1] != owner_b[at]):
                groups.append(([a[x] for x in left], [b[y] for y in right]))
                left, right = [], []
        parsed.append((a, b, groups, [(x, y) for g in groups for x in g[0] for y in g[1]]))
    counts = Counter(p for _, _, _, links in parsed for p in set(links))
    most = {}
    for (x, _), c in counts.items():
        most[x] = max(c, most.get(x, 0))
    out = []
    for a, b, groups, links in parsed:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return out


ODD = [
    None, "", " ", "a", "word", "word", "two  spaces", " lead", "tail ", "line\n\nbreak\t\x0b", "it's 12,345 <|endoftext|> </s> <0x41>",
    "Straße 東京 привет 🙂🙂", "a▁b", "▁", "é é", "x" * 3000, "\r\n" * 5, " nbsp　", "the the the", "ﬁ ﬂ",
]


@pytest.mark.parametrize("rows", [T.BLOCK_ROWS, 3])
def test_odd_texts_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(T, "BLOCK_ROWS", rows)
    data = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "word", "y"), (3, "the a", "z"), (3, "the a", "z")]
    df = spark.createDataFrame(data, "doc_id long, text string, block string").repartition(3)
    found = T.link_statistics(df, *T.public_models()).collect()
    want = brute([t for _, t, _ in data])
    as_rows = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found), key=repr)
    assert as_rows == sorted([(d[0], *w) for d, w in zip(data, want)], key=repr)
    assert T.link_statistics(df.limit(0), *T.public_models()).count() == 0


def test_query_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    want = {d.doc_id: w for d, w in zip(docs, brute([d.text for d in docs]))}
    found = T.op13_token_alignment(spark, sf)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == want


def test_groups_give_the_text_back(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "a_ids int, text string")
    aligner = T.Aligner(*T.public_models())
    out = T.align_tokens(df, *T.public_models()).collect()
    assert len(out) == len(ODD)
    for r in out:
        assert len(r.a_cuts) == len(r.b_cuts)
        i = j = 0
        for i2, j2 in zip(r.a_cuts, r.b_cuts):
            left, right = (b"".join(side.bytes[x] for x in ids) for side, ids in ((aligner.a, r.a_ids[i:i2]), (aligner.b, r.b_ids[j:j2])))
            assert left == right and left
            i, j = i2, j2
        assert (i, j) == (len(r.a_ids), len(r.b_ids))
        assert not r.a_ids or b"".join(aligner.a.bytes[x] for x in r.a_ids) == (" " + r.text).encode()
