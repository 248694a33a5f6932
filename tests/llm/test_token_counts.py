"""Counts against the public libraries' own unigram models over the same vocabulary."""

import random

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from sentencepiece import sentencepiece_model_pb2 as pb

from tripleloom.llm.token_counts import Viterbi, count_tokens, load_vocabulary, op4_token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return Viterbi(load_vocabulary(PATH))


@pytest.fixture(scope="module")
def reference():
    """The public library's unigram decoder, given the vocabulary's pieces and scores (double precision)."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size())]
    # The library takes the lowest score of all entries; byte entries must not lower it.
    low = min(s for i, (_, s) in enumerate(pieces) if not sp.is_byte(i))
    pieces = [(p, low if sp.is_byte(i) or i < 3 else s) for i, (p, s) in enumerate(pieces)]
    own = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=0, byte_fallback=True))
    return lambda t: len(own.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0


@pytest.fixture(scope="module")
def original():
    proto = pb.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1  # unigram
    own = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    return lambda t: len(own.encode(t))


CASES = ["", " ", "  ", "\n", "a", "Hello  world\nfoo\t x", " lead", "trail ", "a\n\nb", "née ▁x", "日本語 テスト", "😀😀 x", "ab" * 300,
         "x\n y", "thth er", "\u0000", "<s> </s> <unk> <0x41>"]


@pytest.mark.parametrize("text", CASES)
def test_cases(model, original, text):
    assert model.count(text) == original(text)


def test_random_texts(model, reference, original):
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["th", "er", " ", "\n", "é", "z", "Q", "  ", "日", "😀", "an", "."]) for _ in range(rng.randint(1, 60)))
        assert model.count(text) == original(text), repr(text)


def test_whole_documents(spark, sf, model, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r.doc_id: r.n_tokens for r in op4_token_counts(spark, sf).collect()}
    assert found.keys() == texts.keys()
    # Words are independent, so a text's count is the sum over its lines and pieces.
    for i, t in texts.items():
        assert found[i] == model.pieces("▁" + t.replace(" ", "▁"))


def test_nulls_repeats_and_clashes(spark):
    df = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, None, 2), (2, "", 3)], "doc_id long, text string, n_tokens long")
    out = count_tokens(df, load_vocabulary(PATH), keep=["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == [("1", 0), ("1", 0), ("2", 0), ("None", 2)]
    assert count_tokens(df.limit(0), load_vocabulary(PATH), keep=["doc_id"]).count() == 0
