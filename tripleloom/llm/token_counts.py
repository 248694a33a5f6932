"""Token counts by count-only Viterbi over a unigram vocabulary (operator 4).

An Aho-Corasick automaton enumerates every piece of the vocabulary in a text; dynamic
programming carries the best score and its number of pieces per place, and no back
pointers. Tie rules are the tokenizer's: among equal scores the longest last piece wins, a
character no piece covers costs the lowest score less ten and counts one piece per UTF-8 byte.

Spaces become the vocabulary's space mark and one is put in front. No piece of a vocabulary
of this kind has a mark behind a letter, so the best path always cuts there; the words
between are counted one by one, and the counts of recent words are kept.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from tripleloom.llm.common import map_slices, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
KEPT_WORDS = 200_000


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a vocabulary file, on the driver."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size()) if not odd(i)]


class Viterbi:
    """Counts the pieces of the best segmentation."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.crossing = any(MARK in p.lstrip(MARK) for p, _ in vocabulary)
        self.has_newline = any("\n" in p for p, _ in vocabulary)
        self.inner: dict[str, int] = {}
        self.first: dict[str, int] = {}

    def pieces(self, text: str) -> int:
        """Pieces of one stretch of text, its spaces already marked."""
        best, count, unknown = [0.0], [0], self.unknown
        end, value, pieces, single = 1, float("-inf"), 0, False

        def close() -> None:
            """Settles place ``end``; the unknown character comes last, where no piece is that character alone."""
            nonlocal end, value, pieces, single
            if not single and best[-1] + unknown > value:
                value = best[-1] + unknown
                pieces = count[-1] + len(text[end - 1].encode())
            best.append(value)
            count.append(pieces)
            end, value, single = end + 1, float("-inf"), False

        # Matches come by their end, the longest first; a later one must be strictly better.
        for last, (size, score) in self.automaton.iter(text):
            while end <= last:
                close()
            total = best[end - size] + score
            if total > value:
                value, pieces = total, count[end - size] + 1
            single = single or size == 1
        while end <= len(text):
            close()
        return count[-1]

    def word(self, word: str, kept: dict[str, int], prefix: str) -> int:
        if len(kept) >= KEPT_WORDS:
            kept.clear()
        kept[word] = n = self.pieces(prefix + word)
        return n

    def count(self, text: str) -> int:
        """Pieces of a whole text; an empty one has none."""
        if not text:
            return 0
        if self.crossing or self.has_newline or MARK in text:
            return self.pieces(MARK + text.replace(" ", MARK))
        lines = text.split("\n")
        total = len(lines) - 1  # no piece holds a line break: each is one byte
        first, inner = self.first, self.inner
        for i, line in enumerate(lines):
            words = line.split(" ")
            if "" in words:
                total += self.marked(line, i == 0)
                continue
            if i:
                w = words.pop(0)
                n = first.get(w)
                total += self.word(w, first, "") if n is None else n
            for w in words:
                n = inner.get(w)
                total += self.word(w, inner, MARK) if n is None else n
        return total

    def marked(self, line: str, with_mark: bool) -> int:
        """A line with runs of spaces, cut before each run: no piece has a mark behind a letter."""
        text = (MARK if with_mark else "") + line.replace(" ", MARK)
        total, start = 0, 0
        for i in range(1, len(text)):
            if text[i] == MARK and text[i - 1] != MARK:
                total += self.pieces(text[start:i])
                start = i
        return total + (self.pieces(text[start:]) if text else 0)


def count_tokens(
    df: DataFrame, vocabulary: list[tuple[str, float]], text: str = "text", keep: list[str] | None = None,
    name: str = "n_tokens",
) -> DataFrame:
    """``keep`` (all columns by default) and the number of tokens of every whole text.

    A null or empty text has none. Scores add up in double precision, so counts do not depend on a
    text's length; repeated rows count alike; an empty table gives no rows. The vocabulary (tens of
    thousands of pieces) travels in the task's closure.
    """

    def make() -> Callable[[list[str | None]], list[list]]:
        model = Viterbi(vocabulary)
        return lambda texts: [[model.count(t or "") for t in texts]]

    return map_slices(df, [text], make, f"`{name}` bigint", keep)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents with the public 32,000-piece vocabulary."""
    import public_tokenizers

    vocabulary = load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])
