"""Alignment of two tokenizers (operator 13).

Every text is encoded twice. The cumulative byte ends of each encoding form a dictionary from end to
number of tokens; the ends in both dictionaries cut the two id lists into groups, and every pair of
tokens inside a group is a link.

Over the corpus, a pair of ids counts the documents that hold it linked. Documents are gathered in
blocks of bounded size. A block adds up its pairs before anything is shuffled, asks for the counts of its
distinct pairs once, and spends them on its documents: no row per document and pair is ever shuffled.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from tripleloom.llm.common import fresh, map_slices, table
from tripleloom.llm.hilbert_pack import WORDS, byte_letters, merge_ranks
from tripleloom.session import cut_lineage

SLICE = 128
BLOCK_ROWS = 1024
BLOCK_LINKS = 4_000_000
KEPT = 200_000  # entries of a task's caches


def cuts(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[list[int], list[int]]:
    """How many tokens of either side end at each byte offset where both do, in order."""
    a_ends = dict(zip(a_lengths.cumsum().tolist(), range(1, len(a_lengths) + 1)))
    b_ends = dict(zip(b_lengths.cumsum().tolist(), range(1, len(b_lengths) + 1)))
    # The second dictionary's keys are sorted already, so those also in the first one are.
    common = list(filter(a_ends.__contains__, b_ends))
    return list(map(a_ends.__getitem__, common)), list(map(b_ends.__getitem__, common))


class BytePieces:
    """Ids and token bytes of a byte-level BPE file, for a space and the text."""

    def __init__(self, spec_text: str):
        spec = json.loads(spec_text)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes = [b""] * (1 + max(vocab.values()))
        for piece, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in piece) if set(piece) <= letters.keys() else piece.encode()
        ranks = merge_ranks(spec)
        if ranks is None:
            own = Tokenizer.from_str(spec_text)
            own.encode_special_tokens = True  # their strings in a text are ordinary text
            self.encode = lambda t: np.array(own.encode(t, add_special_tokens=False).ids, np.int64)
        else:
            bpe = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda t: bpe.encode_to_numpy(t, disallowed_special=())
        self.plain = ranks is not None  # gives back every text


class WordPieces:
    """Ids and token bytes of a sentencepiece model, which puts the space itself."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_proto=model)
        pieces = [(i, self.own.id_to_piece(i)) for i in range(self.own.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces
        ]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


class Known(dict):
    """What ``make`` gives for recent keys."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= KEPT:
            self.clear()
        self[key] = value = self.make(key)
        return value


class Aligner:
    """Both encodings of a slice of texts with their groups."""

    def __init__(self, spec_text: str, model: bytes):
        self.a, self.b = BytePieces(spec_text), WordPieces(model)
        self.a_bytes, self.b_bytes = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        self.a_lengths, self.b_lengths = (np.array(list(map(len, x.bytes))) for x in (self.a, self.b))
        self.shift = max(1, (len(self.b.bytes) - 1).bit_length())
        mask = (1 << self.shift) - 1
        self.shown = Known(lambda code: f"{code >> self.shift}|{code & mask}")
        self.wide = Known(self.expanded)

    def expanded(self, group: tuple[int, ...]) -> tuple[str, list[int]]:
        """A group of any size (both id lists, -1 between) as text, and the codes of its links."""
        cut = group.index(-1)
        left, right = group[:cut], group[cut + 1 :]
        text = ",".join(map(str, left)) + "|" + ",".join(map(str, right))
        return text, [x << self.shift | y for x in left for y in right]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
        """Per text: ids, ids and both ``cuts``; all empty where a side doesn't give the text's bytes back."""
        out = []
        none = np.empty(0, np.int64)
        for text, ids in zip(texts, self.b.ids([t or "" for t in texts])):
            whole = (" " + text).encode() if text else b""
            if not text or b"".join(map(self.b_bytes, ids)) != whole:
                out.append((none, none, [], []))
                continue
            a, b = self.a.encode(" " + text).astype(np.int64), np.array(ids, np.int64)
            if not self.a.plain and b"".join(map(self.a_bytes, a.tolist())) != whole:
                out.append((none, none, [], []))
                continue
            out.append((a, b, *cuts(self.a_lengths[a], self.b_lengths[b])))
        return out

    def links(self, a: np.ndarray, b: np.ndarray, a_cuts: list[int], b_cuts: list[int]) -> tuple[str, np.ndarray]:
        """The groups as text, and one code per link: the first id beside the second."""
        if not a_cuts:
            return "", np.empty(0, np.int64)
        left, right = np.array([0, *a_cuts]), np.array([0, *b_cuts])
        wide = (np.diff(left) > 1) | (np.diff(right) > 1)
        # Most groups are one token a side; the others are put right below.
        codes = a[left[1:] - 1] << self.shift | b[right[1:] - 1]
        shown = list(map(self.shown.__getitem__, codes.tolist()))
        more: list[int] = []
        a, b = a.tolist(), b.tolist()
        at = np.flatnonzero(wide)
        for g, i, i2, j, j2 in zip(*[x.tolist() for x in (at, left[at], left[at + 1], right[at], right[at + 1])]):
            group = (*a[i:i2], -1, *b[j:j2])
            # A stretch that the sides cut differently throughout is one long group, not worth keeping.
            shown[g], codes_of = self.wide[group] if len(group) < 64 else self.expanded(group)
            more += codes_of
        return ";".join(shown), np.concatenate([codes[~wide], np.array(more, np.int64)])


def sent_models(spark: SparkSession, spec_text: str, model: bytes):
    # Both vocabularies are of fixed size (a few MB), so each executor gets them once.
    return spark.sparkContext.broadcast((spec_text, model))


def align_tokens(df: DataFrame, spec_text: str, model: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with ``a_ids``, ``b_ids``, ``a_cuts`` and ``b_cuts``.

    Group ``g`` holds the ids from cut ``g - 1`` (or 0) up to cut ``g`` of either side. Null and empty texts, and texts
    that a tokenizer doesn't give back byte for byte, have empty arrays. Texts of any length are encoded whole.
    Repeated rows are aligned alike; an empty table gives none. A kept column with the name of a new one is replaced.
    """
    sent = sent_models(df.sparkSession, spec_text, model)

    def make() -> Callable[[list[str | None]], list[list]]:
        aligner = Aligner(*sent.value)

        def work(texts: list[str | None]) -> list[list]:
            found = aligner.encode(texts)
            return list(map(list, zip(*found))) or [[]] * 4

        return work

    return map_slices(df, [text], make, "a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>", keep, SLICE)


DOCUMENT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
BLOCKS = f"{DOCUMENT}, block bigint, codes binary, times binary, pairs array<bigint>, holders array<bigint>"


def linked_blocks(df: DataFrame, spec_text: str, model: bytes, key: str, text: str) -> DataFrame:
    """One row per document, and one per block whose ``pairs`` are not null.

    A document has its digests, its block, and its distinct codes with the number of links of each, as bytes. A
    block has its distinct codes and how many of its documents hold each.
    """
    sent = sent_models(df.sparkSession, spec_text, model)
    schema = StructType([df.schema[key]] + StructType.fromDDL(BLOCKS).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*sent.value)
        block = TaskContext.get().partitionId() << 36
        held: list[np.ndarray] = []
        rows = links = 0

        def block_row() -> pa.RecordBatch:
            pairs, holders = np.unique(np.concatenate(held), return_counts=True)
            values = [None] * 6 + [block, None, None, pairs, holders]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = []
                for a, b, a_cuts, b_cuts in aligner.encode(part.column(1).to_pylist()):
                    shown, codes = aligner.links(a, b, a_cuts, b_cuts)
                    distinct, times = np.unique(codes, return_counts=True)
                    digest = hashlib.sha256(shown.encode()).hexdigest() if a_cuts else ""
                    made.append((
                        len(a), len(b), len(a_cuts), len(codes), digest, block,
                        distinct.astype("<u4" if not len(distinct) or distinct[-1] < 1 << 32 else "<u8").tobytes(),
                        times.astype("<u4").tobytes(), None, None,
                    ))
                    held.append(distinct)
                    rows += 1
                    links += len(codes)
                    if rows >= BLOCK_ROWS or links >= BLOCK_LINKS:
                        yield block_row()
                        held, rows, links, block = [], 0, 0, block + 1
                keys = part.column(0).cast(arrow.field(0).type)
                yield pa.RecordBatch.from_arrays(
                    [keys, *[pa.array(c, f.type) for c, f in zip(zip(*made), list(arrow)[1:])]], schema=arrow
                )
        if held:
            yield block_row()

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def pair_counts(blocks: DataFrame, shift: int) -> DataFrame:
    """``code``, ``count`` (documents that hold it linked) and ``best``: whether no other pair of its first id counts more."""
    asked = blocks.where("pairs IS NOT NULL").select(F.inline(F.arrays_zip("pairs", "holders")))
    counts = asked.groupBy(F.col("pairs").alias("code")).agg(F.sum("holders").alias("count"))
    counts = cut_lineage(counts.withColumn("first_id", F.shiftright("code", shift)), "pairs")
    most = counts.groupBy("first_id").agg(F.max("count").alias("most"))
    return counts.join(most, "first_id").select("code", "count", (F.col("count") == F.col("most")).alias("best"))


def link_statistics(df: DataFrame, spec_text: str, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: ``key``, token, group and link counts, ``n_best``, ``count_sum`` and ``groups_sha256``.

    Every row is a document of its own, with null and repeated keys too. Null and empty texts, and texts that a tokenizer
    doesn't give back, count zero and have an empty digest. Ties for the highest count are all best. An empty
    table gives none. A block holds ``BLOCK_ROWS`` documents, fewer where they are long, and one at least.
    """
    (k,) = fresh(df.sparkSession.createDataFrame([], f"{BLOCKS}, n_best bigint, count_sum bigint, code bigint"), "key")
    named = df.select(F.col(f"`{key}`").alias(k), F.col(f"`{text}`").alias("text"))
    staged = cut_lineage(linked_blocks(named, spec_text, model, k, "text"), "aligned")
    shift = Aligner(spec_text, model).shift
    counts = pair_counts(staged, shift)
    asked = staged.where("pairs IS NOT NULL").select(F.col("block").alias("of"), F.explode("pairs").alias("code"))
    answers = asked.join(counts, "code").select("of", "code", "count", "best")
    documents = staged.where("pairs IS NULL").select(k, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "codes", "times")
    schema = StructType([staged.schema[k]] + StructType.fromDDL(
        "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    ).fields)
    arrow = to_arrow_schema(schema)

    def spend(docs: pa.Table, known: pa.Table) -> pa.Table:
        code, count, best = (known.column(c).to_numpy() for c in ("code", "count", "best"))
        order = np.argsort(code)
        code, count, best = code[order], count[order], best[order].astype(bool)
        n_best, count_sum = [], []
        for c, t in zip(docs.column("codes").to_pylist(), docs.column("times").to_pylist()):
            times = np.frombuffer(t, "<u4").astype(np.int64)
            at = np.searchsorted(code, np.frombuffer(c, "<u4" if len(c) == len(t) else "<u8").astype(np.int64))
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int((times * count[at]).sum()))
        added = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.table([added[f.name] if f.name in added else docs.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    made = documents.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(spend, schema)
    return made.withColumnRenamed(k, key)


def public_models() -> tuple[str, bytes]:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec_text = file.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return spec_text, file.read()


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return link_statistics(table(spark, sf_dir, "documents"), *public_models())
