"""Packing along a space-filling curve (operator 10).

1. Every document becomes its token ids and a hashed vector (signed counts in 64 places,
   damped, of unit length), projected to four dimensions. Their normal quantiles are the
   coordinates of a Hilbert curve.
2. The written table is range-sorted by Hilbert key, then id, then row: equal keys (copies)
   are split over partitions as well.
3. Each partition is read once as a stream of ids and cut every ``capacity`` ids. Its tail is
   cut at powers of two, so nothing is padded.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType
from tokenizers import Tokenizer

from tripleloom.llm.common import map_slices, table
from tripleloom.session import cut_lineage

CAPACITY = 2048
END_ID = 1
PLACES = 64
DIMS, BITS = 4, 12
PART_IDS = 4_000_000
KEPT_WORDS = 200_000

# How the byte-level vocabulary cuts a text into words (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, reversed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Byte pieces with their ids, if ids are ranks of a plain byte-level BPE; else None."""
    pre = spec.get("pre_tokenizer") or {}
    model = spec["model"]
    plain = (
        pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and not spec.get("normalizer") and model.get("type", "BPE") == "BPE" and not model.get("dropout")
        and not model.get("ignore_merges")
    )
    if not plain:
        return None
    letters = byte_letters()
    added = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {p: i for p, i in model["vocab"].items() if p not in added}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if any(not set(p) <= letters.keys() for p in vocab) or [vocab.get(p) for p in merged] != list(range(256, 256 + len(merged))):
        return None
    return {bytes(letters[c] for c in p): i for p, i in vocab.items()}


class Odd(Exception):
    """White space that the word cache does not cover."""


class Words(dict):
    """Ids of recent words as bytes; a miss asks the encoder."""

    def __init__(self, encode: Callable[[str], bytes], prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        if word.split() != [word]:
            raise Odd
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = ids = self.encode(self.prefix + word)
        return ids


class Encoder:
    """A text's ids as little-endian bytes, equal to the tokenizer's own."""

    def __init__(self, spec_text: str, ranks: dict[bytes, int] | None, dtype: str):
        self.own = Tokenizer.from_str(spec_text)
        self.dtype = dtype
        self.special = [t["content"] for t in json.loads(spec_text).get("added_tokens", [])]
        self.fast = ranks is not None
        if self.fast:
            bpe = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            self.plain = lambda t: np.array(bpe.encode_ordinary(t), dtype).tobytes()
            self.first, self.inner = Words(self.plain, ""), Words(self.plain, " ")
            self.line = self.plain("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.fast or any(s in text for s in self.special):
            return self.whole(text)
        try:
            # Between single spaces and line breaks every word is encoded by itself.
            parts: list[bytes] = []
            for i, line in enumerate(text.split("\n")):
                if i:
                    parts.append(self.line)
                words = line.split(" ")
                parts.append(self.first[words[0]])
                parts.extend(map(self.inner.__getitem__, words[1:]))
            return b"".join(parts)
        except Odd:
            return self.plain(text)


def projection() -> np.ndarray:
    """A fixed orthonormal map from the hashed places to the curve's dimensions."""
    return np.linalg.qr(np.random.default_rng(2).standard_normal((PLACES, DIMS)))[0]


def place_table(size: int) -> np.ndarray:
    """For each id its hashed place, and beyond ``PLACES`` the same place with a minus sign."""
    mixed = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(57)).astype(np.int64)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows), by the transpose form of the curve."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(counts: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Hilbert keys of signed hashed counts (rows of ``PLACES`` plus and as many minus places)."""
    vec = counts[:, :PLACES] - counts[:, PLACES:]
    vec = np.sign(vec) * np.sqrt(np.abs(vec))
    size = np.sqrt((vec**2).sum(axis=1, keepdims=True))
    flat = (vec / np.where(size == 0, 1, size)) @ matrix * np.sqrt(PLACES)
    # Coordinates are near to normal; the logistic curve is close to the normal distribution's.
    cells = (1 / (1 + np.exp(-1.702 * np.clip(flat, -8, 8)))) * (1 << BITS)
    return hilbert_keys(np.clip(cells.astype(np.int64), 0, (1 << BITS) - 1))


def encoded(df: DataFrame, spec_text: str, key: str, text: str, end_id: int) -> DataFrame:
    """``key``, ``ids`` (bytes, the end id last) and ``curve``, the Hilbert key."""
    spec = json.loads(spec_text)
    size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", [])), end_id])
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    # A vocabulary is of fixed size (about 2 MB), so it is sent to each executor once.
    sent = df.sparkSession.sparkContext.broadcast((spec_text, merge_ranks(spec)))
    matrix = projection()

    def make() -> Callable[[list[str | None]], list[list]]:
        encoder = Encoder(*sent.value, dtype)
        places = place_table(size)
        end = np.array([end_id], dtype).tobytes()

        def work(texts: list[str | None]) -> list[list]:
            bodies = [encoder.ids(t or "") for t in texts]
            counts = [np.bincount(places[np.frombuffer(b, dtype)], minlength=2 * PLACES) for b in bodies]
            return [[b + end for b in bodies], curve_keys(np.array(counts, np.float64), matrix).tolist()]

        return work

    return map_slices(df, [text], make, "ids binary, curve bigint", [key]), dtype


def pack_documents(
    df: DataFrame, spec_text: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    part_ids: int = PART_IDS,
) -> DataFrame:
    """One row per piece: ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset`` and ``tokens``, the ids.

    A null or empty text is the end id alone. Null keys and repeated rows are documents of their
    own; an empty table gives no pieces. A text longer than ``capacity`` is cut over sequences.
    ``part_ids`` is the number of ids that one task packs, so the number of tasks follows the input.
    """
    spark = df.sparkSession
    made, dtype = encoded(df, spec_text, key, text, end_id)
    width = np.dtype(dtype).itemsize
    staged = cut_lineage(made.withColumn("row", F.monotonically_increasing_id()), "ids")
    total = staged.agg(F.sum(F.length("ids"))).first()[0] or 0
    parts = max(1, -(-total // (width * part_ids)))
    run_order = ["curve", f"`{key}`", "row"]
    ordered = staged.repartitionByRange(parts, *run_order).sortWithinPartitions(*run_order)
    fields = StructType.fromDDL(
        "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tokens array<int>"
    ).fields
    schema = StructType([StructField(key, df.schema[key].dataType), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        number, filled = 0, 0
        rows: list[tuple] = []
        tail: list[tuple] = []  # pieces of the open sequence, as (key, start, doc size, ids)

        def close(pieces: list[tuple]) -> None:
            nonlocal number
            at = 0
            for k, start, size, ids in pieces:
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                rows.append((k, start, len(ids), crc, size, first + number, at, ids.astype(np.int32)))
                at += len(ids)
            number += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            arrays = [pa.array(c, arrow.field(i).type) for i, c in enumerate(columns[:-1])]
            sizes = np.concatenate([[0], np.cumsum([len(c) for c in columns[-1]])])
            ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(columns[-1])))
            return pa.RecordBatch.from_arrays([*arrays, ids.cast(arrow.field(len(arrays)).type)], schema=arrow)

        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(body.as_buffer(), dtype)
                at = 0
                while at < len(ids):
                    take = ids[at : at + capacity - filled]
                    tail.append((k, at, len(ids), take))
                    at += len(take)
                    filled += len(take)
                    if filled == capacity:
                        close(tail)
                        tail, filled = [], 0
                if len(rows) >= 512:
                    yield flushed()
        # The rest is cut into sequences of powers of two, the largest first.
        while filled:
            size = 1 << (filled.bit_length() - 1)
            filled -= size
            now: list[tuple] = []
            while size:
                k, start, n, ids = tail.pop(0)
                if len(ids) > size:
                    tail.insert(0, (k, start + size, n, ids[size:]))
                    ids = ids[:size]
                now.append((k, start, n, ids))
                size -= len(ids)
            close(now)
        if rows:
            yield flushed()

    return ordered.select(F.col(f"`{key}`"), "ids").mapInArrow(run, schema)


def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's pieces of all documents, with the public byte-level vocabulary."""
    return pack_table(table(spark, sf_dir, "documents"))


def pack_table(documents: DataFrame) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec_text = file.read()
    return pack_documents(documents, spec_text).drop("tokens")
