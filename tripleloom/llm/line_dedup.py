"""Line dedup by range-partitioned hashes (operator 11).

Every line with a long enough key becomes a row (hash, document, position). The rows are range-sorted by all
three, so a line that is everywhere spreads over partitions like any other rows. A task streams its range: the first
document of a hash keeps its lines, rows of later documents go. Only the first hash of a partition may have begun
in an earlier one; its rows wait for the partitions' heads (two rows each), which tell its first document.

What goes is returned as one compressed keep bitmap per document; texts are never shuffled to find it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tripleloom.llm.common import SPACES, explode_slices, fresh, map_slices, table
from tripleloom.session import cut_lineage

MIN_CHARS = 10
DROP, WAIT, HEAD = 0, 1, 2


def version(text: Column) -> Column:
    """Tells apart the texts of rows that share a key; rows alike in both have the same lines."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(df: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """``h1``, ``h2`` (128 bits of the line's key), ``doc``, ``ver`` and ``pos`` of every line whose key has ``min_chars`` code points."""
    fields = [StructField("doc", df.schema[key].dataType), *StructType.fromDDL("ver bigint, pos int, h1 bigint, h2 bigint").fields]
    named = df.select(F.col(f"`{key}`").alias("doc"), version(F.col(f"`{text}`")).alias("ver"), F.col(f"`{text}`").alias("text"))
    schema = StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                codes, places, owners = [], [], []
                for n, body in enumerate(part.column(2)):
                    if not body.is_valid:
                        continue
                    for pos, line in enumerate(body.as_buffer().to_pybytes().split(b"\n")):
                        line = line.strip(SPACES)
                        if len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode()) >= min_chars):
                            codes.append(digest(line.lower()))  # bytes: A-Z only
                            places.append(pos)
                            owners.append(n)
                words = np.frombuffer(b"".join(codes), "<i8").reshape(-1, 2)
                took = pa.array(owners, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(arrow.field(0).type).take(took), part.column(1).take(took), pa.array(places, pa.int32()),
                     pa.array(words[:, 0]), pa.array(words[:, 1])], schema=arrow,
                )

    return named.mapInArrow(run, schema)


def same(array: pa.Array) -> np.ndarray:
    """For every value but the first: whether it equals the one before, nulls being equal."""
    both = pc.and_(pc.is_null(array[1:]), pc.is_null(array[:-1]))
    return pc.or_(pc.fill_null(pc.equal(array[1:], array[:-1]), False), both).to_numpy(zero_copy_only=False)


def stream_ranges(lines: DataFrame, parts: int) -> DataFrame:
    """Rows of range-sorted lines that go (``DROP``) or wait for the heads (``WAIT``), and each partition's ``HEAD`` rows."""
    order = [F.col("h1"), F.col("h2"), F.col("doc").asc_nulls_last(), F.col("ver"), F.col("pos")]
    ranges = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = StructType([*StructType.fromDDL("kind int").fields, *lines.schema.fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in arrow][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.RecordBatch | None = None  # the last row seen
        head: pa.RecordBatch | None = None  # the first row of the current hash
        opening, later = True, False  # in the partition's first hash; a later document of the current hash was seen

        def rows(kind: int, chosen: pa.RecordBatch) -> pa.RecordBatch:
            kinds = pa.array(np.full(chosen.num_rows, kind, np.int32))
            return pa.RecordBatch.from_arrays([kinds, *[chosen.column(n).cast(arrow.field(n).type) for n in names]], schema=arrow)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            whole = pa.Table.from_batches([before, batch] if before is not None else [batch]).combine_chunks().to_batches()[0]
            extra = whole.num_rows - n
            alike = same(whole.column("h1")) & same(whole.column("h2"))
            known = same(whole.column("doc"))
            begins = np.concatenate([[True], ~alike])[-n:] if not extra else ~alike
            moved = np.concatenate([[False], alike & ~known])[-n:] if not extra else alike & ~known
            # Documents seen before in the current hash: moves since its beginning.
            seen = np.cumsum(moved)
            run_of = np.cumsum(begins)
            base = np.concatenate([[-1 if later else 0], (seen - moved)[begins]])
            gone = seen - base[run_of] > 0
            first = (run_of == (1 if before is None else 0)) if opening else np.zeros(n, bool)
            if head is None:
                head = batch.slice(0, 1)
                yield rows(HEAD, head)
            if first.any():
                yield rows(WAIT, batch.filter(pa.array(first)))
            if (gone & ~first).any():
                yield rows(DROP, batch.filter(pa.array(gone & ~first)))
            opening = opening and bool(first[-1])
            later = bool(gone[-1])
            if begins.any():
                head = batch.slice(int(np.flatnonzero(begins)[-1]), 1)
            before = batch.slice(n - 1, 1)
        if head is not None:
            yield rows(HEAD, head)

    return ranges.mapInArrow(run, schema)


def dropped_lines(df: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc``, ``ver`` and ``pos`` of every line that goes."""
    spark = df.sparkSession
    lines = cut_lineage(line_hashes(df, key, text, min_chars), "lines")
    streamed = cut_lineage(stream_ranges(lines, int(spark.conf.get("spark.sql.shuffle.partitions"))), "ranges")
    # Two heads per partition at most, one row per hash after the aggregate: small enough to broadcast.
    heads = streamed.where(F.col("kind") == HEAD).groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.min("doc").alias("owner"))
    waiting = streamed.where(F.col("kind") == WAIT).join(
        F.broadcast(heads), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    )
    late = waiting.where(~F.col("doc").eqNullSafe(F.col("owner")))
    return streamed.where(F.col("kind") == DROP).select("doc", "ver", "pos").union(late.select("doc", "ver", "pos"))


def bitmap(places: np.ndarray) -> bytes:
    """Compressed bits, 0 for each of the lines at ``places``; lines beyond the last bit stay."""
    bits = np.ones(8 * (int(places.max()) // 8 + 1), np.uint8)
    bits[places] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def kept(lines: list, bits: bytes | None) -> list:
    """The lines whose bit is set, all without a bitmap."""
    if bits is None:
        return lines
    flags = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), bitorder="little").tolist()
    return [x for x, keep in zip(lines, flags) if keep] + lines[len(flags):]


def keep_bitmaps(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc``, ``ver`` (see ``version``) and ``keep``, the bitmap of every document that loses a line.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of ``min_chars`` code points or more
    lose all lines but those of the smallest document. Documents are told apart by ``key``: rows that share one are the
    same document, so they lose nothing to each other; null keys are one document after all others. Null and empty
    texts are one empty line. Equal rows share a bitmap; an empty table gives none.
    """
    gone = dropped_lines(df, key, text, min_chars).groupBy("doc", "ver").agg(F.collect_list("pos").alias("places"))

    def make() -> Callable[[list[list[int]]], list[list]]:
        return lambda places: [[bitmap(np.array(p)) for p in places]]

    return map_slices(gone, ["places"], make, "keep binary", ["doc", "ver"])


def with_bitmaps(df: DataFrame, bitmaps: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``df`` with its bitmap as ``name``, null where a document loses nothing."""
    doc, ver = fresh(df, "doc", "ver")
    right = bitmaps.select(F.col("doc").alias(doc), F.col("ver").alias(ver), F.col("keep").alias(name))
    matched = F.col(f"`{key}`").eqNullSafe(F.col(doc)) & (version(F.col(f"`{text}`")) == F.col(ver))
    return df.join(right, matched, "left").select(*[F.col(f"`{c}`") for c in df.columns], name)


def drop_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``df`` with ``text`` reduced to the lines that stay; rules as in ``keep_bitmaps``. A null text stays null."""
    (name,) = fresh(df, "keep")
    joined = with_bitmaps(df, keep_bitmaps(df, key, text, min_chars), name, key, text)

    def make() -> Callable[..., list[list]]:
        return lambda texts, bits: [[t if b is None else "\n".join(kept(t.split("\n"), b)) for t, b in zip(texts, bits)]]

    made = map_slices(joined, [text, name], make, f"`{text}` string", [c for c in df.columns if c != text])
    return made.select(*[F.col(f"`{c}`") for c in df.columns])


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of the kept lines of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = with_bitmaps(docs, keep_bitmaps(docs), "keep")

    def make() -> Callable[..., list[list]]:
        def work(ids: list, texts: list[str | None], bits: list[bytes | None]) -> list[list]:
            sizes, gone, digests = [], [], []
            for t, b in zip(texts, bits):
                lines = (t or "").encode().split(b"\n")
                stay = kept(lines, b)
                sizes.append(len(lines))
                gone.append(len(lines) - len(stay))
                digests.append(hashlib.sha256(b"\n".join(stay)).hexdigest())
            return [ids, sizes, gone, digests]

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return explode_slices(
        joined, ["doc_id", "text", "keep"], make, f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string"
    )


OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
s AS (SELECT r, p, line, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.owner AS gone FROM k LEFT JOIN f USING (key)),
t AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS body FROM s GROUP BY r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(body) AS kept_sha256
FROM d JOIN t USING (r)"""
