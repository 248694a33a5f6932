"""Prefix trie of conversations (operator 12).

A conversation is a path: the 128-bit digests of its turns. Paths are dealt to shards by range, at splitters drawn from a
bounded sample. A node's members are neighbours in path order, so a node reaches into more than one
shard only if it lies on the path of a splitter. The splitters (their trie is the skeleton) are broadcast;
every shard streams its sorted paths and

* finishes all nodes off the skeleton by itself, with one stack as deep as the path at hand;
* sends partial aggregates of its skeleton nodes, which a reduction adds up.

A splitter is kept to its first ``SPLIT_TURNS`` turns; deeper nodes below a cut one count as skeleton nodes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tripleloom.llm.common import map_slices, table
from tripleloom.session import cut_lineage

WIDTH = 16  # bytes of a turn's digest
SPLIT_TURNS = 32
SAMPLE_PER_SHARD = 30
MAX_SAMPLE = 200_000
PART_TURNS = 1_000_000
PIECE_BYTES = 1 << 16
ROWS = 2048
DONE, WAIT, SHARED, ENDS = 0, 1, 2, 3

OUT = (
    "kind int, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, node binary, parent binary, above array<binary>, words bigint, shard int, "
    "piece int, ids binary"
)


def digested(df: DataFrame, turn: str = "turn", role: str = "role", text: str = "text", key: str = "conv_id") -> DataFrame:
    """``conv``, ``turn``, ``digest`` of role and text, ``words`` of the text; rows without a conversation are left out."""

    def make() -> Callable[..., list[list]]:
        def work(roles: list[str | None], texts: list[str | None]) -> list[list]:
            digests, words = [], []
            for r, t in zip(roles, texts):
                r, t = (r or "").encode(), (t or "").encode()
                digests.append(xxhash.xxh3_128_digest(len(r).to_bytes(8, "little") + r + t))
                words.append(len(t.split()))  # bytes: ASCII white space only
            return [digests, words]

        return work

    named = df.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text")
    )
    return map_slices(named, ["role", "text"], make, "digest binary, words bigint", ["conv", "turn"])


def conversations(turns: DataFrame) -> DataFrame:
    """``conv`` and its ``turns``, an array of (digest, words) by turn (null first), then digest."""
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").isNotNull(), F.lit(False)).alias("has"), "turn", "digest", "words")))
    taken = F.transform(rows, lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words")))
    return turns.groupBy("conv").agg(taken.alias("turns"))


def spliced(convs: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Every conversation with its first turns taken from its group's first one.

    ``c`` begins with the first ``h = crc32(c) % heads`` turns of ``c - c % group`` (all if fewer, none if absent) and goes on
    with its own turns after its first ``h``.
    """
    bases = convs.where(F.pmod("conv", F.lit(group)) == 0).select(
        F.col("conv").alias("base"), F.slice("turns", 1, heads - 1).alias("lead")
    )
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    joined = convs.join(bases, (F.col("conv") - F.pmod("conv", F.lit(group))) == F.col("base"), "left")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    lead = F.slice("lead", F.lit(1), h)
    return joined.select("conv", F.when(F.col("lead").isNull(), own).otherwise(F.concat(lead, own)).alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    """``conv``, ``path`` (the digests end to end) and ``words`` of every turn."""

    def make() -> Callable[..., list[list]]:
        return lambda turns: [[b"".join([x["digest"] for x in t]) for t in turns], [[x["words"] for x in t] for t in turns]]

    return map_slices(convs, ["turns"], make, "path binary, words array<bigint>", ["conv"])


def splitters(staged: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Sorted (path, conversation) at which a shard begins, the first shard left out.

    Chosen from at most ``MAX_SAMPLE`` conversations drawn by hash, at even shares of their turns.
    """
    if shards < 2:
        return []
    cut = F.substring("path", 1, WIDTH * SPLIT_TURNS)
    drawn = staged.select(cut.alias("path"), "conv", (F.size("words") + 1).alias("weight")).orderBy(F.xxhash64("conv"), "conv")
    rows = sorted((bytes(r.path), r.conv, r.weight) for r in drawn.limit(min(MAX_SAMPLE, shards * SAMPLE_PER_SHARD)).collect())
    step = sum(r[2] for r in rows) / shards
    chosen, total = [], 0
    for path, conv, weight in rows:
        if total >= step * (len(chosen) + 1):
            chosen.append((path, conv))
        total += weight
    return chosen


class Node:
    """An open node: what its members have told so far."""

    __slots__ = ("members", "least", "children", "leaves", "saved", "words", "ends", "waiting", "shared")

    def __init__(self, words: int, shared: bool):
        self.members, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.words, self.shared, self.ends, self.waiting = words, shared, None, []

    def add(self, members: int, least: int) -> None:
        self.members += members
        self.least = least if self.least is None else min(self.least, least)


NO_ENDS = hashlib.sha256(b"").hexdigest()


def node_key(path: bytes, depth: int) -> bytes:
    return xxhash.xxh3_128_digest(path[: WIDTH * depth])


class Shard:
    """Streams the sorted paths of one shard; ``out`` collects rows in the order of ``OUT``."""

    def __init__(self, number: int, edges: list[bytes], out: list[tuple]):
        self.number, self.edges, self.out = number, edges, out
        self.path = b""
        self.open = [Node(0, True)]  # the root is part of every skeleton
        self.ids: list[bytes] = []
        self.size = self.pieces = 0

    def is_shared(self, path: bytes, depth: int) -> bool:
        """Whether the node may have members in another shard: it is on, or below a cut end of, an edge's path."""
        at = WIDTH * depth
        return any(path.startswith(e[:at]) and (len(e) >= at or len(e) == WIDTH * SPLIT_TURNS) for e in self.edges)

    def push(self, path: bytes, words: list[int], conv: int) -> None:
        same = 0
        if path == self.path:
            same = len(path) // WIDTH
        else:
            if self.ids:
                self.flush()
            limit = min(len(path), len(self.path))
            while WIDTH * same < limit and path[WIDTH * same : WIDTH * (same + 1)] == self.path[WIDTH * same : WIDTH * (same + 1)]:
                same += 1
        while len(self.open) > same + 1:
            self.close()
        self.path = path
        for depth in range(same + 1, len(path) // WIDTH + 1):
            self.open.append(Node(words[depth - 1], self.open[-1].shared and self.is_shared(path, depth)))
        node = self.open[-1]
        node.add(1, conv)
        if node.shared:
            self.ids.append(b"%d" % conv)
            self.size += len(self.ids[-1]) + 1
            if self.size >= PIECE_BYTES:
                self.flush()
        elif node.ends is None:
            node.ends = hashlib.sha256(b"%d" % conv)
        else:
            node.ends.update(b",%d" % conv)

    def flush(self) -> None:
        """Hands on the ids that end at the open (shared) node, in order."""
        depth = len(self.open) - 1
        self.out.append((ENDS, *[None] * 8, node_key(self.path, depth), None, None, None, self.number, self.pieces, b",".join(self.ids)))
        self.ids, self.size = [], 0
        self.pieces += 1

    def close(self) -> None:
        """Ends the deepest open node."""
        depth = len(self.open) - 1
        if self.ids:
            self.flush()
        node = self.open.pop()
        up = self.open[-1] if depth else None
        if node.shared:
            keys = [node_key(self.path, d) for d in range(depth + 1)]
            parent = keys[-2] if depth else None
            self.out.append((
                SHARED, depth, node.least, None, node.members, node.children, node.leaves, node.saved, None,
                keys[-1], parent, keys, node.words, self.number, None, None,
            ))
            for row in node.waiting:
                self.out.append((WAIT, *row[:2], None, *row[2:], None, keys[-1], None, None, None, None, None))
            if up:
                up.add(node.members, node.least)
            return
        for row in node.waiting:
            self.out.append((DONE, *row[:2], node.least, *row[2:], None, None, None, None, None, None, None))
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.members - 1) * node.words
        ends = node.ends.hexdigest() if node.ends else NO_ENDS
        up.waiting.append((depth, node.least, node.members, node.children, leaves, saved, ends))
        up.add(node.members, node.least)
        up.children += 1
        up.leaves += leaves
        up.saved += saved
        if up.shared:  # its key is known, so its children need not be held
            key = node_key(self.path, depth - 1)
            for row in up.waiting:
                self.out.append((WAIT, *row[:2], None, *row[2:], None, key, None, None, None, None, None))
            up.waiting = []

    def end(self) -> None:
        while self.open:
            self.close()


def sharded(staged: DataFrame, shards: int) -> DataFrame:
    """The rows of all shards, as ``OUT``."""
    spark = staged.sparkSession
    # At most SPLIT_TURNS digests and an id per shard.
    sent = spark.sparkContext.broadcast(splitters(staged, shards))

    def make() -> Callable[..., list[list]]:
        begins = sent.value
        return lambda path, conv: [[bisect_right(begins, (p[: WIDTH * SPLIT_TURNS], c)) for p, c in zip(path, conv)]]

    dealt = map_slices(staged, ["path", "conv"], make, "shard int", ["conv", "path", "words"])
    runs = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv")
    schema = StructType.fromDDL(OUT)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = sent.value
        out: list[tuple] = []
        shard: Shard | None = None

        def rows() -> pa.RecordBatch:
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "path", "words", "conv")]
            for number, path, words, conv in zip(*[c.to_pylist() for c in columns]):
                if shard is None or shard.number != number:
                    if shard:
                        shard.end()
                    edges = [begins[i][0] for i in (number - 1, number) if 0 <= i < len(begins)]
                    shard = Shard(number, edges, out)
                shard.push(path, words, conv)
                if len(out) >= ROWS:
                    yield rows()
        if shard:
            shard.end()
        if out:
            yield rows()

    return runs.mapInArrow(run, schema)


def hashed_ends(pieces: DataFrame) -> DataFrame:
    """``node`` and ``ends`` of shared nodes with ends: their pieces are streamed in order, a hash at a time."""
    runs = pieces.select("node", "shard", "piece", "ids").repartition("node").sortWithinPartitions("node", "shard", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends"])

        for batch in batches:
            for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if key != node:
                    if state:
                        yield row()
                    node, state = key, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
        if state:
            yield row()

    return runs.mapInArrow(run, "node binary, ends string")


def prefix_trie(convs: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of ``convs`` (``conv``, and ``turns`` as an array of (digest, words)).

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``. Turnless conversations end at the root; equal conversations share all nodes; a table without
    conversations has no node. A conversation is held in one row as 24 bytes a turn, however long its texts.
    """
    spark = convs.sparkSession
    staged = cut_lineage(paths(convs), "paths")
    if shards is None:
        turns = staged.agg(F.sum(F.size("words") + 1)).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // PART_TURNS))
    rows = cut_lineage(sharded(staged, shards), "trie")
    partial = rows.where(F.col("kind") == SHARED).groupBy("node").agg(
        *[F.min(c).alias(c) for c in ("parent", "above", "depth", "words", "conv_id")],
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    partial = cut_lineage(partial, "skeleton")
    inner = partial.where("depth > 0").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("inner"))
    nodes = cut_lineage(
        partial.join(inner, F.col("node") == F.col("of"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0))), "skeleton"
    )
    own = nodes.select(
        F.explode("above").alias("at"),
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    totals = own.groupBy("at").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    parents = nodes.select(F.col("node").alias("key"), F.col("conv_id").alias("parent_conv_id"))
    ends = hashed_ends(rows.where(F.col("kind") == ENDS)).withColumnRenamed("node", "ended")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    skeleton = (
        nodes.drop("n_leaves", "saved_tokens", "of", "inner")
        .join(totals, F.col("node") == F.col("at"))
        .join(ends, F.col("node") == F.col("ended"), "left")
        .join(parents, F.col("parent") == F.col("key"), "left")
        .withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS)))
    )
    waiting = rows.where(F.col("kind") == WAIT).drop("parent_conv_id").join(parents, F.col("parent") == F.col("key"))
    done = rows.where(F.col("kind") == DONE)
    return done.select(*columns).union(waiting.select(*columns)).union(skeleton.select(*columns))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's nodes of all rebuilt conversations."""
    turns = digested(table(spark, sf_dir, "conversations"))
    return prefix_trie(spliced(cut_lineage(conversations(turns), "conversations")))


# crc32 of the decimal id, bit by bit; a prefix is known by the hash chain of its turns.
OP12_SQL = r"""WITH RECURSIVE t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c - c % 20 AS base FROM t),
bits AS (SELECT c, base, CAST(4294967295 AS BIGINT) AS crc, 0 AS i FROM ids
  UNION ALL
  SELECT c, base, list_reduce([xor(crc, CAST(ascii(substr(CAST(c AS VARCHAR), i + 1, 1)) AS BIGINT)), 0, 0, 0, 0, 0, 0, 0, 0],
           lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END), i + 1
  FROM bits WHERE i < length(CAST(c AS VARCHAR))),
h AS (SELECT c, base, xor(crc, CAST(4294967295 AS BIGINT)) % 4 AS h FROM bits WHERE i = length(CAST(c AS VARCHAR))),
u AS (SELECT h.c, 0 AS part, t.p, t.g, t.w FROM h JOIN t ON t.c = h.base AND t.p <= h.h
      UNION ALL SELECT h.c, 1, t.p, t.g, t.w FROM h JOIN t ON t.c = h.c AND t.p > h.h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, g, w FROM u),
walk AS (SELECT c, 0 AS d, '' AS k, CAST(NULL AS VARCHAR) AS up, 0 AS w FROM ids
  UNION ALL SELECT r.c, walk.d + 1, sha256(walk.k || r.g), walk.k, r.w FROM walk JOIN r ON r.c = walk.c AND r.d = walk.d + 1),
size AS (SELECT c, max(d) AS n FROM walk GROUP BY c),
node AS (SELECT d, k, min(up) AS up, min(w) AS w, min(walk.c) AS c, count(*) AS n,
                sha256(coalesce(string_agg(CAST(walk.c AS VARCHAR), ',' ORDER BY walk.c) FILTER (WHERE walk.d = size.n), '')) AS ends
         FROM walk JOIN size ON walk.c = size.c GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS kids FROM node LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k),
below AS (SELECT a.d, a.k, count(*) FILTER (WHERE f.kids = 0) AS leaves, sum((f.n - 1) * f.w) AS saved
          FROM full_ f JOIN walk a ON a.c = f.c AND a.d <= f.d GROUP BY a.d, a.k)
SELECT CAST(f.c AS BIGINT) AS conv_id, CAST(f.d AS BIGINT) AS depth, CAST(p.c AS BIGINT) AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs,
       CAST(f.kids AS BIGINT) AS n_children, CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens,
       f.ends AS ends_sha256
FROM full_ f JOIN below ON below.d = f.d AND below.k = f.k LEFT JOIN full_ p ON p.d = f.d - 1 AND p.k = f.up"""
