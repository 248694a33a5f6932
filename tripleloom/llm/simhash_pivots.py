"""SimHash near duplicates by pivot distance tables (operator 6).

The reference fingerprints ("pivots") are the zero word, the 32 words with one pair of
bits set, and 16 dense pseudo-random words. Hamming distance is a metric, so two
fingerprints at ``k`` or fewer differing bits differ by at most ``k`` in their distance to any pivot.

The distances to the zero word and to a pair's word give the number of bits set in that
pair: ``d(x, 0) - d(x, pair) = 2 * set - 2``. These 32 coordinates belong to disjoint
bits, so ``k`` differing bits change at most ``k`` of them. Cut into five groups, at least
three groups stay as they are; one equi-join key per choice of three groups (ten keys)
therefore brings every linked pair together. Inside a bucket pairs are discarded by the
largest coordinate difference to the dense pivots, and the rest verified.

No pair leaves a bucket: a task reduces its bucket to the edges of a spanning forest, at
most one per fingerprint, and a large bucket is cut again by finer choices of groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm.common import fresh, map_slices, table
from tripleloom.session import cut_lineage

SHINGLE = 3
SEED = 42
MAX_BITS = 2
GROUPS = 5
FINE_GROUPS = 8
SMALL_BUCKET = 512
LOW = 0x5555555555555555


def fingerprint(text: str) -> int:
    """64-bit SimHash of a text's three-word shingles; zero where it has no word.

    A bit is set if it is set in over half of the shingles' hashes, repeats counted.
    """
    words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-SHINGLE] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        n = len(starts)
        hashes = np.fromiter(
            (digest(line[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())), np.uint64, n
        )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(majority.view(np.uint64)[0])


def add_fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and the fingerprint as a signed long. A null text counts as empty."""

    def make() -> Callable[[list[str | None]], list[list]]:
        def work(texts: list[str | None]) -> list[list]:
            found = [fingerprint(t or "") for t in texts]
            return [[x - (1 << 64) if x >> 63 else x for x in found]]

        return work

    return map_slices(df, [text], make, f"`{name}` bigint", keep)


def group_masks(groups: int, max_bits: int = MAX_BITS) -> list[int]:
    """For every choice of unchanged groups, the mask of their coordinates (two bits each)."""
    edges = [round(32 * g / groups) for g in range(groups + 1)]
    fields = [sum(3 << (2 * i) for i in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(fields, groups - max_bits)]


def pair_counts(x: Column) -> Column:
    """All 32 pair coordinates in one word: bits set in each pair, two bits each."""
    even = x.bitwiseAND(F.lit(LOW))
    odd = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(LOW))
    return even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def pivots(n: int = 16) -> np.ndarray:
    """Dense reference fingerprints, the same in every run."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(n)], np.uint64)


class Forest:
    """Union-find over the places of a bucket."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def link_block(values: np.ndarray, places: np.ndarray, table_: np.ndarray, forest: Forest, max_bits: int) -> None:
    """Joins linked fingerprints of a block: pivot table first, Hamming distance after."""
    n = len(places)
    rows = max(1, (1 << 21) // max(1, n))
    for at in range(0, n - 1, rows):
        i = np.arange(at, min(n, at + rows))
        left, right = np.nonzero(i[:, None] < np.arange(n)[None, :])
        left = left + at
        for p in range(table_.shape[1]):
            column = table_[places, p]
            near = np.abs(column[left] - column[right]) <= max_bits
            left, right = left[near], right[near]
            if len(left) < 64:
                break
        a, b = places[left], places[right]
        linked = np.bitwise_count(values[a] ^ values[b]) <= max_bits
        for u, v in zip(a[linked].tolist(), b[linked].tolist()):
            forest.union(u, v)


def bucket_edges(values: np.ndarray, refs: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a bucket's links: each fingerprint and its tree's first one.

    ``values`` are distinct and sorted. A bucket over ``SMALL_BUCKET`` is cut again by the finer keys.
    """
    distances = np.stack([np.bitwise_count(values ^ r) for r in refs], axis=1).astype(np.int16)
    forest = Forest(len(values))
    if len(values) <= SMALL_BUCKET:
        link_block(values, np.arange(len(values)), distances, forest, max_bits)
    else:
        counts = values - ((values >> np.uint64(1)) & np.uint64(LOW))
        for mask in group_masks(FINE_GROUPS, max_bits):
            key = counts & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(order)]])
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                link_block(values, order[s:e], distances, forest, max_bits)
    roots = np.array([forest.root(i) for i in range(len(values))])
    moved = np.flatnonzero(roots != np.arange(len(values)))
    return values[moved], values[roots[moved]]


def fingerprint_links(distinct: DataFrame, name: str = "fingerprint", max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints that join what is linked, without listing all pairs."""
    x = F.col(name)
    counts = pair_counts(x)
    keys = [
        F.struct(F.lit(i).alias("choice"), counts.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key"))
        for i, m in enumerate(group_masks(GROUPS, max_bits))
    ]
    keyed = distinct.select(x.alias("value"), F.explode(F.array(*keys)).alias("k"))
    # The table is dealt by key and sorted in the tasks, so a bucket is a run of rows.
    dealt = keyed.select("value", F.xxhash64("k.choice", "k.key").alias("bucket"))
    runs = dealt.repartition("bucket").sortWithinPartitions("bucket", "value")
    refs = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def edges(bucket: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
            many = ends - starts > 1
            a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for s, e in zip(starts[many].tolist(), ends[many].tolist()):
                u, v = bucket_edges(np.unique(value[s:e].view(np.uint64)), refs, max_bits)
                a.append(u)
                b.append(v)
            out = [np.concatenate(x).view(np.int64) for x in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], schema=schema)

        for batch in batches:
            value, bucket = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(bucket):
                continue
            # All but the last bucket of what has come are whole.
            last = int(np.searchsorted(bucket, bucket[-1]))
            if held and (last or held[-1][0][0] != bucket[0]):
                whole = [*held, (bucket[:last], value[:last])]
                yield edges(*[np.concatenate(x) for x in zip(*whole)])
                held = [(bucket[last:].copy(), value[last:].copy())]
            elif held:
                held.append((bucket.copy(), value.copy()))
            else:
                if last:
                    yield edges(bucket[:last], value[:last])
                held = [(bucket[last:].copy(), value[last:].copy())]
        if held:
            yield edges(*[np.concatenate(x) for x in zip(*held)])

    return runs.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` for every node with an edge; the root is the smallest node reachable.

    Every round, each node takes the smallest label around it and then its label's label, so
    long chains shrink in about the logarithm of their length. Labels are tables in the
    shared folder; only a count comes to the driver.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    both = cut_lineage(both.distinct(), "links")
    label = cut_lineage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")).withColumnRenamed("u", "node"), "labels")
    for _ in range(max_rounds):
        around = both.join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("label").alias("near"))
        lower = label.join(around, label["node"] == around["u"]).select(
            "node", "label", F.least("label", "near").alias("low")
        )
        jump = label.select(F.col("node").alias("at"), F.col("label").alias("next"))
        step = lower.join(jump, lower["low"] == jump["at"]).select(
            "node", F.least("low", "next").alias("label"), (F.least("low", "next") != F.col("label")).alias("moved")
        )
        step = cut_lineage(step, "labels")
        label = step.select("node", "label")
        if step.where("moved").isEmpty():
            return label.select("node", F.col("label").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def fingerprint_groups(prints: DataFrame, name: str = "fingerprint") -> DataFrame:
    """``node`` and ``root`` of every linked fingerprint; one without a link has no row."""
    return components(cut_lineage(fingerprint_links(prints.select(name).distinct(), name), "edges"))


def with_groups(prints: DataFrame, name: str, group: str) -> DataFrame:
    """``prints`` with the root of their fingerprint's component as ``group``."""
    roots = fingerprint_groups(prints, name)
    joined = prints.join(roots, prints[name] == roots["node"], "left")
    return joined.select(*prints.columns, F.coalesce("root", F.col(name)).alias(group))


def component_ids(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``fingerprint`` (signed long) and ``component_id``, the smallest key of its component.

    Null and empty texts share fingerprint zero. Null keys get a component like any other row
    but never name one unless it has no other; repeated rows stay; an empty table gives none.
    """
    prints = cut_lineage(add_fingerprints(df, text, keep=[key]), "prints")
    grouped = with_groups(prints, "fingerprint", "group")
    grouped = cut_lineage(grouped, "groups")
    least = grouped.groupBy("group").agg(F.min(key).alias("component_id"))
    return grouped.join(least, "group").select(key, "fingerprint", "component_id")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest key of every component, its columns unchanged.

    Ties and repeated rows: exactly one row stays. A null key stays only where its component has
    no other. Rows are numbered in a written table, so they can be told apart.
    """
    row, mark, group = fresh(df, "row", "mark", "group")
    columns = [F.col(f"`{c}`") for c in df.columns]
    numbered = df.select(*columns, F.monotonically_increasing_id().alias(row))
    staged = cut_lineage(add_fingerprints(numbered, text, mark), "staged")
    grouped = with_groups(staged.select(row, F.col(f"`{key}`").alias("k"), mark), mark, group)
    best = F.min(F.struct(F.col("k").isNull().alias("z"), F.col("k").alias("k"), F.col(row).alias("r")))
    kept = grouped.groupBy(group).agg(best.alias("b")).select(F.col("b.r").alias("kept_row"))
    return staged.join(kept, staged[row] == kept["kept_row"], "left_semi").select(*columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    found = component_ids(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
