"""Benchmark decontamination by the q-gram lemma (operator 3).

Both sides are lower-cased and runs of white space become one space. An item leaks into a
document if a window of it (``WINDOW`` characters, or the whole item where it is shorter) lies
within an edit budget of some stretch of the text. By the q-gram lemma such a stretch shares at least
``length + 1 - q * (budget + 1)`` q-grams with the window on ``budget + 1`` neighbouring diagonals.
So shared q-grams are counted in overlapping bands of diagonals, regions that reach the bound
are kept, and every window of the item there is verified by alignment inside the band.

The benchmark is taken in blocks of a bounded number of characters; each block's index travels in
the closure of one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm.common import explode_slices, fresh, map_slices, table

Q = 8
WINDOW = 60
EDIT_SHARE = 12  # one edit per so many characters
BAND = 16
BLOCK_CHARS = 2_000_000
FILTER_BITS = 22
CHUNK = 2048
PAIRS = 1_000_000  # places of a text times occurrences in the items, taken at once


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def budget_of(length: int) -> int:
    """Edits allowed in a window: one in twelve characters, as far as the lemma still has a bound."""
    return min(length // EDIT_SHARE, length // Q - 1)


def gram_codes(points: np.ndarray) -> np.ndarray:
    """A 32-bit code of the eight characters from every place; equal ones may still differ."""
    step = np.uint32(0x9E3779B1)
    codes = points * np.uint32(0x85EBCA6B) + np.uint32(1)
    width = 1
    while width < Q:
        codes = codes[: len(codes) - width] * step + codes[width:]
        step = np.uint32((int(step) * int(step)) & 0xFFFFFFFF)
        width *= 2
    return codes ^ (codes >> np.uint32(15))


@dataclass
class Index:
    """Items of one window length: their q-grams with the places where they occur."""

    window: int
    budget: int
    bound: int
    items: list
    grams: np.ndarray
    owner: np.ndarray  # q-gram number times items plus item, sorted: where the occurrences of both lie
    item_of: np.ndarray
    place_of: np.ndarray
    filter: np.ndarray
    body: np.ndarray  # the items' characters laid together, with where each begins and its size
    begins: np.ndarray
    sizes: np.ndarray


def telling_places(points: np.ndarray, window: int) -> np.ndarray:
    """Places whose q-gram belongs to the first of equal windows: what repeats inside an item is indexed once."""
    windows = len(points) - window + 1
    if windows == 1:
        return np.arange(len(points) - Q + 1)
    raw, seen = points.tobytes(), set()
    cover = np.zeros(len(points) + 1, np.int64)
    for t in range(windows):
        body = raw[4 * t : 4 * (t + window)]
        if body not in seen:
            seen.add(body)
            cover[t] += 1
            cover[t + window - Q + 1] -= 1
    return np.flatnonzero(np.cumsum(cover) > 0)


def build_indexes(items: list[tuple[int, str]]) -> list[Index]:
    """One index per window length. Items of fewer than eight characters cannot be told from chance and have none."""
    classes: dict[int, list[tuple[int, np.ndarray]]] = {}
    for number, text in items:
        points = code_points(normalised(text))
        if len(points) >= Q:
            classes.setdefault(min(WINDOW, len(points)), []).append((number, points))
    out = []
    for window, members in sorted(classes.items()):
        codes, item_of, place_of = [], [], []
        for i, (_, points) in enumerate(members):
            places = telling_places(points, window)
            codes.append(gram_codes(points)[places])
            item_of.append(np.full(len(places), i, np.int64))
            place_of.append(places)
        codes, item_of = np.concatenate(codes), np.concatenate(item_of)
        order = np.argsort(codes, kind="stable")
        grams, number = np.unique(codes[order], return_inverse=True)
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[grams >> np.uint32(32 - FILTER_BITS)] = True
        budget = budget_of(window)
        sizes = np.array([len(p) for _, p in members])
        out.append(
            Index(window, budget, window + 1 - Q * (budget + 1), [n for n, _ in members], grams, number * len(members) + item_of[order],
                  item_of[order], np.concatenate(place_of)[order], seen,
                  np.concatenate([p for _, p in members]), np.cumsum(sizes) - sizes, sizes)
        )
    return out


def dense_hits(places: np.ndarray, reach: int, bound: int) -> np.ndarray:
    """Which of the sorted places lie in a stretch of ``reach`` that holds ``bound`` of them."""
    upto = np.searchsorted(places, places + reach, side="right")
    full = np.flatnonzero(upto - np.arange(len(places)) >= bound)
    cover = np.zeros(len(places) + 1, np.int64)
    np.add.at(cover, full, 1)
    np.add.at(cover, upto[full], -1)
    return np.cumsum(cover[:-1]) > 0


def within_budget(windows: np.ndarray, texts: np.ndarray, budget: int) -> np.ndarray:
    """Whether each window aligns to its text strip within the budget.

    ``texts`` holds, per window, the strip of the band: place ``i + j`` faces window place ``i`` on
    the band's diagonal ``j``. Both ends of the text are free.
    """
    n, length = windows.shape
    width = texts.shape[1] - length
    # One row per diagonal, so that every step runs along the windows. Costs above the budget need not be exact.
    windows, texts = np.ascontiguousarray(windows.T), np.ascontiguousarray(texts.T)
    cost = np.zeros((width, n), np.uint8)
    for i in range(length):
        other = np.minimum(cost, budget + 1) + (texts[i : i + width] != windows[i])
        np.minimum(other[:-1], cost[1:] + 1, out=other[:-1])
        for j in range(1, width):
            np.minimum(other[j], other[j - 1] + 1, out=other[j])
        cost = other
    return cost.min(axis=0) <= budget


def find_regions(index: Index, points: np.ndarray) -> list[tuple[int, int, int]]:
    """Verified (item place, start, end) in a run of texts laid behind each other with gaps.

    Places and their occurrences in items are listed for ``PAIRS`` at once: for a stretch of places, which overlaps the
    next one by a window's reach, and where one stretch has more, for a part of the items.
    """
    if len(points) < Q:
        return []
    codes = gram_codes(points)
    hits = np.flatnonzero(index.filter[codes >> np.uint32(32 - FILTER_BITS)])
    at = np.searchsorted(index.grams, codes[hits])
    at = np.minimum(at, len(index.grams) - 1)
    same = index.grams[at] == codes[hits]
    hits, at = hits[same], at[same]
    reach = index.window + index.budget - Q
    if len(hits) < index.bound:
        return []
    dense = dense_hits(hits, reach, index.bound)
    hits, at = hits[dense], at[dense]
    if not len(hits):
        return []
    n = len(index.items)
    upto = np.append(0, np.cumsum(occurrences(index, at, 0, n)[1]))
    out, a = [], 0
    while True:
        b = max(int(np.searchsorted(upto, upto[a] + PAIRS, side="right")) - 1, int(np.searchsorted(hits, hits[a] + 2 * reach, side="right")))
        out += regions_of(index, points, hits[a:b], at[a:b], 0, n)
        if b >= len(hits):
            return out
        a = int(np.searchsorted(hits, hits[b] - reach))


def occurrences(index: Index, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the q-grams' occurrences in the items from ``low`` to ``high`` begin, and their numbers."""
    n = len(index.items)
    begins = np.searchsorted(index.owner, at * n + low)
    return begins, np.searchsorted(index.owner, at * n + high) - begins


def regions_of(index: Index, points: np.ndarray, hits: np.ndarray, at: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """The verified regions of a stretch of places with the items from ``low`` to ``high``."""
    reach = index.window + index.budget - Q
    # Every occurrence of the q-gram in an item gives a diagonal.
    begins, times = occurrences(index, at, low, high)
    if times.sum() > 2 * PAIRS and high - low > 1:
        middle = (low + high) // 2
        return regions_of(index, points, hits, at, low, middle) + regions_of(index, points, hits, at, middle, high)
    where = np.repeat(begins - np.cumsum(times) + times, times) + np.arange(times.sum())
    place = np.repeat(hits, times)
    item, inside = index.item_of[where], index.place_of[where]
    diagonal = place - inside + (1 << 20)
    band = diagonal // BAND
    shared = diagonal % BAND < index.budget
    place, item, inside = (np.concatenate([x, x[shared]]) for x in (place, item, inside))
    band = np.concatenate([band, band[shared] - 1])
    order = np.lexsort((inside, place, band, item))
    place, item, inside, band = place[order], item[order], inside[order], band[order]
    k = index.bound - 1
    if len(place) <= k:
        return []
    full = (item[k:] == item[: len(item) - k]) & (band[k:] == band[: len(band) - k]) & (place[k:] - place[: len(place) - k] <= reach)
    first = np.flatnonzero(full)
    if not len(first):
        return []
    # Overlapping runs of one item and band are one region.
    joins = (first[1:] <= first[:-1] + k) & (item[first[1:]] == item[first[:-1]]) & (band[first[1:]] == band[first[:-1]])
    cuts = np.flatnonzero(~joins) + 1
    ends = np.append(cuts, len(first))
    starts = np.insert(cuts, 0, 0)
    regions = []
    for a, b in zip(first[starts].tolist(), (first[ends - 1] + k + 1).tolist()):
        size = index.sizes[item[a]]
        lowest = max(0, int(inside[a:b].min()) - index.window + Q)
        highest = min(size - index.window, int(inside[a:b].max()))
        if highest >= lowest:
            regions.append((int(item[a]), int(place[a:b].min()), int(place[a:b].max()) + Q, int(band[a]) * BAND - (1 << 20), lowest, highest))
    # A few windows of every region first, then all windows of those not yet verified.
    good = np.zeros(len(regions), bool)
    for few in (True, False):
        rows = []
        for r, (i, _, _, diag, lowest, highest) in enumerate(regions):
            if not good[r]:
                step = max(1, (highest - lowest) // 3) if few else 1
                rows.append(np.array([(r, index.begins[i] + t, t + diag) for t in range(lowest, highest + 1, step)]))
        if rows:
            tries = np.concatenate(rows)
            for at in range(0, len(tries), CHUNK):
                part = tries[at : at + CHUNK]
                part = part[~good[part[:, 0]]]
                if len(part):
                    good[part[verified(index, points, part[:, 1], part[:, 2]), 0]] = True
    return [(i, s, e) for ok, (i, s, e, *_) in zip(good, regions) if ok]


def verified(index: Index, points: np.ndarray, begins: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Which windows (their places in the items laid together) align to the text from ``spots`` on."""
    windows = index.body[begins[:, None] + np.arange(index.window)]
    places = spots[:, None] + np.arange(index.window + BAND + index.budget)
    inside = (places >= 0) & (places < len(points))
    texts = np.where(inside, points[np.clip(places, 0, len(points) - 1)], np.uint32(0xFFFFFFFF))
    return within_budget(windows, texts, index.budget)


def finder(indexes: list[Index]) -> Callable[[list[str | None]], list[list[tuple[int, int, int]]]]:
    """A function from texts to their leaks: (item, start, end) in the normalised text, overlapping ones of an item merged."""

    def find(texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        bodies = [code_points(normalised(t)) for t in texts]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for index in indexes:
            gap = np.full(2 * index.window + 2 * BAND, 0xFFFFFFFF, np.uint32)
            starts, laid, size = [], [], 0
            for b in bodies:
                starts.append(size)
                laid += [b, gap]
                size += len(b) + len(gap)
            places = np.array(starts)
            for i, s, e in find_regions(index, np.concatenate(laid) if laid else gap):
                doc = int(np.searchsorted(places, s, side="right")) - 1
                out[doc].append((index.items[i], s - starts[doc], e - starts[doc]))
        return [merged(found) for found in out]

    return find


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of one item that overlap become one."""
    out: list[tuple[int, int, int]] = []
    for n, s, e in sorted(spans):
        if out and out[-1][0] == n and s <= out[-1][2]:
            out[-1] = (n, out[-1][1], max(out[-1][2], e))
        else:
            out.append((n, s, e))
    return out


def benchmark_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS):
    """The benchmark's items in blocks of about ``block_chars`` characters, one block at a time on the driver.

    Repeated items are taken once; rows without id or text are left out.
    """
    items = benchmark.select(F.col(item).alias("item"), F.col(text).alias("body")).where("item is not null and body is not null")
    items = items.distinct()
    total = items.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == b)
        rows = [(r["item"], r["body"]) for r in part.collect()]
        if rows:
            yield rows


def find_leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, item that leaks into it and stretch where it does: ``key``, ``item_id``, ``start``, ``end``.

    Places are in the normalised text; overlapping stretches of an item are one. Null and empty texts leak nothing;
    repeated rows repeat their leaks; null keys stay; an empty table on either side gives no rows. Very long texts are
    read whole, in pieces of a bounded number of shared q-grams.
    """
    (own,) = fresh(documents.select(key), "item_id")
    kind = dict(benchmark.dtypes)["item_id"]
    schema = f"`{key}` {dict(documents.dtypes)[key]}, `{own}` {kind}, start bigint, end bigint"
    found = None
    for rows in benchmark_blocks(benchmark):
        indexes = build_indexes(rows)

        def make(indexes: list[Index] = indexes) -> Callable[..., list[list]]:
            find = finder(indexes)

            def work(keys: list, texts: list[str | None]) -> list[list]:
                out = [(k, *leak) for k, leaks in zip(keys, find(texts)) for leak in leaks]
                return [list(c) for c in zip(*out)] or [[]] * 4

            return work

        part = explode_slices(documents, [key, text], make, schema)
        found = part if found is None else found.union(part)
    return documents.sparkSession.createDataFrame([], schema) if found is None else found


def drop_leaking(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Documents into which no item leaks, their columns unchanged. Nulls and repeats stay as they are."""
    columns = [F.col(f"`{c}`") for c in documents.columns]
    for rows in benchmark_blocks(benchmark):
        (mark,) = fresh(documents, "leaks")
        indexes = build_indexes(rows)

        def make(indexes: list[Index] = indexes) -> Callable[..., list[list]]:
            find = finder(indexes)
            return lambda texts: [[bool(x) for x in find(texts)]]

        documents = map_slices(documents, [text], make, f"`{mark}` boolean").where(~F.col(mark)).select(*columns)
    return documents


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks of the benchmark into the documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
