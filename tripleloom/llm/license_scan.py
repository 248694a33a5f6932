"""License scan by MinHash bands over overlapping windows (operator 7).

Words are runs of letters and digits in small letters, shingles are of five words. A template
of ``n`` shingles belongs to the class ``c``, the smallest power of two not below ``n``. It
matches a stretch of at most ``2 c`` shingles that holds four fifths of its distinct shingles.

Windows of ``3 c`` shingles, one every ``c``, hold any such stretch whole. The Jaccard similarity of
window and template is then above ``0.8 n / (3 c + 0.2 n)``, 0.129 at the least (n just over
half of c), so with ``BANDS`` bands of one MinHash value each a window meets its template with
probability ``1 - (1 - 0.129) ** 64`` = 0.99986 or more. What it meets is checked by exact containment.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tripleloom.llm.common import explode_slices, fresh, table
from tripleloom.llm.license_texts import TEMPLATES

SHINGLE = 5
SHARE = 0.8
BANDS = 64
WORD = r"[^\W_]+"


def collision_bound(share: float = SHARE, bands: int = BANDS) -> float:
    """The least probability that a window holding a match shares a band with its template."""
    similarity = share * 0.5 / (3 + (1 - share) * 0.5)
    return 1 - (1 - similarity) ** bands


def shingle_codes(codes: np.ndarray) -> np.ndarray:
    """64-bit codes of the five-word shingles from word codes."""
    n = len(codes) - SHINGLE + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(SHINGLE if n > 0 else 0):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    return out ^ (out >> np.uint64(32))


def word_codes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def band_keys(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed masks and odd factors of the hash functions."""
    mixed = [xxhash.xxh64_intdigest(b"band %d" % i) for i in range(n)]
    return np.array([m & 0xFFFFFFFF for m in mixed], np.uint32), np.array([(m >> 32) | 1 for m in mixed], np.uint32)


class Template:
    """A template's distinct shingles, their class and MinHash values."""

    def __init__(self, name: str, text: str, masks: np.ndarray, factors: np.ndarray):
        words = re.findall(WORD, text.lower())
        self.name = name
        codes = shingle_codes(word_codes(words))
        self.shingles = {int(c): tuple(words[i : i + SHINGLE]) for i, c in enumerate(codes.tolist())}
        self.size = len(self.shingles)
        self.need = math.ceil(SHARE * self.size - 1e-9)
        self.width = 1 << max(0, self.size - 1).bit_length()
        low = np.array(list(self.shingles), np.uint64).astype(np.uint32)
        self.values = ((low[None, :] ^ masks[:, None]) * factors[:, None]).min(axis=1) if self.size else None


def usable(templates: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Templates of at least one shingle; null or shorter texts cannot be found and are left out."""
    rows = sorted({(n, t) for n, t in templates if n is not None and t})
    return [(n, t) for n, t in rows if len(re.findall(WORD, t.lower())) >= SHINGLE]


class Scanner:
    """Finds templates in texts; built in the task, as word codes hold for one process."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.masks, self.factors = band_keys(BANDS)
        self.classes: dict[int, list[Template]] = {}
        for name, text in templates:
            t = Template(name, text, self.masks, self.factors)
            self.classes.setdefault(t.width, []).append(t)
        # Per class and band: the templates of a value, and which upper halves of a value occur at all.
        self.values: dict[int, list[dict[int, list[Template]]]] = {}
        self.seen: dict[int, np.ndarray] = {}
        for width, members in self.classes.items():
            self.values[width] = [{} for _ in range(BANDS)]
            self.seen[width] = np.zeros((BANDS, 1 << 16), bool)
            for t in members:
                for k, v in enumerate(t.values.tolist()):
                    self.values[width][k].setdefault(v, []).append(t)
                    self.seen[width][k, v >> 16] = True
        self.find = re.compile(WORD).findall

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int, list[Template]]]:
        """(window, class, templates) that share a band."""
        low = codes.astype(np.uint32)
        met: dict[tuple[int, int], dict[str, Template]] = {}
        classes = sorted(self.classes)
        for k in range(BANDS):
            block = (low ^ self.masks[k]) * self.factors[k]
            size = 1
            for width in classes:
                while size < width:
                    if len(block) % 2:
                        block = np.append(block, np.uint32(0xFFFFFFFF))
                    block = np.minimum(block[::2], block[1::2])
                    size *= 2
                wide = np.concatenate([block, np.full(2, 0xFFFFFFFF, np.uint32)])
                least = np.minimum(np.minimum(wide[:-2], wide[1:-1]), wide[2:])
                for w in np.flatnonzero(self.seen[width][k][least >> np.uint32(16)]).tolist():
                    for t in self.values[width][k].get(int(least[w]), ()):
                        met.setdefault((w, width), {})[id(t)] = t
        return [(w, width, list(ts.values())) for (w, width), ts in met.items()]

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        """Per text its matches, (name, containment, first word, last word exclusive), by place and name."""
        words = [self.find((t or "").lower()) for t in texts]
        parts = [shingle_codes(word_codes(w)) for w in words]
        ends = np.cumsum([len(p) for p in parts])
        found: list[dict[tuple[str, int], tuple[str, float, int, int]]] = [{} for _ in texts]
        if not len(ends) or not ends[-1] or not self.classes:
            return [[] for _ in texts]
        codes = np.concatenate(parts)
        for window, width, templates in self.candidates(codes):
            low, high = window * width, min((window + 3) * width, len(codes))
            for doc in range(int(np.searchsorted(ends, low, side="right")), len(texts)):
                start = int(ends[doc]) - len(parts[doc])
                if start >= high:
                    break
                a, b = max(low, start) - start, min(high, int(ends[doc])) - start
                for t in templates:
                    if match := self.stretch(t, words[doc], parts[doc][a:b].tolist(), a):
                        found[doc][t.name, match[1]] = (t.name, *match[0])
        return [merged(list(f.values())) for f in found]

    def stretch(self, t: Template, words: list[str], codes: list[int], at: int):
        """The stretch of at most ``2 c`` shingles with the largest containment, if that is enough."""
        spots = [(at + i, c) for i, c in enumerate(codes) if t.shingles.get(c) == tuple(words[at + i : at + i + SHINGLE])]
        if len(spots) < t.need:
            return None
        best, first, counts = None, 0, {}
        for last, (place, code) in enumerate(spots):
            counts[code] = counts.get(code, 0) + 1
            while place - spots[first][0] >= 2 * t.width:
                left = spots[first][1]
                counts[left] -= 1
                if not counts[left]:
                    del counts[left]
                first += 1
            if len(counts) >= t.need and (best is None or len(counts) > best[0]):
                best = (len(counts), spots[first][0], place + SHINGLE)
        return best and ((best[0] / t.size, best[1], best[2]), best[1])


def merged(matches: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
    """One match for overlapping ones of a name, with the largest containment and the whole stretch.

    Where matches of several names overlap, those of the largest containment stay, of equal ones the longest.
    """
    out: list[tuple[str, float, int, int]] = []
    for name, share, start, end in sorted(matches, key=lambda m: (m[0], m[2], m[3])):
        if out and out[-1][0] == name and start < out[-1][3]:
            _, s, a, b = out[-1]
            out[-1] = (name, max(s, share), a, max(b, end))
        else:
            out.append((name, share, start, end))
    best = [m for m in out if not any((o[1], o[3] - o[2]) > (m[1], m[3] - m[2]) and o[2] < m[3] and m[2] < o[3] for o in out)]
    return sorted(best, key=lambda m: (m[2], m[0]))


def default_templates() -> list[tuple[str, str]]:
    """The fixed texts, and for every name of enough words its line of the form ``SPDX-License-Identifier: name``."""
    return usable((name, text) for name, texts in TEMPLATES.items() for text in (*texts, f"SPDX-License-Identifier: {name}"))


def scan_licenses(
    df: DataFrame, templates: list[tuple[str, str]] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per license and place in a document: ``key``, ``license``, ``containment``, ``start_word``, ``end_word``.

    Null and empty texts hold none; null keys stay; repeated rows repeat their matches; an empty
    table or template list gives no rows. The templates (a short fixed list of the caller's) travel in the closure.
    """
    templates = default_templates() if templates is None else usable(templates)
    (name,) = fresh(df.select(key), "license")

    def make() -> Callable[..., list[list]]:
        scanner = Scanner(templates)

        def work(keys: list, texts: list[str | None]) -> list[list]:
            out = [(k, *m) for k, ms in zip(keys, scanner.scan(texts)) for m in ms]
            return [list(c) for c in zip(*out)] or [[]] * 5

        return work

    kind = dict(df.dtypes)[key]
    return explode_slices(
        df, [key, text], make, f"`{key}` {kind}, `{name}` string, containment double, start_word bigint, end_word bigint", rows=64
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All license notices in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
