"""Toxic passages by maximum-scoring segments (operator 1).

Training: log-odds of words and word stems between toxic and other labelled documents, with an
informative Dirichlet prior (pooled document frequencies), kept where they stand out of their own
error. A word scores as the most telling of itself and its stems; every word without one
costs a small drift, so a random text scores below zero on average.

Scoring: a linear scan finds all maximal scoring segments of a text. Segment scores of random
texts follow an extreme-value law, P(best <= s) = exp(-K n exp(-lambda s)) for n words; lambda
solves the law's equation for the scores of clean text, K is its likelihood estimate. A segment is
significant if its expected number by chance is at most ``E_LIMIT``. A document's score
calibrates the evidence of its best segment and the sum over its significant ones by a
logistic fit on cross-fitted training scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm.common import explode_slices, labelled_texts, logistic, map_slices, remainder, table
from tripleloom.session import cut_lineage

MAX_LABELLED = 20_000
MAX_TERMS = 20_000
PRIOR_SHARE = 0.05  # weight of the prior, as a share of the labelled documents
STEMS = (3, 4, 5, 6, 7)
KEPT_WORDS = 200_000
MIN_Z = 3.0
DRIFT = 0.1
E_LIMIT = 0.5
WORD = r"[^\W_]+"
FOLDS = 2


@dataclass(frozen=True)
class ToxicityModel:
    """Log-odds of the telling words and stems, the extreme-value law, and the calibration."""

    terms: dict[str, float]
    rate: float
    scale: float
    weights: tuple[float, ...]


def maximal_segments(scores: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first place, last place, score), of a sequence given by
    its places with a score of their own; all other places score ``-drift``.

    One pass over the scored places with a stack of candidates, each with the cumulative score before and after it.
    """
    stack: list[list] = []  # [first, last, before, after, place on the stack of the nearest lower start]
    total, previous = 0.0, -1
    for place, score in scores:
        total -= drift * (place - previous - 1)
        previous = place
        before, total = total, total + score
        if score <= 0:
            continue
        entry = [place, place, before, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= entry[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= entry[3]:
                entry[4] = j
                stack.append(entry)
                break
            # Everything from that candidate on becomes one longer candidate.
            entry = [stack[j][0], entry[1], stack[j][2], entry[3], -1]
            del stack[j:]
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def keys_of(word: str) -> list[str]:
    """A word and its stems."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


class WordScores(dict):
    """Scores of recent words; a miss looks at the word's stems. Zero: no telling key."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> float:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = score = max((self.terms.get(k, 0.0) for k in keys_of(word)), default=0.0)
        return score


def word_scores(text: str, find: Callable[[str], list[str]], scores: WordScores) -> tuple[int, list[tuple[int, float]]]:
    """Number of words, and the places and scores of the telling ones."""
    words = find(text.lower())
    values = list(map(scores.__getitem__, words))
    return len(words), [(i, s) for i, s in enumerate(values) if s] if any(values) else []


def evidence(n: int, segments: list[tuple[int, int, float]], rate: float, scale: float) -> tuple[list[float], list]:
    """Calibration features and the significant segments with their expected number by chance."""
    base = math.log(max(scale * n, 1e-12)) if n else 0.0
    rated = [(a, b, s, base - rate * s) for a, b, s in segments]
    best = max((-e for *_, e in rated), default=-10.0)
    significant = [x for x in rated if x[3] <= math.log(E_LIMIT)]
    total = sum(-e for *_, e in significant)
    return [min(max(best, -10.0), 30.0), math.log1p(max(total, 0.0)), math.log1p(len(significant))], significant


def class_terms(toxic: dict[str, int], other: dict[str, int], n1: int, n0: int) -> dict[str, float]:
    """Log-odds with a Dirichlet prior of the keys that stand out in ``n1`` toxic and ``n0`` other
    documents, at most ``MAX_TERMS``."""
    if not n1 or not n0:
        return {}
    weight = PRIOR_SHARE * (n1 + n0)
    found = []
    for word, a in toxic.items():
        b = other.get(word, 0)
        if a + b >= n1 + n0:
            continue  # in every document: tells nothing, and the odds of its absence are not defined
        prior = PRIOR_SHARE * (a + b)
        odds = math.log((a + prior) / (n1 + weight - a - prior)) - math.log((b + prior) / (n0 + weight - b - prior))
        z = odds / math.sqrt(1 / (a + prior) + 1 / (b + prior))
        if z >= MIN_Z and odds > DRIFT:
            found.append((-z, word, odds))
    return {word: odds for _, word, odds in sorted(found)[:MAX_TERMS]}


def law_rate(terms: dict[str, float], clean: dict[str, int], words: int) -> float:
    """The positive root of sum p(s) exp(rate * s) = 1 over the word scores of clean text."""
    values = np.array([(s, clean.get(w, 0) + 0.5) for w, s in terms.items()]).reshape(-1, 2)
    rest = max(words - values[:, 1].sum(), 1.0)
    scores, p = np.append(values[:, 0], -DRIFT), np.append(values[:, 1], rest)
    p = p / p.sum()
    if scores.max() <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    excess = lambda r: (p * np.exp(np.minimum(r * scores, 500))).sum() - 1
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if excess(mid) > 0 else (mid, high)
    return max(high, 1e-3)


def sketch(words: list[str]) -> int:
    """Smallest hash of a text's five-word shingles: copies mostly share it."""
    grams = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    return min(xxhash.xxh64_intdigest(g, 1) for g in grams) >> 1


def counted_words(sample: DataFrame) -> list[tuple[str, int, int, int, int]]:
    """(key, label, fold, documents, words) over the sample, copies counted once.

    Keys of three or more toxic documents, at most ``10 * MAX_TERMS``; the empty key holds the totals.
    """

    def keyed() -> Callable[..., list[list]]:
        find = re.compile(WORD).findall
        return lambda texts: [[sketch(find(t.lower())) for t in texts]]

    sketched = map_slices(sample, ["text"], keyed, "sketch bigint", ["doc_id", "text", "label"])
    first = sketched.groupBy("sketch", "label").agg(F.min_by(F.struct("doc_id", "text"), F.struct("doc_id", "text")).alias("r"))

    def words() -> Callable[..., list[list]]:
        find = re.compile(WORD).findall

        def work(sketches: list[int], labels: list[int], texts: list[str]) -> list[list]:
            out: dict[tuple[str, int, int], list[int]] = {}
            for s, y, t in zip(sketches, labels, texts):
                found = find(t.lower())
                for w in {k for w in set(found) for k in keys_of(w)}:
                    c = out.setdefault((w, y, s % FOLDS), [0, 0])
                    c[0] += 1
                c = out.setdefault(("", y, s % FOLDS), [0, 0])
                c[0] += 1
                c[1] += len(found)
            return [list(c) for c in zip(*[(*k, *v) for k, v in out.items()])] or [[]] * 5

        return work

    rows = first.select("sketch", "label", F.col("r.text").alias("text"))
    counted = explode_slices(rows, ["sketch", "label", "text"], words, "word string, label int, fold int, docs bigint, n bigint")
    per = counted.groupBy("word", "label", "fold").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    toxic = F.sum(F.when(F.col("label") == 1, F.col("docs")).otherwise(0))
    common = per.groupBy("word").agg(toxic.alias("all"), F.collect_list(F.struct("label", "fold", "docs", "n")).alias("by"))
    kept = common.where("all >= 3 or word = ''").orderBy(F.col("all").desc(), "word").limit(10 * MAX_TERMS)
    return [(r["word"], b["label"], b["fold"], b["docs"], b["n"]) for r in kept.collect() for b in r["by"]]


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, keep: Column, max_labelled: int = MAX_LABELLED
) -> ToxicityModel:
    """A model learnt from at most ``max_labelled`` labelled ids for which ``keep`` holds, chosen by hash, one text each.

    Without rows of both labels every text gets the labels' base rate (0.5 without any).
    """
    drawn = labelled_texts(documents, labels, "toxic", keep, max_labelled)
    sample = cut_lineage(drawn.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")
    counts = counted_words(sample)

    def model_of(folds: set[int]) -> tuple[dict[str, float], float]:
        by: list[dict[str, int]] = [{}, {}]
        size, words = [0, 0], 0
        for word, label, fold, docs, n in counts:
            if fold in folds and word:
                by[label][word] = by[label].get(word, 0) + docs
            elif fold in folds:
                size[label] += docs
                words += n * (1 - label)
        terms = class_terms(by[1], by[0], size[1], size[0])
        return terms, law_rate(terms, by[0], words)

    full = model_of(set(range(FOLDS)))
    parts = [model_of({g for g in range(FOLDS) if g != f}) for f in range(FOLDS)]

    def scored() -> Callable[..., list[list]]:
        find = re.compile(WORD).findall
        tables = [WordScores(terms) for terms, _ in parts]

        def work(labels: list[int], texts: list[str]) -> list[list]:
            out = []
            for y, t in zip(labels, texts):
                fold = sketch(find(t.lower())) % FOLDS
                n, places = word_scores(t, find, tables[fold])
                segments = maximal_segments(places)
                out.append((y, fold, n, [float(s) for *_, s in segments]))
            return [list(c) for c in zip(*out)] or [[]] * 4

        return work

    rows = explode_slices(sample, ["label", "text"], scored, "label int, fold int, n int, segments array<double>").collect()
    rows = sorted((r["label"], r["fold"], r["n"], r["segments"]) for r in rows)

    def scale_of(rate: float, folds: set[int]) -> float:
        clean = [(n, max(s, default=0.0)) for y, f, n, s in rows if not y and f in folds and n]
        return len(clean) / max(sum(n * math.exp(-rate * s) for n, s in clean), 1e-9) if clean else 1.0

    scales = [scale_of(parts[f][1], {f}) for f in range(FOLDS)]
    x = np.array([evidence(n, [(0, 0, v) for v in s], parts[f][1], scales[f])[0] for _, f, n, s in rows]).reshape(-1, 3)
    y = np.array([r[0] for r in rows], float)
    weights = logistic(x, y) if len(rows) else np.zeros(4)
    return ToxicityModel(full[0], full[1], float(np.exp(np.mean(np.log(scales)))), tuple(float(w) for w in weights))


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default), ``toxicity`` from 0 to 1, and ``passages``.

    ``passages``: the significant segments as (start, end, score, log_e) in code points of the lower-cased
    text, by start. A null or empty text has none and gets the score of a text without evidence. Repeated
    rows score alike; an empty table gives none.
    """

    def make() -> Callable[[list[str | None]], list[list]]:
        pattern = re.compile(WORD)
        table_ = WordScores(model.terms)
        *w, bias = model.weights

        def work(texts: list[str | None]) -> list[list]:
            scores, passages = [], []
            for t in texts:
                n, places = word_scores(t or "", pattern.findall, table_)
                x, found = evidence(n, maximal_segments(places), model.rate, model.scale)
                scores.append(1 / (1 + math.exp(-min(max(sum(a * b for a, b in zip(w, x)) + bias, -35), 35))))
                spots = [m.span() for m in pattern.finditer(t.lower())] if found else []
                passages.append(sorted(
                    ({"start": spots[a][0], "end": spots[b][1], "score": s, "log_e": e} for a, b, s, e in found),
                    key=lambda p: p["start"],
                ))
            return [scores, passages]

        return work

    return map_slices(
        df, [text], make,
        "toxicity double, passages array<struct<start: bigint, end: bigint, score: double, log_e: double>>", keep,
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents; rows with crc32(doc_id) mod 5 = 0 are held out."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(documents, labels, remainder("doc_id", 5) != 0)
    scored = score_toxicity(documents, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
