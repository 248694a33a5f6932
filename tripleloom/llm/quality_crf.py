"""Document quality by a linear-chain conditional random field over lines (operator 2).

Every line gets features of its own and of its neighbours; a two-state chain labels it good or
bad. Forward-backward marginals, weighted by line length, give the document's share of good text,
which a logistic fit calibrates against the labels.

Documents carry labels, lines don't. A good document's lines count as good; of a bad one those
that a line classifier finds bad, the worst line always, in a few rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm.common import explode_slices, labelled_texts, logistic, map_slices, remainder, table
from tripleloom.session import cut_lineage

MAX_LABELLED = 4_000
MAX_LINES = 500_000
CHAIN_LINES = 256
THRESHOLD = 0.7
CLASSES = 9
OWN = 15
NEIGHBOUR = (1, 2, 3, 7, 8, 9)
FEATURES = OWN + 2 * len(NEIGHBOUR)


def byte_classes() -> np.ndarray:
    """0 break, 1 space, 2 small letter, 3 capital, 4 digit, 5 punctuation, 6 symbol, 7 exclamation, 8 beyond ASCII."""
    out = np.full(256, 5, np.uint8)
    out[list(b" \t\r\x0b\x0c")] = 1
    out[97:123], out[65:91], out[48:58], out[128:] = 2, 3, 4, 8
    out[list(b"#*$%&|<>@^~_=\\{}[]")] = 6
    out[list(b"!?")] = 7
    out[10] = 0
    return out


TABLE = byte_classes()


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths as weights, and the number of lines of each text (at least one)."""
    lines, sizes, repeated = [], [], []
    for t in texts:
        own = (t or "").split("\n")
        seen: set[str] = set()
        for line in own:
            repeated.append(line in seen and line.strip() != "")
            seen.add(line)
        lines += own
        sizes.append(len(own))
    data = np.frombuffer("\n".join(lines).encode("utf-8", "surrogatepass"), np.uint8)
    kinds = TABLE[data]
    line = np.cumsum(kinds == 0) - (kinds == 0)
    counts = np.bincount(line * CLASSES + kinds, minlength=len(lines) * CLASSES).reshape(len(lines), CLASSES).astype(np.float32)
    length = counts[:, 1:].sum(axis=1)
    per = 1 / np.maximum(length, 1)
    words = np.empty((len(lines), 4), np.float32)
    for i, text in enumerate(lines):
        w = text.split()
        words[i] = (len(w), len(set(w)), sum(map(eq, w, w[1:])), sum(map((1).__eq__, map(len, w))))
    n = np.maximum(words[:, 0], 1)
    x = np.zeros((len(lines), FEATURES), np.float32)
    x[:, 0] = np.log1p(length) / 5
    x[:, 1] = np.minimum(counts[:, 6] * per * 5, 3)
    x[:, 2] = np.minimum(counts[:, 7] * per * 10, 3)
    x[:, 3] = counts[:, 3] / np.maximum(counts[:, 2] + counts[:, 3], 1)
    x[:, 4] = counts[:, 4] * per * 5
    x[:, 5] = np.minimum(counts[:, 5] * per * 10, 3)
    x[:, 6] = counts[:, 1] * per * 5
    x[:, 7] = words[:, 2] / n * 3
    x[:, 8] = 1 - words[:, 1] / n
    x[:, 9] = repeated
    x[:, 10] = words[:, 3] / n
    x[:, 11] = words[:, 0] < 4
    x[:, 12] = length == 0
    x[:, 13] = (words[:, 1] / n < 0.5) & (words[:, 0] > 10)
    x[:, 14] = np.abs(length / n - 6) > 4
    ends = np.cumsum(sizes)
    starts = ends - sizes
    before, after = np.arange(len(lines)) - 1, np.arange(len(lines)) + 1
    before[starts], after[ends - 1] = -1, -1
    near = np.concatenate([x[:, NEIGHBOUR], np.zeros((1, len(NEIGHBOUR)), np.float32)])
    k = len(NEIGHBOUR)
    x[:, OWN : OWN + k], x[:, OWN + k :] = near[before], near[after]
    return x, length + 1, np.array(sizes)


@dataclass(frozen=True)
class QualityModel:
    """Line weights (the last is the intercept), log weights of the four steps, and the calibration."""

    weights: tuple[float, ...]
    steps: tuple[float, float, float, float]  # bad-bad, bad-good, good-bad, good-good
    calibration: tuple[float, float]


def marginals(odds: np.ndarray, steps: tuple[float, ...]) -> list[float]:
    """P(good) of every line of one text from its own odds of good, by forward and backward ratios."""
    t00, t01, t10, t11 = (math.exp(s) for s in steps)
    own = odds.tolist()
    ahead, r = [], 1.0
    for i, u in enumerate(own):
        r = u if i == 0 else u * (r * t11 + t01) / (r * t10 + t00)
        r = min(max(r, 1e-12), 1e12)
        ahead.append(r)
    b = 1.0
    for i in range(len(own) - 1, -1, -1):
        good = ahead[i] * b
        ahead[i] = good / (1 + good)
        v = own[i] * b
        b = (t10 + t11 * v) / (t00 + t01 * v)
    return ahead


def good_share(texts: list[str | None], model: QualityModel) -> tuple[list[float], list[list[float]]]:
    """Length-weighted share of good text, and the line marginals, of each text."""
    x, weight, sizes = line_features(texts)
    score = x @ np.array(model.weights[:-1], np.float32) + model.weights[-1]
    odds = np.exp(np.clip(score.astype(np.float64), -25, 25))
    shares, lines, at = [], [], 0
    for n in sizes.tolist():
        p = marginals(odds[at : at + n], model.steps)
        w = weight[at : at + n]
        shares.append(float(np.dot(w, p) / w.sum()))
        lines.append(p)
        at += n
    return shares, lines


def padded(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains of one batch as arrays (line, chain, feature), (line, chain), and their mask."""
    longest = max(map(len, y))
    xs = np.zeros((longest, len(x), x[0].shape[1]), np.float32)
    ys, mask = np.zeros((longest, len(x)), np.int64), np.zeros((longest, len(x)), bool)
    for i, (a, b) in enumerate(zip(x, y)):
        xs[: len(a), i], ys[: len(b), i], mask[: len(b), i] = a, b, True
    return xs, ys, mask


def chain_gradient(xs: np.ndarray, ys: np.ndarray, mask: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of a batch of labelled chains and its gradient in line weights and steps."""
    longest, n = ys.shape
    unary = xs @ w[:-1] + w[-1]
    forward = np.zeros((longest, n, 2))
    forward[0, :, 1] = unary[0]
    for i in range(1, longest):
        into = np.logaddexp(forward[i - 1, :, :1] + t[0], forward[i - 1, :, 1:] + t[1])
        into[:, 1] += unary[i]
        forward[i] = np.where(mask[i][:, None], into, forward[i - 1])
    total = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
    backward = np.zeros((n, 2))
    gw, gt = np.zeros_like(w), np.zeros((2, 2))
    value = -total.sum() + (unary * (ys == 1) * mask).sum()
    for i in range(longest - 1, -1, -1):
        live = mask[i]
        p = np.exp(forward[i, :, 1] + backward[:, 1] - total)
        error = np.where(live, (ys[i] == 1) - p, 0.0)
        gw[:-1] += error @ xs[i]
        gw[-1] += error.sum()
        if i:
            into = backward.copy()
            into[:, 1] += unary[i]
            for a in (0, 1):
                for b in (0, 1):
                    q = np.exp(forward[i - 1, :, a] + t[a, b] + into[:, b] - total)
                    seen = (ys[i - 1] == a) & (ys[i] == b)
                    gt[a, b] += (np.where(live, seen - q, 0.0)).sum()
                    value += t[a, b] * (seen & live).sum()
            back = np.stack([np.logaddexp(t[a, 0] + into[:, 0], t[a, 1] + into[:, 1]) for a in (0, 1)], axis=1)
            backward = np.where(live[:, None], back, backward)
    return value, gw, gt


def train_chain(x: list[np.ndarray], y: list[np.ndarray], rounds: int = 80, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Line weights and step weights by gradient ascent with a step size per weight (Adam)."""
    order = sorted(range(len(y)), key=lambda i: len(y[i]))
    batches = [padded([x[i] for i in part], [y[i] for i in part]) for part in np.array_split(order, min(8, len(order))) if len(part)]
    size = sum(map(len, y))
    p = np.zeros(x[0].shape[1] + 5)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for r in range(1, rounds + 1):
        g = -ridge * p
        for xs, ys, mask in batches:
            _, gw, gt = chain_gradient(xs, ys, mask, p[:-4], p[-4:].reshape(2, 2))
            g += np.concatenate([gw, gt.ravel()]) / size
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + 0.2 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return p[:-4], p[-4:].reshape(2, 2)


def line_labels(x: list[np.ndarray], y: np.ndarray, rounds: int = 3) -> list[np.ndarray]:
    """Line labels from document labels: good documents are good throughout, bad ones where a line looks bad."""
    labels = [np.full(len(a), int(k)) for a, k in zip(x, y)]
    flat = np.concatenate(x).astype(np.float64)
    for _ in range(rounds):
        w = logistic(flat, np.concatenate(labels).astype(float))
        for i, (a, k) in enumerate(zip(x, y)):
            if not k:
                s = a @ w[:-1] + w[-1]
                labels[i] = (s > 0).astype(int)
                labels[i][int(np.argmin(s))] = 0
    return labels


def chains_of(x: list[np.ndarray]) -> list[np.ndarray]:
    """Every text's lines as chains of at most ``CHAIN_LINES`` neighbours, so that a long text learns as many short ones."""
    return [a[at : at + CHAIN_LINES] for a in x for at in range(0, len(a), CHAIN_LINES)]


def fit_quality(
    documents: DataFrame, labels: DataFrame, keep: Column, max_labelled: int = MAX_LABELLED, max_lines: int = MAX_LINES
) -> QualityModel:
    """A model learnt from the whole texts of a bounded sample of the labelled rows for which ``keep`` holds.

    The sample is drawn by hash of the id: at most ``max_labelled`` rows, and in that order no row after the one with
    which their lines pass ``max_lines``. An id with several texts gives the one with the smallest hash. The features of these lines (112
    bytes each) are all that comes to the driver. Without labelled rows every text scores 0.5.
    """
    drawn = labelled_texts(documents, labels, "quality", keep, max_labelled)
    sample = drawn.groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def make() -> Callable[..., list[list]]:
        def work(ids: list, ys: list[int], texts: list[str]) -> list[list]:
            x, weight, sizes = line_features(texts)
            cut = np.split(np.arange(len(x)), np.cumsum(sizes)[:-1])
            return [ids, ys, sizes.tolist(), [x[c].tobytes() for c in cut], [weight[c].astype(np.float32).tobytes() for c in cut]]

        return work

    key = dict(sample.dtypes)["doc_id"]
    made = explode_slices(sample, ["doc_id", "label", "text"], make, f"doc_id {key}, label int, n_lines bigint, x binary, w binary")
    made = cut_lineage(made.withColumn("place", F.xxhash64("doc_id")), "quality")
    places = sorted((r.place, r.n_lines) for r in made.select("place", "n_lines").collect())
    total = np.cumsum([n for _, n in places])
    last = places[min(len(places) - 1, int(np.searchsorted(total, max_lines)))][0] if places else 0
    rows = made.where(F.col("place") <= last).collect()
    if not rows:
        return QualityModel((0.0,) * (FEATURES + 1), (0.0,) * 4, (0.0, 0.0))
    rows = sorted(((r["doc_id"], r["label"], bytes(r["x"]), bytes(r["w"])) for r in rows))
    x = [np.frombuffer(r[2], np.float32).reshape(-1, FEATURES) for r in rows]
    y = np.array([min(1, max(0, r[1])) for r in rows])
    w, t = train_chain(chains_of(x), chains_of(line_labels(x, y)))
    steps = tuple(t.ravel().tolist())
    shares = []
    for a, r in zip(x, rows):
        p = marginals(np.exp(np.clip((a @ w[:-1] + w[-1]).astype(np.float64), -25, 25)), steps)
        weight = np.frombuffer(r[3], np.float32)
        shares.append(float(np.dot(weight, p) / weight.sum()))
    fit = logistic(log_odds(np.array(shares))[:, None], y.astype(float))
    return QualityModel(tuple(w.tolist()), steps, tuple(fit.tolist()))


def log_odds(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 0.01, 0.99)
    return np.log(share / (1 - share))


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None, name: str = "quality") -> DataFrame:
    """``keep`` (all columns by default), ``name`` (the score) and ``name``_lines, P(good) of every line.

    A null or empty text is one empty line; every line of a text of any length counts. Repeated rows score alike; an empty table gives none.
    """

    def make() -> Callable[[list[str | None]], list[list]]:
        a, b = model.calibration

        def work(texts: list[str | None]) -> list[list]:
            shares, lines = good_share(texts, model)
            return [(1 / (1 + np.exp(-np.clip(a * log_odds(np.array(shares)) + b, -35, 35)))).tolist(), lines]

        return work

    return map_slices(df, [text], make, f"`{name}` double, `{name}_lines` array<double>", keep)


def training_rows() -> Column:
    """Rows whose labels may be learnt from."""
    return remainder("doc_id", 4) != 2


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents; rows with crc32(doc_id) mod 4 = 2 are held out."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(documents, labels, training_rows())
    scored = score_quality(documents, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        F.col("quality").alias("score"),
        F.when(F.col("quality") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        F.size("quality_lines").alias("n_lines"),
        F.size(F.filter("quality_lines", lambda p: p < 0.5)).alias("n_bad_lines"),
    )
