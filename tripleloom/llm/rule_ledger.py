"""Quality rules as a bitmask ledger (operator 8).

``evaluate`` measures every document once and stores one failure bit per rule
beside the measurements. Policies are versioned masks over those bits, so a
change of policy or an ablation needs no second look at a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm.common import map_slices, table

WINDOW = 5
SYMBOLS = "#*$%&|<>"

MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_stutter bigint, n_shouts bigint"
)


@dataclass(frozen=True)
class Rule:
    """A rule's bit and the SQL condition under which a document fails it."""

    bit: int
    name: str
    fails: str


# A bit is never given to another rule: stored ledgers stay readable.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "4 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > n_words"),
    Rule(4, "long_words", "word_chars > 20 * n_words"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
    Rule(6, "stutter", "4 * n_stutter > n_words"),
    Rule(7, "shouting", "4 * n_shouts > n_words"),
)

# Versions of the policy: the rules whose failure rejects a document.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols"),
    3: ("few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words", "short_words", "stutter", "shouting"),
}
CURRENT = 3


def mask_of(names: tuple[str, ...]) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    code = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + code[i : i + n]
    mixed ^= mixed >> np.uint64(32)
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    # The windows themselves decide, not their codes.
    places = np.flatnonzero(np.isin(mixed, twice))
    seen = Counter(tuple(words[p : p + WINDOW]) for p in places.tolist())
    covered = np.zeros(len(words) + 1, np.int64)
    for p in places.tolist():
        if seen[tuple(words[p : p + WINDOW])] > 1:
            covered[p] += 1
            covered[p + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    data = text.encode()
    words = data.split()  # bytes split at the six ASCII white space characters only
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = data.split(b"\n")
    repeats = len(lines) - len(set(lines))
    if repeats:
        counted = Counter(x for x in lines if x.strip(b" \t\r\x0b\x0c"))
        repeats = counted.total() - len(counted)
    stutter = sum(map(eq, words, words[1:]))
    return len(words), chars, symbols, repeats, repeated_words(words), stutter, text.count("!!")


def evaluate(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default), the measurements, and ``failed``: one bit per rule.

    A null text counts as empty: no words, so it fails ``few_words``. Repeated rows get equal
    ledgers; an empty table gives none.
    """

    def make() -> Callable[[list[str | None]], list[list]]:
        def work(texts: list[str | None]) -> list[list]:
            return [list(c) for c in zip(*[measure(t or "") for t in texts])] or [[]] * 7

        return work

    ledger = map_slices(df, [text], make, MEASURES, keep)
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return ledger.withColumn("failed", failed.cast("long"))


def passes(version: int = CURRENT, failed: Column | str = "failed") -> Column:
    """Whether a ledger row passes a version of the policy."""
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(mask_of(POLICIES[version]))) == 0


def ablation(ledger: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else, and that would be kept without it.

    The ledger is first reduced to one row per distinct mask, at most 2 to the number of rules.
    """
    mask = mask_of(POLICIES[version])
    masks = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    rules = [r for r in RULES if r.name in POLICIES[version]]
    per_rule = masks.select(
        "failed", "n", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules])).alias("r")
    )
    has = F.col("failed").bitwiseAND(F.col("r.bit")) != 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    return per_rule.groupBy(F.col("r.rule").alias("rule")).agg(
        total(has)("n_failed"),
        total(F.col("failed") == F.col("r.bit"))("n_failed_alone"),
        total((F.col("failed") == 0) | (F.col("failed") == F.col("r.bit")))("n_kept_without"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, from the ledger over all documents."""
    ledger = evaluate(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[1]))) != 0
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), passes().alias("kept"), "failed", "n_stutter", "n_shouts",
    )


OP8_SQL = r"""WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
win AS (
  SELECT r, i, words[i:i + 4] AS g FROM (SELECT r, words, unnest(range(1, CAST(len(words) - 3 AS BIGINT))) AS i FROM w WHERE len(words) >= 5) t),
twice AS (SELECT r, i, g, count(*) OVER (PARTITION BY r, g) AS c FROM win),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice WHERE c > 1) t GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(DISTINCT l) AS d
       FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM w) t WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(ln.n - ln.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(range(1, CAST(len(words) AS BIGINT)), lambda i: words[i] = words[i + 1])) AS BIGINT) AS n_stutter,
         CAST((length(text) - length(replace(text, '!!', ''))) / 2 AS BIGINT) AS n_shouts
  FROM w LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
f AS (
  SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END
         + CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > n_words THEN 8 ELSE 0 END
         + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
         + CASE WHEN 4 * n_stutter > n_words THEN 64 ELSE 0 END + CASE WHEN 4 * n_shouts > n_words THEN 128 ELSE 0 END AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed % 4 <> 0 AS base_failed, failed = 0 AS kept,
       CAST(failed AS BIGINT) AS failed, n_stutter, n_shouts
FROM f"""
