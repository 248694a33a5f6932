"""Scores of clusterings and classifiers.

All of them start from the contingency table, one aggregate over the data;
whatever follows has at most one row per pair of labels.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tripleloom.operators.numbering import numbered, repeat_rows
from tripleloom.session import cut_lineage

TASK_CELLS = 1_000_000
SIZE_BLOCK = 512
SIZE_SALTS = 64


def contingency(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def _xlnx(n: Column) -> Column:
    return n * F.log(n)


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2.0


def _level_sums(table: DataFrame) -> DataFrame:
    """One row: N and, for cells, rows and columns, the sums of n ln n and of n(n-1)/2."""
    table = table.select("t", "p", F.col("n").cast("double").alias("n"))
    levels = table.groupingSets([["t", "p"], ["t"], ["p"]], "t", "p").agg(
        F.sum("n").alias("n"), F.grouping_id().alias("level")
    )
    out = []
    # Grouping ids: 0 = cell, 1 = column p rolled up (a row total), 2 = a column total.
    for level, name in ((0, "tp"), (1, "t"), (2, "p")):
        at = F.col("level") == level
        out.append(F.sum(F.when(at, _xlnx(F.col("n")))).alias(f"x_{name}"))
        out.append(F.sum(F.when(at, _pairs(F.col("n")))).alias(f"c_{name}"))
        out.append(F.count(F.when(at, 1)).alias(f"k_{name}"))
    out.append(F.sum(F.when(F.col("level") == 0, F.col("n"))).alias("total"))
    return levels.agg(*out)


def _information(sums: DataFrame) -> DataFrame:
    """Entropies and mutual information from the level sums."""
    n = F.col("total")
    return sums.select(
        "*",
        F.greatest(F.log(n) - F.col("x_t") / n, F.lit(0.0)).alias("h_t"),
        F.greatest(F.log(n) - F.col("x_p") / n, F.lit(0.0)).alias("h_p"),
        F.greatest(
            F.log(n) + (F.col("x_tp") - F.col("x_t") - F.col("x_p")) / n, F.lit(0.0)
        ).alias("mi"),
    )


def v_measure(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Homogeneity, completeness and their harmonic mean."""
    info = _information(_level_sums(contingency(df, true, pred)))
    hom = F.when(F.col("h_t") <= 1e-15, 1.0).otherwise(F.col("mi") / F.col("h_t"))
    com = F.when(F.col("h_p") <= 1e-15, 1.0).otherwise(F.col("mi") / F.col("h_p"))
    scored = info.select(hom.alias("homogeneity"), com.alias("completeness"))
    both = F.col("homogeneity") + F.col("completeness")
    return scored.withColumn(
        "v_measure",
        F.when(both == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / both),
    )


def nmi(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Mutual information over the arithmetic mean of the entropies."""
    info = _information(_level_sums(contingency(df, true, pred)))
    mean = (F.col("h_t") + F.col("h_p")) / 2
    single = (F.col("k_t") == 1) & (F.col("k_p") == 1)
    return info.select(
        F.when(single, 1.0).when(mean <= 1e-15, 0.0).otherwise(F.col("mi") / mean).alias("nmi")
    )


def ari(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Adjusted Rand index from pair counts."""
    sums = _level_sums(contingency(df, true, pred))
    expected = F.col("c_t") * F.col("c_p") / _pairs(F.col("total"))
    top = F.col("c_tp") - expected
    bottom = (F.col("c_t") + F.col("c_p")) / 2 - expected
    return sums.select(F.when(bottom == 0, 1.0).otherwise(top / bottom).alias("ari"))


def ln_factorial(n: Column) -> Column:
    """ln(n!): exact for small n, else Stirling's series. A plain expression of the row."""
    small = F.log(F.factorial(F.least(n, F.lit(16.0)).cast("int")).cast("double"))
    z = n + 1.0
    series = (
        (z - 0.5) * F.log(z) - z + 0.9189385332046727
        + 1.0 / (12.0 * z) - 1.0 / (360.0 * F.pow(z, 3.0)) + 1.0 / (1260.0 * F.pow(z, 5.0))
    )
    return F.when(n <= 16, small).otherwise(series)


def expected_mutual_information(table: DataFrame, block: int = SIZE_BLOCK) -> DataFrame:
    """Expected mutual information of two random labelings with these marginals.

    Equal marginals are taken once with their number. The different sizes of the clusters are dealt by hash into blocks
    of about ``block``; every size of the labels meets every block in a join on block and salt, so no array holds a
    whole side, whatever the number of sizes.
    The hypergeometric terms run only where they are not zero in double precision, and in
    bounded pieces.
    """
    rows = table.groupBy("t").agg(F.sum("n").cast("double").alias("a"))
    rows = rows.groupBy("a").agg(F.count("*").alias("na"))
    cols = table.groupBy("p").agg(F.sum("n").cast("double").alias("b"))
    cols = cols.groupBy("b").agg(F.count("*").alias("nb"))
    blocks = cols.agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("bigint")).scalar()
    total = table.agg(F.sum("n").cast("double")).scalar()
    dealt = cols.withColumn("_block", F.pmod(F.xxhash64("b"), blocks))
    dealt = dealt.groupBy("_block").agg(F.collect_list(F.struct("b", "nb")).alias("_cols"))
    dealt = dealt.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SIZE_SALTS - 1).cast("bigint"))))
    asked = rows.select("a", "na", F.pmod(F.xxhash64("a"), F.lit(SIZE_SALTS)).cast("bigint").alias("_salt"), blocks.alias("_blocks"))
    asked = asked.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
    pairs = asked.join(dealt, ["_block", "_salt"]).select("a", "na", total.alias("n"), F.inline("_cols"))
    return _emi_terms(pairs).agg(F.coalesce(F.sum("term"), F.lit(0.0)).alias("emi"))


def _emi_terms(pairs: DataFrame) -> DataFrame:
    """The terms of the expectation that are not zero, for pairs of sizes a and b, na and nb times, among n rows."""
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    mean = a * b / n
    spread = F.sqrt(mean * (n - a) / n * (n - b) / F.greatest(n - 1, F.lit(1.0)))
    reach = 40.0 * spread + 200.0
    low = F.greatest(F.lit(1.0), a + b - n, F.floor(mean - reach).cast("double"))
    high = F.least(a, b, F.ceil(mean + reach).cast("double"))
    cells = repeat_rows(
        pairs.withColumn("low", low).withColumn("terms", (high - low + 1).cast("bigint")), "terms", "_i"
    ).withColumn("x", F.col("low") + F.col("_i") - 1)
    x = F.col("x")
    log_p = (
        ln_factorial(a) + ln_factorial(b) + ln_factorial(n - a) + ln_factorial(n - b)
        - ln_factorial(n) - ln_factorial(x) - ln_factorial(a - x) - ln_factorial(b - x)
        - ln_factorial(n - a - b + x)
    )
    return cells.withColumn("term", F.col("na") * F.col("nb") * x / n * F.log(n * x / (a * b)) * F.exp(log_p))


def model_scores(table: DataFrame, by: str = "model") -> DataFrame:
    """``v_measure`` and ``ami`` of every model, from one contingency table (``by``, t, p, n) over all of them."""
    table = cut_lineage(table.withColumn("n", F.col("n").cast("double")), "contingency")
    rows = table.groupBy(by, "t").agg(F.sum("n").alias("a"))
    cols = table.groupBy(by, "p").agg(F.sum("n").alias("b"))
    cells = table.groupBy(by).agg(F.sum("n").alias("n"), F.sum(_xlnx(F.col("n"))).alias("x_tp"))
    x_t = rows.groupBy(by).agg(F.sum(_xlnx(F.col("a"))).alias("x_t"), F.count("*").alias("k_t"))
    x_p = cols.groupBy(by).agg(F.sum(_xlnx(F.col("b"))).alias("x_p"), F.count("*").alias("k_p"))
    sizes_t = rows.groupBy(by, "a").agg(F.count("*").alias("na"))
    sizes_p = cols.groupBy(by, "b").agg(F.count("*").alias("nb"))
    pairs = sizes_t.join(sizes_p, by).join(cells.select(by, "n"), by)
    emi = _emi_terms(pairs).groupBy(by).agg(F.sum("term").alias("emi"))
    n, zero = F.col("n"), F.lit(0.0)
    info = cells.join(x_t, by).join(x_p, by).join(emi, by, "left").select(
        by, "k_t", "k_p", F.coalesce("emi", zero).alias("emi"),
        F.greatest(F.log(n) - F.col("x_t") / n, zero).alias("h_t"), F.greatest(F.log(n) - F.col("x_p") / n, zero).alias("h_p"),
        F.greatest(F.log(n) + (F.col("x_tp") - F.col("x_t") - F.col("x_p")) / n, zero).alias("mi"),
    )
    hom = F.when(F.col("h_t") <= 1e-15, 1.0).otherwise(F.col("mi") / F.col("h_t"))
    com = F.when(F.col("h_p") <= 1e-15, 1.0).otherwise(F.col("mi") / F.col("h_p"))
    bottom = (F.col("h_t") + F.col("h_p")) / 2 - F.col("emi")
    safe = F.when(bottom < 0, F.least(bottom, F.lit(-2.2e-16))).otherwise(F.greatest(bottom, F.lit(2.2e-16)))
    return info.select(
        by, F.when(hom + com == 0, 0.0).otherwise(2 * hom * com / (hom + com)).alias("v_measure"),
        F.when((F.col("k_t") == 1) & (F.col("k_p") == 1), 1.0).otherwise((F.col("mi") - F.col("emi")) / safe).alias("ami"),
    )


def ami(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Adjusted mutual information, arithmetic mean normaliser.

    The contingency table is needed several times and is written once, so that the data is read once.
    """
    table = cut_lineage(contingency(df, true, pred), "contingency")
    info = _information(_level_sums(table))
    scored = info.select("*", expected_mutual_information(table).scalar().alias("emi"))
    mean = (F.col("h_t") + F.col("h_p")) / 2
    bottom = mean - F.col("emi")
    safe = F.when(bottom < 0, F.least(bottom, F.lit(-2.2e-16))).otherwise(
        F.greatest(bottom, F.lit(2.2e-16))
    )
    single = (F.col("k_t") == 1) & (F.col("k_p") == 1)
    return scored.select(
        "emi", F.when(single, 1.0).otherwise((F.col("mi") - F.col("emi")) / safe).alias("ami")
    )


def best_assignment(rows: Sequence, cols: Sequence, weights: Sequence[int]) -> tuple[dict[int, int], dict]:
    """One-to-one assignment with the largest total over sparse cells (row, column, weight > 0).

    Returns the cell of every assigned row and the price of every column, by shortest augmenting paths
    over the cells alone: a row may stay free, at no gain. The prices prove the result, as the sum of
    all prices and of every row's best gain above them equals the total. Each cell is given once.
    """
    near: dict = {}
    for cell, row in enumerate(rows):
        near.setdefault(row, []).append(cell)
    price = dict.fromkeys(cols, 0)
    cell_of: dict = {}  # row -> its cell
    owner: dict = {}  # column -> its row
    for start in near:
        reached: dict = {}  # column -> distance
        parent: dict = {}  # column -> cell it was reached by
        best: dict = {}
        heap: list[tuple[int, int, int]] = []
        row, base, free_end, free_row, end = start, 0, 0, start, None
        while True:
            for cell in near[row]:
                col, far = cols[cell], base + price[cols[cell]] - weights[cell]
                if col not in reached and far < best.get(col, free_end):
                    best[col], parent[col] = far, cell
                    heapq.heappush(heap, (far, cell, row))
            while heap and (cols[heap[0][1]] in reached or parent[cols[heap[0][1]]] != heap[0][1]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= free_end:
                break
            far, cell, _ = heapq.heappop(heap)
            col = cols[cell]
            if col not in owner:
                end, free_end = col, far
                break
            reached[col] = far
            row = owner[col]
            base = far + weights[cell_of[row]] - price[col]
            if base < free_end:  # this row could go free instead
                free_end, free_row = base, row
        for col, far in reached.items():
            price[col] += free_end - far
        if end is None:  # from the start to the row that goes free
            if free_row == start:
                continue
            end = cols[cell_of.pop(free_row)]
        while True:
            cell = parent[end]
            row = rows[cell]
            before = cell_of.get(row)
            cell_of[row], owner[end] = cell, row
            if row == start:
                break
            end = cols[before]
    return cell_of, price


def _settled(table: DataFrame) -> DataFrame:
    """Cells (t, p, n) that some best assignment holds: at least as heavy as the heaviest other cell of
    their row and the heaviest other cell of their column together. Never two of a row or column."""
    by_t = table.groupBy("t").agg(F.max(F.struct("n", "p"))["p"].alias("p"))
    by_p = table.groupBy("p").agg(F.max(F.struct("n", "t"))["t"].alias("t"))
    mutual = table.join(by_t, ["t", "p"]).join(by_p, ["t", "p"])
    others = table.join(mutual.select("t", "p"), ["t", "p"], "left_anti")
    return (
        mutual.join(others.groupBy("t").agg(F.max("n").alias("_row")), "t", "left")
        .join(others.groupBy("p").agg(F.max("n").alias("_col")), "p", "left")
        .where(F.col("n") >= F.coalesce("_row", F.lit(0)) + F.coalesce("_col", F.lit(0)))
        .select("t", "p", "n")
    )


def clustering_accuracy(df: DataFrame, true: str, pred: str, task_cells: int = TASK_CELLS) -> DataFrame:
    """Share of rows on the best one-to-one mapping of clusters to labels. Exact at any number of labels.

    While the contingency table has more than ``task_cells`` cells, rounds of joins settle the cells that
    no other choice can beat and drop their labels and clusters. The cells left then go to
    one task, which holds cells only, never a label by cluster matrix. Rows without a label or cluster
    don't count; without rows the accuracy is null.
    """

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        n = cells["n"].tolist()
        chosen, _ = best_assignment(cells["t"].tolist(), cells["p"].tolist(), n)
        return pd.DataFrame({"n": [sum(n[c] for c in chosen.values())]})

    whole = contingency(df.where(F.col(true).isNotNull() & F.col(pred).isNotNull()), true, pred)
    table = rest = cut_lineage(whole, "contingency")
    parts = []
    while rest.count() > task_cells:
        settled = cut_lineage(_settled(rest), "settled")
        if settled.isEmpty():
            break
        parts.append(settled.select("n"))
        rest = rest.join(settled.select("t"), "t", "left_anti").join(settled.select("p"), "p", "left_anti")
        rest = cut_lineage(rest, "contingency")
    matched = rest.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(solve, "n bigint")
    for part in parts:
        matched = matched.unionByName(part)
    return matched.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matched")).select(
        "matched", F.coalesce(table.agg(F.sum("n")).scalar(), F.lit(0)).alias("total")
    ).withColumn("accuracy", F.try_divide("matched", "total"))


def classification_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per label, then accuracy, macro and weighted averages."""
    cells = contingency(df, true, pred)
    sides = F.array(
        F.struct(
            F.col("t").cast("string").alias("label"),
            F.col("n").alias("n_true"),
            F.lit(0).cast("bigint").alias("n_pred"),
            F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
        ),
        F.struct(
            F.col("p").cast("string").alias("label"),
            F.lit(0).cast("bigint").alias("n_true"),
            F.col("n").alias("n_pred"),
            F.lit(0).cast("bigint").alias("hit"),
        ),
    )
    counts = cells.select(F.inline(sides)).groupBy("label").agg(
        *[F.sum(c).alias(c) for c in ("n_true", "n_pred", "hit")]
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    hit = F.col("hit")
    per_label = counts.select(
        "label",
        ratio(hit, F.col("n_pred")).alias("precision"),
        ratio(hit, F.col("n_true")).alias("recall"),
        ratio(2 * hit, F.col("n_pred") + F.col("n_true")).alias("f1"),
        F.col("n_true").alias("support"),
        "hit",
    )
    support = F.sum("support")
    scores = ("precision", "recall", "f1")
    macro = per_label.agg(*[F.avg(c).alias(c) for c in scores], support.alias("support"))
    weighted = per_label.agg(
        *[(F.sum(F.col(c) * F.col("support")) / support).alias(c) for c in scores],
        support.alias("support"),
    )
    share = F.sum("hit") / support
    accuracy = per_label.agg(*[share.alias(c) for c in scores], support.alias("support"))
    columns = ["label", *scores, "support"]
    report = per_label.select(*columns)
    for name, part in (("accuracy", accuracy), ("macro avg", macro), ("weighted avg", weighted)):
        report = report.unionByName(part.select(F.lit(name).alias("label"), *columns[1:]))
    return report


def confusion_matrix(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Row percentages in long form; ``ord`` ranks the rows by their diagonal."""
    cells = contingency(df, true, pred)
    total = F.sum("n").over(W.partitionBy("t"))
    percent = cells.withColumn("percent", 100.0 * F.col("n") / total)
    diagonal = percent.groupBy("t").agg(
        F.sum(F.when(F.col("t") == F.col("p"), F.col("percent")).otherwise(0.0)).alias("_d")
    )
    keyed = cut_lineage(diagonal.select("t", F.struct((-F.col("_d")).alias("d"), "t").alias("_k")), "diagonal")
    ranked = numbered(keyed, "_k", name="ord")
    return percent.join(ranked.select("t", "ord"), "t").select(
        "t", "p", "n", "percent", F.col("ord").cast("int").alias("ord")
    )


def shared_label(own: Column, other: Column) -> Column:
    """First of the own labels that the other side has too, else the first own one."""
    common = F.filter(own, lambda v: F.array_contains(other, v))
    return F.coalesce(F.get(common, F.lit(0)), F.get(own, F.lit(0)))


def multilabel_overlap_eval(df: DataFrame, assigned: str, predicted: str) -> DataFrame:
    """Report on label lists, each reduced to one label."""
    a, p = F.col(assigned), F.col(predicted)
    reduced = df.select(shared_label(a, p).alias("t"), shared_label(p, a).alias("p"))
    return classification_report(reduced, "t", "p")


def precision_recall_at_k(df: DataFrame, gold: str, predicted: str, k: int = 3) -> DataFrame:
    """Hits over predictions and over gold labels, for the first k predictions."""
    top = F.slice(predicted, 1, k)
    hits = F.sum(F.size(F.array_intersect(top, F.col(gold))))
    return df.agg(
        F.count("*").alias("n"),
        (hits / F.sum(F.size(top))).alias("precision_at_k"),
        (hits / F.sum(F.size(gold))).alias("recall_at_k"),
    )
