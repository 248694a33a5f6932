"""Top rows, samples, splits, shuffles, over-sampling and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tripleloom.operators.numbering import hash_int, hash_unit, numbered, repeat_rows, top_per_group


# Between packed texts; must not occur in them.
DELIMITER = " \u241f "


def top_per_cluster(df: DataFrame, n: int = 999) -> DataFrame:
    """Best n rows by score in each cluster; ties by (subject, relation, object)."""
    order = [F.col("score").desc(), F.col("subject"), F.col("relation"), F.col("object")]
    return top_per_group(df, ["cluster"], order, n)


def sample_per_cluster(df: DataFrame, key: list[str], n: int = 10, seed: int = 42) -> DataFrame:
    """n pseudo-random rows per cluster, the same on every run."""
    order = [hash_int(*key, F.lit(str(seed))), *[F.col(k) for k in key]]
    return top_per_group(df, ["cluster"], order, n)


def split_60_20_20(df: DataFrame, file: str) -> DataFrame:
    """Train, dev and test by ordered file: 60 % of the files, half the rest, the rest."""
    files = numbered(df.select(file).distinct(), file, name="_no")
    counted = files.select("*", df.agg(F.countDistinct(file)).scalar().alias("_n"))
    train = F.floor(F.col("_n") * 0.6)
    dev = train + F.floor((F.col("_n") - train) / 2)
    part = F.when(F.col("_no") <= train, "train").when(F.col("_no") <= dev, "dev").otherwise("test")
    return df.join(counted.select(file, part.alias("part")), file)


def shuffle_rows(df: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """Deterministic shuffle: a range-partitioned sort by a hash of the key."""
    return df.orderBy(hash_int(*key, F.lit(str(seed))), *key)


def sort_by_score(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.col("score").desc(), "subject", "relation", "object").limit(n)


def sort_by_cluster(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("cluster", "subject", "relation", "object").limit(n)


def oversample_to_second(
    df: DataFrame, label: str, key: str, seed: int = 42
) -> DataFrame:
    """Originals plus, for every class below the second largest size T, T rows drawn from it.

    Draws are made as (class, row number) keys in bounded pieces and joined to the
    numbered rows, so neither a class nor its draws ever sit in one task.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    second = sizes.orderBy(F.col("_size").desc()).limit(2).agg(
        F.when(F.count("*") == 2, F.min("_size")).otherwise(0).alias("_t")
    )
    small = sizes.select("*", second.scalar().alias("_t")).where(F.col("_size") < F.col("_t"))
    draws = repeat_rows(small, "_t", "_i").select(
        label,
        (hash_int(F.col(label).cast("string"), F.col("_i").cast("string"), F.lit(str(seed)))
         % F.col("_size") + 1).alias("_rn"),
    )
    pool = numbered(df.join(small.select(label), label, "left_semi"), key, [label], "_rn")
    extra = draws.join(pool, [label, "_rn"]).select(*df.columns)
    return df.withColumn("drawn", F.lit(False)).unionByName(extra.withColumn("drawn", F.lit(True)))


def random_uniform_labels(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """Baseline labels, uniform over 0..n."""
    unit = hash_unit(*key, F.lit(f"u{seed}"))
    return df.withColumn("cluster_uniform", F.floor(unit * (n + 1)).cast("int"))


def random_exp_labels(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """Baseline labels, exponential(0.4) scaled by its maximum to 0..n."""
    raw = -0.4 * F.log(1.0 - hash_unit(*key, F.lit(f"e{seed}")))
    drawn = df.withColumn("_e", raw)
    top = drawn.agg(F.max("_e")).scalar()
    return (
        drawn.select("*", top.alias("_m"))
        .withColumn("cluster_exp", F.floor(F.col("_e") / F.col("_m") * n).cast("int"))
        .drop("_e", "_m")
    )


def interleave_labelled(
    df: DataFrame, labelled: DataFrame, key: str, batch: int, full_blocks_only: bool = False
) -> DataFrame:
    """Every block of ``batch`` rows followed by all labelled rows.

    Adds ``block``, ``pos`` and ``labelled``. The labelled rows reach the blocks by
    an equi join on their number. A last short block is kept unless only full
    blocks are asked for.
    """
    rows = numbered(df, key, name="_no")
    rows = rows.withColumn("block", F.floor((F.col("_no") - 1) / batch)).withColumn(
        "pos", (F.col("_no") - 1) % batch
    )
    blocks = rows.groupBy("block").agg(F.count("*").alias("_size"))
    if full_blocks_only:
        blocks = blocks.where(F.col("_size") == batch)
        rows = rows.join(blocks.select("block"), "block", "left_semi")
    marks = numbered(labelled, key, name="_i")
    wanted = repeat_rows(
        blocks.select("*", labelled.agg(F.count("*")).scalar().alias("_m")), "_m", "_i"
    )
    extra = wanted.join(marks, "_i").withColumn("pos", F.col("_size") + F.col("_i") - 1)
    columns = [*df.columns, "block", "pos"]
    return rows.select(*columns, F.lit(False).alias("labelled")).unionByName(
        extra.select(*columns, F.lit(True).alias("labelled"))
    )


def split_labelled(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(label) > 0), df.where(F.coalesce(F.col(label), F.lit(0)) == 0)


def pack_chunks(
    df: DataFrame, key: str, text: str, max_chars: int = 10000, delimiter: str = DELIMITER,
    shard_rows: int = 1024,
) -> DataFrame:
    """Consecutive texts joined by a delimiter into chunks of at most ``max_chars``; a longer text is a chunk of its own.

    Shards are runs of ``shard_rows`` consecutive integer keys, folded greedily side by side, so a
    shard's last chunk may be short. ``sizes`` holds the texts' lengths (null for a null text),
    by which ``unpack_chunks`` cuts: the delimiter may occur in a text.
    """
    gap = len(delimiter)
    row = F.struct(F.col(key).alias("k"), F.col(text).alias("t"), F.length(text).alias("n"))
    shards = df.groupBy(F.floor(F.col(key) / shard_rows).alias("shard")).agg(
        F.array_sort(F.collect_list(row)).alias("_p")
    )

    def place(state: Column, p: Column) -> Column:
        size = F.coalesce(p["n"], F.lit(0))
        full = state["used"] + gap + size > max_chars
        first = F.size(state["at"]) == 0
        chunk = F.when(~first & full, state["chunk"] + 1).otherwise(state["chunk"])
        used = F.when(first | full, size).otherwise(state["used"] + gap + size)
        return F.struct(chunk.alias("chunk"), used.alias("used"), F.concat(state["at"], F.array(chunk)).alias("at"))

    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("at"))
    placed = shards.select("shard", "_p", F.aggregate("_p", start, place, lambda s: s["at"]).alias("_at"))
    rows = placed.select("shard", F.explode(F.arrays_zip("_p", "_at")).alias("_r"))
    own = rows.groupBy("shard", F.col("_r._at").alias("chunk")).agg(
        F.array_sort(F.collect_list("_r._p")).alias("_p")
    )
    return own.select(
        "shard",
        "chunk",
        F.transform("_p", lambda p: p["k"]).alias("keys"),
        F.transform("_p", lambda p: p["n"]).alias("sizes"),
        F.array_join(F.transform("_p", lambda p: F.coalesce(p["t"], F.lit(""))), delimiter).alias("text"),
    )


def unpack_chunks(df: DataFrame, key: str, delimiter: str = DELIMITER) -> DataFrame:
    """Chunk texts back to one row per text, in order, cut by their lengths."""
    gap = len(delimiter)
    ends = F.aggregate(
        "sizes",
        F.array(F.lit(1)),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + F.coalesce(n, F.lit(0)) + gap)),
    )
    cut = df.select("keys", "sizes", "text", ends.alias("_ends"))
    return cut.select("text", F.posexplode(F.arrays_zip("keys", "sizes", F.slice("_ends", 1, F.size("keys")).alias("_from"))).alias("_i", "_z")).select(
        F.col("_z.keys").alias(key),
        F.when(F.col("_z.sizes").isNotNull(), F.substr("text", F.col("_z._from"), F.col("_z.sizes"))).alias("piece"),
    )
