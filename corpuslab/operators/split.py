"""Shuffles, splits and samples.

Every operator is exact (fixed counts, not Bernoulli draws) and reproducible:
the row order is md5(key|seed) and positions come from ``two_level_rank``, so
the result does not change with the partition count and can be recomputed in
plain SQL.  Totals (n, per-class counts) are scalar or tiny grouped aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from .rank import Bucket, hash_rank, range_rank, two_level_rank


def _ranked(df: DataFrame, key_col: str, seed: int) -> tuple[DataFrame, Column]:
    """The seeded shuffle and the number of rows, from one scan's bucket counts."""
    return hash_rank(df, key_col, seed, rank_col="rank", total_col="_total"), F.col("_total").cast("double")


def shuffle(df: DataFrame, key_col: str, seed: int = 42, rank_col: str = "rank") -> DataFrame:
    """A reproducible permutation, exposed as a dense rank 1..n."""
    return hash_rank(df, key_col, seed, rank_col=rank_col)


def cumulative_bounds(fracs: dict) -> list:
    """Cumulative fractions summed left to right in floating point, like a Python loop."""
    out, total = [], 0.0
    for name, p in fracs.items():
        lo = total
        total = total + p
        out.append((name, lo, total))
    return out


def fraction_split(df: DataFrame, fracs: dict, key_col: str, seed: int = 42,
                   split_col: str = "split") -> DataFrame:
    """Shuffle, then slice positions [int(lo*n), int(hi*n)) per split.

    Rows that fall in no slice (only possible when the fractions sum below 1) are
    dropped, as a positional slice would.
    """
    ranked, n = _ranked(df, key_col, seed)
    expr = None
    for name, lo, hi in cumulative_bounds(fracs):
        cond = ((F.col("rank") > F.floor(F.lit(lo) * n)) & (F.col("rank") <= F.floor(F.lit(hi) * n)))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return ranked.withColumn(split_col, expr).filter(F.col(split_col).isNotNull()).drop("_total")


def random_split(df: DataFrame, test_frac: float, key_col: str, seed: int = 42,
                 split_col: str = "split") -> DataFrame:
    """Unstratified hold-out; test = the first ceil(frac*n) shuffled rows."""
    ranked, n = _ranked(df, key_col, seed)
    return ranked.withColumn(
        split_col, F.when(F.col("rank") <= F.ceil(F.lit(test_frac) * n), "test").otherwise("train")).drop("_total")


def sample_exact(df: DataFrame, frac: float, key_col: str, seed: int = 42) -> DataFrame:
    """Exactly round-half-even(frac*n) rows without replacement."""
    ranked, n = _ranked(df, key_col, seed)
    return ranked.filter(F.col("rank") <= F.bround(F.lit(frac) * n, 0)).drop("_total")


def sample_n(df: DataFrame, n: int, key_col: str, seed: int = 42) -> DataFrame:
    """N distinct rows, first n of the seeded shuffle (top-k, no full sort)."""
    k = order_key(F.col(key_col), seed)
    return (df.withColumn("_okey", k).orderBy(F.col("_okey"), F.col(key_col))
            .limit(n).drop("_okey"))


def stratified_split(df: DataFrame, label_col: str, test_frac: float, key_col: str,
                     seed: int = 42, split_col: str = "split") -> DataFrame:
    """R2: stratified hold-out with exact counts.

    n_test = ceil(frac*n); the train side gets n - n_test rows spread over the
    classes by largest remainder of count*n_train/n (ties: smaller label first);
    each class sends its remaining rows to test.  Inside a class the rows are
    taken in md5(key|seed) order; the class rank is two-level, so a huge class is
    not ranked by one task.
    """
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_c"))
    wall = Window.partitionBy()  # the class table has one row per class
    alloc = (counts
             .withColumn("_n", F.sum("_c").over(wall))
             .withColumn("_ntrain", F.col("_n") - F.ceil(F.lit(test_frac) * F.col("_n").cast("double")))
             .withColumn("_q", F.col("_c") * F.col("_ntrain") / F.col("_n"))
             .withColumn("_f", F.floor("_q"))
             .withColumn("_need", F.col("_ntrain") - F.sum("_f").over(wall))
             .withColumn("_ord", F.row_number().over(
                 Window.orderBy((F.col("_q") - F.col("_f")).desc(), F.col(label_col).asc())))
             .withColumn("_train", F.col("_f") + F.when(F.col("_ord") <= F.col("_need"), 1).otherwise(0))
             .select(label_col, (F.col("_c") - F.col("_train")).alias("_ntest")))
    k = order_key(F.col(key_col), seed)
    ranked = two_level_rank(
        df.withColumn("_okey", k),
        order=[F.col("_okey").asc(), F.col(key_col).asc()],
        buckets=[Bucket(F.substring(F.col("_okey"), 1, 4))],
        partition_cols=[label_col], rank_col="_crank")
    out = ranked.join(alloc, on=label_col, how="inner")
    return (out.withColumn(split_col, F.when(F.col("_crank") <= F.col("_ntest"), "test").otherwise("train"))
            .drop("_okey", "_crank", "_ntest"))


def nested_stratified_split(df: DataFrame, label_col: str, key_col: str, test_frac: float = 0.1,
                            val_frac: float = 0.15, seed: int = 42) -> DataFrame:
    """R2 used twice: test off the whole, then validation off the rest."""
    first = stratified_split(df, label_col, test_frac, key_col, seed, split_col="_s1")
    rest = first.filter(F.col("_s1") == "train").drop("_s1")
    test = first.filter(F.col("_s1") == "test").drop("_s1").withColumn("split", F.lit("test"))
    second = stratified_split(rest, label_col, val_frac, key_col, seed + 1, split_col="split")
    second = second.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))
    return second.unionByName(test)


def concat_corpora(named: dict, key_col: str) -> DataFrame:
    """Bag union (no de-duplication) with a ``corpus`` tag and a fresh unique key."""
    out = None
    for name, df in named.items():
        tagged = df.withColumn("corpus", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out.withColumn("uid", F.concat_ws(":", F.col("corpus"), F.col(key_col).cast("string")))


def complement(df: DataFrame, pred: Column) -> DataFrame:
    """Rows where ``pred`` is false or null."""
    return df.filter(~F.coalesce(pred, F.lit(False)))


def overlapping_keys(df: DataFrame, key_col: str, split_col: str = "split") -> DataFrame:
    """Keys that sit in more than one split (empty when the splits are disjoint)."""
    return (df.groupBy(key_col).agg(F.countDistinct(split_col).alias("n_splits"))
            .filter(F.col("n_splits") > 1))


def batch_counts(df: DataFrame, batch_size: int, epochs: int) -> DataFrame:
    """Rows, batches = ceil(n/B), log interval = n // B, total steps."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows")).select(
        "rows",
        F.ceil(F.col("rows") / F.lit(batch_size)).cast("long").alias("batches"),
        F.floor(F.col("rows") / F.lit(batch_size)).cast("long").alias("log_interval"),
        (F.ceil(F.col("rows") / F.lit(batch_size)) * F.lit(epochs)).cast("long").alias("total_steps"))


def head(df: DataFrame, n: int, order) -> DataFrame:
    """First ``n`` rows by ``order`` for display (a top-k, no full sort)."""
    return df.orderBy(*order).limit(n)


def row_slice(df: DataFrame, lo: int, hi: int, order: list) -> DataFrame:
    """Rows at positions [lo, hi) of ``order`` (0-based), with their ``position``."""
    return range_rank(df, order, rank_col="position", start=0).filter(
        (F.col("position") >= F.lit(lo)) & (F.col("position") < F.lit(hi)))
