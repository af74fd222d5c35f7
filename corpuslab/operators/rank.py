"""Exact global positions without a single-partition window.

``two_level_rank`` numbers rows 1..n inside each partition group in a total
order.  A coarse bucket that is monotone in that order is counted first (a table
whose size is bounded by the number of buckets), the exclusive running total of
those counts gives each bucket its offset, and a ``row_number`` window only runs
inside one bucket.  No task ever sees more than one bucket, so a hot partition
group (say one class holding a third of all rows) is still spread over many
buckets and many tasks.

W1 (batch offsets) and W6 (batch assignment) sit on it; W7 is a rank minus one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..session import cut_lineage


@dataclass
class Bucket:
    """A bucket column: expression and direction in the total order."""
    expr: Column
    ascending: bool = True


def two_level_rank(df: DataFrame, order: list, buckets: list, partition_cols=(),
                   rank_col: str = "rank", broadcast_offsets: bool = False, total_col: str | None = None) -> DataFrame:
    """Add ``rank_col`` = 1..n within ``partition_cols`` by ``order``; with ``total_col`` n
    too, which the bucket counts give without another scan.

    ``order`` is a list of sort Columns (ties must be broken inside it);
    ``buckets`` a list of :class:`Bucket` whose ordering is a coarsening of
    ``order``.  ``broadcast_offsets`` may only be set when the number of
    distinct (partition, bucket) pairs has a proven small bound.
    """
    part = list(partition_cols)
    bnames = [f"_b{i}" for i in range(len(buckets))]
    b = df
    for name, bk in zip(bnames, buckets):
        b = b.withColumn(name, bk.expr)
    counts = b.groupBy(*part, *bnames).agg(F.count(F.lit(1)).alias("_bn"))
    border = [F.col(n).asc() if bk.ascending else F.col(n).desc() for n, bk in zip(bnames, buckets)]
    wo = Window.partitionBy(*part).orderBy(*border).rowsBetween(Window.unboundedPreceding, -1)
    total = [F.sum("_bn").over(Window.partitionBy(*part)).alias(total_col)] if total_col else []
    offsets = counts.select(*part, *bnames, F.coalesce(F.sum("_bn").over(wo), F.lit(0)).alias("_off"), *total)
    if broadcast_offsets:
        offsets = F.broadcast(offsets)
    joined = b.join(offsets, on=[*part, *bnames], how="inner")
    wr = Window.partitionBy(*part, *bnames).orderBy(*order)
    return (joined.withColumn(rank_col, (F.row_number().over(wr) + F.col("_off")).cast("long"))
            .drop(*bnames, "_off"))


def hash_rank(df: DataFrame, key_col: str, seed: int, partition_cols=(), rank_col: str = "rank",
              prefix_len: int = 4, total_col: str | None = None) -> DataFrame:
    """Rank rows by md5(key|seed) (ties by key): a reproducible shuffle.

    The bucket is the first ``prefix_len`` hex characters of the md5, so the
    offset table holds at most 16**prefix_len rows per partition group.
    """
    k = order_key(F.col(key_col), seed)
    withk = df.withColumn("_okey", k)
    bounded = len(tuple(partition_cols)) == 0
    out = two_level_rank(
        withk,
        order=[F.col("_okey").asc(), F.col(key_col).asc()],
        buckets=[Bucket(F.substring(F.col("_okey"), 1, prefix_len))],
        partition_cols=partition_cols, rank_col=rank_col, broadcast_offsets=bounded, total_col=total_col)
    return out.drop("_okey")


def range_rank(df: DataFrame, order: list, rank_col: str = "rank", start: int = 1) -> DataFrame:
    """Exact global positions in any sort order, whatever the keys look like.

    Rows are range-partitioned by ``order`` once (sampled boundaries, so sparse,
    skewed or prefixed keys still spread evenly) and materialised, so that the
    partition of a row is fixed; the partitions are counted (one row each) and
    rows are numbered inside their partition.  Ties must be broken in ``order``.
    The number of partitions is given, so that they are not merged before the
    result is materialised and read by everything downstream.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut_lineage(df.repartitionByRange(parts, *order).withColumn("_rp", F.spark_partition_id()))
    counts = laid.groupBy("_rp").agg(F.count(F.lit(1)).alias("_rn"))
    before = Window.orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    offsets = counts.select("_rp", F.coalesce(F.sum("_rn").over(before), F.lit(0)).alias("_ro"))
    inside = Window.partitionBy("_rp").orderBy(*order)
    return (laid.join(F.broadcast(offsets), "_rp")                              # bounded by the partition count
            .withColumn(rank_col, (F.row_number().over(inside) + F.col("_ro") + F.lit(start - 1)).cast("long"))
            .drop("_rp", "_ro"))


def assign_batches(df: DataFrame, key_col: str, batch_size: int, seed: int | None = 42,
                   batch_col: str = "batch_id") -> DataFrame:
    """batch = (rank-1) // B over a seeded shuffle (or key order when seed is None).

    The last, short batch is kept.  Adds ``pos_in_batch`` (0-based) and ``rank``.
    """
    if seed is None:
        ranked = range_rank(df, [F.col(key_col).asc()])
    else:
        ranked = hash_rank(df, key_col, seed, rank_col="rank")
    return (ranked
            .withColumn(batch_col, F.floor((F.col("rank") - 1) / F.lit(batch_size)).cast("long"))
            .withColumn("pos_in_batch", ((F.col("rank") - 1) % F.lit(batch_size)).cast("long")))


def batch_offsets(df: DataFrame, length_col: str, batch_col: str = "batch_id",
                  order_col: str = "rank", offset_col: str = "offset") -> DataFrame:
    """Exclusive running sum of lengths inside each batch (batches are bounded by B)."""
    w = (Window.partitionBy(batch_col).orderBy(order_col)
         .rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(offset_col, F.coalesce(F.sum(length_col).over(w), F.lit(0)).cast("long"))


def running_total(df: DataFrame, value_cols: list, partition_cols: list, order_col, suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``value_cols`` per partition group, ordered by ``order_col``
    (a column, or a list of columns).

    Rows are range-partitioned by (group, order) once and materialised, so however many
    rows a group has and whatever its steps look like, every task gets a fair share.
    Inside a range a window sums the rows of each group; only the group that a range
    begins with can have rows before it, so the sums carried across borders are one row
    per range at most (broadcast: bounded by the number of partitions).
    ``order_col`` must be unique within a group; nulls form a group of their own.
    """
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = [F.col(c).asc() for c in partition_cols]
    laid = cut_lineage(df.repartitionByRange(parts, *group, *[F.col(c).asc() for c in order]).withColumn("_rp", F.spark_partition_id()))
    sums = laid.groupBy("_rp", *partition_cols).agg(*[F.sum(c).alias(f"_s_{c}") for c in value_cols])
    before = Window.partitionBy(*partition_cols).orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(c).alias(f"_g{i}") for i, c in enumerate(partition_cols)]
    carried = (sums.withColumn("_n", F.count(F.lit(1)).over(before))
               .select("_n", F.col("_rp").alias("_cp"), *named, *[F.sum(f"_s_{c}").over(before).alias(f"_o_{c}") for c in value_cols])
               .where(F.col("_n") > 0).drop("_n"))
    on = F.col("_rp") == F.col("_cp")
    for i, c in enumerate(partition_cols):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = (Window.partitionBy("_rp", *partition_cols).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    j = laid.join(F.broadcast(carried), on, "left")
    for c in value_cols:
        zero = F.lit(0).cast(carried.schema[f"_o_{c}"].dataType)
        j = j.withColumn(f"{c}{suffix}", F.sum(c).over(inside) + F.coalesce(F.col(f"_o_{c}"), zero))
    return j.select(*df.columns, *[f"{c}{suffix}" for c in value_cols])
