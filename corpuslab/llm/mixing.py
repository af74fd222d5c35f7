"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) get the weights of ``PATTERN`` in turn
and share ``SHARE`` times the size of the whole table; a target stops at ``CAP``
times its source's size and the excess is shared again by weight.

Inside a source every document expects ``target / source_size`` copies.  The
documents are laid out in order of size (so that neighbours stand in for each
other), the expected copies are summed along that order, one offset hashed from
the source is added, and a document is emitted once for every integer that its
interval crosses: ``floor(u + e * r) - floor(u + e * (r - 1))`` for the r-th one.

Nothing is ordered globally.  The position r comes from counts in buckets
(source, leading bits of the size, two hash digits of the key): at most a few
hundred size classes of a source and 256 hash classes of each are summed in a
window, and rows are only numbered inside one bucket, so a source with a third
of all rows, or one with only equal sizes, is spread over many tasks.

Contract: a null text has size 0; a null source is a source of its own, the
last; a null key sorts first in its bucket; rows with one key are separate
documents; with no words at all every target and every count is 0; an empty
table stays empty.  Reruns agree: there is no random state but hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..session import cut_lineage
from .words import word_count

PATTERN = (3, 1, 2)
SHARE = 1.5
CAP = 2
LEAD_BITS = 4
SEED = 11


def _rank_by_ranges(df: DataFrame, order: list[Column], rank_col: str) -> DataFrame:
    """0-based rank in a global order: rows are range-partitioned once, the
    partitions counted, and rows numbered inside their partition."""
    laid = cut_lineage(df.repartitionByRange(*order).withColumn("_mx_part", F.spark_partition_id()))
    sizes = laid.groupBy("_mx_part").count()                   # one row per partition
    before = Window.orderBy("_mx_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_mx_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_mx_off"))
    inside = Window.partitionBy("_mx_part").orderBy(*order)
    return (laid.join(offsets, "_mx_part")
            .withColumn(rank_col, F.col("_mx_off") + F.row_number().over(inside) - 1).drop("_mx_part", "_mx_off"))


def source_targets(sized: DataFrame, source_col: str = "source", size_col: str = "size") -> DataFrame:
    """One row per source: source_size, weight, target."""
    totals = sized.groupBy(F.col(source_col).alias("_mx_source")).agg(F.sum(size_col).alias("source_size"))
    ranked = _rank_by_ranges(totals, [F.col("_mx_source").asc_nulls_last()], "_mx_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in PATTERN]), (F.col("_mx_rank") % len(PATTERN) + 1).cast("int"))
    table = cut_lineage(ranked.withColumn("weight", weight.cast("long")).drop("_mx_rank"))
    level, capped = 0.0, -1
    while True:                                                # each round caps at least one more source
        over = F.lit(level) * F.col("weight") > F.lit(CAP) * F.col("source_size") if capped >= 0 else F.lit(False)
        s = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.lit(CAP) * F.col("source_size"))).alias("full"),
                      F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count(F.when(over, 1)).alias("n")).first()
        if not s["all"] or not s["open"] or s["n"] == capped:
            break
        capped, level = s["n"], (SHARE * float(s["all"]) - float(s["full"] or 0)) / float(s["open"])
    return table.withColumn("target", F.least((F.lit(CAP) * F.col("source_size")).cast("double"),
                                              F.lit(level) * F.col("weight").cast("double")))


def _buckets(df: DataFrame, key_col: str, source_col: str, size_col: str) -> DataFrame:
    bits = F.length(F.bin(F.col(size_col)))
    return (df.withColumn("_mx_bits", bits)
            .withColumn("_mx_lead", F.expr(f"shiftright({size_col}, greatest(_mx_bits - {LEAD_BITS}, 0))"))
            .withColumn("_mx_sub", F.substring(F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit(""))), 1, 2)))


def with_copies(df: DataFrame, sized: DataFrame, key_col: str = "doc_id", source_col: str = "source",
                size_col: str = "size") -> DataFrame:
    """``df`` (with its size column) plus source_size, target and copies.
    ``sized`` holds key, source and size of the same rows, materialised."""
    targets = source_targets(sized, source_col, size_col)
    named = ["_mx_bits", "_mx_lead", "_mx_sub"]
    counts = (_buckets(sized, key_col, source_col, size_col)
              .groupBy(F.col(source_col).alias("_mx_source"), *named).agg(F.count(F.lit(1)).alias("_mx_n")))
    classes = counts.groupBy("_mx_source", "_mx_bits", "_mx_lead").agg(F.sum("_mx_n").alias("_mx_class"))
    earlier = Window.unboundedPreceding, -1
    by_class = Window.partitionBy("_mx_source").orderBy("_mx_bits", "_mx_lead").rowsBetween(*earlier)
    by_sub = Window.partitionBy("_mx_source", "_mx_bits", "_mx_lead").orderBy("_mx_sub").rowsBetween(*earlier)
    zero = F.lit(0)
    classes = classes.withColumn("_mx_off", F.coalesce(F.sum("_mx_class").over(by_class), zero)).drop("_mx_class")
    classes = _null_safe(classes, targets, ["_mx_source"])
    offsets = _null_safe(counts.withColumn("_mx_in", F.coalesce(F.sum("_mx_n").over(by_sub), zero)).drop("_mx_n"),
                         classes, ["_mx_source", "_mx_bits", "_mx_lead"])
    rows = _buckets(df, key_col, source_col, size_col).withColumn("_mx_source", F.col(source_col))
    joined = _null_safe(rows, offsets, ["_mx_source", *named])
    inside = Window.partitionBy("_mx_source", *named).orderBy(F.col(key_col).asc_nulls_first())
    rank = (F.col("_mx_off") + F.col("_mx_in") + F.row_number().over(inside)).cast("double")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = uniform(F.coalesce("_mx_source", F.lit("")), seed=SEED)
    placed = joined.withColumn("_mx_r", rank).withColumn("_mx_e", share).withColumn("_mx_u", offset)
    copies = (F.floor(F.col("_mx_u") + F.col("_mx_e") * F.col("_mx_r"))
              - F.floor(F.col("_mx_u") + F.col("_mx_e") * (F.col("_mx_r") - 1))).cast("long")
    return placed.withColumn("copies", copies).select(*df.columns, "source_size", "target", "copies")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null in ``_mx_source``."""
    l, r = left.alias("l"), right.alias("r")
    on = F.lit(True)
    for k in keys:
        a, b = F.col(f"l.{k}"), F.col(f"r.{k}")
        on = on & (a.eqNullSafe(b) if k == "_mx_source" else a == b)
    return l.join(r, on).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])


def sizes(df: DataFrame, key_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Key, source and word count of every document, materialised (narrow rows)."""
    return cut_lineage(df.select(F.col(key_col).alias("doc_id"), F.col(source_col).alias("source"),
                                 word_count(F.col(text_col)).alias("size")))


def mix(df: DataFrame, key_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns."""
    keep = df.columns
    plain = df.select(*[F.col(c).alias(f"_in_{c}") for c in keep], F.col(key_col).alias("doc_id"),
                      F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    taken = with_copies(plain, sizes(df, key_col, source_col, text_col)).where("copies > 0")
    return (taken.withColumn("_mx_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(*[F.col(f"_in_{c}").alias(c) for c in keep]))
