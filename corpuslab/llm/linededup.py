"""Line deduplication across documents, with keep bitmaps instead of text.

Lines are hashed where the text is read; from there on only (128-bit hash,
document, position) move.  The hash space is cut into ranges; inside a range
rows are sorted by hash, document (descending) and position, and streamed: the
first occurrence of a hash in a document counts the document, and the first of
all names the largest document.  A range is also salted by document, so a line
that a third of all documents share is streamed by many tasks; their counts
(one row per hash and salt) are then added up.  The hashed lines are written once
to the shared folder: the texts are split and hashed a single time.

Lines that go are returned as run-length bitmaps, one per document, and applied
to the text where it is needed.

Contract: a null or empty text is one empty line; the rows of one key are one
document, however many texts it has, and lose or keep their lines together; a row
without a key is a document of its own text, smaller than any other; rows with the
same key and text get the same bitmap; an empty table stays empty; extra columns
pass through ``apply_bitmaps``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import let
from ..session import cut_lineage
from .words import BLANKS, ascii_lower

MIN_CHARS = 40
MIN_DOCS = 5
RANGE_BITS = 12
SALTS = 16


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _identity(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(df: DataFrame, key_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, body, pos, h1, h2) of every line whose key has ``min_chars`` characters."""
    lines = df.select(F.col(key_col).alias("doc"), _identity(F.col(text_col)).alias("body"),
                      F.posexplode_outer(split_lines(F.col(text_col))).alias("pos", "line"))
    keyed = lines.where(F.char_length("line") >= min_chars).select(
        "doc", "body", "pos", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= min_chars)
    return keyed.select("doc", "body", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), F.col("k")).alias("h2"))


def dropped_lines(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                  min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, body, pos) of every line that goes."""
    lines = cut_lineage(hashed_lines(df, key_col, text_col, min_chars))
    own = F.when(F.col("doc").isNull(), F.col("body"))         # tells rows without a key apart
    ranged = (lines.withColumn("range", F.shiftrightunsigned("h1", 64 - RANGE_BITS))
              .withColumn("salt", F.pmod(F.xxhash64(F.col("doc"), own), F.lit(SALTS)).cast("int"))
              .repartition("range", "salt"))
    stream = Window.partitionBy("range", "salt", "h1", "h2").orderBy(F.col("doc").desc_nulls_last(), "body", "pos")
    seen = ranged.withColumn("prev", F.lag(F.struct(F.col("doc"), own.alias("own"))).over(stream))
    new_doc = F.col("prev").isNull() | ~F.struct(F.col("doc"), own.alias("own")).eqNullSafe(F.col("prev"))
    first = seen.where(new_doc).groupBy("range", "salt", "h1", "h2").agg(F.count(F.lit(1)).alias("docs"),
                                                                         F.max("doc").alias("top"))
    common = (first.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))
              .where(F.col("docs") >= min_docs)
              .select("h1", "h2", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    met = ranged.join(common, ["h1", "h2", "salt"])
    return met.where(~F.col("doc").eqNullSafe(F.col("top"))).select("doc", "body", "pos")


def bitmaps(dropped: DataFrame) -> DataFrame:
    """One run-length bitmap per document: ``runs`` of (first line, lines) that go."""
    per_doc = dropped.groupBy("doc", "body").agg(F.sort_array(F.collect_set("pos")).alias("p"))

    def edge(p: Column, step: int) -> Column:
        ends = lambda x, i: (i == (F.lit(0) if step < 0 else F.size(p) - 1)) | (F.get(p, i + F.lit(step)) != x + F.lit(step))
        return F.filter(p, ends)

    runs = let(F.col("p"), lambda p: F.zip_with(edge(p, -1), edge(p, 1), lambda a, b: F.struct(
        a.alias("first"), (b - a + 1).alias("lines"))))
    return per_doc.select("doc", "body", runs.alias("runs"))


def apply_bitmaps(df: DataFrame, maps: DataFrame, key_col: str = "doc_id", text_col: str = "text",
                  kept_col: str = "kept", n_lines_col: str = "n_lines", n_dropped_col: str = "n_dropped") -> DataFrame:
    """``df`` plus the text that stays and the counts of lines."""
    maps = maps.select(F.col("doc").alias("_ld_doc"), F.col("body").alias("_ld_body"), F.col("runs").alias("_ld_runs"))
    own = df.withColumn("_ld_own", _identity(F.col(text_col)))
    met = own.join(maps, own[key_col].eqNullSafe(maps["_ld_doc"]) & (own["_ld_own"] == maps["_ld_body"]), "left")
    text, runs = F.coalesce(F.col(text_col), F.lit("")), F.col("_ld_runs")
    gone = F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["first"] + r["lines"] - 1)))

    def remaining(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    kept = F.when(runs.isNull(), text).otherwise(let(split_lines(F.col(text_col)), remaining))
    n_dropped = F.coalesce(F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["lines"]), F.lit(0).cast("long"))
    n_lines = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    made = {n_lines_col: n_lines, n_dropped_col: n_dropped, kept_col: kept}
    return met.select(*[F.col(c) for c in df.columns if c not in made], *[e.alias(n) for n, e in made.items()])


def dedup_lines(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    return apply_bitmaps(df, bitmaps(dropped_lines(df, key_col, text_col)), key_col, text_col, **kw)
