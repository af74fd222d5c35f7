"""Vocabularies, id encoding, word vectors.

A vocabulary is a DataFrame (word, idx, freq): specials first (idx 0..k-1),
then words by frequency descending and word ascending.  It is never collected:
encoding and decoding are joins, ranking is by range partitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import normal_vector, normal_vectors
from .rank import range_rank
from .wordmap import map_tokens


def build_vocab(df: DataFrame, tokens_col: str, specials=("<unk>",), min_freq: int = 1) -> DataFrame:
    """A5: (word, idx, freq).  Counting is a partially aggregated groupBy, so a hot
    word is combined map-side; ranks come from range partitions of (freq, word), so
    the many words seen once are spread like all others."""
    counts = (df.select(F.explode_outer(F.col(tokens_col)).alias("word"))
              .where(F.col("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
              .filter((F.col("freq") >= min_freq) & ~F.col("word").isin(list(specials))))
    ranked = range_rank(counts, [F.col("freq").desc(), F.col("word").asc()], rank_col="_r")
    words = ranked.select("word", (F.col("_r") - 1 + len(specials)).cast("long").alias("idx"),
                          F.col("freq").cast("long"))
    spark = df.sparkSession
    sp = spark.createDataFrame([(s, i, 0) for i, s in enumerate(specials)],
                               "word string, idx long, freq long")
    return sp.unionByName(words)


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"))


def encode_ids(df: DataFrame, key_cols, tokens_col: str, vocab: DataFrame, unk_idx: int = 0,
               out_col: str = "ids", keep_cols=()) -> DataFrame:
    """Token -> idx through a left join, unknown -> ``unk_idx``, order kept."""
    return map_tokens(df, key_cols, tokens_col, vocab, "word", "idx", out_col,
                      default=unk_idx, keep_cols=keep_cols)


def decode_ids(df: DataFrame, key_cols, ids_col: str, vocab: DataFrame, skip_ids=(0, 1),
               out_col: str = "decoded") -> DataFrame:
    """Idx -> word by join on idx, special ids skipped, joined by one space."""
    kept = df.select(*key_cols, F.filter(F.col(ids_col), lambda i: ~i.isin(list(skip_ids))).alias("_ids"))
    words = map_tokens(kept, key_cols, "_ids", vocab, "idx", "word", "_w", default="<unk>")
    return words.select(*key_cols, F.array_join("_w", " ").alias(out_col))


def encode_sequence(ids, max_len: int, pad: int = 0, text: bool = False) -> Column:
    """Cut to ``max_len`` and right-pad with ``pad``; returns struct(input_ids, attention_mask),
    with ``text`` both joined by commas: padding is then a repeated text and no padded array is made."""
    c = F.col(ids) if isinstance(ids, str) else ids
    cut = F.slice(c, 1, max_len)
    n = F.size(cut)
    if text:
        def joined(head, value):                               # all but an empty head end before a comma
            left = F.lit(max_len) - n
            return F.concat(head, F.when((n == 0) & (left > 0), F.concat(F.lit(str(value)), F.repeat(F.lit(f",{value}"), left - 1)))
                            .otherwise(F.repeat(F.lit(f",{value}"), left)))
        ones = F.when(n > 0, F.concat(F.lit("1"), F.repeat(F.lit(",1"), n - 1))).otherwise("")
        return F.struct(joined(F.array_join(cut.cast("array<string>"), ","), pad).alias("input_ids"), joined(ones, 0).alias("attention_mask"))
    padded = F.concat(cut, F.array_repeat(F.lit(pad).cast("long"), F.lit(max_len) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n))
    return F.struct(padded.alias("input_ids"), mask.alias("attention_mask"))


def pad_batches(df: DataFrame, ids_col: str = "ids", batch_col: str = "batch_id", pad: int = 0) -> DataFrame:
    """Dynamic padding - every row's ids padded to the longest of its batch;
    adds input_ids, attention_mask and batch_len (batches are bounded by their size)."""
    n = F.max(F.size(ids_col)).over(Window.partitionBy(batch_col))
    d = df.withColumn("batch_len", n)
    left = F.col("batch_len") - F.size(ids_col)
    return (d.withColumn("input_ids", F.concat(F.col(ids_col), F.array_repeat(F.lit(pad).cast("long"), left)))
            .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(ids_col)), F.array_repeat(F.lit(0), left)))
            .withColumn("batch_len", F.col("batch_len").cast("long")))


def mask_labels(labels, pad: int = 0, ignore: int = -100) -> Column:
    """Pad id -> ignore index."""
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.transform(c, lambda x: F.when(x == pad, F.lit(ignore)).otherwise(x))


def unmask_labels(labels, pad: int = 0, ignore: int = -100) -> Column:
    """T20 inverse: ignore index -> pad id before decoding."""
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.transform(c, lambda x: F.when(x == ignore, F.lit(pad)).otherwise(x))


def oov_vector(key: Column, dim: int, scale: float = 0.6, seed: int = 42) -> Column:
    """M6: N(0, scale^2) per dimension, a pure function of (key, dim, seed)."""
    return F.transform(normal_vector(key, dim, seed=seed), lambda x: F.lit(scale) * x)


def build_embedding_table(vocab: DataFrame, vectors: DataFrame, dim: int, key: str = "idx",
                          vec_key: str = "vec_id", vec_col: str = "embedding",
                          seed: int = 42) -> DataFrame:
    """Every vocabulary entry gets its stored vector, or a seeded OOV vector.

    Output (idx, word, found, vec array<double>).  A left equi-join; AQE chooses
    broadcast or sort-merge from the measured sizes.
    """
    v = vectors.select(F.col(vec_key).alias(key),
                       F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("_v"))
    j = vocab.join(v, on=key, how="left")
    return j.select(key, "word", F.col("_v").isNotNull().alias("found"),
                    F.coalesce(F.col("_v"), oov_vector(F.col(key), dim, seed=seed)).alias("vec"))


def stored_vectors(vocab: DataFrame, vectors: DataFrame, key: str = "idx", vec_key: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """J1 without its draws: (idx, word, vec), ``vec`` null for an entry without a stored vector,
    whose seeded one (``oov_vectors``) is drawn where it is used and so is neither kept nor moved."""
    v = vectors.select(F.col(vec_key).alias(key), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("vec"))
    return vocab.join(v, on=key, how="left").select(key, "word", "vec")


def oov_vectors(keys, dim: int, scale: float = 0.6, seed: int = 42) -> np.ndarray:
    """M6 for many keys at once: the vectors of ``oov_vector``."""
    return scale * normal_vectors(keys, dim, seed)


def embedding_coverage(vocab: DataFrame, vectors: DataFrame, key: str = "idx",
                       vec_key: str = "vec_id") -> DataFrame:
    """Available / unavailable vocabulary entries."""
    j = vocab.join(vectors.select(F.col(vec_key).alias(key), F.lit(1).alias("_hit")), on=key, how="left")
    return j.agg(F.count("_hit").alias("available"),
                 F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).cast("long").alias("unavailable"))


def read_word_vectors_text(spark, path: str, dim: int) -> DataFrame:
    """S3: ``word f1 ... fn`` lines -> (word, vec array<float>); duplicate words keep
    the last line (by file and byte offset), like building a dict."""
    raw = spark.read.text(path).select(
        F.input_file_name().alias("_file"), F.input_file_block_start().alias("_blk"),
        F.monotonically_increasing_id().alias("_off"),
        F.split(F.regexp_replace(F.col("value"), r"\s+$", ""), " ").alias("_p"))
    parsed = raw.select("_file", "_blk", "_off", F.col("_p")[0].alias("word"),
                        F.slice(F.col("_p"), 2, dim).cast(T.ArrayType(T.FloatType())).alias("vec"))
    last = parsed.groupBy("word").agg(F.max_by(F.col("vec"), F.struct("_file", "_blk", "_off")).alias("vec"))
    return last
