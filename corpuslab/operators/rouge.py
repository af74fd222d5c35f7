"""ROUGE evaluation of (prediction, reference) pairs.

Tokens: lower-case, every run outside [a-z0-9] is a separator.
* ROUGE-N is a multiset intersection inside the row: the sorted n-grams of a side
  are numbered within each run of equal ones, which makes them a set, and the two
  sets are intersected by hash.  Nothing is exploded or shuffled.
* ROUGE-L needs the LCS length: a pandas UDF over Arrow batches (bit-parallel).
* ROUGE-Lsum needs the union-LCS backtrack: a pandas UDF per pair.
All four together are one projection over tokens that are cut once.
P = overlap / max(|pred|, 1), R = overlap / max(|ref|, 1), F = 2PR/(P+R) (0 if both 0).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.hashing import TWO_32, let
from ..functions.lcs import lcs_length, summary_lcs_scores
from ..functions.stem import porter_stem
from .wordmap import map_tokens

TOKEN = "[a-z0-9]+"


def rouge_tokens(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)


def ngrams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    def grams(t):
        k = F.size(t) - n + 1
        return F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))),
                                         lambda i: F.array_join(F.slice(t, i, n), " "))) \
            .otherwise(F.array().cast(T.ArrayType(T.StringType())))
    return let(tokens, grams)


def _prf(overlap: Column, n_pred: Column, n_ref: Column, prefix: str) -> list:
    p = overlap / F.greatest(n_pred, F.lit(1))
    r = overlap / F.greatest(n_ref, F.lit(1))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return [p.alias(f"{prefix}_precision"), r.alias(f"{prefix}_recall"), f.alias(f"{prefix}_fmeasure")]


def numbered(grams: Column) -> Column:
    """A multiset as a set: every gram with its number among the equal ones."""
    def runs(a: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0))),
                          lambda i: (i < F.size(a)) & ((i == 0) | (F.get(a, i) != F.get(a, F.greatest(i - 1, F.lit(0))))))
        return let(starts, lambda s: F.flatten(F.transform(s, lambda at, j: F.transform(
            F.sequence(F.lit(1), F.coalesce(F.get(s, j + 1), F.size(a)) - at),
            lambda k: F.concat_ws("#", F.get(a, at), k.cast("string"))))))

    return let(F.array_sort(grams), runs)


def _overlap(p: Column, r: Column) -> Column:
    return F.size(F.array_intersect(numbered(p), numbered(r)))


def _cut(pairs: DataFrame, keys, pred: str, ref: str, *more) -> DataFrame:
    """The tokens of both sides; null text has none."""
    none = F.array().cast(T.ArrayType(T.StringType()))
    return pairs.select(*keys, F.coalesce(rouge_tokens(pred), none).alias("_pt"), F.coalesce(rouge_tokens(ref), none).alias("_rt"), *more)


def _n_scores(n: int, prefix: str) -> list:
    size = lambda c: F.greatest(F.size(c) - (n - 1), F.lit(0))
    return _prf(_overlap(ngrams(F.col("_pt"), n), ngrams(F.col("_rt"), n)), size("_pt"), size("_rt"), prefix)


def rouge_n(pairs: DataFrame, keys, pred: str = "prediction", ref: str = "reference", n: int = 1,
            prefix: str | None = None) -> DataFrame:
    """Clipped n-gram overlap per pair -> (keys, P, R, F)."""
    return _cut(pairs, keys, pred, ref).select(*keys, *_n_scores(n, prefix or f"rouge{n}"))


@F.pandas_udf(T.LongType())
def _lcs_len_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x) if x is not None else [], list(y) if y is not None else [])
                      for x, y in zip(a, b)], dtype="int64")


def rouge_l(pairs: DataFrame, keys, pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """LCS-based P / R / F per pair (no shuffle)."""
    t = _cut(pairs, keys, pred, ref)
    return t.withColumn("_lcs", _lcs_len_udf("_pt", "_rt")).select(
        *keys, *_prf(F.col("_lcs"), F.size("_pt"), F.size("_rt"), "rougeL"))


_LSUM_SCHEMA = T.StructType([T.StructField("p", T.DoubleType()), T.StructField("r", T.DoubleType()),
                             T.StructField("f", T.DoubleType())])


@F.pandas_udf(_LSUM_SCHEMA)
def _lsum_udf(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = [summary_lcs_scores(p, r) for p, r in zip(pred, ref)]
    return pd.DataFrame(rows, columns=["p", "r", "f"], dtype="float64")


def rouge_lsum(pairs: DataFrame, keys, pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """Summary-level LCS over newline-separated sentences."""
    keys = list(keys)
    s = pairs.select(*keys, _lsum_udf(F.col(pred), F.col(ref)).alias("_s"))
    return s.select(*keys, F.col("_s.p").alias("rougeLsum_precision"), F.col("_s.r").alias("rougeLsum_recall"),
                    F.col("_s.f").alias("rougeLsum_fmeasure"))


def rouge_all(pairs: DataFrame, keys, pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """E1-E4 F-measures per pair, one row per pair; Lsum reads T12 sentences."""
    t = _cut(pairs, keys, pred, ref, tx.newline_sentences(F.col(pred)).alias("_pl"), tx.newline_sentences(F.col(ref)).alias("_rl"))
    t = t.withColumn("_lcs", _lcs_len_udf("_pt", "_rt")).withColumn("_sum", _lsum_udf("_pl", "_rl"))
    scores = {"rouge1": _n_scores(1, "f"), "rouge2": _n_scores(2, "f"),
              "rougeL": _prf(F.col("_lcs"), F.size("_pt"), F.size("_rt"), "f")}
    return t.select(*keys, *[f.alias(name) for name, (_, _, f) in scores.items()], F.col("_sum.f").alias("rougeLsum"))


def stem_words(df: DataFrame, key_cols, col: str) -> DataFrame:
    """E5: a text's ROUGE tokens replaced by their Porter stems, joined by blanks.
    Every distinct word is stemmed once; only words that change are mapped back."""
    toks = df.select(*key_cols, rouge_tokens(col).alias("_rt"))
    words = toks.select(F.explode_outer("_rt").alias("word")).where(F.length("word") > 3).distinct()
    stems = words.select("word", _stem_udf("word").alias("stem")).where(F.col("stem") != F.col("word"))
    return map_tokens(toks, list(key_cols), "_rt", stems, "word", "stem", "_st").select(
        *key_cols, F.array_join("_st", " ").alias(col))


@F.pandas_udf(T.StringType())
def _stem_udf(words: pd.Series) -> pd.Series:
    return words.map(porter_stem)


def stemmed_pairs(pairs: DataFrame, keys, pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """E5: both sides stemmed; every ROUGE operator takes the result."""
    return stem_words(pairs, keys, pred).join(stem_words(pairs, keys, ref), list(keys))


def rouge_corpus(scores: DataFrame, cols=("rouge1", "rouge2", "rougeL", "rougeLsum")) -> DataFrame:
    """Mean F over pairs (partial + final aggregation)."""
    return scores.agg(F.count(F.lit(1)).alias("pairs"), *[F.avg(c).alias(c) for c in cols])


# Poisson(1) inverse CDF thresholds: P(K <= k) for k = 0..11 (fixed values, e^-1 * sum 1/j!).
def _poisson1_cdf(kmax: int = 11) -> list:
    out, acc = [], 0.0
    for k in range(kmax + 1):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out


def poisson1(h: Column) -> Column:
    """Poisson(1) draw (double) by inverse CDF of the uniform that a hex hash begins with: its
    first 32 bits over 2 ** 32, as in ``hashing.uniform``.  Hex digits sort as their number
    does, so the hash is compared with the CDF as it is."""
    expr = F
    for k, c in enumerate(_poisson1_cdf()):
        expr = expr.when(h < F.lit(f"{math.ceil(c * TWO_32):08x}"), F.lit(float(k)))
    return expr.otherwise(F.lit(float(len(_poisson1_cdf()))))


def rouge_bootstrap(scores: DataFrame, key: str, cols=("rouge1", "rouge2", "rougeL", "rougeLsum"),
                    n_samples: int = 1000, seed: int = 42) -> DataFrame:
    """Bootstrap confidence (low / mid / high = 2.5 / 50 / 97.5 percentiles)
    of the mean F, with hash-seeded Poisson(1) resampling weights.

    A pair's weights for all replicates are one array, and a vector aggregate adds the
    arrays up: a task ships one array of ``n_samples * (1 + metrics)`` sums, whatever
    the number of pairs.  The pairs are dealt out before their draws, which are nearly all
    of the work: a scan may have fewer tasks than there are cores.
    """
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    head = F.when(F.col(key).isNull(), "").otherwise(F.concat(F.col(key).cast("string"), F.lit("|")))
    dealt = scores.select(head.alias("_h"), *[F.col(c).cast("double").alias(c) for c in cols]).repartition(parts, "_h")
    tails = F.split(F.lit(",".join(f"{r}|{seed}" for r in range(n_samples))), ",")     # folded into one literal array
    weights = F.transform(F.transform(tails, lambda t: F.md5(F.concat("_h", t))), poisson1)
    rep = dealt.select(*cols, weights.alias("_w"))

    def scaled(c: str) -> Column:
        return F.transform("_w", lambda w: w * F.coalesce(F.col(c), F.lit(0.0)))

    total = rep.select(array_to_vector(F.concat("_w", *map(scaled, cols))).alias("_v")).agg(Summarizer.sum(F.col("_v")).alias("_s"))
    sums = total.select(vector_to_array("_s").alias("_s")).where("_s is not null")
    at = lambda i: F.get("_s", F.col("replicate") + i * n_samples)
    means = sums.select("_s", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("replicate")).select(
        *[F.try_divide(at(1 + i), at(0)).alias(c) for i, c in enumerate(cols)])
    out = []
    for c in cols:
        out.append(F.percentile(F.col(c), F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias(c))
    agg = means.agg(*out)
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c)[0].alias("low"), F.col(c)[1].alias("mid"),
                 F.col(c)[2].alias("high")) for c in cols])).alias("_m")).select("_m.*")
