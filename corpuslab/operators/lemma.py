"""Noun lemmatiser (T8) and its lexicon.

Contract (WordNet-style noun morphology): the candidates of a word are the word
itself followed by every suffix rule that applies, in rule order; an exception
entry replaces the rules.  Candidates not in the lexicon are dropped; the
shortest survivor wins (earlier candidate on a tie); with no survivor the word
is unchanged.

A lexicon is a table: a plain word list (word), or one fitted on a corpus with
its counts (word, freq), which is saved and used for any text, so a text's lemmas
do not depend on what else is cleaned.  In a fitted lexicon a stem counts only if
it is at least ``1 / RARER`` as frequent as the word: "news" stays where "new" is
a slip that occurs twice.

Work is done once per *distinct* word: explode -> distinct -> candidates ->
join with the lexicon -> min by (length, position).  The resulting
word -> lemma table is then applied to token arrays by ``map_tokens``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .wordmap import map_tokens

# Noun suffix-detachment rules (suffix, replacement), in order.
NOUN_RULES = [
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
]


def lemma_candidates(word: Column) -> Column:
    """Ordered candidate array: the word, then each applicable rule's output."""
    cands = [word]
    for old, new in NOUN_RULES:
        cut = F.substring(word, F.lit(1), F.length(word) - F.lit(len(old)))
        cands.append(F.when(word.endswith(old), F.concat(cut, F.lit(new))))
    return F.filter(F.array(*cands), lambda c: c.isNotNull())


RARER = 10                  # times a stem may be rarer than its word in a fitted lexicon


def fit_lexicon(tokens_df: DataFrame, tokens_col: str, min_freq: int = 2) -> DataFrame:
    """(word, freq) of the corpus words seen at least ``min_freq`` times, materialised."""
    counts = (tokens_df.select(F.explode_outer(F.col(tokens_col)).alias("word"))
              .where(F.col("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("freq")))
    return cut_lineage(counts.filter(F.col("freq") >= min_freq))


def save_lexicon(lexicon: DataFrame, path: str) -> str:
    lexicon.write.mode("overwrite").parquet(path)
    return path


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lemma_table(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None,
                word_col: str = "word") -> DataFrame:
    """(word, lemma) for every distinct word of ``words``."""
    distinct = words.select(F.col(word_col).alias("word")).where(F.col("word").isNotNull()).distinct()
    cands = distinct.select("word", F.posexplode(lemma_candidates(F.col("word"))).alias("cpos", "cand"))
    if exceptions is not None:
        exc = exceptions.select(F.col("word").alias("word"), F.col("lemma").alias("cand"))
        exc_words = exc.select("word").distinct()
        cands = (cands.join(exc_words, "word", "left_anti")
                 .unionByName(distinct.join(exc_words, "word", "inner")
                              .select("word", F.lit(0).alias("cpos"), F.col("word").alias("cand")))
                 .unionByName(exc.select("word", F.lit(1).alias("cpos"), "cand")))
    if "freq" in lexicon.columns:
        kept = (cands.join(lexicon.select(F.col("word").alias("cand"), F.col("freq").alias("_cf")), "cand")
                .join(lexicon.select("word", F.col("freq").alias("_wf")), "word", "left")
                .where(F.coalesce(F.col("_wf"), F.lit(0)) <= RARER * F.col("_cf")))
    else:
        kept = cands.join(lexicon.select(F.col("word").alias("cand")).distinct(), on="cand", how="left_semi")
    best = kept.groupBy("word").agg(
        F.min_by(F.col("cand"), F.struct(F.length("cand"), F.col("cpos"), F.col("cand"))).alias("lemma"))
    return (distinct.join(best, on="word", how="left")
            .select("word", F.coalesce(F.col("lemma"), F.col("word")).alias("lemma")))


def lemmatize(df: DataFrame, key_cols, tokens_col: str, lexicon: DataFrame | None = None,
              exceptions: DataFrame | None = None, out_col: str = "lemmas", keep_cols=()) -> DataFrame:
    """T8 over token arrays: each distinct word is lemmatised once, then mapped back.
    Without a lexicon one is fitted on ``df`` itself."""
    lex = lexicon if lexicon is not None else fit_lexicon(df, tokens_col)
    words = df.select(F.explode_outer(F.col(tokens_col)).alias("word"))
    table = lemma_table(words, lex, exceptions)
    changed = table.filter(F.col("lemma") != F.col("word"))
    return map_tokens(df, key_cols, tokens_col, changed, "word", "lemma", out_col, keep_cols=keep_cols)
