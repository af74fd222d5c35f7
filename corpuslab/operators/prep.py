"""Projections, predicates, label handling and the cleaning pipelines
(P1-P12, J5-J7, T6, T7).  All DataFrame -> DataFrame, map-only unless noted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage
from .lemma import lemmatize


def labelled(docs: DataFrame, labels: DataFrame, label_col: str = "quality",
             key: str = "doc_id") -> DataFrame:
    """Documents with their label (inner equi-join on the key).

    The label table is small next to the texts; Spark's size check decides
    whether it is broadcast.
    """
    return docs.join(labels.select(key, F.col(label_col).alias("label")), on=key, how="inner")


def to_text_label(df: DataFrame, text: str = "headline", label: str = "is_sarcastic",
                  key: str = "doc_id") -> DataFrame:
    """P1 (+P10): rename to the working (key, text, label) table; text cast to string."""
    return df.select(F.col(key), tx.as_text(F.col(text)).alias("text"),
                     F.col(label).cast("int").alias("label"))


def keep_columns(df: DataFrame, cols) -> DataFrame:
    """P2."""
    return df.select(*cols)


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """P2."""
    return df.drop(*cols)


def keep_label(df: DataFrame, value: int = 1, label_col: str = "label") -> DataFrame:
    """Rows of one class (the intent of the scraper's selection, see N1)."""
    return df.filter(F.col(label_col) == F.lit(value))


def min_words(df: DataFrame, col: str, cutoff: int = 30) -> DataFrame:
    """Rows with strictly more than ``cutoff`` whitespace words."""
    return df.filter(tx.word_count(F.col(col)) > F.lit(cutoff))


def partition_by_predicate(df: DataFrame, pred: Column, flag: str = "is_long") -> DataFrame:
    """P5: one flag column instead of two frames; null predicate -> complement."""
    return df.withColumn(flag, F.coalesce(pred, F.lit(False)))


def with_constant(df: DataFrame, col: str, value) -> DataFrame:
    """P6."""
    return df.withColumn(col, F.lit(value))


def one_hot(label, k: int = 2) -> Column:
    """[int(i == label) for i in 0..k-1]."""
    lab = F.col(label) if isinstance(label, str) else label
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == lab).cast("int"))


def map_label(label, mapping: dict) -> Column:
    """Dictionary lookup; an unknown key raises at run time."""
    lab = F.col(label) if isinstance(label, str) else label
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    looked = F.element_at(m, lab)
    return F.when(looked.isNull(), F.raise_error(F.concat(F.lit("unknown label: "), lab.cast("string")))) \
        .otherwise(looked)


def row_at(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup by key (pushed down to the Parquet scan)."""
    return df.filter(F.col(key) == F.lit(value))


def attach_predictions(df: DataFrame, pred: DataFrame, key: str = "doc_id") -> DataFrame:
    """Predictions glued to their rows by key (inner equi-join)."""
    return df.join(pred, on=key, how="inner")


def zip_pairs(df: DataFrame, text: str = "text", label: str = "label") -> Column:
    """The (text, label) pair of one row, as a struct."""
    return F.struct(F.col(text).alias("text"), F.col(label).alias("label"))


def clean_tokens(text) -> Column:
    """T1 -> T2 -> T3 -> T4 as one projection: letters only, lower, split, stop words out."""
    return tx.drop_stopwords(tx.words(tx.lower(tx.letters_only(text))))


def clean_text(df: DataFrame, key: str = "doc_id", text: str = "text", lemmas: bool = True,
               lexicon: DataFrame | None = None, exceptions: DataFrame | None = None,
               out_col: str = "clean", keep_cols=()) -> DataFrame:
    """T1 -> T2 -> T3 -> T4 -> T8 -> T5.

    ``lemmas=False`` stops after the stop-word step.  ``lexicon`` is a word list or a
    fitted lexicon (``lemma.fit_lexicon``); without one it is fitted on ``df``.
    """
    toks = df.select(key, *keep_cols, clean_tokens(F.col(text)).alias("_tokens"))
    if not lemmas:
        return toks.select(key, *keep_cols, tx.join_words(F.col("_tokens")).alias(out_col))
    toks = cut_lineage(toks)                                   # read three times: lexicon, distinct words, texts
    lem = lemmatize(toks, [key], "_tokens", lexicon=lexicon, exceptions=exceptions,
                    out_col="_lem", keep_cols=keep_cols)
    return lem.select(key, *keep_cols, tx.join_words(F.col("_lem")).alias(out_col))


def clean_text_twice(df: DataFrame, key: str = "doc_id", text: str = "text",
                     lexicon: DataFrame | None = None, out_col: str = "clean") -> DataFrame:
    """Stop words out (case-sensitive, no lower-casing) -> word tokens ->
    lemmatise -> lemmas that are stop words out -> join."""
    first = tx.join_words(tx.drop_stopwords(tx.words(F.col(text))))
    toks = df.select(key, tx.word_tokens(first).alias("_tokens"))
    lem = lemmatize(cut_lineage(toks), [key], "_tokens", lexicon=lexicon, out_col="_lem")
    return lem.select(key, tx.join_words(tx.drop_stopwords(F.col("_lem"))).alias(out_col))
