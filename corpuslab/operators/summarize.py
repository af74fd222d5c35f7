"""Article tables from pages, lead-1 summaries and the baseline evaluation
(S4, P6, P7, T13, T14, L9, E6, A4)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html as H
from ..session import cut_lineage
from ..functions import text as tx
from . import rouge as rg
from .split import fraction_split


def articles(pages: DataFrame, terms=None) -> DataFrame:
    """(page_id, url, headline, body) in one map-only stage."""
    return pages.select("page_id", "url", H.extract_title(F.col("html")).alias("headline"),
                        H.extract_body(F.col("html"), terms).alias("body"))


def length_cutoffs(df: DataFrame, cols, q: float = 0.995) -> DataFrame:
    """A4: exact linear-interpolated percentile of word counts, truncated to int."""
    return df.agg(*[F.percentile(tx.word_count(F.col(c)), F.lit(q)).cast("long").alias(f"max_{c}_length")
                    for c in cols])


def lead_summary(body, max_words: int | None = None):
    """L9 (lead method): the first sentence, cut to ``max_words`` words when given."""
    lead = tx.lead_sentence(body)
    if max_words is None:
        return lead
    return F.array_join(F.slice(tx.words(lead), 1, max_words), " ")


def extractive_summary(df: DataFrame, key: str, body: str = "body", min_words: int = 10, max_words: int | None = None,
                       out_col: str = "summary") -> DataFrame:
    """L9 (extractive method): sentences whose words are frequent in their article.

    A sentence scores the mean count, over the article, of its lower-case
    [a-z0-9]+ words; sentences are taken by score (ties: earlier first) until at
    least ``min_words`` words are taken, put back in order and cut to
    ``max_words``.  Articles without a sentence of such words get the empty summary.

    An article moves once, to meet the other rows of its key (rows that share one are one
    article); its sentences are cut, counted and chosen inside the row.  Rows without a
    key have the empty summary.
    """
    arts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(body)).alias("_b"))
    sents = F.flatten(F.transform("_b", lambda b: F.transform(
        tx.sentences(b), lambda s, i: F.struct(i.alias("pos"), s.alias("s"), rg.rouge_tokens(s).alias("words"), tx.word_count(s).alias("len")))))
    cut = arts.select(key, "_n", sents.alias("_s"))
    taken = cut.select(key, "_n", "_s", _chosen("_s.pos", "_s.words", "_s.len", F.lit(min_words)).alias("_t"))
    picked = F.array_sort(F.transform("_t", lambda i: F.struct(F.get("_s", i)["pos"].alias("pos"), F.get("_s", i)["s"].alias("s"))))
    text = F.array_join(F.transform(picked, lambda x: x["s"]), " ")
    if max_words is not None:
        text = F.array_join(F.slice(tx.words(text), 1, max_words), " ")
    out = taken.select(key, "_n", text.alias(out_col)).select(
        key, F.explode(F.array_repeat(out_col, F.col("_n").cast("int"))).alias(out_col))
    return out.unionByName(df.where(F.col(key).isNull()).select(key, F.lit("").alias(out_col)))


WORDS = 1 << 18             # words that are numbered at a time (at least one article)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _chosen(pos: pa.Array, words: pa.Array, length: pa.Array, least: pa.Array) -> pa.Array:
    """The sentences of every article (numbers in its list, ascending) that are taken."""
    total = np.concatenate([[0], np.cumsum(words.flatten().value_lengths().to_numpy(zero_copy_only=False))])
    ends = total[np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]
    edges = [0]
    while edges[-1] < len(pos):
        done = ends[edges[-1] - 1] if edges[-1] else 0
        edges.append(max(edges[-1] + 1, int(np.searchsorted(ends, done + WORDS, side="right"))))
    parts = [_taken(*(x.slice(a, b - a) for x in (pos, words, length)), least[0].as_py()) for a, b in zip(edges, edges[1:])]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def _taken(pos: pa.Array, words: pa.Array, length: pa.Array, least: int) -> pa.Array:
    sizes = pos.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = words.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place, size = pos.flatten().to_numpy(zero_copy_only=False).astype(np.int64), length.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(row)), tokens.value_lengths().to_numpy(zero_copy_only=False))
    flat = tokens.flatten().dictionary_encode()
    code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, back, times = np.unique(row[owner] * max(len(flat.dictionary), 1) + code, return_inverse=True, return_counts=True)
    # rows of one key may each have a sentence at a place: these score together
    _, same = np.unique(row * (int(place.max(initial=0)) + 1) + place, return_inverse=True)
    n = np.bincount(same[owner], minlength=len(same))
    score = np.bincount(same[owner], weights=times[back], minlength=len(same)) / np.maximum(n, 1)
    order = np.lexsort((at, place, -score[same], row))
    order = order[n[same[order]] > 0]
    before = np.cumsum(size[order]) - size[order]
    first = np.concatenate([[True], row[order][1:] != row[order][:-1]]) if len(order) else np.zeros(0, bool)
    before -= np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(order))))
    keep = np.sort(order[before < least])
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(sizes)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[keep], pa.int32()))


def summarize(df: DataFrame, body: str = "body", headline: str = "headline", key: str = "page_id",
              max_words: int | None = None) -> DataFrame:
    """One summary per article -> (key, Body, Headline, Summary)."""
    return df.select(key, F.col(body).alias("Body"), F.col(headline).alias("Headline"),
                     lead_summary(F.col(body), max_words).alias("Summary"))


def evaluate_baseline(arts: DataFrame, key: str = "page_id", min_words: int = 30, seed: int = 42,
                      split: str = "val") -> DataFrame:
    """Lead-1 of the body vs the headline on one split of the long-body
    articles (80/10/10 positional split of a seeded shuffle); mean F of
    ROUGE-1/2/L/Lsum."""
    # the split reads its input three times (count, bucket counts, rank): extract once
    long_ = cut_lineage(arts.filter(tx.word_count(F.col("body")) > min_words))
    s = fraction_split(long_, {"train": 0.8, "val": 0.1, "test": 0.1}, key, seed).filter(F.col("split") == split)
    pairs = s.select(key, lead_summary(F.col("body")).alias("prediction"), F.col("headline").alias("reference"))
    pairs = cut_lineage(pairs)  # read by four metrics
    return rg.rouge_corpus(rg.rouge_all(pairs, [key]))
