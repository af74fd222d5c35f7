"""Periodic runs of words by seed-and-extend along diagonals.

A run is a maximal stretch of words with smallest period q (words q apart are
the same) that is at least ``max(24, 3 q)`` words long.  Words of a run that are
q apart match on the diagonal of lag q, over at least ``max(24 - q, 2 q)`` words.

*Index.*  So an index of k-grams with k = 16 has a pair of equal k-grams on the
diagonal of every run of period 16 and less, and one with k = 16 * 2^c of every
run with a period in (k / 2, k]: each overlap is k words at least.  k-grams are
named exactly, by ranks of pairs of the names of k/2-grams.

*Seeds.*  Occurrences of a k-gram are paired with the next one only.  With k no
smaller than q that is enough: inside a run of smallest period q the next
occurrence of a k-gram is q words on (a closer one would be a smaller period),
so a text of n words has at most n pairs for each k, and every pair's lag is the
smallest period of the stretch around it.

*Extension.*  Pairs are taken by lag and position.  A table keeps for each lag
how far it is covered; a pair inside a covered stretch is skipped, any other is
extended to both sides, so each stretch is walked once.

Texts without a 16-gram that occurs twice have no run; they are told apart by
hashes of many texts at once (equal 16-grams have equal hashes), and only the
others are indexed exactly.

Contract: null and empty texts have no words, no run and an empty collapsed
text; words are runs of anything but the six blanks, case kept; texts of any
length are taken whole, one at a time; rows with one key, and null keys, are
separate rows; an empty table gives an empty table.  Only the named columns are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import GOLD, mix
from .tokens import byte_class, byte_slices, hashed_words

LEAST = 24                  # words of the shortest run
TIMES = 3                   # periods of the shortest run
GRAM = 16                   # smallest overlap of a run with itself: max(24 - q, 2 q) >= 16
SLICE_BYTES = 1 << 19
WORD_BYTES = byte_class((0x20, 0x20), (0x09, 0x0D))
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


# -- one text ---------------------------------------------------------------------
def _pair_names(names: np.ndarray, step: int) -> np.ndarray:
    """Names of grams of twice the length, equal exactly for equal grams."""
    both = names[:-step] * (int(names.max()) + 1) + names[step:]
    return np.unique(both, return_inverse=True)[1]


def _seeds(names: np.ndarray, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, position) of neighbouring occurrences with a lag in (shortest, longest], in order."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    at = order[:-1][same]
    lag = order[1:][same] - at
    fits = (lag > shortest) & (lag <= longest)
    at, lag = at[fits], lag[fits]
    order = np.lexsort((at, lag))
    return lag[order], at[order]


def _matching(ids: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many words from ``i`` on (forwards or backwards) equal those ``lag`` further."""
    n, done, width = len(ids), 0, 64
    while True:
        if step > 0:
            lo = i + done
            hi = min(lo + width, n - lag)
            equal = ids[lo:hi] == ids[lo + lag:hi + lag] if hi > lo else np.zeros(0, dtype=bool)
        else:
            hi = i - done + 1
            lo = max(0, hi - width)
            equal = (ids[lo:hi] == ids[lo + lag:hi + lag])[::-1] if hi > lo else np.zeros(0, dtype=bool)
        if not len(equal):
            return done
        if not equal.all():
            return done + int(equal.argmin())
        done += len(equal)
        width *= 2


def text_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text whose words are numbered, by start and period."""
    n = len(ids)
    runs: list[tuple[int, int, int]] = []
    if n < LEAST:
        return runs
    names, size = ids.astype(np.int64), 1
    while size < GRAM:
        names, size = _pair_names(names, size), size * 2
    shortest = 0
    while True:
        covered: dict[int, int] = {}
        for lag, i in zip(*(x.tolist() for x in _seeds(names, shortest, size))):
            if i < covered.get(lag, 0):
                continue
            start = i - _matching(ids, i - 1, lag, -1)
            end = i + _matching(ids, i, lag, 1)                # words of [start, end) equal those one lag on
            covered[lag] = end
            length = end - start + lag
            if length >= max(LEAST, TIMES * lag):
                runs.append((start, length, lag))
        if len(names) <= size or 2 * size * TIMES > 2 * n or len(np.unique(names)) == len(names):
            return sorted(runs, key=lambda r: (r[0], r[2]))
        names, shortest, size = _pair_names(names, size), size, size * 2


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


# -- many texts ---------------------------------------------------------------------
def may_have_runs(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which texts hold a 16-gram twice, by the hashes of their words end to end."""
    out = np.zeros(len(counts), dtype=bool)
    if len(h) < GRAM:
        return out
    owner = np.repeat(np.arange(len(counts)), counts)
    gram, size = h, 1
    while size < GRAM:
        gram, size = mix(gram[:-size] * GOLD + gram[size:], size), size * 2
    own = owner[:len(gram)]
    whole = own == owner[GRAM - 1:]
    own, gram = own[whole], mix(gram[whole], own[whole].astype(np.uint64) + np.uint64(1))
    order = np.argsort(gram, kind="stable")
    twice = gram[order[1:]] == gram[order[:-1]]
    out[own[order[1:][twice]]] = True
    return out


def collapse_runs(df: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: the runs by start and period,
    and the words that stay, joined by one space."""
    kind = dict(df.select(key_col).dtypes)[key_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in byte_slices(batch, "t", SLICE_BYTES):
                h, counts = hashed_words(texts, WORD_BYTES)
                found, collapsed = [], []
                for text, again in zip(texts, may_have_runs(h, counts).tolist()):
                    words = text.split()
                    runs = []
                    if again:
                        number: dict[bytes, int] = {}
                        ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
                        runs = text_runs(ids)
                    if runs:
                        words = [w for w, stays in zip(words, kept_words(len(words), runs).tolist()) if stays]
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    collapsed.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(counts, pa.int64()),
                     pa.array(found, pa.list_(RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["key", "n_words", "runs", "collapsed"])

    out = df.select(F.col(key_col).alias("key"), F.col(text_col).alias("t")).mapInArrow(
        work, f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("key", key_col)
