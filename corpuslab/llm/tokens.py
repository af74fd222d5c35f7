"""Words of many texts at once, as hashes read off one running sum.

A text is bytes; a word is a maximal run of bytes of a given class.  No Python
object is made per word: the polynomial hash of a word modulo 2 ** 64 is the
difference of two prefix sums (see ``shingles``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shingles import _byte_values, _powers, mix


def byte_class(*outside: tuple[int, int]) -> np.ndarray:
    """Which byte values belong to a word: all but the given ranges (ends included)."""
    inside = np.ones(256, dtype=bool)
    for lo, hi in outside:
        inside[lo:hi + 1] = False
    return inside


def byte_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive rows of about ``most`` bytes (one row at least), as (first row,
    texts in UTF-8); null counts as the empty text."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    texts: list[bytes] = []
    start = held = 0
    for i in range(len(values)):
        t = values[i].as_py() or b""
        if texts and held + len(t) > most:
            yield start, texts
            texts, start, held = [], i, 0
        texts.append(t)
        held += len(t)
    if texts:
        yield start, texts


def hashed_spans(texts: list[bytes], inside: np.ndarray, seed: int | None = None):
    """(hash of every word, end to end; number of words of each text; the texts' bytes
    laid end to end; first and last byte of every word).  The line feed, which separates
    the texts, must not belong to words.  Each ``seed`` gives other hashes."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    member = inside[data]
    edge = np.flatnonzero(member[1:] != member[:-1]) + 1
    if member[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(data))
    values = _byte_values() if seed is None else mix(_byte_values(), 1000 + seed)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * power[:len(data)], out=sums[1:], dtype=np.uint64)
    h = (sums[ends] - sums[starts]) * inverse[starts]
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, np.cumsum(sizes))]))
    return mix(h, (ends - starts).astype(np.uint64)), counts, data, starts, ends


def hashed_words(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, end to end; number of words of each text)."""
    return hashed_spans(texts, inside)[:2]
