"""Hashed word shingles of many texts at once, in numpy.

Words are hashed by a polynomial over random byte values modulo 2 ** 64, read
off one running sum, so no Python object is made per word.  A text's set holds
the 64-bit hashes of its distinct five-word shingles; a text with one to four
words has one shingle, its whole sequence; a text without words has none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SIZE = 5
GOLD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93                                  # odd, so it has an inverse modulo 2 ** 64


def mix(x: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    x = (x ^ np.asarray(seed, dtype=np.uint64)) * GOLD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64), 0x1234567) | np.uint64(1)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)]), dtype=np.uint64)
                      for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, A-Z lower-cased, end to end; number of words of each text)."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[data] * power[:len(data)], out=sums[1:], dtype=np.uint64)
    h = (sums[ends] - sums[starts]) * inverse[starts]
    text_ends = np.cumsum(sizes)
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, text_ends)]))
    return mix(h, (ends - starts).astype(np.uint64)), counts


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text end to end; set sizes)."""
    h, counts = word_hashes(texts)
    n = len(texts)
    owner = np.repeat(np.arange(n), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(h))       # words from here to the text's end
    parts, owners = [], []
    if len(h) >= SIZE:
        whole = np.flatnonzero(left >= SIZE)
        x = mix(h[whole], 1)
        for j in range(1, SIZE):
            x = mix(x * GOLD + h[whole + j], 1 + j)
        parts.append(x)
        owners.append(owner[whole])
    few = np.flatnonzero((counts > 0) & (counts < SIZE))
    if len(few):
        first = np.cumsum(counts)[few] - counts[few]
        x = mix(counts[few].astype(np.uint64), 99)
        for j in range(SIZE - 1):
            has = counts[few] > j
            x[has] = mix(x[has] * GOLD + h[first[has] + j], 100 + j)
        parts.append(x)
        owners.append(few)
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(n, dtype=np.int64)
    x, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    return x[new], np.bincount(owner[new], minlength=n)
