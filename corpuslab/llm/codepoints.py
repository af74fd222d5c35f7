"""Code-point helpers shared by the vectorised text operators."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

LETTER, NUMBER, BLANK, SPACE, APOSTROPHE, OTHER = range(6)

# The Unicode White_Space property.
WHITE_SPACE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
               (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]

# Letters and numbers that Unicode 16 added to 15.1 (the tokenizer
# library follows 16, Python's own table may be older).
UNICODE_16_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
                      (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
                      (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
                      (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D),
                      (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
UNICODE_16_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139),
                      (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point (one byte each), built once per worker."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)),
                      dtype=np.uint8, count=0x110000)
    for ranges, value in ((UNICODE_16_LETTERS, LETTER), (UNICODE_16_NUMBERS, NUMBER), (WHITE_SPACE, SPACE)):
        for lo, hi in ranges:
            out[lo:hi + 1] = value
    out[0x20] = BLANK
    out[0x27] = APOSTROPHE
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def text_slices(batch: pa.RecordBatch, column: str, max_chars: int) -> Iterator[tuple[int, list[str]]]:
    """Consecutive runs of rows of about ``max_chars`` characters (one row at
    least), as (first row, texts); null counts as the empty text."""
    texts: list[str] = []
    start = held = 0
    values = batch.column(batch.schema.get_field_index(column))
    for i in range(len(values)):
        t = values[i].as_py() or ""
        if texts and held + len(t) > max_chars:
            yield start, texts
            texts, start, held = [], i, 0
        texts.append(t)
        held += len(t)
    if texts:
        yield start, texts


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the n + 1 offsets of the texts."""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return code_points("".join(texts)), offsets
