"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Every paragraph (text between newlines) hashes to a wide vector:

* ``EXACT`` lanes of 64 bits from the paragraph's own digest, and
* ``NEAR`` lanes of 32 bits: the sum over the paragraph's word triples (the
  whole paragraph where it has fewer words) of +1 or -1, drawn by the triple's
  hash.

A document's fingerprint is the lane-wise sum modulo 2 ** 64 and 2 ** 32 over
its paragraphs.  Sums commute, so paragraph order does not matter, and a
paragraph is inserted or deleted by adding or subtracting its vector.  Equal
fingerprints mean equal paragraph multisets up to a 512-bit collision; the
cosine of the near lanes, read as signed numbers, estimates how much of the two
texts is shared.

Contract: a null text is the empty text, which is one empty paragraph; texts of
any length are hashed whole in bounded slices; repeated rows each get their
fingerprint; an empty table gives an empty table; only the two named columns are
read, so other columns may have any name.  A near lane holds 2 ** 31 equal triples.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT, NEAR = 8, 256
BLOCK = 1 << 14            # triples turned into lanes at once
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class WordHashes:
    """Bounded memory of word hashes, one per worker."""

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = _word_hash(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31)) ^ np.uint64(k + 1)) * _MIX[k]
    x = (x ^ (x >> np.uint64(29))) * _MIX[(k + 1) % 4]
    return x ^ (x >> np.uint64(32))


def _near(hashes: np.ndarray) -> np.ndarray:
    """Sum of the signed lanes of the hashed features, modulo 2 ** 32."""
    total = np.zeros(NEAR, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at:at + BLOCK]
        bits = np.empty((len(part), NEAR // 64), dtype="<u8")
        for k in range(NEAR // 64):
            bits[:, k] = _mix(part, k)
        ones = np.unpackbits(bits.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        total += 2 * ones - len(part)
    return (total & 0xFFFFFFFF).astype(np.uint32)


def _features(paragraphs: list[str], words: WordHashes) -> np.ndarray:
    """Hashes of the word triples of each paragraph."""
    tokens = [WORD.findall(p) for p in paragraphs]
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    flat = [w for t in tokens for w in t]
    if not flat:
        return np.zeros(0, dtype=np.uint64)
    h = words.of(flat)
    short = np.zeros(len(h), dtype=np.uint64)
    triples = np.zeros(0, dtype=np.uint64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(h))
    if len(h) >= 3:
        whole = at[:-2] + 2 < ends[:-2]
        a, b, c = h[:-2][whole], h[1:-1][whole], h[2:][whole]
        triples = (a * _MIX[0] + (b ^ (a >> np.uint64(17)))) * _MIX[1] + (c ^ (b >> np.uint64(13))) * _MIX[2]
    few = sizes < 3
    if few.any():
        starts = np.cumsum(sizes) - sizes
        one = starts[few & (sizes >= 1)]
        two = sizes[few & (sizes >= 1)] == 2
        short = h[one] * _MIX[3]
        short[two] += h[one[two] + 1] * _MIX[2] + np.uint64(1)
        return np.concatenate([triples, short])
    return triples


def paragraph_vector(paragraph: str, words: WordHashes | None = None) -> tuple[np.ndarray, np.ndarray]:
    digest = hashlib.blake2b(paragraph.encode("utf-8", "surrogatepass"), digest_size=8 * EXACT).digest()
    return np.frombuffer(digest, dtype="<u8").copy(), _near(_features([paragraph], words or WordHashes()))


def text_vector(text: str, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the vectors of all paragraphs of a text."""
    paragraphs = text.split("\n")
    digests = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8 * EXACT).digest()
                       for p in paragraphs)
    exact = np.frombuffer(digests, dtype="<u8").reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)
    return exact, _near(_features(paragraphs, words))


def insert(fp, paragraph: str):
    e, n = paragraph_vector(paragraph)
    return fp[0] + e, fp[1] + n


def delete(fp, paragraph: str):
    e, n = paragraph_vector(paragraph)
    return fp[0] - e, fp[1] - n


def to_hex(fp) -> str:
    return fp[0].astype("<u8").tobytes().hex() + fp[1].astype("<u4").tobytes().hex()


def from_hex(text: str):
    raw = bytes.fromhex(text)
    return np.frombuffer(raw[:8 * EXACT], dtype="<u8").copy(), np.frombuffer(raw[8 * EXACT:], dtype="<u4").copy()


def likeness(a, b) -> float:
    """1 for equal fingerprints, else the cosine of the near lanes, 0 at least."""
    if np.array_equal(a[0], b[0]):
        return 1.0
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    norm = np.sqrt((x @ x) * (y @ y))
    return float(min(1.0, max(0.0, x @ y / norm))) if norm else 0.0


# -- neighbours in key order --------------------------------------------------
def _range_of(cuts: list[int]):
    @F.pandas_udf("int")
    def f(keys: pd.Series) -> pd.Series:
        return pd.Series([-1 if pd.isna(k) else bisect_right(cuts, int(k)) for k in keys.astype("Int64")], dtype="int32")
    return f


def with_lower_neighbour(df: DataFrame, key_col: str, text_col: str, ranges: int | None = None) -> DataFrame:
    """Columns ``key``, ``text``, ``part``, ``last``: every row in the key range
    ``part``; the highest row of a range is also in the range above it (that of
    the highest range in the lowest one) with ``last`` true.  Sorted within a
    range, the row before a row is then its neighbour with the next lower key.

    The cuts are quantiles of the key, as many as there are shuffle partitions;
    the driver holds those numbers only."""
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.col(key_col).cast("long").alias("key"))
    cuts = keys.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    part = _range_of(cuts)
    highest = (keys.select(part("key").alias("part"), "key").groupBy("part")
               .agg(F.max("key").alias("key")).orderBy("part").collect())       # one row per range
    above = {r["part"]: highest[(i + 1) % len(highest)]["part"] for i, r in enumerate(highest)}
    tops = {r["part"]: r["key"] for r in highest}
    rows = df.select(F.col(key_col).cast("long").alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("part", part("key"))
    if not highest:
        return rows.withColumn("last", F.lit(False))
    top = F.element_at(F.create_map(*[F.lit(x) for k, v in tops.items() for x in (k, v)]), F.col("part"))
    up = F.element_at(F.create_map(*[F.lit(x) for k, v in above.items() for x in (k, v)]), F.col("part"))
    copies = F.when(F.col("key").eqNullSafe(top), F.array(F.struct(F.col("part"), F.lit(False).alias("last")),
                                                         F.struct(up.alias("part"), F.lit(True).alias("last")))
                    ).otherwise(F.array(F.struct(F.col("part"), F.lit(False).alias("last"))))
    return rows.withColumn("c", F.explode(copies)).select("key", "text", "c.part", "c.last")


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint_edits(df: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text; the next text is that
    of the next lower key (the lowest key's next is the highest).  Rows with one
    key follow each other by text hash; a null key is the lowest.  Only one text
    and its neighbour are held at a time."""
    parted = with_lower_neighbour(df, key_col, text_col)
    ordered = (parted.repartition("part")
               .sortWithinPartitions("part", F.col("last").desc(), F.col("key").asc_nulls_first(), F.xxhash64("text")))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n_chars", T.LongType()),
                           T.StructField("edited", T.StringType()), T.StructField("fingerprint", T.StringType()),
                           T.StructField("edited_fingerprint", T.StringType()),
                           T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        part = before = before_fp = None
        out: list[tuple] = []
        held = 0
        for batch in batches:
            key, text, parts, last = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                p, t = parts[i].as_py(), text[i].as_py()
                if p != part:
                    part = p
                fp = text_vector(t, words)
                if not last[i].as_py():
                    new = edited(t, before)
                    new_fp = text_vector(new, words)
                    out.append((key[i].as_py(), len(t), new, to_hex(fp), to_hex(new_fp), likeness(fp, new_fp),
                                likeness(fp, before_fp)))
                    held += len(new)
                    if held > 1 << 20:
                        yield _records(out, schema)
                        out, held = [], 0
                before, before_fp = t, fp
        if out:
            yield _records(out, schema)

    return ordered.mapInArrow(work, schema).withColumnRenamed("key", key_col)


def _records(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(f.name, pa.string())) for c, f in zip(zip(*rows), schema.fields)],
                                      names=schema.names)
