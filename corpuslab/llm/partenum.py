"""Exact n-gram Jaccard join by PartEnum signatures.

Two texts link when ``100 * |intersection| >= 75 * |union|`` of their shingle
sets.  Linked sets of sizes a and b differ in at most ``(a + b) // 7`` shingles.

*Size bands.*  Sizes fall into bands ``[l, 16 l / 9]``; linked sets lie in one
band or in neighbouring ones.  Band i has its own partitioning of the shingle
domain; a set takes part in that of its band and, if a partner may be larger
than the band, in that of the next.

*Signatures.*  A partition's signature is the hash of all the set's shingles in
it.  At most d = (a + b) // 7 partitions of two linked sets differ, so with all
non-empty partitions of a set ordered by one order of signature values (most
shingles first, then by hash), the first ``d + 1`` of each set have a signature
in common.  A set with too few non-empty partitions emits all of them and tries
again with twice the partitions; two such sets meet there.

*Candidates.*  Rows (signature, class) are shuffled by signature, where a class
is a distinct shingle set; only buckets with several classes go on.  In small
buckets all pairs are candidates; a bucket of more than ``HOT`` classes is cut
into blocks, and a row stays only if some partner passes the sketch test below.

*Sketch test.*  A set's sketch has the parity of the number of shingles hashed to
each bit.  Sketches differ in no more bits than the sets differ in shingles, so
a pair whose sketches differ in more than (a + b) // 7 bits cannot link.  Plain
sketches have at least as many bits as the set shingles; those of classes that
pass are made again with ``FINE`` times the bits, which leaves few wrong pairs.

*Links.*  Surviving pairs are verified with the whole sets, and components found are
contracted before more is verified.  A class of small buckets is verified against one
partner first; a hot bucket has a leader, and a class is verified against the leader it
shares most buckets with.  Only pairs of different components go on, and of hot buckets
those rows that still have a partner by the fine sketches: each is verified against its
nearest partner of another component, as long as that finds links and ``ROUNDS`` times
at most, and what is still apart pair by pair.  No link between components is lost, and
a group of near copies is not expanded into all pairs.

Components come from rounds that move verified links to the smallest class around.
Every step's rows are in the shared checkpoint folder; the driver only sees
counts and one fixed-size bitmap.

Contract: null text, empty text and text without words have the empty set and
link with nothing; equal sets are one class, whatever the number of copies;
rows with one key are separate documents; a null key stays null and does not
count for a component's smallest key; an empty table stays empty.  Classes are
64-bit hashes of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_lineage_dealt
from .bitmap import bitmap_filter
from .codepoints import text_slices
from .shingles import GOLD, mix, shingle_sets
from .words import BLANKS

HOT = 40                   # classes from which a bucket is compared in blocks
BLOCK = 2048               # classes of a block
ROUNDS = 4                 # contractions of hot buckets before the rest is verified
FINE = 8                   # a fine sketch has this many times the bits of a plain one
SEEN = 100_000             # classes whose signatures a task remembers to have emitted
BITMAP = 1 << 18           # bits of the filter that fetches texts again
SLICE_CHARS = 1 << 18
TASK_ROWS = 1 << 13        # rows or pairs that a task takes at least, where there are as many
TASK_LINKS = 1 << 16       # the same for links, of two numbers each


def _bands() -> np.ndarray:
    out, low = [], 1
    while low < 1 << 50:
        out.append((low, max(low, low * 16 // 9)))
        low = out[-1][1] + 1
    return np.array(out, dtype=np.int64)


BANDS = _bands()


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS[:, 0], sizes, side="right") - 1


def partitions(bands: np.ndarray, variant: int) -> np.ndarray:
    """Partitions of the shingle domain in a band's scheme."""
    return ((2 * BANDS[bands, 1] // 7 + 1) * 5 // 4 + 3) << variant


def _scheme_signatures(x: np.ndarray, sizes: np.ndarray, scheme: np.ndarray, most: np.ndarray,
                       variant: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, owner) of sets laid end to end; ``most``: largest difference."""
    if not len(x):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    seed = (scheme.astype(np.uint64) * np.uint64(64) + np.uint64(variant)) * GOLD
    cell = ((mix(x, seed[owner]) >> np.uint64(24)).astype(np.int64) & 0xFFFFFFFF) % partitions(scheme, variant)[owner]
    place = owner.astype(np.uint64) << np.uint64(34) | cell.astype(np.uint64)
    order = np.argsort(place, kind="stable")
    place = place[order]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    total = np.add.reduceat(mix(x[order], 31), first)
    count = np.diff(np.concatenate([first, [len(place)]]))
    own = (place[first] >> np.uint64(34)).astype(np.int64)
    sig = mix(total + (place[first] & np.uint64(0x3FFFFFFFF)) * GOLD, seed[own] ^ np.uint64(77))
    order = np.lexsort((sig, -count, own))
    sig, own = sig[order], own[order]
    have = np.bincount(own, minlength=n)
    rank = np.arange(len(own)) - np.repeat(np.cumsum(have) - have, have)
    keep = rank <= most[own]
    sig, own = sig[keep], own[keep]
    short = np.flatnonzero(have <= most)
    if len(short):                                             # too few partitions hold a shingle: twice as many
        again = np.repeat(np.isin(np.arange(n), short), sizes)
        s2, o2 = _scheme_signatures(x[again], sizes[short], scheme[short], most[short], variant + 1)
        sig, own = np.concatenate([sig, s2]), np.concatenate([own, short[o2]])
    return sig, own


def signatures(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, index of the set) of non-empty sets laid end to end."""
    band = band_of(sizes)
    partner = 4 * sizes // 3                                   # largest linked set
    top = BANDS[band, 1]
    sig, own = _scheme_signatures(x, sizes, band, (sizes + np.minimum(top, partner)) // 7)
    up = np.flatnonzero(partner > top)
    if len(up):
        s2, o2 = _scheme_signatures(x[np.repeat(partner > top, sizes)], sizes[up], band[up] + 1,
                                    (sizes[up] + partner[up]) // 7)
        sig, own = np.concatenate([sig, s2]), np.concatenate([own, up[o2]])
    return sig, own


def class_ids(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit id of every set (0 for the empty one)."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    has = sizes > 0
    if has.any():
        first = (np.cumsum(sizes) - sizes)[has]
        out[has] = mix(np.add.reduceat(mix(x, 57), first) + sizes[has].astype(np.uint64) * GOLD, 3)
    return out.view(np.int64)


def sketch_bits(sizes: np.ndarray) -> np.ndarray:
    return np.int64(1) << np.maximum(7, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))


def sketches(x: np.ndarray, sizes: np.ndarray, factor: int = 1) -> list[bytes]:
    """Parity bits of every set: a power of two of bits, at least ``factor`` times its size."""
    bits = sketch_bits(sizes) * factor
    base = np.cumsum(bits) - bits
    spot = np.repeat(base, sizes) + (mix(x, 91) & (np.repeat(bits, sizes) - 1).astype(np.uint64)).astype(np.int64)
    parity = (np.bincount(spot, minlength=int(bits.sum())) & 1).astype(np.uint8)
    packed = np.packbits(parity, bitorder="little").tobytes()
    return [packed[a // 8:(a + b) // 8] for a, b in zip(base.tolist(), bits.tolist())]


def _fold(words: np.ndarray, width: int) -> np.ndarray:
    """A sketch of fewer bits: the parity of the bits that fall together."""
    return np.bitwise_xor.reduce(words.reshape(-1, width), axis=0)


def sketch_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
    width = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, width) ^ _fold(y, width)).sum())


# -- scans of the texts -------------------------------------------------------
def doc_classes(df: DataFrame, key_col: str, text_col: str, with_body: bool = False) -> DataFrame:
    """(doc, n_shingles, cls, sketch) of every row; ``with_body``: its text hash too."""
    kept = ["doc", "body"] if with_body else ["doc"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, "t", SLICE_CHARS):
                x, sizes = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(start, len(texts)) for i in range(len(kept))], pa.array(sizes, pa.int64()),
                     pa.array(class_ids(x, sizes), pa.int64()), pa.array(sketches(x, sizes), pa.binary())],
                    names=[*kept, "n_shingles", "cls", "sketch"])

    made = {"doc": F.col(key_col).cast("long"), "body": F.xxhash64(text_col)}
    return df.select(*[made[c].alias(c) for c in kept], F.col(text_col).alias("t")).mapInArrow(
        work, ", ".join(f"{c} long" for c in kept) + ", n_shingles long, cls long, sketch binary")


def signature_rows(df: DataFrame, text_col: str) -> DataFrame:
    """(sig, cls): the signatures of every class, once per task and class."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in text_slices(batch, "t", SLICE_CHARS):
                x, sizes = shingle_sets(texts)
                cls = class_ids(x, sizes)
                if len(seen) > SEEN:
                    seen.clear()
                new = np.zeros(len(cls), dtype=bool)
                for i, (c, n) in enumerate(zip(cls.tolist(), sizes.tolist())):
                    if n and c not in seen:
                        seen.add(c)
                        new[i] = True
                sig, own = signatures(x[np.repeat(new, sizes)], sizes[new])
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64), pa.int64()),
                                                  pa.array(cls[new][own], pa.int64())], names=["sig", "cls"])

    return df.select(F.col(text_col).alias("t")).mapInArrow(work, "sig long, cls long")


def fetch_sets(df: DataFrame, key_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(cls, n, shingles, sketch) of the wanted (cls, doc), with fine sketches: texts
    are read again, but only rows whose key falls on a bit of a bitmap of fixed size."""
    may_be = bitmap_filter(wanted, "doc", BITMAP)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch, "t", SLICE_CHARS):
                x, sizes = shingle_sets(texts)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(class_ids(x, sizes), pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array([x[e - n:e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())], pa.binary()),
                     pa.array(sketches(x, sizes, FINE), pa.binary())], names=["cls", "n", "shingles", "sketch"])

    rows = df.select(F.col(key_col).cast("long").alias("doc"), F.col(text_col).alias("t"))
    found = rows.where(may_be(F.col("doc"))).select("t").mapInArrow(work, "cls long, n long, shingles binary, sketch binary")
    return found.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def kept(df: DataFrame) -> DataFrame:
    return cut_lineage_dealt(df, TASK_ROWS)


def with_both(pairs: DataFrame, table: DataFrame, *cols: str) -> DataFrame:
    """Distinct pairs (a, b) with the columns of both classes, as ``<col>_a`` and ``<col>_b``."""
    one, two = (table.select(F.col("cls").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cols]) for s in "ab")
    pairs = kept(pairs)
    if pairs.rdd.getNumPartitions() > 1:
        return pairs.join(one, "a").join(two, "b")
    few = F.broadcast(pairs)                                   # TASK_ROWS pairs at most go to the classes
    sides = one.join(few, "a").unionByName(two.join(few, "b"), allowMissingColumns=True)
    found = [f"{c}_{s}" for s in "ab" for c in cols]
    met = cut_lineage_dealt(sides, 2 * TASK_ROWS).groupBy("a", "b").agg(*[F.first(c, ignorenulls=True).alias(c) for c in found])
    return met.dropna(subset=found)


# -- candidates ---------------------------------------------------------------
def bucket_rows(sig_rows: DataFrame) -> DataFrame:
    """(sig, cls, c): members of the buckets with c > 1 classes, streamed in order."""
    w = Window.partitionBy("sig").orderBy("cls")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = sig_rows.withColumn("leader", F.first("cls").over(so_far)).withColumn("prev", F.lag("cls").over(w))
    others = kept(marked.where((F.col("cls") != F.col("leader")) & (F.col("cls") != F.col("prev")))
                         .select("sig", "leader", "cls"))
    counts = others.groupBy("sig", "leader").agg((F.count(F.lit(1)) + 1).alias("c"))
    members = others.select("sig", "cls").unionByName(counts.select("sig", F.col("leader").alias("cls")))
    return kept(members.join(counts.select("sig", "c"), "sig"))


def star_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a < b): a bucket's leader is the class that meets most others, and
    every class pairs with the leader that it shares most buckets with."""
    known = rows.withColumn("_w", F.sum("c").over(Window.partitionBy("cls")))
    led = known.withColumn("lead", F.max(F.struct("_w", "cls")).over(Window.partitionBy("sig"))["cls"])
    shared = led.where("cls != lead").groupBy("cls", "lead").agg(F.count(F.lit(1)).alias("k"))
    best = shared.groupBy("cls").agg(F.max(F.struct("k", "lead")).alias("m"))
    return best.select(F.least("cls", "m.lead").alias("a"), F.greatest("cls", "m.lead").alias("b")).distinct()


def open_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, cls, c, label): members of the buckets that hold several components."""
    known = rows.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    w = Window.partitionBy("sig")
    marked = known.withColumns({"_lo": F.min("label").over(w), "_hi": F.max("label").over(w)})
    return marked.where("_lo < _hi").select("sig", "cls", "c", "label")


def open_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components."""
    one = labels.select(F.col("cls").alias("a"), F.col("label").alias("la"))
    two = labels.select(F.col("cls").alias("b"), F.col("label").alias("lb"))
    met = pairs.join(one, "a", "left").join(two, "b", "left")
    return met.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def small_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of the classes of small buckets."""
    lists = rows.where(F.col("c") <= HOT).groupBy("sig").agg(F.sort_array(F.collect_list("cls")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(
        F.slice("m", i + 2, F.size("m")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return lists.select(F.explode_outer(pairs).alias("p")).select("p.a", "p.b").where("a is not null").distinct()


def sketch_test(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sketches do not rule a link out."""
    @F.pandas_udf("boolean")
    def passes(na: pd.Series, nb: pd.Series, sa: pd.Series, sb: pd.Series) -> pd.Series:
        return pd.Series([sketch_distance(s, t) <= (x + y) // 7 for x, y, s, t in zip(na, nb, sa, sb)], dtype=bool)

    met = with_both(pairs, classes.where("n > 0"), "n", "sketch")
    near = met.where((4 * F.col("n_a") >= 3 * F.col("n_b")) & (4 * F.col("n_b") >= 3 * F.col("n_a")))
    return near.where(passes("n_a", "n_b", "sketch_a", "sketch_b")).select("a", "b")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that link, by their whole sets."""
    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y):
            u, v = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
            common = len(np.intersect1d(u, v, assume_unique=True))
            out.append(100 * common >= 75 * (len(u) + len(v) - common))
        return pd.Series(out, dtype=bool)

    return with_both(pairs, sets, "shingles").where(linked("shingles_a", "shingles_b")).select("a", "b")


def _block_rows(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of hot buckets with their sketches, once for each pair of blocks
    they take part in (blocks are cut by hash, so none is larger than about BLOCK)."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int")
    # a class meets its sketch once, whatever the number of its buckets
    by_class = rows.groupBy("cls").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "cls"])).alias("_in"))
    met = by_class.join(classes.select("cls", "n", "sketch"), "cls").select("cls", "n", "sketch", F.inline("_in"))
    met = met.withColumn("nb", blocks).withColumn("own", own)
    return met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "sig", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "cls", "n", "sketch",
        *[c for c in rows.columns if c == "label"])


def _distances(pdf: pd.DataFrame, lo: int, hi: int, words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words[lo:hi, None, :] ^ words[None, :, :]).sum(axis=2, dtype=np.int64)


def _near_matrix(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distances, may link) in strips of a block pair's matrix."""
    n = pdf["n"].to_numpy(dtype=np.int64)
    width = min(len(s) for s in pdf["sketch"]) // 8
    words = np.stack([_fold(np.frombuffer(s, dtype="<u8"), width) for s in pdf["sketch"]])
    own, cls = pdf["own"].to_numpy(), pdf["cls"].to_numpy()
    across = pdf["b1"].iloc[0] != pdf["b2"].iloc[0]
    strip = max(1, (1 << 22) // max(1, len(n) * width))
    for lo in range(0, len(n), strip):
        hi = min(len(n), lo + strip)
        d = _distances(pdf, lo, hi, words)
        ok = d <= (n[lo:hi, None] + n[None, :]) // 7
        ok &= (4 * n[lo:hi, None] >= 3 * n[None, :]) & (4 * n[None, :] >= 3 * n[lo:hi, None])
        ok &= cls[lo:hi, None] != cls[None, :]
        if across:
            ok &= own[lo:hi, None] != own[None, :]
        if "label" in pdf:
            label = pdf["label"].to_numpy()
            ok &= label[lo:hi, None] != label[None, :]
        yield lo, d, ok


def hot_members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, cls, c) of the hot buckets' rows with a partner of another label that passes."""
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        some = np.zeros(len(pdf), dtype=bool)
        for lo, _, ok in _near_matrix(pdf):
            some[lo:lo + len(ok)] = ok.any(axis=1)
        return pdf.loc[some, ["sig", "cls"]]

    near = _block_rows(rows, classes).groupBy("sig", "b1", "b2").applyInPandas(pick, "sig long, cls long").distinct()
    counts = near.groupBy("sig").agg(F.count(F.lit(1)).alias("c"))
    return kept(near.join(counts, "sig"))


def hot_pairs(rows: DataFrame, classes: DataFrame, labels: DataFrame, nearest: bool) -> DataFrame:
    """Distinct passing pairs of different components in hot buckets: for every
    class its nearest partner only, or all of them."""
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        cls = pdf["cls"].to_numpy()
        a, b, dist = [], [], []
        for lo, d, ok in _near_matrix(pdf):
            if nearest:
                d = np.where(ok, d, np.iinfo(np.int64).max)
                at = d.argmin(axis=1)
                i = np.flatnonzero(ok.any(axis=1))
                j = at[i]
            else:
                i, j = np.nonzero(ok)
            a.append(cls[lo + i])
            b.append(cls[j])
            dist.append(d[i, j])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "d": np.concatenate(dist)})

    found = _block_rows(open_rows(rows, labels), classes).groupBy("sig", "b1", "b2").applyInPandas(pick, "a long, b long, d long")
    if nearest:
        found = found.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", "m.b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# -- components ---------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(cls, label): the smallest class reachable over edges (a, b), for every class but
    the smallest ones themselves.

    Every round hangs the larger neighbours of a class under its smallest neighbour, then
    joins the smaller neighbours of a class under the smallest of them.  An edge never
    moves up, so a round that moves none has reached stars around the smallest classes.
    """
    stars = cut_lineage_dealt(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), TASK_LINKS)
    w = Window.partitionBy("u")
    while True:
        ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        near = stars.select(ends.alias("e")).select("e.u", "e.v").withColumn("m", F.least("u", F.min("v").over(w)))
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("moved"))
        least = large.withColumn("m", F.min("v").over(w))
        small = least.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                             F.col("m").alias("v"), (F.col("moved") | (F.col("v") != F.col("m"))).alias("moved"))
        after = cut_lineage_dealt(small.groupBy("u", "v").agg(F.max("moved").alias("moved")), TASK_LINKS)
        stars = after.select("u", "v")
        if after.where("moved").isEmpty():
            return stars.select(F.col("u").alias("cls"), F.col("v").alias("label"))


def merged(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of the components over new links and the components known before."""
    return components(links.unionByName(labels.select(F.col("cls").alias("a"), F.col("label").alias("b"))))


def class_components(df: DataFrame, docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(cls, doc, label): every class of ``docs`` (the rows' classes) with its
    smallest key and the label of its component."""
    classes = kept(docs.where("n_shingles > 0").groupBy("cls").agg(
        F.min("doc").alias("doc"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    rows = bucket_rows(signature_rows(df, text_col))
    pairs = kept(sketch_test(small_pairs(rows), classes))
    hot = hot_members(rows.where(F.col("c") > HOT), classes)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(hot.select("cls")).distinct()
    sets = kept(fetch_sets(df, key_col, text_col, kept(classes.join(wanted, "cls").select("cls", "doc"))))
    # one partner of every class first, which leaves few pairs of different components
    pairs = kept(sketch_test(pairs, sets))
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    led = kept(sketch_test(star_pairs(hot), sets))
    labels = components(verify(first.unionByName(led).distinct(), sets))
    links = kept(verify(open_pairs(pairs, labels), sets))
    if not links.isEmpty():
        labels = merged(links, labels)
    if not hot.isEmpty():                                      # now by the fine sketches
        hot = hot_members(open_rows(hot, labels), sets)
    turn, nearest = 1, True
    while not hot.isEmpty():
        links = kept(verify(hot_pairs(hot, sets, labels, nearest), sets))
        found = not links.isEmpty()
        if found:
            labels = merged(links, labels)
        if not nearest:                                        # every pair that could link has been verified
            break
        turn, nearest = turn + 1, found and turn + 1 < ROUNDS
    return classes.select("cls", "doc").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def join_components(df: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``df``."""
    docs = cut_lineage(doc_classes(df, key_col, text_col))
    named = class_components(df, docs, key_col, text_col)
    smallest = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    by_class = named.join(smallest, "label").select("cls", "component_id")
    out = docs.drop("sketch").join(by_class, "cls", "left")
    return out.select(F.col("doc").alias(key_col), "n_shingles", F.coalesce("component_id", "doc").alias("component_id"))


def one_per_component(df: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the smallest key (a null key is the
    largest), then the smallest text hash.  Rows without words link with nothing
    and all stay.  Rows are chosen by (key, text hash), so rows of one key with
    unlike texts are told apart, and rows equal in both are copies."""
    wordless = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(BLANKS)) == ""
    docs = cut_lineage(doc_classes(df, key_col, text_col, with_body=True))
    named = class_components(df, docs, key_col, text_col)
    # A class's first row before the join: many copies of one text are one row by then.
    order = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "body")
    first = docs.where("n_shingles > 0").groupBy("cls").agg(F.min(order).alias("m"))
    chosen = first.join(named.select("cls", "label"), "cls").groupBy("label").agg(F.min("m").alias("m")).select(
        F.col("m.doc").alias("_pe_doc"), F.col("m.body").alias("_pe_body"))
    rows = df.where(~wordless)
    found = rows.join(chosen, F.col(key_col).cast("long").eqNullSafe(F.col("_pe_doc"))
                      & (F.xxhash64(text_col) == F.col("_pe_body")), "left_semi")
    copies = found.groupBy(F.col(key_col).alias("_pe_doc"), F.xxhash64(text_col).alias("_pe_body")).agg(
        F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias("_pe_row"))
    return copies.select(*[F.col("_pe_row")[c].alias(c) for c in df.columns]).unionByName(df.where(wordless))
