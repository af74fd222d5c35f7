"""L3: a random forest over sparse vectors, grown level by level (all trees at once).

Rows are kept in blocks of binned entries; an entry in the bin of zero counts as absent, so
a row costs what it holds, whatever the number of features.  Features are binned as Spark ML
does it (midpoints of the distinct values, or quantiles of all rows where there are more than
``max_bins``).  A level is one job: rows move to the children, the entries of the features drawn
for their node are counted by (node, feature, bin, class) inside the block and met by node,
and the best split of each node, by Gini gain, reaches the driver.  The absent rows of a
feature are the node's total less those counted.  The driver holds the trees; a task holds one
block, or the counts of its share of the nodes.

A node draws a feature with probability sqrt(features) / features by a hash of (seed, tree, node,
feature); a row's Poisson(1) weight in a tree is a hash of (seed, tree, key).  Nothing depends on
the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

BLOCK_ENTRIES = 1 << 16
BLOCK_ROWS = 1 << 12
GROUP_ENTRIES = 1 << 21
STORED_EVERY = 6
# P(weight <= k) of a Poisson(1) draw, as 32-bit bounds.
POISSON = np.array([int(c * 2**32) for c in np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])], np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of 32-bit numbers."""
    with np.errstate(over="ignore"):
        x = x * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
    return x


def named(seed: int, *parts: np.ndarray) -> np.ndarray:
    """A 32-bit hash of several numbers."""
    out = mixed(np.asarray([seed & 0xFFFFFFFF], np.uint32))
    for p in parts:
        p = np.asarray(p).astype(np.int64).view(np.uint64)
        out = mixed(out ^ mixed((p & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
        out = mixed(out ^ (p >> np.uint64(32)).astype(np.uint32))
    return out


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, dtype=kind).tobytes()


def rows_of(indices: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries a row, feature, value) of vectors in their storage form, dense ones included."""
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    dense = np.repeat(indices.is_null().to_numpy(zero_copy_only=False), sizes)
    place[~dense] = indices.flatten().to_numpy()
    return sizes, place, values.flatten().to_numpy()


def thresholds(values: np.ndarray, counts: np.ndarray, max_bins: int) -> np.ndarray:
    """Where Spark ML splits a continuous feature of the given distinct values."""
    mid = (values[:-1] + values[1:]) / 2.0
    if len(mid) < max_bins:
        return mid
    cum = np.cumsum(counts).astype(np.float64)
    nearer, stride = cum[:-1] + cum[1:], cum[-1] / max_bins
    out, target, after = [], stride, 0
    while (i := max(after, int(np.searchsorted(nearer, 2 * target, side="right")))) < len(mid):
        out.append(mid[i])
        target, after = target + stride, i + 1
    return np.array(out)


def _laid(df: DataFrame, key: str, label: str, features: str) -> DataFrame:
    """One row a block: (block, n, hash, y, row, idx, val), materialised."""
    v = F.unwrap_udt(features)
    base = df.select(F.xxhash64(key).alias("h"), F.col(label).cast("int").alias("y"), v["indices"].alias("i"), v["values"].alias("v"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes, idx, val = rows_of(batch.column(2), batch.column(3))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            a = 0
            while a < len(sizes):
                b = min(max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK_ENTRIES, side="right")) - 1), a + BLOCK_ROWS, len(sizes))
                e = slice(ends[a], ends[b])
                own = np.repeat(np.arange(b - a), sizes[a:b])
                keep = val[e] != 0
                cells = [part + number, b - a, _bytes(batch.column(0).to_numpy()[a:b], "<i8"), _bytes(batch.column(1).to_numpy()[a:b], "<i4"),
                         _bytes(own[keep], "<i4"), _bytes(idx[e][keep], "<i4"), _bytes(val[e][keep], "<f8")]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], names=names)
                a, number = b, number + 1

    names = ["block", "n", "hash", "y", "row", "idx", "val"]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return cut_lineage(base.mapInArrow(blocks, "block long, n int, hash binary, y binary, row binary, idx binary, val binary"))


def _binned(laid: DataFrame, max_bins: int) -> tuple[DataFrame, DataFrame, int]:
    """Blocks with their entries' bins (block, n, hash, y, row, idx, bin, zero) by row and feature,
    the bounds of the bins (idx, bounds), and the number of tasks that the blocks give work to.
    Entries meet by feature and go back to their block."""
    spark = laid.sparkSession
    n_rows, n_entries, n_blocks = laid.agg(F.sum("n"), F.sum(F.octet_length("idx") / 4), F.count(F.lit(1))).first()
    n_parts = min(n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(n_parts, int(n_entries) // GROUP_ENTRIES + 1)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, row, idx, val in zip(*(c.to_pylist() for c in batch.columns)):
                row, idx, val = np.frombuffer(row, "<i4"), np.frombuffer(idx, "<i4"), np.frombuffer(val, "<f8")
                group = idx % groups
                order = np.argsort(group, kind="stable")
                edges = np.searchsorted(group[order], np.arange(groups + 1))
                some = [(g, order[a:b]) for g, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g for g, _ in some], pa.int32()), pa.array([block] * len(some), pa.int64()),
                     *(pa.array([x[o].tobytes() for _, o in some], pa.binary()) for x in (row, idx, val))], names=["g", "block", "row", "idx", "val"])

    def met(t: pa.Table) -> pa.Table:
        row, idx = (np.frombuffer(b"".join(t[c].to_pylist()), "<i4") for c in ("row", "idx"))
        val = np.frombuffer(b"".join(t["val"].to_pylist()), "<f8")
        lengths = np.array([len(b) // 4 for b in t["idx"].to_pylist()])
        order = np.lexsort((val, idx))
        i, v = idx[order], val[order]
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        bin_, zero = np.empty(len(i), np.uint8), np.empty(len(i), np.uint8)
        bounds = []
        for a, b in zip(first, [*first[1:], len(i)]):
            if b - a == 1 and n_rows > 1:                      # most words are in one text
                at = np.array([v[a] / 2.0])
            else:
                x, n = np.unique(v[a:b], return_counts=True)
                if b - a < n_rows:
                    p = int(np.searchsorted(x, 0.0))
                    x, n = np.insert(x, p, 0.0), np.insert(n, p, n_rows - (b - a))
                at = thresholds(x, n, max_bins)
            bin_[a:b] = np.searchsorted(at, v[a:b], side="left")
            zero[a:b] = np.searchsorted(at, 0.0, side="left")
            bounds.append(at.tolist())
        back, zeros = np.empty_like(bin_), np.empty_like(zero)
        back[order], zeros[order] = bin_, zero
        blocks, ends = t["block"].to_pylist(), np.cumsum(lengths)
        cut = [slice(b - n, b) for n, b in zip(lengths, ends)]
        cols = [pa.array([x[c].tobytes() for c in cut] + [None], pa.binary()) for x in (row, idx, back, zeros)]
        none = [None] * len(cut)
        return pa.Table.from_arrays([pa.array([*blocks, None], pa.int64()), *cols, pa.array([*none, i[first].tolist()], pa.list_(pa.int32())),
                                     pa.array([*none, bounds], pa.list_(pa.list_(pa.float64())))],
                                    names=["block", "row", "idx", "bin", "zero", "features", "bounds"])

    found = cut_lineage(laid.select("block", "row", "idx", "val").mapInArrow(dealt, "g int, block long, row binary, idx binary, val binary")
                        .groupBy("g").applyInArrow(met, "block long, row binary, idx binary, bin binary, zero binary, features array<int>, "
                                                        "bounds array<array<double>>"))
    bounds = found.where("block is null").select(F.explode(F.arrays_zip("features", "bounds")).alias("b")).select(
        F.col("b.features").alias("idx"), "b.bounds")

    def whole(head: pa.Table, parts: pa.Table) -> pa.Table:
        row, idx = (np.frombuffer(b"".join(parts[c].to_pylist()), "<i4") for c in ("row", "idx"))
        bin_, zero = (np.frombuffer(b"".join(parts[c].to_pylist()), np.uint8) for c in ("bin", "zero"))
        order = np.lexsort((idx, row))
        order = order[bin_[order] != zero[order]]
        return pa.Table.from_arrays([*(head[c] for c in ("block", "n", "hash", "y")),
                                     *(pa.array([x[order].tobytes()], pa.binary()) for x in (row, idx, bin_, zero))], names=schema.split())

    schema = "block n hash y row idx bin zero"
    parts = found.where("block is not null").select("block", "row", "idx", "bin", "zero").repartition(n_parts, "block")
    heads = laid.select("block", "n", "hash", "y").repartition(n_parts, "block")
    return cut_lineage(heads.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(
        whole, "block long, n int, hash binary, y binary, row binary, idx binary, bin binary, zero binary")), bounds, n_parts


class _Block:
    """A block's arrays; entries by row and feature."""

    def __init__(self, row, width: int):
        self.n, self.hash, self.y = row["n"], np.frombuffer(row["hash"], "<i8"), np.frombuffer(row["y"], "<i4")
        self.row, self.idx = np.frombuffer(row["row"], "<i4"), np.frombuffer(row["idx"], "<i4")
        self.bin, self.zero = np.frombuffer(row["bin"], np.uint8), np.frombuffer(row["zero"], np.uint8)
        self.spot = self.row.astype(np.int64) * width + self.idx


def weights_of(hashes: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """Rows x trees: Poisson(1) weights of rows with these hashes in trees with those."""
    return np.searchsorted(POISSON, mixed(named(0, hashes)[:, None] ^ trees[None, :]).ravel(), side="right").astype(np.int64).reshape(-1, len(trees))


def _moved(block: _Block, node: np.ndarray, level: dict, width: int) -> np.ndarray:
    """Rows x trees: the nodes of the next level, -1 where a row's leaf is reached."""
    out = np.full(node.shape, -1, np.int32)
    row, tree = np.nonzero(node >= 0)
    at = node[row, tree]
    split = level["feature"][at] >= 0
    row, tree, at = row[split], tree[split], at[split]
    want = row * np.int64(width) + level["feature"][at]
    spot = np.minimum(np.searchsorted(block.spot, want), max(len(block.spot) - 1, 0))
    there = block.spot[spot] == want if len(block.spot) else np.zeros(len(want), bool)
    of = level["zero"][at].astype(np.int64)
    of[there] = block.bin[spot[there]]
    out[row, tree] = np.where(of > level["bin"][at], level["right"][at], level["left"][at])
    return out


def _drawn(x: np.ndarray, share: int) -> np.ndarray:
    """Where a hash of ``x`` (changed in place) is below ``share``; its low bits are not needed."""
    with np.errstate(over="ignore"):
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
    return np.flatnonzero(x < np.uint32(share))


def _counted(block: _Block, node: np.ndarray, names: np.ndarray, trees: np.ndarray, share: int, width: int, bins: int, classes: int,
             parts: int) -> Iterator[tuple[int, tuple]]:
    """The block's counts by (node, feature, bin, class) of the features drawn, for each share of the nodes."""
    weight, sizes = weights_of(block.hash, trees), np.bincount(block.row, minlength=block.n)
    drawn = mixed(block.idx.astype(np.uint32))
    keys, zero, label, times = [], [], [], []
    for t in range(node.shape[1]):
        at = node[:, t]
        active = (at >= 0) & (weight[:, t] > 0)
        if not active.any():
            continue
        name = names[np.maximum(at, 0)]
        if active.mean() < 0.4:
            e = np.flatnonzero(np.repeat(active, sizes))
            where = e[_drawn(drawn[e] ^ np.repeat(name[active], sizes[active]), share)]
        else:
            where = _drawn(drawn ^ np.repeat(name, sizes), share)
            where = where[active[block.row[where]]]
        own = block.row[where]
        keys.append((at[own].astype(np.int64) * width + block.idx[where]) * bins + block.bin[where])
        zero.append(block.zero[where])
        label.append(block.y[own])
        times.append(weight[own, t])
    if not keys:
        return
    keys, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    label, times, zero = np.concatenate(label), np.concatenate(times), np.concatenate(zero)[first]
    counts = np.bincount(back * classes + label, weights=times, minlength=len(keys) * classes).astype(np.int64).reshape(-1, classes)
    small = counts.astype(np.uint16) if counts.size == 0 or counts.max() < 1 << 16 else counts
    part = keys // (width * bins) % parts
    for p in np.unique(part).tolist():
        o = part == p
        yield p, (keys[o].tobytes(), zero[o].tobytes(), small[o].tobytes(), small.dtype.str)


def gini(counts: np.ndarray) -> np.ndarray:
    n = np.maximum(counts.sum(axis=-1, keepdims=True), 1)
    return 1.0 - ((counts / n) ** 2).sum(axis=-1)


def best_splits(keys: np.ndarray, zero: np.ndarray, counts: np.ndarray, total: np.ndarray, width: int, bins: int) -> dict[str, np.ndarray]:
    """The best split of every node with one: (node, feature, bin, zero, left counts).  ``keys`` are
    (node, feature, bin) as one number, rows that repeat add up; ``total`` has every node's counts."""
    keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
    sums = np.zeros((len(keys), counts.shape[1]), np.int64)
    np.add.at(sums, back, counts)
    zero, pair = zero[first], keys // bins
    begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    absent = total[pair[begin] // width] - np.add.reduceat(sums, begin, axis=0)
    some = absent.sum(axis=1) > 0
    keys = np.concatenate([keys, (pair[begin] * bins + zero[begin])[some]])
    zero, sums = np.concatenate([zero, zero[begin][some]]), np.concatenate([sums, absent[some]])
    order = np.argsort(keys)
    keys, zero, sums = keys[order], zero[order], sums[order]
    pair = keys // bins
    begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    run = np.cumsum(sums, axis=0)
    left = run - np.repeat((run - sums)[begin], np.diff([*begin, len(pair)]), axis=0)
    node = pair // width
    right = total[node] - left
    n_left, n = left.sum(axis=1), total[node].sum(axis=1)
    gain = gini(total[node]) - n_left / n * gini(left) - (n - n_left) / n * gini(right)
    ok = np.flatnonzero((n_left > 0) & (n_left < n) & (gain > 0))
    ok = ok[np.lexsort((keys[ok], -gain[ok], node[ok]))]
    ok = ok[np.concatenate([[True], node[ok][1:] != node[ok][:-1]])] if len(ok) else ok
    return {"node": node[ok], "feature": (pair % width)[ok], "bin": (keys % bins)[ok], "zero": zero[ok], "left": left[ok]}


@dataclass
class Forest:
    """A fitted forest: one table of nodes for all trees, -1 where there is no child."""
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray
    width: int
    features: str

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` plus the probability (vector, the mean of the leaves' shares) and the prediction."""
        shares = self.counts / np.maximum(self.counts.sum(axis=1, keepdims=True), 1)
        held = df.sparkSession.sparkContext.broadcast((self.roots, self.feature, self.threshold, self.left, self.right, shares))
        width = self.width

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def voted(indices: pa.Array, values: pa.Array) -> pa.Array:
            roots, feature, threshold, left, right, share = held.value
            sizes, idx, val = rows_of(indices, values)
            spot = np.repeat(np.arange(len(sizes)), sizes) * np.int64(width) + idx
            order = np.argsort(spot, kind="stable")
            spot, val = spot[order], val[order]
            node = np.tile(roots, (len(sizes), 1))
            row, tree = np.nonzero(feature[node] >= 0)
            while len(row):
                at = node[row, tree]
                want = row * np.int64(width) + feature[at]
                x = np.zeros(len(row))
                if len(spot):
                    p = np.minimum(np.searchsorted(spot, want), len(spot) - 1)
                    x = np.where(spot[p] == want, val[p], 0.0)
                at = np.where(x <= threshold[at], left[at], right[at])
                node[row, tree] = at
                on = feature[at] >= 0
                row, tree = row[on], tree[on]
            p = np.zeros((len(sizes), share.shape[1]))
            for t in range(node.shape[1]):
                p += share[node[:, t]]
            return pa.array(list(p / max(node.shape[1], 1)), pa.list_(pa.float64()))

        v = F.unwrap_udt(self.features)
        out = df.withColumn("_p", voted(v["indices"], v["values"]))
        best = F.array_position("_p", F.array_max("_p")) - 1
        return out.withColumns({"probability": array_to_vector("_p"), "prediction": best.cast("double")}).drop("_p")


def grow(train: DataFrame, features: str = "features", label: str = "label", num_trees: int = 100, max_depth: int = 30,
         max_bins: int = 32, seed: int = 42, key: str = "doc_id") -> Forest:
    """A forest of ``num_trees`` trees of at most ``max_depth`` levels of splits."""
    spark = train.sparkSession
    laid = _laid(train, key, label, features)
    v = F.unwrap_udt(features)
    width, most = train.agg(F.max(F.coalesce(v["size"], F.size(v["values"]))), F.max(F.col(label).cast("int"))).first()
    if width is None:
        raise ValueError("no rows to train on")
    classes = max(2, most + 1)
    binned, bounds, parts = _binned(laid, max_bins)
    share = min(2**32 - 1, int(np.ceil(np.sqrt(width)) / width * 2**32))
    trees = named(seed, np.arange(num_trees))
    total = np.zeros((num_trees, classes), np.int64)
    for part in laid.select("hash", "y").rdd.map(lambda r: _totals(r, trees, classes)).toLocalIterator():
        total += part
    feature, cut, left, right = (np.full(num_trees, -1, np.int64) for _ in range(4))
    table = {"feature": [feature], "bin": [cut], "left": [left], "right": [right], "counts": [total]}
    size, ids, tree = num_trees, np.arange(num_trees), np.arange(num_trees)
    open_ = (total > 0).sum(axis=1) > 1
    first = np.where(open_, np.cumsum(open_) - 1, -1).astype(np.int32)
    state = binned.rdd.map(lambda r: (r.asDict(), np.tile(first, (r["n"], 1)).tobytes()))
    ids, tree, total = ids[open_], tree[open_], total[open_]
    moves, kept, sent_ = [], None, []                          # levels since ``state``; its stored form; all that was sent
    for _ in range(max_depth):
        if not len(ids):
            break
        sent = spark.sparkContext.broadcast((moves, named(seed, tree, ids), total))
        sent_.append(sent)

        def now(x, sent=sent):
            row, node = x
            node = np.frombuffer(node, np.int32).reshape(row["n"], num_trees)
            block = _Block(row, width)
            for level in sent.value[0]:
                node = _moved(block, node, level, width)
            return block, node

        def moved(x, now=now):
            return x[0], now(x)[1].tobytes()

        def counted(x, now=now, sent=sent):
            return _counted(*now(x), sent.value[1], trees, share, width, max_bins, classes, parts)

        def chosen(it, sent=sent):
            got = [x for _, x in it]
            if not got:
                return
            keys, zero = (np.concatenate([np.frombuffer(g[k], kind) for g in got]) for k, kind in ((0, np.int64), (1, np.uint8)))
            counts = np.concatenate([np.frombuffer(g[2], g[3]).astype(np.int64) for g in got]).reshape(-1, classes)
            yield best_splits(keys, zero, counts, sent.value[2], width, max_bins)

        found = state.flatMap(counted).partitionBy(parts).mapPartitions(chosen).collect()
        if len(moves) == STORED_EVERY:
            state, old = state.map(moved).persist(StorageLevel.DISK_ONLY), kept
            state.count()
            moves, kept = [], state
            if old is not None:
                old.unpersist()
        best = {k: np.concatenate([f[k] for f in found]) if found else np.zeros((0, classes) if k == "left" else 0, np.int64)
                for k in ("node", "feature", "bin", "zero", "left")}
        order = np.argsort(best["node"])                       # nodes are named alike however they were dealt out
        best = {k: x[order] for k, x in best.items()}
        n, at = len(ids), best["node"]
        children = np.stack([best["left"], total[at] - best["left"]], axis=1).reshape(-1, classes)
        child = size + np.arange(len(children))
        opened = (children > 0).sum(axis=1) > 1
        number = np.where(opened, np.cumsum(opened) - 1, -1)
        last = {"feature": np.full(n, -1, np.int64), "bin": np.zeros(n, np.int64), "zero": np.zeros(n, np.int64),
                "left": np.full(n, -1, np.int32), "right": np.full(n, -1, np.int32)}
        for k, x in (("feature", best["feature"]), ("bin", best["bin"]), ("zero", best["zero"]), ("left", number[::2]), ("right", number[1::2])):
            last[k][at] = x
        for k, x in (("feature", best["feature"]), ("bin", best["bin"]), ("left", child[::2]), ("right", child[1::2])):
            whole = np.concatenate(table[k])
            whole[ids[at]] = x
            table[k] = [whole, np.full(len(children), -1, np.int64)]
        table["counts"].append(children)
        size += len(children)
        tree = np.repeat(tree[at], 2)[opened]
        ids, total = child[opened], children[opened]
        moves = [*moves, last]
    if kept is not None:
        kept.unpersist()
    for sent in sent_:
        sent.destroy()
    feature, cut, left, right, counts = (np.concatenate(table[k]) for k in ("feature", "bin", "left", "right", "counts"))
    return Forest(np.arange(num_trees), feature, _values(bounds, feature, cut), left, right, counts, width, features)


def _totals(row, trees: np.ndarray, classes: int) -> np.ndarray:
    """Trees x classes: the weights of a block's rows."""
    weight, y = weights_of(np.frombuffer(row["hash"], "<i8"), trees), np.frombuffer(row["y"], "<i4")
    return np.stack([weight[y == c].sum(axis=0) for c in range(classes)], axis=1)


def _values(bounds: DataFrame, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The thresholds of the splits chosen, from the table of bounds."""
    out, at = np.zeros(len(feature)), np.flatnonzero(feature >= 0)
    if len(at):
        spark = bounds.sparkSession
        want = spark.createDataFrame(pd.DataFrame({"idx": feature[at].astype(np.int32), "cut": cut[at].astype(np.int32)}).drop_duplicates())
        got = want.join(bounds, "idx").select("idx", "cut", F.get("bounds", F.col("cut")).alias("x")).toPandas()
        named_ = dict(zip(zip(got["idx"], got["cut"]), got["x"]))
        out[at] = [named_[k] for k in zip(feature[at].tolist(), cut[at].tolist())]
    return out
