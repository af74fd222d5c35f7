import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from corpuslab.operators import forest as fo
from corpuslab.operators import models as md


def sparse(n=120, width=60, seed=0):
    """Rows of few entries, some of them below zero; the class follows two features."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, width)) < 0.12, np.round(rng.normal(1.0, 1.0, (n, width)), 1), 0.0)
    return x, ((x[:, 3] > 0.4) | (x[:, 7] > 1.0) | (rng.random(n) < 0.1)).astype(int)


def table(spark, x, y, dense=False):
    vec = Vectors.dense if dense else lambda r: Vectors.sparse(len(r), [(j, v) for j, v in enumerate(r.tolist()) if v])
    return spark.createDataFrame([(i, vec(r), int(c)) for i, (r, c) in enumerate(zip(x, y))], ["doc_id", "features", "label"])


def test_every_node_has_its_best_split(spark):
    """Each split is the best of all those of the features drawn, over the rows that reach the node; each leaf has none."""
    x, y = sparse()
    df = table(spark, x, y)
    f = fo.grow(df, num_trees=4, max_depth=6, max_bins=8)
    hashes = np.array([r["h"] for r in df.orderBy("doc_id").select(F.xxhash64("doc_id").alias("h")).collect()])
    trees = fo.named(42, np.arange(4))
    weight, share = fo.weights_of(hashes, trees), int(np.ceil(np.sqrt(60)) / 60 * 2**32)
    bounds = [fo.thresholds(*np.unique(x[:, j], return_counts=True), 8) for j in range(60)]

    def gain(w, go):
        c = [np.array([w[m & (y == k)].sum() for k in (0, 1)]) for m in (np.ones(len(y), bool), go, ~go)]
        n = [k.sum() for k in c]
        return -1.0 if not n[1] or not n[2] else fo.gini(c[0]) - n[1] / n[0] * fo.gini(c[1]) - n[2] / n[0] * fo.gini(c[2])

    splits = 0
    todo = [(t, int(f.roots[t]), np.ones(len(y), bool), 0) for t in range(4)]
    while todo:
        t, node, here, depth = todo.pop()
        w = weight[:, t] * here
        assert f.counts[node].tolist() == [w[y == 0].sum(), w[y == 1].sum()]
        drawn = fo.mixed(fo.mixed(np.arange(60, dtype=np.uint32)) ^ fo.named(42, [t], [node])) < np.uint32(share)
        best = max([gain(w, x[:, j] <= b) for j in np.flatnonzero(drawn) for b in bounds[j]], default=-1.0)
        if f.feature[node] < 0:
            assert depth == 6 or best <= 1e-12 or min(f.counts[node]) == 0
            continue
        go, splits = x[:, f.feature[node]] <= f.threshold[node], splits + 1
        assert drawn[f.feature[node]] and gain(w, go) == pytest.approx(best)
        todo += [(t, int(f.left[node]), here & go, depth + 1), (t, int(f.right[node]), here & ~go, depth + 1)]
    assert splits > 20


def test_forest_learns_and_does_not_depend_on_the_layout(spark, monkeypatch):
    x, y = sparse(300, 40, 1)
    df = table(spark, x, y)
    a = md.train_rf(df, num_trees=20, max_depth=12)
    p = {r["doc_id"]: r for r in md.score(a, df).collect()}
    assert np.mean([p[i]["prediction"] == c for i, c in enumerate(y)]) > 0.9 and all(0 <= r["p1"] <= 1 for r in p.values())
    monkeypatch.setattr(fo, "BLOCK_ENTRIES", 100)
    b = md.train_rf(table(spark, x, y, dense=True).repartition(5), num_trees=20, max_depth=12)
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("feature", "threshold", "left", "right", "counts"))


def test_bounds_of_many_values():
    """Quantiles of the counts where a feature has more values than bins."""
    at = fo.thresholds(np.arange(100.0), np.ones(100, int), 4)
    assert at.tolist() == [24.5, 49.5, 74.5]
    assert fo.thresholds(np.array([0.0, 2.0]), np.array([9, 1]), 4).tolist() == [1.0]


def test_a_wide_table_costs_its_entries(spark):
    """2,000 rows of 2,000,000 features would be 16 GB as dense bins."""
    df = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    stored = df.rdd.map(lambda r: (r["doc_id"], Vectors.sparse(2_000_000, {r["doc_id"] * 7 + 11: 1.0, 1_999_998 + r["label"]: 0.5}), r["label"]))
    f = fo.grow(stored.toDF(["doc_id", "features", "label"]), num_trees=3, max_depth=3)
    assert f.width == 2_000_000 and f.counts[:3].sum() > 5000
