import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import partenum
from corpuslab.llm.queries import QUERIES
from corpuslab.llm.shingles import shingle_sets, word_hashes
from tests.conftest import SMALL

from . import brute


def near_copies(seed, groups, copies, words, edit):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(*words))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(0, int(edit * len(w))))):
                at = rng.randrange(len(w))
                w[at:at + 1] = rng.choice([[rng.choice(vocab)], [], [w[at], rng.choice(vocab)]])
            rows.append((len(rows) * 3 + g, " ".join(w)))
    rng.shuffle(rows)
    return rows


def check(spark, make_docs, rows):
    got = partenum.join_components(make_docs(rows)).collect()
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(brute.jaccard_components(rows), key=order)


def test_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op4_jaccard_join"](spark, SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(brute.jaccard_components(rows))


@pytest.mark.parametrize("words,edit", [((5, 40), 0.08), ((60, 300), 0.05)])
def test_near_copies(spark, make_docs, words, edit):
    check(spark, make_docs, near_copies(len(str(words)), 12, 8, words, edit))


def test_hot_group_and_shared_passage(spark, make_docs, monkeypatch):
    """Buckets above HOT: near copies around the limit, and unrelated texts that share a passage."""
    monkeypatch.setattr(partenum, "HOT", 4)
    monkeypatch.setattr(partenum, "BLOCK", 8)
    rows = near_copies(5, 1, 60, (120, 120), 0.045)
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(50))
    rows += [(10_000 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([10, 30, 150]))))
             for i in range(40)]
    check(spark, make_docs, rows)


def test_edges(spark, make_docs):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "a b c d e"),
            (8, "a b c d e"), (8, "a b c d e"), (9, "a  b\tc d e f"), (None, "one two"), (None, "lonely words here"),
            (11, "É b c d e f"), (12, "é b c d e f"), (13, "z " * 30_000), (14, "z " * 10_000)]
    got = partenum.join_components(make_docs(rows, extra=["cls", "sig", "label"])).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.jaccard_components(rows)))


def test_empty_table(spark, make_docs):
    assert partenum.join_components(make_docs([])).count() == 0


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(1)
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 13, 16, 20, 31, 57, 100, 333, 1000]:
        for _ in range(30):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            most = n // 4                                      # |a & b| / |a | b| >= 0.75 with b inside or around a
            drop = rng.integers(0, most + 1)
            add = min((4 * (n - drop) - 3 * n) // 3, most) if 4 * (n - drop) >= 3 * n else 0
            b = np.concatenate([a[drop:], rng.integers(0, 2**63, max(0, int(add)), dtype=np.uint64)])
            common, union = n - drop, n + max(0, int(add))
            if 100 * common < 75 * union:
                continue
            sa, sb = (set(partenum.signatures(np.sort(x), np.array([len(x)]))[0].tolist()) for x in (a, b))
            assert sa & sb, (n, drop, add)


def test_sketch_never_rules_a_link_out():
    rng = np.random.default_rng(2)
    for n in [1, 5, 40, 127, 129, 700]:
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        for drop in range(0, n // 4 + 1, max(1, n // 12)):
            b = a[drop:]
            sa, sb = partenum.sketches(np.concatenate([a, b]), np.array([n, n - drop]))
            assert partenum.sketch_distance(sa, sb) <= drop


def test_shingles_follow_the_words():
    texts = ["A b\tC d e f", "a B c D e F", "", "é x", "É x", "a b c d", "a b c d e", "x\x0by\x0cz w v u"]
    x, sizes = shingle_sets(texts)
    assert sizes.tolist() == [len(brute.shingles(t)) for t in texts]
    parts = np.split(x, np.cumsum(sizes)[:-1])
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert np.array_equal(parts[i], parts[j]) == (brute.shingles(texts[i]) == brute.shingles(texts[j]))
    assert word_hashes(["ab ba", "ba ab"])[0].tolist()[0] == word_hashes(["ab ba", "ba ab"])[0].tolist()[3]


def test_near_copies_are_not_verified_in_pairs(spark, make_docs, monkeypatch):
    """Components are contracted on the way: a group of near copies costs some pairs a class, not all."""
    verified = []

    def counted(pairs, sets, was=partenum.verify):
        verified.append(pairs.count())
        return was(pairs, sets)

    monkeypatch.setattr(partenum, "verify", counted)
    for hot in (40, 4):
        monkeypatch.setattr(partenum, "HOT", hot)
        verified.clear()
        check(spark, make_docs, near_copies(7, 1, 36, (120, 120), 0.01))
        assert sum(verified) <= 3 * 36


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    names = rng.sample(range(-10 ** 12, 10 ** 12), 60)
    edges = list(zip(names[:20], names[1:20])) + [(names[20], x) for x in names[21:35]] + [(names[35], names[35])]
    edges += [tuple(rng.sample(names[36:], 2)) for _ in range(16)]
    group = {x: {x} for x in names}
    for a, b in edges:
        both = group[a] | group[b]
        for x in both:
            group[x] = both
    got = partenum.components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, min(group[x])) for x in names if min(group[x]) != x)
    assert partenum.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_steps_over_few_rows_have_few_tasks(spark):
    """Partitions follow the rows, also where the session does not merge those of a shuffle."""
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)], "a long, b long")
        labels = partenum.components(edges)
        assert labels.rdd.getNumPartitions() == 1
        assert sorted(map(tuple, labels.collect())) == [(i, 1) for i in range(2, 21)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pairs_meet_both_classes_whatever_their_number(spark, monkeypatch):
    table = spark.createDataFrame([(i, i * 10) for i in range(1, 9)], "cls long, n long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 8), (5, 99)], "a long, b long")
    for rows in (8192, 1):
        monkeypatch.setattr(partenum, "TASK_ROWS", rows)
        got = partenum.with_both(pairs, table, "n").select("a", "b", "n_a", "n_b").collect()
        assert sorted(map(tuple, got)) == [(1, 2, 10, 20), (1, 3, 10, 30), (4, 8, 40, 80)]


def test_a_class_meets_its_sketch_once(spark):
    """The join with sketches grows with the classes, not with their buckets."""
    rows = spark.createDataFrame([(s, c, 3) for s in range(50) for c in (1, 2, 3)], "sig long, cls long, c long")
    classes = spark.createDataFrame([(c, 5, b"x") for c in (1, 2, 3)], "cls long, n long, sketch binary")
    out = partenum._block_rows(rows, classes)
    assert sorted(map(tuple, out.select("sig", "cls", "n", "b1", "b2").collect())) == [
        (s, c, 5, 0, 0) for s in range(50) for c in (1, 2, 3)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") < plan.index("collect_list")


def test_bitmap_lets_every_value_pass(spark):
    from corpuslab.llm.bitmap import bitmap_filter
    for n in (0, 3, 2000):                                     # no bit, some, every bit of every number
        values = spark.range(n).select(F.col("id").alias("k"))
        may_be = bitmap_filter(values, "k", 128)
        assert values.where(may_be(F.col("k"))).count() == n
    assert spark.range(5000).where(bitmap_filter(spark.range(2000), "id", 128)(F.col("id"))).count() == 5000
    assert spark.range(5000).where(bitmap_filter(spark.range(0), "id", 128)(F.col("id"))).count() == 0
