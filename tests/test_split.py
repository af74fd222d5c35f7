from pyspark.sql import functions as F

from corpuslab.operators import rank, split


def _docs(spark, n=500, parts=4):
    return spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).cast("int").alias("label")) \
        .repartition(parts)


def test_hash_rank_invariant_to_partitioning(spark):
    ranks = []
    for parts in (1, 4, 17):
        r = split.shuffle(_docs(spark, parts=parts), "doc_id", 42)
        ranks.append(sorted((x["doc_id"], x["rank"]) for x in r.collect()))
    assert ranks[0] == ranks[1] == ranks[2]
    assert sorted(x for _, x in ranks[0]) == list(range(1, 501))


def test_two_level_rank_equals_global_order(spark):
    df = _docs(spark, 300).withColumn("k", F.md5(F.col("doc_id").cast("string")))
    r = rank.hash_rank(df, "doc_id", 7, rank_col="r").collect()
    want = sorted(r, key=lambda x: (F and __import__("hashlib").md5(f"{x['doc_id']}|7".encode()).hexdigest(), x["doc_id"]))
    assert [x["r"] for x in want] == list(range(1, 301))


def test_stratified_split_exact_and_disjoint(spark):
    for parts in (1, 5):
        s = split.stratified_split(_docs(spark, 101, parts), "label", 0.2, "doc_id", 42)
        rows = s.collect()
        assert len(rows) == 101 and len({r["doc_id"] for r in rows}) == 101
        test = [r for r in rows if r["split"] == "test"]
        assert len(test) == 21  # ceil(0.2 * 101)
        pos = sum(1 for r in test if r["label"] == 1)
        assert pos in (3, 4)  # 15 positives * 21 / 101 = 3.1
        assert split.overlapping_keys(s, "doc_id").count() == 0


def test_stratified_small_imbalanced(spark):
    df = spark.createDataFrame([(i, 1 if i < 2 else 0) for i in range(7)], "doc_id long, label int")
    s = split.stratified_split(df, "label", 0.2, "doc_id", 42).collect()
    assert sum(r["split"] == "test" for r in s) == 2  # ceil(1.4)


def test_fraction_split_counts(spark):
    s = split.fraction_split(_docs(spark, 966), {"train": 0.8, "val": 0.1, "test": 0.1}, "doc_id", 42)
    c = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"train": 772, "val": 97, "test": 97}


def test_sample_exact_and_n(spark):
    assert split.sample_exact(_docs(spark, 55), 0.1, "doc_id", 1).count() == 6  # round-half-even(5.5)
    assert split.sample_n(_docs(spark, 55), 3, "doc_id", 1).count() == 3


def test_batches_and_offsets(spark):
    df = _docs(spark, 40).withColumn("n_tokens", (F.col("doc_id") % 5 + 1).cast("long"))
    b = rank.batch_offsets(rank.assign_batches(df, "doc_id", 16, 42), "n_tokens").collect()
    sizes = {}
    for r in b:
        sizes[r["batch_id"]] = sizes.get(r["batch_id"], 0) + 1
    assert sizes == {0: 16, 1: 16, 2: 8}
    first = [r for r in b if r["pos_in_batch"] == 0]
    assert all(r["offset"] == 0 for r in first)


def test_running_total_two_level(spark):
    df = spark.createDataFrame([("a", i, 1) for i in range(100)] + [("b", i, 2) for i in range(10)],
                               "run string, step long, v long")
    r = rank.running_total(df, ["v"], ["run"], "step").collect()
    got = {(x["run"], x["step"]): x["v_cum"] for x in r}
    assert got[("a", 99)] == 100 and got[("a", 0)] == 1 and got[("b", 9)] == 20
