from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.operators import vocab as vb


def test_vocab_order_and_roundtrip(spark):
    docs = spark.createDataFrame([(1, "b a a c"), (2, "a b d"), (3, "")], "doc_id long, text string")
    t = docs.select("doc_id", tx.words(F.col("text")).alias("t"))
    voc = vb.build_vocab(t, "t", specials=("<pad>", "<unk>"))
    got = {r["word"]: r["idx"] for r in voc.collect()}
    assert got == {"<pad>": 0, "<unk>": 1, "a": 2, "b": 3, "c": 4, "d": 5}
    enc = vb.encode_ids(t, ["doc_id"], "t", voc, unk_idx=1)
    ids = {r["doc_id"]: r["ids"] for r in enc.collect()}
    assert ids == {1: [3, 2, 2, 4], 2: [2, 3, 5], 3: []}
    dec = {r["doc_id"]: r["decoded"] for r in vb.decode_ids(enc, ["doc_id"], "ids", voc).collect()}
    assert dec == {1: "b a a c", 2: "a b d", 3: ""}


def test_sequence_padding(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([1, 2, 3, 4, 5, 6],)], "ids array<long>")
    r = df.select(vb.encode_sequence("ids", 4).alias("s")).collect()
    assert r[0]["s"]["input_ids"] == [5, 6, 7, 0] and r[0]["s"]["attention_mask"] == [1, 1, 1, 0]
    assert r[1]["s"]["input_ids"] == [1, 2, 3, 4]
    m = df.select(vb.mask_labels(vb.encode_sequence("ids", 4)["input_ids"]).alias("m")).first()["m"]
    assert m == [5, 6, 7, -100]


def test_oov_vectors_deterministic(spark):
    df = spark.range(200).select(F.col("id").alias("idx"))
    a = df.select("idx", vb.oov_vector(F.col("idx"), 8).alias("v")).collect()
    b = df.repartition(5).select("idx", vb.oov_vector(F.col("idx"), 8).alias("v")).collect()
    assert sorted(a) == sorted(b)
    xs = [x for r in a for x in r["v"]]
    mean = sum(xs) / len(xs)
    sd = (sum((x - mean) ** 2 for x in xs) / len(xs)) ** 0.5
    assert abs(mean) < 0.1 and 0.5 < sd < 0.7


def test_lookups_of_any_length(spark):
    """Dictionaries: order, repeats, unknown words, empty and null rows, and no positions in an exchange."""
    from corpuslab.operators import wordmap
    n = 5000
    rows = [(1, [f"w{i % 700}" for i in range(n)]), (2, []), (3, None), (4, ["zz", "w1", "zz", "w1"]), (5, ["w3"] * 900)]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    table = spark.createDataFrame([(f"w{i}", i) for i in range(650)], "word string, idx long")
    out = wordmap.map_tokens(df, ["k"], "t", table, "word", "idx", "ids", default=-1)
    number = {f"w{i}": i for i in range(650)}
    assert {r["k"]: r["ids"] for r in out.collect()} == {k: [number.get(w, -1) for w in t or []] for k, t in rows}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan


def test_words_meet_their_table_by_blocks(spark, monkeypatch):
    """Blocks of a few tokens give what one block gives; words move once a block, not once a text."""
    from corpuslab.operators import features as fe
    from corpuslab.operators import wordmap
    rows = [(i % 50, [f"w{j % 7}" for j in range(i % 11)]) for i in range(60)] + [(None, ["w1", "zz", None]), (77, None)]
    df = spark.createDataFrame(rows, "k long, t array<string>").coalesce(2)
    table = spark.createDataFrame([(f"w{i}", i, 1.0 + i, [float(i), -float(i)]) for i in range(6)] + [("<unk>", 9, 1.0, [5.0, 5.0])],
                                  "term string, idx long, idf double, vec array<double>")

    def results():
        ids = wordmap.map_tokens(df, ["k"], "t", table, "term", "idx", "ids", default=-1)
        pooled = fe.pool_vectors(fe.word_vectors(df, "k", "t", table.withColumnRenamed("term", "word")), "k")
        most = fe.pool_vectors(fe.word_vectors(df, "k", "t", table.withColumnRenamed("term", "word"), "max"), "k", how="max")
        return [sorted(str([[round(x, 9) for x in v] if isinstance(v, list) and v and isinstance(v[0], float) else v for v in r]) for r in d.collect())
                for d in (ids, pooled, most, fe.tfidf_rows(df, ["k"], "t", table))]

    whole = results()
    monkeypatch.setattr(wordmap, "BLOCK_TOKENS", 16)
    assert results() == whole
    assert whole[0].count("[77, []]") == 1 and "[None, [1, -1, -1]]" in whole[0]
    assert "[None, 2, [3.0, 2.0]]" in whole[1] and "[None, 2, [5.0, 5.0]]" in whole[2]
    assert len(whole[1]) == len({k for k, t in rows if t})
    blocks = wordmap.token_blocks(df.where("t is not null"), "t").groupBy("_block").agg(F.sum(F.size("t")).alias("n")).collect()
    assert len(blocks) > 10 and max(r["n"] for r in blocks) <= 16 + 10  # the bound and one text


def test_words_with_several_vectors(spark):
    """A word that its table holds twice counts with each of its vectors."""
    from corpuslab.operators import features as fe
    df = spark.createDataFrame([(1, ["a", "a", "b", "zz"]), (2, ["b"])], "k long, t array<string>")
    table = spark.createDataFrame([("a", [1.0, 8.0]), ("a", [3.0, 2.0]), ("b", [6.0, 4.0]), ("<unk>", [2.0, 1.0])], "word string, vec array<double>")
    got = {how: {r["k"]: (r["n_tokens"], r["pooled"]) for r in fe.pool_vectors(fe.word_vectors(df, "k", "t", table, how), "k", how=how).collect()}
           for how in ("mean", "max")}
    assert got["mean"][2] == (1, [6.0, 4.0]) and got["mean"][1][0] == 6
    assert [round(x, 9) for x in got["mean"][1][1]] == [round(16 / 6, 9), round(25 / 6, 9)]
    assert got["max"] == {1: (6, [6.0, 8.0]), 2: (1, [6.0, 4.0])}


def test_longest_text_is_whole(spark, tmp_path):
    """The longest text sets the length of all sequences; nothing is cut."""
    from corpuslab.plans import load_all
    rows = [(i, "a b c") for i in range(300)] + [(300, " ".join(f"w{i}" for i in range(400)))]
    spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(str(tmp_path / "documents.parquet"))
    queries = load_all()[0]
    seq = queries["encode_sequence"](spark, str(tmp_path)).collect()
    assert {len(r["input_ids"].split(",")) for r in seq} == {400} and max(r["n_real"] for r in seq) == 400
    assert {len(r["labels"].split(",")) for r in queries["mask_labels"](spark, str(tmp_path)).collect()} == {400}
    assert {r["doc_id"]: r["decoded"] for r in queries["decode_ids"](spark, str(tmp_path)).collect()} == dict(rows)


def test_drawn_vectors_are_those_of_the_table(spark):
    """A vector drawn where it is used is the one that the embedding table holds; only stored vectors move."""
    from corpuslab.functions.hashing import normal_vector, normal_vectors
    from corpuslab.operators import features as fe
    keys = spark.createDataFrame([(k,) for k in (0, 1, 77, 10**12, -5)], "idx long")
    for dim in (64, 7):
        want = {r["idx"]: r["v"] for r in keys.select("idx", normal_vector(F.col("idx"), dim).alias("v")).collect()}
        assert all(abs(a - b) < 1e-12 for k, v in want.items() for a, b in zip(v, normal_vectors([k], dim)[0], strict=True))
    df = spark.createDataFrame([(1, ["a", "a", "b", "zz"]), (2, ["b", "c"]), (3, None), (4, ["zz"])], "k long, t array<string>")
    voc = vb.build_vocab(df.where("k < 3"), "t").where("word <> 'zz'")
    stored = spark.createDataFrame([(1, [1.0] * 8), (99, [2.0] * 8)], "vec_id long, embedding array<float>")
    for how in ("mean", "max"):
        a, b = ({r["k"]: r["pooled"] for r in fe.pool_vectors(fe.word_vectors(df, "k", "t", t, how, draw=d), "k", how=how).collect()}
                for t, d in ((vb.build_embedding_table(voc, stored, 8), None), (vb.stored_vectors(voc, stored), lambda k: vb.oov_vectors(k, 8))))
        assert a.keys() == b.keys() == {1, 2, 4} and all(abs(x - y) < 1e-12 for k in a for x, y in zip(a[k], b[k], strict=True))
    assert sum(r["vec"] is not None for r in vb.stored_vectors(voc, stored).collect()) == 1


def test_blocks_move_packed(spark, monkeypatch):
    """A block is materialised and moved as one compressed row, not as its tokens."""
    from corpuslab.operators import wordmap
    monkeypatch.setattr(wordmap, "BLOCK_TOKENS", 10_000)
    df = spark.range(300).select("id", F.array_repeat(F.lit("word"), 400).alias("t"))
    rows = wordmap.packed_blocks(df, "t").collect()
    assert len({r["_block"] for r in rows}) == len(rows) <= 20
    assert sum(len(r["_rows"]) for r in rows) < 300 * 400 * len("word ")          # less than the texts
    got = wordmap.map_tokens(df, ["id"], "t", spark.createDataFrame([("word", 7)], "w string, i long"), "w", "i", "ids", default=0)
    assert "_rows" in got._jdf.queryExecution().optimizedPlan().toString() and got.count() == 300


def test_only_the_columns_asked_for_are_kept(spark):
    from corpuslab.operators import models as md
    df = spark.createDataFrame([(1, "one two", 0), (2, "two three", 1)], "doc_id long, text string, label int")
    assert md.fit_tfidf(df).transform(df, columns=["doc_id", "label"]).columns == ["doc_id", "label", "features"]


def test_sequences_as_text(spark):
    """Joined text of the padded arrays, made without them."""
    df = spark.createDataFrame([([5, 0, 7],), ([],), ([1, 2, 3, 4, 9, 8],), ([3],)], "ids array<bigint>")
    join = lambda c: F.array_join(c.cast("array<string>"), ",")
    for n in (0, 1, 3, 5):
        a = vb.encode_sequence("ids", n)
        b = vb.encode_sequence("ids", n, text=True)
        labels = vb.encode_sequence(vb.mask_labels("ids"), n, pad=-100, text=True)["input_ids"]
        for r in df.select(join(a["input_ids"]), b["input_ids"], join(a["attention_mask"]), b["attention_mask"],
                           join(vb.mask_labels(a["input_ids"])), labels).collect():
            assert r[0] == r[1] and r[2] == r[3] and r[4] == r[5]
