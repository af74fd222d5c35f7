import zlib

from corpuslab.llm import langid
from tests.conftest import SMALL

PARAMS = langid.LangParams(bits=14, per_class=200, epochs=8)


def test_held_out_accuracy_and_query(spark):
    from corpuslab.llm.queries import QUERIES
    got = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_edges(spark, make_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(docs, params=PARAMS)
    df = make_docs([(1, None), (2, ""), (3, "12 !! --"), (None, "the of and that with from"), (5, "der und die nicht " * 9000),
                    (5, "der und die nicht " * 9000)], extra=["score", "rejected"])
    rows = langid.predict(df, model).collect()
    by = {r["doc_id"]: r for r in rows}
    for k in (1, 2, 3):
        assert by[k]["lang_pred"] == "und" and by[k]["score"] == 0 and by[k]["rejected"]
    assert by[None]["lang_pred"] == "en" and by[5]["lang_pred"] == "de" and len(rows) == 6
    assert isinstance(by[5]["score"], float)


def test_score_does_not_depend_on_batches(spark):
    model = langid.train(spark.read.parquet(f"{SMALL}/documents.parquet"), params=PARAMS)
    texts = ["the thing and " * 50, "la de que " * 3, "x"]
    together = langid._score_texts(texts, model)[1].tolist()
    assert together == [langid._score_texts([t], model)[1][0] for t in texts]


def test_no_labels(spark, make_docs):
    df = make_docs([(1, "the of", None, "s", 6), (3, "and", None, "s", 3)])
    assert langid.train(df) is None
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(df, None).collect()} == {("und", 0.0)}


def test_the_sample_is_bounded_whatever_the_keys(spark, make_docs):
    """Null and equal keys are drawn row by row, and copies of one row count once."""
    words = ["the", "of", "and", "der", "und", "thing"]
    rows = [(None if i % 2 else 7, " ".join(words[(i >> k) % 6] + str(i) for k in range(8)), "en", "s", 0) for i in range(3000)]
    rows += [(None, "one text that is there very often", "en", "s", 0)] * 2000
    p = langid.LangParams(per_class=300)
    n = langid.training_sample(make_docs(rows), "doc_id", "text", "lang", p).num_rows
    assert 100 < n < 500


def test_empty_table(spark, make_docs):
    assert langid.train(make_docs([])) is None
