from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.operators import prep


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_stopword_list_fixed():
    assert len(tx.STOPWORDS_EN) == 179
    assert len(set(tx.STOPWORDS_EN)) == 179


def test_clean_tokens_pipeline(spark):
    got = _one(spark, prep.clean_tokens, "The 3 cats, and THE dogs!")
    assert got == ["cats", "dogs"]


def test_words_no_empties(spark):
    assert _one(spark, tx.words, "  a  b\tc\n") == ["a", "b", "c"]
    assert _one(spark, tx.words, "") == []


def test_basic_english(spark):
    got = _one(spark, tx.basic_english, 'He said "Hi." (ok)<br />fine; yes: no!')
    assert got == ["he", "said", "hi", ".", "(", "ok", ")", "fine", "yes", "no", "!"]


def test_tfidf_tokens_unicode(spark):
    assert _one(spark, tx.tfidf_tokens, "Été a b2 ok") == ["été", "b2", "ok"]


def test_word_tokens(spark):
    assert _one(spark, tx.word_tokens, "Hi, you!") == ["Hi", ",", "you", "!"]


def test_sentences_and_lead(spark):
    assert _one(spark, tx.sentences, " One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert _one(spark, tx.lead_sentence, "  First one. Second.") == "First one."
    assert _one(spark, tx.lead_sentence, "no terminator here") == "no terminator here"
    assert _one(spark, tx.lead_sentence, "v1.2 is out. Yes") == "v1.2 is out."


def test_one_hot_and_label_map(spark):
    df = spark.createDataFrame([(0,), (1,)], "label int")
    rows = df.select(prep.one_hot("label", 2).alias("o"), prep.map_label("label", {0: 0, 1: 1}).alias("m")).collect()
    assert [r["o"] for r in rows] == [[1, 0], [0, 1]]
    assert [r["m"] for r in rows] == [0, 1]


def test_predicate_split_covers_table(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, " ".join(["w"] * 40))], "doc_id long, text string")
    flagged = prep.partition_by_predicate(df, F.size(tx.words(F.col("text"))) > 30)
    got = {r["doc_id"]: r["is_long"] for r in flagged.collect()}
    assert got == {1: False, 2: False, 3: True}
