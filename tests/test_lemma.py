import tempfile

from corpuslab.operators import lemma
from corpuslab.operators.lemma import lemma_table

LEXICON = ["cat", "bus", "wolf", "box", "church", "dish", "man", "city", "glass", "news", "s",
           "dog", "fly", "ox"]
CASES = [
    ("cats", "cat"), ("buses", "bus"), ("wolves", "wolf"), ("boxes", "box"), ("churches", "church"),
    ("dishes", "dish"), ("men", "man"), ("cities", "city"), ("glasses", "glass"), ("news", "news"),
    ("dog", "dog"), ("unknowns", "unknowns"), ("flies", "fly"), ("oxen", "oxen"),
]


def test_noun_rules(spark):
    words = spark.createDataFrame([(w,) for w, _ in CASES], "word string")
    lex = spark.createDataFrame([(w,) for w in LEXICON], "word string")
    got = {r["word"]: r["lemma"] for r in lemma_table(words, lex).collect()}
    assert got == dict(CASES)


def test_exceptions_first(spark):
    words = spark.createDataFrame([("oxen",), ("geese",)], "word string")
    lex = spark.createDataFrame([("ox",), ("goose",)], "word string")
    exc = spark.createDataFrame([("oxen", "ox"), ("geese", "goose")], "word string, lemma string")
    got = {r["word"]: r["lemma"] for r in lemma_table(words, lex, exc).collect()}
    assert got == {"oxen": "ox", "geese": "goose"}


def lemmas(spark, texts, lexicon):
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "k long, t array<string>")
    return {r["k"]: r["lemmas"] for r in lemma.lemmatize(df, ["k"], "t", lexicon=lexicon).collect()}


def test_fitted_lexicon(spark):
    """Slips that occur twice do not take the s off frequent words, and a saved lexicon
    gives a text the same lemmas whatever else is cleaned."""
    corpus = [("news " * 30 + "less " * 30 + "bus " * 30 + "new new les les bu bu cat cats cats dog dogs",)] * 2
    fitted = lemma.fit_lexicon(spark.createDataFrame([(c[0].split(),) for c in corpus], "t array<string>"), "t")
    path = lemma.save_lexicon(fitted, tempfile.mkdtemp(prefix="corpuslab-lex-"))
    lexicon = lemma.load_lexicon(spark, path)
    text = "news less bus cats dogs unknowns"
    want = "news less bus cat dog unknowns".split()
    assert lemmas(spark, [text], lexicon)[0] == want
    assert lemmas(spark, ["unknown unknown bu bu new new", text, "les les"], lexicon)[1] == want
