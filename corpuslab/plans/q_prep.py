"""Queries over labels, projections and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import prep, split
from ..operators.lemma import fit_lexicon, lemma_table
from ..sources.tables import read_table
from ..sources.profile import profile
from . import sqlfrag as q
from .registry import query

LABELLED_SQL = "(SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"


def _labelled(spark, sf):
    return prep.labelled(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


@query("class_balance", ops="A1 J7", sql=f"""
SELECT label, count(*) AS n FROM {LABELLED_SQL} GROUP BY label""")
def class_balance(spark, sf):
    return _labelled(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("num_classes", ops="A2", sql=f"""
SELECT count(DISTINCT label) AS num_classes FROM {LABELLED_SQL}""")
def num_classes(spark, sf):
    return _labelled(spark, sf).agg(F.countDistinct("label").alias("num_classes"))


@query("profile_documents", ops="S8", sql="""
SELECT * FROM (VALUES ('doc_id','bigint'),('text','string'),('lang','string'),('source','string'),('n_chars','bigint')) v(column_name, dtype)
JOIN (SELECT count(*) AS rows, count(doc_id) AS nn_doc_id, count(text) AS nn_text, count(lang) AS nn_lang,
             count(source) AS nn_source, count(n_chars) AS nn_n_chars FROM documents) c ON TRUE
""".replace("SELECT * FROM", "SELECT column_name, dtype, CASE column_name WHEN 'doc_id' THEN nn_doc_id WHEN 'text' THEN nn_text WHEN 'lang' THEN nn_lang WHEN 'source' THEN nn_source ELSE nn_n_chars END AS non_null, rows FROM"))
def profile_documents(spark, sf):
    return profile(read_table(spark, sf, "documents"))


@query("to_text_label", ops="P1 P10 J7", sql=f"""
SELECT doc_id, CAST(text AS VARCHAR) AS text, label FROM {LABELLED_SQL}""")
def to_text_label(spark, sf):
    df = _labelled(spark, sf)
    return prep.to_text_label(df, text="text", label="label")


@query("one_hot_label", ops="P8 P9", sql=f"""
SELECT doc_id, label, CASE label WHEN 0 THEN 0 WHEN 1 THEN 1 END AS mapped,
       array_to_string([CAST(label = 0 AS INTEGER), CAST(label = 1 AS INTEGER)], ',') AS one_hot
FROM {LABELLED_SQL}""")
def one_hot_label(spark, sf):
    df = _labelled(spark, sf)
    return df.select("doc_id", "label", prep.map_label("label", {0: 0, 1: 1}).alias("mapped"),
                     F.array_join(prep.one_hot("label", 2), ",").alias("one_hot"))


@query("keep_label", ops="P3 P12", sql=f"""
SELECT doc_id, text FROM {LABELLED_SQL} WHERE label = 1""")
def keep_label(spark, sf):
    return prep.keep_label(_labelled(spark, sf), 1).select("doc_id", "text")


@query("clean_stopwords", ops="T1 T2 T3 T4 T5 J3", sql=f"""
SELECT doc_id, array_to_string({q.clean_tokens('text')}, ' ') AS clean FROM documents""")
def clean_stopwords(spark, sf):
    return prep.clean_text(read_table(spark, sf, "documents"), lemmas=False)


@query("clean_text", ops="T6 T8 J4", sql=f"""
WITH t AS (SELECT doc_id, {q.clean_tokens('text')} AS toks FROM documents),
{q.lemma_map_ctes('t', 'toks')},
mapped AS (SELECT ex.doc_id, string_agg(lemmap.lemma, ' ' ORDER BY ex.pos) AS clean
           FROM ex JOIN lemmap USING (word) GROUP BY ex.doc_id)
SELECT t.doc_id, coalesce(mapped.clean, '') AS clean FROM t LEFT JOIN mapped USING (doc_id)""")
def clean_text(spark, sf):
    return prep.clean_text(read_table(spark, sf, "documents"))


@query("lemmatize_words", ops="T8 J4", sql=f"""
WITH t AS (SELECT doc_id, {q.clean_tokens('text')} AS toks FROM documents),
{q.lemma_map_ctes('t', 'toks')}
SELECT word, lemma FROM lemmap""")
def lemmatize_words(spark, sf):
    docs = read_table(spark, sf, "documents")
    toks = docs.select(prep.clean_tokens(F.col("text")).alias("toks"))
    words = toks.select(F.explode_outer("toks").alias("word"))
    return lemma_table(words, fit_lexicon(toks, "toks"))


@query("clean_text_twice", ops="T7 T10 J3 T8", sql=f"""
WITH f AS (SELECT doc_id, array_to_string(list_filter({q.words('text')}, lambda t: NOT list_contains({q.SW}, t)), ' ') AS first FROM documents),
t AS (SELECT doc_id, regexp_extract_all(first, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]') AS toks FROM f),
{q.lemma_map_ctes('t', 'toks')},
mapped AS (SELECT ex.doc_id, string_agg(lemmap.lemma, ' ' ORDER BY ex.pos)
                  FILTER (WHERE NOT list_contains({q.SW}, lemmap.lemma)) AS clean
           FROM ex JOIN lemmap USING (word) GROUP BY ex.doc_id)
SELECT t.doc_id, coalesce(mapped.clean, '') AS clean FROM t LEFT JOIN mapped USING (doc_id)""")
def clean_text_twice(spark, sf):
    return prep.clean_text_twice(read_table(spark, sf, "documents"))


@query("basic_english_tokens", ops="T9 D6", sql=f"""
SELECT doc_id, array_to_string({q.basic_english('text')}, ' ') AS tokens, len({q.basic_english('text')}) AS n_tokens FROM documents""")
def basic_english_tokens(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", tx.basic_english(F.col("text")).alias("t"))
    return d.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n_tokens"))


@query("tfidf_tokens", ops="T11", sql=f"""
SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '{tx.TFIDF_TOKEN}'), ' ') AS tokens,
       len(regexp_extract_all(lower(text), '{tx.TFIDF_TOKEN}')) AS n_tokens FROM documents""")
def tfidf_tokens(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", tx.tfidf_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n_tokens"))


@query("word_tokens", ops="T10", sql=f"""
SELECT doc_id, len(regexp_extract_all(text, '{tx.WORD_OR_PUNCT}')) AS n_tokens,
       array_to_string(regexp_extract_all(text, '{tx.WORD_OR_PUNCT}'), ' ') AS tokens FROM documents""")
def word_tokens(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", tx.word_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("max_words", ops="A3", sql=f"""
SELECT max(len({q.clean_tokens('text')})) AS max_words FROM documents""")
def max_words(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.agg(F.max(F.size(prep.clean_tokens(F.col("text")))).cast("long").alias("max_words"))


@query("min_words_mask", ops="P4 P5 U2 T22", sql=f"""
SELECT doc_id, {q.word_count('text')} AS n_words, coalesce({q.word_count('text')} > 30, FALSE) AS is_long FROM documents""")
def min_words_mask(spark, sf):
    d = read_table(spark, sf, "documents").withColumn("n_words", tx.word_count(F.col("text")))
    return prep.partition_by_predicate(d, F.col("n_words") > 30).select("doc_id", "n_words", "is_long")


@query("union_corpora", ops="U1", sql="""
SELECT 'v1' AS corpus, doc_id, 'v1:' || doc_id AS uid FROM documents WHERE source IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9')
UNION ALL SELECT 'v2' AS corpus, doc_id, 'v2:' || doc_id AS uid FROM documents""")
def union_corpora(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    v1 = d.filter(F.col("source").isin([f"src{i}" for i in range(10)]))
    return split.concat_corpora({"v1": v1, "v2": d}, "doc_id").select("corpus", "doc_id", "uid")
