"""End-to-end jobs: what a user starts, writing the CSV tables they end with."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import models as md
from ..operators.lemma import fit_lexicon
from ..operators import prep, split
from ..operators import rouge as rg
from ..operators import summarize as sm
from ..functions import text as tx
from ..functions.numeric import r6
from ..session import cut_lineage
from ..sources import files as fl
from ..sources.tables import read_table
from .q_io import _scratch
from .registry import query

PREDICTIONS = T.StructType([T.StructField("text", T.StringType()), T.StructField("output", T.IntegerType()),
                            T.StructField("label", T.IntegerType())])
SUMMARIES = T.StructType([T.StructField("Body", T.StringType()), T.StructField("Headline", T.StringType()),
                          T.StructField("Summary", T.StringType())])


def classify_to_csv(docs, labels, path: str, label_col: str = "quality", key: str = "doc_id", seed: int = 42) -> str:
    """stratified split -> lexicon of the training side -> clean -> TF-IDF + LR on the
    training side -> score the rest -> CSV (text, output, label)."""
    rows = cut_lineage(prep.labelled(docs, labels, label_col).select(key, "text", "label"))
    sides = split.stratified_split(rows.select(key, "label"), "label", 0.2, key, seed).select(key, "split")
    parts = cut_lineage(rows.join(sides, key))
    lexicon = fit_lexicon(parts.filter(F.col("split") == "train").select(prep.clean_tokens(F.col("text")).alias("toks")), "toks")
    clean = cut_lineage(prep.clean_text(parts, key, "text", lexicon=lexicon, out_col="clean", keep_cols=["label", "split"])
                        .withColumnRenamed("clean", "text"))
    model = md.fit_text_classifier(clean.filter(F.col("split") == "train"), key)
    scored = model.score(clean.filter(F.col("split") == "test"), [key])
    return fl.write_csv(scored.select("text", F.col("prediction").alias("output"), F.col("label").cast("int")), path)


def summaries_to_csv(pages, path: str, min_words: int = 30, seed: int = 42) -> tuple[str, object]:
    """articles -> long bodies -> length cutoff of the training side -> split ->
    extractive summaries of the test side -> CSV (Body, Headline, Summary) and ROUGE."""
    arts = cut_lineage(sm.articles(pages).filter(tx.word_count(F.col("body")) > min_words))
    parts = cut_lineage(split.fraction_split(arts, {"train": 0.8, "val": 0.1, "test": 0.1}, "page_id", seed))
    longest = sm.length_cutoffs(parts.filter(F.col("split") != "test"), ["headline"]).first()[0] or 1
    test = parts.filter(F.col("split") == "test")
    made = sm.extractive_summary(test, "page_id", "body", min_words=min(10, longest), max_words=longest)
    out = cut_lineage(test.join(made, "page_id").select("page_id", F.col("body").alias("Body"),
                                                       F.col("headline").alias("Headline"), F.col("summary").alias("Summary")))
    fl.write_csv(out.drop("page_id"), path)
    pairs = out.select("page_id", F.col("Summary").alias("prediction"), F.col("Headline").alias("reference"))
    return path, rg.rouge_corpus(rg.rouge_all(pairs, ["page_id"]))


@query("classify_job", ops="T6 R2 L1 L2 L6 S5", sql=None)
def classify_job(spark, sf):
    path = classify_to_csv(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"), _scratch(spark, "error-output"))
    return fl.read_csv(spark, path, PREDICTIONS)


@query("summarize_job", ops="T14 P4 A4 R3 L9 S5", sql=None)
def summarize_job(spark, sf):
    path, _ = summaries_to_csv(read_table(spark, sf, "pages"), _scratch(spark, "predictions"))
    return fl.read_csv(spark, path, SUMMARIES)


@query("summarize_job_scores", ops="E1-E4 A13", sql=None)
def summarize_job_scores(spark, sf):
    _, scores = summaries_to_csv(read_table(spark, sf, "pages"), _scratch(spark, "predictions"))
    return scores.select("pairs", *[r6(c).alias(c) for c in ["rouge1", "rouge2", "rougeL", "rougeLsum"]])
