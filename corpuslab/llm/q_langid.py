"""op1: language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid
from .registry import query, table


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and calibrated score; ``rejected`` is the calibrated rule."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs)
    scored = langid.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", langid.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                         "rejected")
