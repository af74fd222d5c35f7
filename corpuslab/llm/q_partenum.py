"""op4: n-gram Jaccard join of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import partenum
from .registry import query, table


@query("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.join_components(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id")
