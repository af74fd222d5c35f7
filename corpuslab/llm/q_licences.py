"""op11: license scan of all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences
from .registry import query, table


def _labels(*arrays: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")


@query("op11_license_scan")
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts, base = F.col("places.start"), F.col("places.label")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), _labels(base).alias("base_labels"),
        _labels(base, F.col("found.label")).alias("labels"), "score")
