"""op3: mixing the documents' sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from .registry import query, table

SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM totals),
laid AS (
  SELECT *, 2 * source_size AS cap,
         coalesce(sum(2 * source_size) OVER w, 0)::DOUBLE AS capped, coalesce(sum(weight) OVER w, 0)::DOUBLE AS gone,
         sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER ()::DOUBLE AS weights,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS k
  FROM weighted
  WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (
  SELECT (1.5::DOUBLE * total - capped) / (weights - gone) AS level FROM laid
  WHERE (1.5::DOUBLE * total - capped) / (weights - gone) * weight <= cap ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM chosen), 0) * weight::DOUBLE) AS target FROM laid),
keyed AS (
  SELECT *, length(bin(size)) AS bits, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS sub FROM sized),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY bits, size >> greatest(bits - 4, 0)::INT, sub,
                                doc_id NULLS FIRST))::DOUBLE AS r
  FROM keyed),
placed AS (
  SELECT x.doc_id, x.size, t.source_size, t.target, x.r,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
         ('0x' || substr(md5(coalesce(x.source, '') || '|11'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM ranked x JOIN targets t ON x.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(u + e * r) - floor(u + e * (r - 1)))::BIGINT AS taken FROM placed
"""


@query("op3_mix_sources", SQL)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sizes(table(spark, sf_dir, "documents"))
    return mixing.with_copies(sized, sized).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
