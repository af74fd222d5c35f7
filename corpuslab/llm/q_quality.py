"""op9: quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality
from .registry import query, table

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))

SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM base WHERE len(w) >= 3)),
covered AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n >= 2) GROUP BY doc_id),
counted AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words,
         (length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')))::BIGINT AS n_upper
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id),
failed AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND word_chars::DOUBLE / n_words BETWEEN 2 AND 15 AND n_symbols::DOUBLE / n_words <= 0.3::DOUBLE
        AND n_upper::DOUBLE / word_chars <= 0.5::DOUBLE AND n_stop_words::DOUBLE / n_words >= 0.01::DOUBLE
        AND n_dup_lines::DOUBLE / n_lines <= 0.5::DOUBLE AND n_words::DOUBLE / n_lines >= 1.5::DOUBLE) AS kept
FROM failed
"""


@query("op9_quality_rules", SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "kept")
