"""op12: periodic runs of all documents, a tenth of which are made periodic first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import let
from . import periodic
from .registry import query, table
from .words import words

SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, 8 * length(doc_id::VARCHAR)), lambda i:
               CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1))::UBIGINT ELSE 0::UBIGINT END)),
             lambda c, b: xor(xor(c, b) >> 1, 3988292384::UBIGINT * (xor(c, b) & 1::UBIGINT))), 4294967295::UBIGINT)::BIGINT AS h
  FROM documents),
sized AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g FROM docs),
laid AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM sized),
planted AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
           list_transform(range(0, n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END + 1])
         ELSE w END AS w FROM laid),
grams AS (
  SELECT doc_id, i, list_reduce(w[i + 1:i + 16], lambda x, y: x || ' ' || y) AS gram
  FROM (SELECT doc_id, w, unnest(range(0, n - 15)) AS i FROM planted)),
often AS MATERIALIZED (SELECT doc_id, i, md5(concat(doc_id, ' ', gram)) AS gram FROM grams
  QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM often x JOIN often y ON x.gram = y.gram AND y.i > x.i),
lined AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS line FROM pairs),
stretches AS MATERIALIZED (
  SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 16 + q AS len FROM lined GROUP BY doc_id, q, line),
long AS MATERIALIZED (SELECT * FROM stretches WHERE len >= greatest(24, 3 * q)),
runs AS MATERIALIZED (
  SELECT * FROM long x WHERE NOT EXISTS (
    FROM long y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY
           (len::DOUBLE / q) DESC, s, q) = 1),
told AS (SELECT doc_id, count(*)::BIGINT AS n_runs, string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS txt
         FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
marked AS (SELECT DISTINCT doc_id FROM gone),
kept AS (
  SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS txt
  FROM (SELECT p.doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM planted p JOIN marked m ON m.doc_id = p.doc_id) k
  LEFT JOIN gone ON gone.doc_id = k.doc_id AND gone.i = k.i WHERE gone.i IS NULL GROUP BY k.doc_id)
SELECT p.doc_id, coalesce(t.n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.len::BIGINT AS length, b.q::BIGINT AS period,
       (1000 * b.len // b.q)::BIGINT AS exponent_milli, sha256(coalesce(t.txt, '')) AS runs_sha256,
       sha256(CASE WHEN t.n_runs IS NULL THEN array_to_string(w, ' ') ELSE coalesce(k.txt, '') END) AS collapsed_sha256
FROM planted p LEFT JOIN told t ON t.doc_id = p.doc_id LEFT JOIN best b ON b.doc_id = p.doc_id
LEFT JOIN kept k ON k.doc_id = p.doc_id
"""


def with_periods(key: Column, text: Column) -> Column:
    """The contract's text: every tenth document (by the checksum of its key) repeats
    a stretch of its words; a null key has no checksum and keeps its text."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def planted(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = F.lit(1) + F.call_function("div", n - a, F.lit(3) + g % 8)
        return let(F.struct(ws.alias("ws"), a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), F.size(x["ws"]) - 1),
            lambda i: F.get(x["ws"], F.when(i >= x["a"], x["a"] + (i - x["a"]) % x["p"]).otherwise(i).cast("int"))), " "))

    repeated = let(words(text), lambda ws: F.when(F.size(ws) > 0, planted(ws)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, repeated).otherwise(text)


def longest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first."""
    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    kind = "struct<start: bigint, length: bigint, period: bigint>"
    return F.aggregate(runs, F.lit(None).cast(kind), better)


@query("op12_periodic_runs", SQL)
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_periods(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.collapse_runs(docs).withColumn("best", longest(F.col("runs")))
    told = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.call_function("div", 1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
