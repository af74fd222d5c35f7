"""Queries for the math scalar functions over class-score arrays.

The ``embeddings`` table stands in for text vectors: a linear head over all 64
components gives the ten class scores, ``label`` (0-9) is the true class.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mathfn as mf
from ..functions.numeric import r6
from ..operators import rank
from ..sources.tables import read_table
from .registry import query

W = mf.rule_weights(2, 64)
B = [0.1, -0.1]
W10 = mf.rule_weights(10, 64)
B10 = [0.05 * k for k in range(10)]

_HEAD = ", ".join("list_inner_product(x, [" + ", ".join(repr(float(c)) for c in row) + f"]) + {b!r}" for row, b in zip(W10, B10))
SCORES_SQL = f"""
xs AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
s AS (SELECT vec_id, label, list_transform([{_HEAD}], lambda x: round(x, 9)) AS v FROM xs),
m AS (SELECT vec_id, label, v, list_max(v) AS mx FROM s),
z AS (SELECT vec_id, label, v, mx, list_sum(list_transform(v, lambda x: exp(x - mx))) AS z FROM m)"""


def _scores(spark, sf):
    e = read_table(spark, sf, "embeddings")
    logits = mf.linear_head(mf.as_double_array("embedding"), W10, B10)
    # rounded at 9 digits so that ties between classes do not hang on the order of a sum
    return e.select("vec_id", "label", F.transform(logits, lambda x: F.round(x, 9)).alias("v"))


@query("softmax_scores", ops="M1 M5", sql=f"""
WITH {SCORES_SQL}
SELECT vec_id, label, round(1e-10 + exp(v[label + 1] - mx) / z, 6) AS p_label,
       round(1e-10 + list_max(list_transform(v, lambda x: exp(x - mx) / z)), 6) AS p_max,
       round(1e-10 + (v[label + 1] - mx - ln(z)), 6) AS logp_label,
       round(100 * round(1e-10 + exp(v[label + 1] - mx) / z, 6), 4) AS pct_label FROM z""")
def softmax_scores(spark, sf):
    s = _scores(spark, sf)
    sm = mf.softmax(F.col("v"))
    p = F.element_at(sm, F.col("label") + 1)
    return s.select("vec_id", "label", r6(p).alias("p_label"), r6(F.array_max(sm)).alias("p_max"),
                    r6(F.element_at(mf.log_softmax(F.col("v")), F.col("label") + 1)).alias("logp_label"),
                    mf.scaled(r6(p), 100.0, 4).alias("pct_label"))


@query("argmax_class", ops="R10", sql=f"""
WITH {SCORES_SQL}
SELECT vec_id, label, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS pred,
       list_position(v, list_max(v)) - 1 = label AS correct FROM s""".replace("FROM s\"\"\"", "FROM s"))
def argmax_class(spark, sf):
    s = _scores(spark, sf)
    pred = mf.argmax(F.col("v"))
    return s.select("vec_id", "label", pred.alias("pred"), (pred == F.col("label")).alias("correct"))


@query("losses", ops="M3 M4 W6", sql=f"""
WITH {SCORES_SQL},
b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 32) AS BIGINT) AS batch_id FROM z)
SELECT batch_id, count(*) AS rows, round(1e-10 + avg(-(v[label + 1] - mx - ln(z))), 6) AS ce_loss,
       round(1e-10 + avg(-(v[label + 1] - mx - ln(z))), 6) AS kl_loss,
       round(1e-10 + avg(CASE WHEN list_position(v, list_max(v)) - 1 = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM b GROUP BY batch_id""")
def losses(spark, sf):
    s = rank.assign_batches(_scores(spark, sf), "vec_id", 32, seed=None)
    ls = mf.log_softmax(F.col("v"))
    return s.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("rows"),
        r6(F.avg(mf.cross_entropy(F.col("v"), F.col("label")))).alias("ce_loss"),
        r6(F.avg(mf.kl_loss(ls, F.col("label")))).alias("kl_loss"),
        r6(F.avg((mf.argmax(F.col("v")) == F.col("label")).cast("double"))).alias("accuracy"))


def _wlist(row) -> str:
    return "[" + ", ".join(repr(float(x)) for x in row) + "]"


@query("linear_head", ops="M7 R10", sql=f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
l AS (SELECT vec_id, list_inner_product(x, {_wlist(W[0])}) + {B[0]!r} AS l0,
             list_inner_product(x, {_wlist(W[1])}) + {B[1]!r} AS l1 FROM e)
SELECT vec_id, round(1e-10 + l0, 6) AS logit0, round(1e-10 + l1, 6) AS logit1,
       CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS pred FROM l""")
def linear_head(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", mf.as_double_array("embedding").alias("x"))
    lg = e.select("vec_id", mf.linear_head(F.col("x"), W, B).alias("l"))
    return lg.select("vec_id", r6(F.col("l")[0]).alias("logit0"), r6(F.col("l")[1]).alias("logit1"),
                     mf.argmax(F.col("l")).alias("pred"))


def _erf_sql(x: str) -> str:
    z = f"abs({x})"
    t = f"(1.0 / (1.0 + {mf.ERF_P!r} * {z}))"
    poly = "0.0"
    for a in reversed(mf.ERF_A):
        poly = f"(({poly} + {a!r}) * {t})"
    y = f"(1.0 - {poly} * exp(-({z} * {z})))"
    return f"(CASE WHEN {x} < 0 THEN -{y} ELSE {y} END)"


@query("gelu_scores", ops="M2", sql=f"""
SELECT vec_id, round(1e-10 + list_sum(list_transform(embedding, lambda x: 0.5 * CAST(x AS DOUBLE) *
       (1.0 + {_erf_sql('(CAST(x AS DOUBLE) / sqrt(2.0))')}))), 6) AS gelu_sum FROM embeddings""")
def gelu_scores(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", mf.as_double_array("embedding").alias("x"))
    g = F.aggregate(F.transform("x", lambda v: mf.gelu(v)), F.lit(0.0), lambda a, y: a + y)
    return e.select("vec_id", r6(g).alias("gelu_sum"))
