"""Queries for training-log metrics and classification reports
(A8-A12, W2-W5, L12, J5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6

from ..operators import metrics as me
from ..operators import prep
from ..sources.tables import read_table
from . import sqlfrag as q
from .registry import query

LOG_CTE = f"""
log AS (SELECT user_id AS run,
               CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) + 1 AS BIGINT) AS epoch,
               CASE WHEN {q.uniform(['event_id'])} < 0.2 THEN 'val' ELSE 'train' END AS split,
               event_id AS step, value AS loss,
               CAST(CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE 0 END AS BIGINT) AS correct,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS n
        FROM events)"""

EPOCH_CTE = LOG_CTE + """,
em AS (SELECT run, epoch, split, CAST(sum(n) AS BIGINT) AS rows, sum(correct) / nullif(sum(n), 0) AS accuracy,
              sum(loss) / nullif(sum(n), 0) AS loss_reported, sum(loss * n) / nullif(sum(n), 0) AS loss_mean
       FROM log GROUP BY run, epoch, split)"""


def _log(spark, sf):
    return me.log_from_events(read_table(spark, sf, "events"))


@query("epoch_metrics", ops="A8 N6", sql=f"""
WITH {EPOCH_CTE}
SELECT run, epoch, split, rows, round(1e-10 + accuracy, 6) AS accuracy, round(1e-10 + loss_reported, 6) AS loss_reported,
       round(1e-10 + loss_mean, 6) AS loss_mean FROM em""")
def epoch_metrics(spark, sf):
    m = me.epoch_metrics(_log(spark, sf))
    return m.select("run", "epoch", "split", "rows", *[r6(c, 6).alias(c) for c in
                                                        ["accuracy", "loss_reported", "loss_mean"]])


@query("training_curve", ops="A9", sql=f"""
WITH {EPOCH_CTE}
SELECT run, epoch,
       round(1e-10 + max(CASE WHEN split = 'train' THEN accuracy END), 6) AS accuracy_train,
       round(1e-10 + max(CASE WHEN split = 'train' THEN loss_reported END), 6) AS loss_train,
       round(1e-10 + max(CASE WHEN split = 'val' THEN accuracy END), 6) AS accuracy_valid,
       round(1e-10 + max(CASE WHEN split = 'val' THEN loss_reported END), 6) AS loss_valid
FROM em GROUP BY run, epoch""")
def training_curve(spark, sf):
    c = me.training_curve(_log(spark, sf))
    return c.select("run", "epoch", *[r6(x, 6).alias(x) for x in
                                      ["accuracy_train", "loss_train", "accuracy_valid", "loss_valid"]])


@query("running_metrics", ops="W2", sql=f"""
WITH {LOG_CTE},
r AS (SELECT run, epoch, split, step,
             sum(correct) OVER w AS cc, sum(n) OVER w AS cn, sum(loss) OVER w AS cl
      FROM log WINDOW w AS (PARTITION BY run, epoch, split ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT run, epoch, split, step, round(1e-10 + cc / nullif(cn, 0), 6) AS running_acc, round(1e-10 + cl / nullif(cn, 0), 6) AS running_loss FROM r""")
def running_metrics(spark, sf):
    r = me.running_metrics(_log(spark, sf))
    return r.select("run", "epoch", "split", "step", r6("running_acc", 6).alias("running_acc"),
                    r6("running_loss", 6).alias("running_loss"))


LOG_INTERVAL = 20


@query("interval_accuracy", ops="W3", sql=f"""
WITH {LOG_CTE},
r AS (SELECT run, split, correct, n, row_number() OVER (PARTITION BY run, split ORDER BY step) - 1 AS i FROM log),
iv AS (SELECT run, split, correct, n, i, CAST(greatest(ceil(i / {LOG_INTERVAL}), 1) AS BIGINT) AS interval FROM r),
g AS (SELECT run, split, interval, sum(correct) AS c, sum(n) AS nn, max(i) AS last FROM iv GROUP BY run, split, interval)
SELECT run, split, interval, round(1e-10 + c / nullif(nn, 0), 6) AS accuracy, interval * {LOG_INTERVAL} AS reported_at
FROM g WHERE last >= interval * {LOG_INTERVAL}""")
def interval_accuracy(spark, sf):
    r = me.interval_accuracy(_log(spark, sf), log_interval=LOG_INTERVAL)
    return r.select("run", "split", "interval", r6("accuracy", 6).alias("accuracy"),
                    F.col("reported_at").cast("long").alias("reported_at"))


@query("best_checkpoints", ops="W4", sql=f"""
WITH {EPOCH_CTE},
v AS (SELECT run, epoch, loss_reported AS val_loss FROM em WHERE split = 'val' AND loss_reported IS NOT NULL)
SELECT run, epoch, round(1e-10 + val_loss, 6) AS val_loss,
       coalesce(val_loss < min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS is_best
FROM v""")
def best_checkpoints(spark, sf):
    b = me.best_checkpoints(_log(spark, sf))
    return b.select("run", "epoch", r6("val_loss", 6).alias("val_loss"), "is_best")


@query("top_checkpoints", ops="W5", sql=f"""
WITH {EPOCH_CTE},
v AS (SELECT run, epoch, loss_reported AS val_loss,
             row_number() OVER (PARTITION BY run ORDER BY loss_reported, epoch) AS rk FROM em WHERE split = 'val' AND loss_reported IS NOT NULL)
SELECT run, epoch, round(1e-10 + val_loss, 6) AS val_loss FROM v WHERE rk = 1""")
def top_checkpoints(spark, sf):
    t = me.top_checkpoints(_log(spark, sf), k=1)
    return t.select("run", "epoch", r6("val_loss", 6).alias("val_loss"))


@query("recent_checkpoints", ops="W5", sql=f"""
WITH {EPOCH_CTE},
v AS (SELECT run, epoch, loss_reported AS val_loss,
             row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS rk FROM em WHERE split = 'val' AND loss_reported IS NOT NULL)
SELECT run, epoch, round(1e-10 + val_loss, 6) AS val_loss FROM v WHERE rk <= 3""")
def recent_checkpoints(spark, sf):
    t = me.top_checkpoints(_log(spark, sf), k=3, most_recent=True)
    return t.select("run", "epoch", r6("val_loss", 6).alias("val_loss"))


PRED_SQL = """(SELECT d.doc_id, d.text, l.quality AS label, 1 - l.toxic AS prediction
               FROM documents d JOIN labels l USING (doc_id))"""


def _pred(spark, sf):
    d = read_table(spark, sf, "documents")
    lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"),
                                                 (1 - F.col("toxic")).alias("prediction"))
    return prep.attach_predictions(d, lab)


@query("accuracy_f1", ops="A10 A11", sql=f"""
WITH p AS {PRED_SQL},
c AS (SELECT count(*) AS rows, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS hit,
             sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN label <> 1 AND prediction = 1 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN label = 1 AND prediction <> 1 THEN 1 ELSE 0 END) AS fn FROM p)
SELECT rows, round(1e-10 + hit / rows, 6) AS accuracy,
       round(1e-10 + CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision,
       round(1e-10 + CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall,
       round(1e-10 + CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c""")
def accuracy_f1(spark, sf):
    s = me.binary_scores(_pred(spark, sf))
    return s.select("rows", *[r6(c, 6).alias(c) for c in ["accuracy", "precision", "recall", "f1"]])


@query("classification_report", ops="A12", sql=f"""
WITH p AS {PRED_SQL},
conf AS (SELECT label AS y, prediction AS pr, count(*) AS c FROM p GROUP BY 1, 2),
cls AS (SELECT y AS cls FROM conf UNION SELECT pr FROM conf),
per AS (SELECT cls,
               CAST(coalesce((SELECT sum(c) FROM conf WHERE y = cls), 0) AS BIGINT) AS support,
               coalesce((SELECT sum(c) FROM conf WHERE pr = cls), 0) AS n_pred,
               coalesce((SELECT sum(c) FROM conf WHERE y = cls AND pr = cls), 0) AS tp FROM cls),
m AS (SELECT cls, support, tp, CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS precision,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m),
t AS (SELECT CAST(sum(support) AS BIGINT) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
             sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM f),
u AS (SELECT CAST(cls AS VARCHAR) AS class, precision, recall, f1, support FROM f
      UNION ALL SELECT 'accuracy', NULL, NULL, tp / n, n FROM t
      UNION ALL SELECT 'macro avg', mp, mr, mf, n FROM t
      UNION ALL SELECT 'weighted avg', wp / n, wr / n, wf / n, n FROM t)
SELECT class, round(1e-10 + precision, 6) AS precision, round(1e-10 + recall, 6) AS recall, round(1e-10 + f1, 6) AS f1, support FROM u""")
def classification_report(spark, sf):
    r = me.classification_report(_pred(spark, sf))
    return r.select("class", *[r6(c, 6).alias(c) for c in ["precision", "recall", "f1"]], "support")


@query("error_table", ops="L12 J5", sql=f"""
SELECT doc_id, text, prediction AS output, label, prediction <> label AS is_error FROM {PRED_SQL}""")
def error_table(spark, sf):
    return me.error_table(_pred(spark, sf))
