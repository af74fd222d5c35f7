import collections
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import models as md
from corpuslab.operators import split, summarize
from corpuslab.operators import udf as ud
from corpuslab.operators import vocab as vb
from corpuslab.plans import q_jobs
from corpuslab.sources import files as fl
from corpuslab.sources.tables import read_table

from .conftest import SMALL


def test_classify_job_beats_the_majority(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="corpuslab-job-"), "out")
    q_jobs.classify_to_csv(read_table(spark, "/root/testdata/sf0.1", "documents"),
                           read_table(spark, "/root/testdata/sf0.1", "labels"), path, label_col="toxic")
    rows = fl.read_csv(spark, path, q_jobs.PREDICTIONS).collect()
    majority = max(sum(r["label"] == k for r in rows) for k in (0, 1))
    assert len(rows) > 60 and sum(r["output"] == r["label"] for r in rows) >= majority


def test_summaries_job(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="corpuslab-job-"), "out")
    _, scores = q_jobs.summaries_to_csv(read_table(spark, SMALL, "pages"), path)
    rows = fl.read_csv(spark, path, q_jobs.SUMMARIES).collect()
    assert scores.first()["pairs"] == len(rows) > 0
    assert all(r["Summary"] and len(r["Summary"].split()) <= len(r["Body"].split()) for r in rows)


def test_extractive_summary_golden(spark):
    df = spark.createDataFrame([(1, "Cats eat fish. Cats sleep. Dogs bark loudly at night."), (2, ""), (3, None)], "k long, body string")
    got = {r["k"]: r["summary"] for r in summarize.extractive_summary(df, "k", min_words=1).collect()}
    assert got == {1: "Cats sleep.", 2: "", 3: ""}
    got = {r["k"]: r["summary"] for r in summarize.extractive_summary(df, "k", min_words=3, max_words=4).collect()}
    assert got[1] == "Cats eat fish. Cats"


def test_extractive_summary_moves_an_article_once(spark):
    """Rows of one key are one article and each of them gets its summary; rows without a key get the empty one."""
    rows = [(1, "One two two. Two three."), (1, "Two two two two."), (None, "Some words."), (2, "?! ... Last words. Last."), (3, "...")]
    out = summarize.extractive_summary(spark.createDataFrame(rows, "k long, body string"), "k", min_words=5)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan
    assert sorted((r["k"] or 0, r["summary"]) for r in out.collect()) == [
        (0, ""), (1, "One two two. Two two two two."), (1, "One two two. Two two two two."), (2, "Last words. Last."), (3, "")]


def test_extractive_summary_against_a_loop(spark):
    texts = [" ".join(f"w{(i * 7 + j * j) % 5} x{j % 3}{'.' if j % 4 == 3 else ''}" for j in range(3 + i % 11)) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, body string").coalesce(1)
    got = {r["k"]: r["summary"] for r in summarize.extractive_summary(df, "k", min_words=5).collect()}
    for i, t in enumerate(texts):
        sents = [x for x in re.split(r"(?<=[.!?])\s+", t.strip()) if x]
        cut = [re.findall("[a-z0-9]+", x.lower()) for x in sents]
        n = collections.Counter(w for c in cut for w in c)
        order = sorted((j for j in range(len(sents)) if cut[j]), key=lambda j: (-sum(n[w] for w in cut[j]) / len(cut[j]), j))
        taken, have = [], 0
        for j in order:
            if have >= 5:
                break
            taken.append(j)
            have += len(sents[j].split())
        assert got[i] == " ".join(sents[j] for j in sorted(taken)), i


def test_load_mode_needs_a_saved_model(spark):
    df = read_table(spark, SMALL, "documents").limit(3)
    with pytest.raises(ValueError):
        md.run(None, df, load=True)
    with pytest.raises(Exception):
        md.run(None, df, model_path=os.path.join(tempfile.mkdtemp(), "nothing"), load=True)


def test_no_term_is_dropped(spark):
    df = spark.createDataFrame([(0, " ".join(f"term{i}" for i in range(5000)), 0), (1, "other words", 1)], "doc_id int, text string, label int")
    feats = md.fit_tfidf(df)
    assert feats.size == feats.terms.count() == 5002
    rows = {r["doc_id"]: r["features"] for r in feats.transform(df).collect()}
    assert len(rows[0].indices) == 5000 and len(rows[1].indices) == 2 and rows[0].size == 5002


def test_metric_callback_partials(spark):
    import pandas as pd
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x")).repartition(5)
    out = ud.eval_with(df, lambda x: pd.DataFrame({"s": [x.sum()], "n": [len(x)]}), ["x"], ["s", "n"], F.col("s") / F.col("n"))
    assert out.first()["value"] == 499.5
    by = ud.eval_with(df, lambda x: pd.DataFrame({"s": [x.max()], "n": [1]}), ["x"], ["s", "n"], F.col("n"), group=["g"])
    assert by.count() == 3


def test_padding_and_unknown_words(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, []), (1, [5, 6])], "batch_id int, ids array<bigint>")
    rows = sorted((r["batch_id"], r["input_ids"], r["attention_mask"]) for r in vb.pad_batches(df).collect())
    assert rows == [(0, [1, 2, 3], [1, 1, 1]), (0, [4, 0, 0], [1, 0, 0]), (1, [0, 0], [0, 0]), (1, [5, 6], [1, 1])]
    toks = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "zz"])], "k long, t array<string>")
    voc = vb.build_vocab(toks.filter("k = 1"), "t")
    got = {r["k"]: r["ids"] for r in vb.encode_ids(toks, ["k"], "t", voc).collect()}
    assert got == {1: [1, 2], 2: [1, 0]}


def test_row_slice_and_head(spark):
    df = spark.createDataFrame([(i * i - 50, "x") for i in range(30)], "k long, v string")
    keys = sorted(r["k"] for r in df.collect())
    assert sorted(r["k"] for r in split.row_slice(df, 5, 12, [F.col("k").asc()]).collect()) == keys[5:12]
    assert [r["k"] for r in split.head(df, 3, [F.col("k").asc()]).collect()] == keys[:3]


def _points(spark, n, flip, start=0):
    import random
    rng = random.Random(n + start)
    rows = []
    for i in range(start, start + n):
        y = rng.randrange(2)
        rows.append((i, [rng.gauss(2.0 * y - 1, 0.5), rng.gauss(0, 1)], y if rng.random() > flip else 1 - y))
    return spark.createDataFrame(rows, "doc_id long, pooled array<double>, label int")


def test_the_best_epoch_is_kept(spark):
    """Trained on labels that are opposite to the validation side's: the first epoch is the
    best, and it is what comes back."""
    path = tempfile.mkdtemp(prefix="corpuslab-epochs-")
    train, valid = _points(spark, 400, 1.0), _points(spark, 100, 0.0, start=1000)
    log = md.train_epochs(train, valid, path, epochs=4, lr=0.5, batch=32)
    assert md.best_epoch(log) == 1
    per = {(r["epoch"], r["split"]): r for r in md.me.epoch_metrics(log).collect()}
    assert per[4, "val"]["loss_mean"] > per[1, "val"]["loss_mean"] and per[4, "train"]["loss_mean"] < per[1, "train"]["loss_mean"]
    assert per[1, "train"]["rows"] == 400 and per[2, "val"]["rows"] == 100
    (w1, _), (w4, _) = (md.load_version(spark, path, e) for e in (1, 4))
    assert abs(w4[0]) > abs(w1[0]) > 0
    again = md.train_epochs(train.repartition(3), valid, tempfile.mkdtemp(), epochs=4, lr=0.5, batch=32)
    key = ["epoch", "split", "step", "loss", "correct", "n"]
    assert sorted(map(tuple, log.select(key).collect())) == sorted(map(tuple, again.select(key).collect()))


def test_epochs_learn_and_empty_sides(spark):
    path = tempfile.mkdtemp(prefix="corpuslab-epochs-")
    train, valid = _points(spark, 600, 0.0), _points(spark, 200, 0.0, start=1000)
    log = md.train_epochs(train, valid, path, epochs=5, lr=0.5, batch=32)
    assert md.best_epoch(log) == 5
    w, b = md.load_version(spark, path, 5)
    scored = md.batch_score(valid, "pooled", md.binary_predict_fn(w, b), 2, 2)
    assert scored.where("prediction = label").count() > 190
    assert md.train_epochs(train, valid.limit(0), tempfile.mkdtemp(), epochs=1).where("split = 'val'").count() == 0


@pytest.mark.parametrize("family", ["multinomial", "binomial"])
def test_batch_scores_equal_the_models_own(spark, family):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    df = md.pooled_vector(_points(spark, 300, 0.1))
    path = os.path.join(tempfile.mkdtemp(prefix="corpuslab-model-"), "m")
    LogisticRegression(featuresCol="pooled_vec", labelCol="label", family=family).fit(df).write().save(path)
    model = md.LogisticRegressionModel.load(path)
    own = {r["doc_id"]: r["p"] for r in model.transform(df).select("doc_id", vector_to_array("probability").alias("p")).collect()}
    got = {r["doc_id"]: r["probs"] for r in md.batch_score(df, "pooled", md.fitted_predict_fn(model), 2, 2).collect()}
    assert own.keys() == got.keys() and all(abs(a - b) < 1e-9 for k in own for a, b in zip(own[k], got[k]))
