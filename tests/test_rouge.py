import re
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslab.functions.lcs import lcs_length, lcs_positions, rouge_tokens, summary_lcs_scores
from corpuslab.operators import rouge as rg


def _lcs_dp(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=40))
def test_bit_parallel_lcs_matches_dp(a, b):
    assert lcs_length(a, b) == _lcs_dp(a, b)
    assert len(lcs_positions(a, b)) == _lcs_dp(a, b)


def test_tokens():
    assert rouge_tokens("The Cat-sat, été 42!") == ["the", "cat", "sat", "t", "42"]


def test_lsum_hand_case():
    p, r, f = summary_lcs_scores("the cat sat\non the mat", "the cat\nsat on mat")
    assert (round(p, 6), round(r, 6)) == (round(5 / 6, 6), 1.0)
    assert summary_lcs_scores("a b", "a b") == (1.0, 1.0, 1.0)
    assert summary_lcs_scores("", "a") == (0.0, 0.0, 0.0)


def test_rouge_spark_hand_cases(spark):
    pairs = spark.createDataFrame([
        (1, "the cat sat on the mat", "the cat is on the mat"),
        (2, "a a a", "a"),
        (3, "", "something"),
        (4, "same text here", "same text here"),
    ], "k long, prediction string, reference string")
    r1 = {r["k"]: r for r in rg.rouge_n(pairs, ["k"], n=1).collect()}
    r2 = {r["k"]: r for r in rg.rouge_n(pairs, ["k"], n=2).collect()}
    rl = {r["k"]: r for r in rg.rouge_l(pairs, ["k"]).collect()}
    assert abs(r1[1]["rouge1_fmeasure"] - 5 / 6) < 1e-12
    assert abs(r1[2]["rouge1_precision"] - 1 / 3) < 1e-12 and r1[2]["rouge1_recall"] == 1.0
    assert r1[3]["rouge1_fmeasure"] == 0.0
    assert abs(r2[1]["rouge2_fmeasure"] - 3 / 5) < 1e-12
    assert abs(rl[1]["rougeL_fmeasure"] - 5 / 6) < 1e-12
    for t in (r1, r2, rl):
        assert [v for k, v in t[4].asDict().items() if k.endswith("fmeasure")] == [1.0]


def test_bootstrap_is_seeded(spark):
    rnd = random.Random(0)
    s = spark.createDataFrame([(f"p{i}", rnd.random()) for i in range(50)], "pair string, rouge1 double")
    a = rg.rouge_bootstrap(s, "pair", cols=("rouge1",), n_samples=100).first()
    b = rg.rouge_bootstrap(s.repartition(7), "pair", cols=("rouge1",), n_samples=100).first()
    assert a["metric"] == b["metric"]
    assert all(abs(a[k] - b[k]) < 1e-12 for k in ("low", "mid", "high"))
    assert a["low"] <= a["mid"] <= a["high"]


def test_all_scores_in_one_pass(spark):
    """Repeats, empty and null sides; no shuffle and one cut of the tokens."""
    import collections
    import random
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40))), " ".join(rng.choice("abcd") for _ in range(rng.randrange(40))))
            for i in range(60)] + [(100, None, "a b"), (101, "", ""), (102, "a a a", None), (103, "x" * 5 + " x#1 x", "x x 1")]
    df = spark.createDataFrame(rows, "k long, prediction string, reference string")
    got = {r["k"]: r for r in rg.rouge_all(df, ["k"]).collect()}

    def f(p, r, n):
        p, r = ([tuple(t[i:i + n]) for i in range(len(t) - n + 1)] for t in (re.findall("[a-z0-9]+", (x or "").lower()) for x in (p, r)))
        o = sum((collections.Counter(p) & collections.Counter(r)).values())
        return 2 * o / (len(p) + len(r)) if o else 0.0

    for k, p, r in rows:
        assert abs(got[k]["rouge1"] - f(p, r, 1)) < 1e-12 and abs(got[k]["rouge2"] - f(p, r, 2)) < 1e-12
    plan = rg.rouge_all(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "explode" not in plan


def test_bootstrap_ships_sums_not_replicates(spark):
    df = spark.range(500).select("id", (F.col("id") % 7 / 7.0).alias("rouge1"))
    out = rg.rouge_bootstrap(df, "id", cols=("rouge1",), n_samples=200)
    r = out.first()
    assert r["low"] < r["mid"] < r["high"] and abs(r["mid"] - 0.4274) < 0.05
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 2                 # the replicates and the metrics of one row of sums


def test_bootstrap_draws(spark):
    """Draws of hashes are those of the uniforms; null keys draw too; one scan task's pairs are dealt over several."""
    from corpuslab.functions.hashing import uniform
    df = spark.createDataFrame([(None, 0.5), *((f"p{i}", i / 40) for i in range(40))], "pair string, rouge1 double").coalesce(1)
    reps = df.select("rouge1", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("r"), "pair").select(
        "r", "rouge1", uniform(F.col("pair"), F.col("r"), seed=42).alias("u")).collect()
    w, x = [0] * 100, [0.0] * 100
    for r in reps:
        k = sum(r["u"] >= c for c in rg._poisson1_cdf())
        w[r["r"]] += k
        x[r["r"]] += k * r["rouge1"]
    means = sorted(a / b for a, b in zip(x, w))
    out = rg.rouge_bootstrap(df, "pair", cols=("rouge1",), n_samples=100)
    assert abs(out.first()["mid"] - (means[49] + means[50]) / 2) < 1e-12
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "conv(" not in plan
