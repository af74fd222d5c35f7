from corpuslab.operators import metrics as me


def test_classification_report_hand_case(spark):
    rows = [(1, 1)] * 5 + [(1, 0)] * 2 + [(0, 1)] * 1 + [(0, 0)] * 2
    df = spark.createDataFrame(rows, "label int, prediction int")
    rep = {r["class"]: r for r in me.classification_report(df).collect()}
    assert abs(rep["1"]["precision"] - 5 / 6) < 1e-12
    assert abs(rep["1"]["recall"] - 5 / 7) < 1e-12
    assert abs(rep["0"]["precision"] - 2 / 4) < 1e-12
    assert rep["accuracy"]["f1"] == 0.7 and rep["accuracy"]["support"] == 10
    s = me.binary_scores(df).first()
    assert abs(s["f1"] - 10 / 13) < 1e-12


def test_interval_accuracy_first_interval_has_L_plus_1(spark):
    rows = [(1, 1, "train", i, 0.5, 1 if i <= 4 else 0, 1) for i in range(12)]
    log = spark.createDataFrame(rows, "run long, epoch long, split string, step long, loss double, correct long, n long")
    got = {r["interval"]: r["accuracy"] for r in me.interval_accuracy(log, log_interval=4).collect()}
    # idx 0..4 -> interval 1 (5 batches, all correct); 5..8 -> interval 2; 9..11 unfinished
    assert got == {1: 1.0, 2: 0.0}


def test_best_checkpoints(spark):
    rows = [(1, e, "val", e, loss, 1, 1) for e, loss in [(1, 3.0), (2, 2.0), (3, 2.5), (4, 1.0)]]
    log = spark.createDataFrame(rows, "run long, epoch long, split string, step long, loss double, correct long, n long")
    best = {r["epoch"]: r["is_best"] for r in me.best_checkpoints(log).collect()}
    assert best == {1: True, 2: True, 3: False, 4: True}
    top = me.top_checkpoints(log).first()
    assert top["epoch"] == 4


def test_running_totals_over_sparse_steps(spark):
    """One run holds most rows, with steps all over 64 bits; others have a few rows or a null name."""
    import random
    from itertools import accumulate

    from corpuslab.operators.rank import running_total
    rng = random.Random(3)
    rows = [("hot", s, rng.randrange(100)) for s in {rng.randrange(-2 ** 62, 2 ** 62) for _ in range(5000)}]
    rows += [(None, s, 1) for s in range(10)] + [(f"r{i}", i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "run string, step long, n long")
    out = running_total(df, ["n"], ["run"], "step")
    assert out.columns == ["run", "step", "n", "n_cum"]
    got = {(r["run"], r["step"]): r["n_cum"] for r in out.collect()}
    for run in {r[0] for r in rows}:
        own = sorted((s, n) for k, s, n in rows if k == run)
        assert [got[run, s] for s, _ in own] == list(accumulate(n for _, n in own))
    assert len(got) == len(rows)
