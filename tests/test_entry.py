import math

import duckdb

import __spark_entry__ as E

from .conftest import SMALL

FAST = ["class_balance", "split_balance", "clean_stopwords", "stratified_split", "vocab", "tfidf_weights",
        "epoch_metrics", "classification_report", "rouge_1", "softmax_scores", "page_title", "length_cutoffs"]


def _norm(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def v(x):
        if isinstance(x, float):
            return repr(round(x, 6) + 0.0) if not math.isnan(x) else "nan"
        return str(x)
    return sorted(tuple(v(r[i]) for i in order) for r in rows)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"split", "label", "n", "mean_words"}


def test_every_query_has_a_name_and_callable():
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) >= 80
    assert set(sql) <= set(qs)


def test_fast_queries_match_oracle(spark):
    qs, sql = E.queries(), E.oracle_sql()
    con = duckdb.connect()
    for t in ["documents", "labels", "pages", "conversations", "embeddings", "events", "benchmark"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    for name in FAST:
        df = qs[name](spark, SMALL)
        rel = con.sql(sql[name])
        assert _norm(df.columns, [tuple(r) for r in df.collect()]) == _norm(list(rel.columns), rel.fetchall()), name
