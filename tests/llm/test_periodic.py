"""op12: runs against a plain search over all lags, and the query against its SQL."""

import random
import zlib

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslab.llm import periodic
from corpuslab.llm.queries import ORACLE, QUERIES
from tests.conftest import SMALL
from tests.test_entry import _norm

from . import brute


def plain_runs(w):
    """Every lag, every maximal stretch that repeats at that lag."""
    n, runs = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            part = w[s:i + q]
            shorter = any(part[p:] == part[:-p] for p in range(1, q))
            if len(part) >= max(24, 3 * q) and not shorter:
                runs.append((s, len(part), q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def expected(rows):
    out = []
    for k, text in rows:
        w = brute.WORD.findall(text or "")
        n = len(w)
        h = zlib.crc32(str(k).encode()) if k is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        runs = plain_runs(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        out.append((k, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                    brute.sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
                    brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([1, 2, 3, 8, 9, 16, 17, 33]), st.integers(1, 4), st.integers(0, 120),
                          st.integers(0, 1000)), min_size=1, max_size=5))
def test_runs(parts):
    w = []
    for period, letters, length, seed in parts:
        rng = random.Random(seed)
        base = [rng.randrange(letters) for _ in range(period)]
        w += [base[i % period] for i in range(length)]
    assert periodic.text_runs(np.array(w, dtype=np.int64)) == plain_runs(w)


def test_long_periods_and_one_word():
    base = list(range(700))
    w = base * 3 + [5] * 100 + base
    assert periodic.text_runs(np.array(w)) == plain_runs(w)
    assert periodic.text_runs(np.zeros(50_000, dtype=np.int64)) == [(0, 50_000, 1)]


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    rel = con.sql(ORACLE["op12_periodic_runs"])
    df = QUERIES["op12_periodic_runs"](spark, SMALL)
    assert _norm(df.columns, [tuple(r) for r in df.collect()]) == _norm(list(rel.columns), rel.fetchall())


def test_odd_rows(spark, make_docs, table_dir):
    rng = random.Random(3)
    rows = [(None, "a b " * 20), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "x " * 3000), (4, "x " * 3000), (5, "Ä ä " * 30),
            (6, "a b " * 24), (7, "one two three"), (8, ("p q r " * 12) + ("s t " * 14) + "u")]
    rows += [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(200)))) for i in range(10, 60)]
    df = make_docs(rows, extra=["runs", "key", "start", "t", "collapsed"])
    got = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, table_dir(df)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected(rows)))
    assert periodic.collapse_runs(df.limit(0)).count() == 0
    assert periodic.collapse_runs(df, "source", "text").columns == ["source", "n_words", "runs", "collapsed"]
