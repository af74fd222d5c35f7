"""Mixing, line dedup and quality rules: SQL, brute force and edge cases."""

import duckdb
import pytest

from corpuslab.llm import linededup, mixing, quality
from corpuslab.llm.queries import ORACLE, QUERIES
from tests.conftest import SMALL
from tests.test_entry import _norm

from . import brute


@pytest.mark.parametrize("name", ["op3_mix_sources", "op8_line_dedup", "op9_quality_rules"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    rel = con.sql(ORACLE[name])
    df = QUERIES[name](spark, SMALL)
    assert _norm(df.columns, [tuple(r) for r in df.collect()]) == _norm(list(rel.columns), rel.fetchall())
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def targets(sizes):
    """Reshare the excess until no target is above twice its source's size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over


def test_mixing(spark, make_docs, table_dir):
    rows = [(i, "w " * (1 + (i * 7919) % 60), "en", ["a", "b", "ü", None, "big"][min(4, i % 9)], 0) for i in range(2000)]
    rows += [(9001, None, "en", "a", 0), (9002, "", "en", None, 0), (None, "x y", "en", "b", 0), (7, "dup row", "en", "a", 0)]
    got = QUERIES["op3_mix_sources"](spark, table_dir(make_docs(rows))).collect()
    again = QUERIES["op3_mix_sources"](spark, table_dir(make_docs(rows[::-1]))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, taken = {}, {}
    source = {}
    for k, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
        source[k] = s
    want = targets(sizes)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = [x for x, n in sizes.items() if n == r["source_size"]][0]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert r["target"] == pytest.approx(want[s])
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], abs=60)


def test_mix_repeats_rows_and_keeps_columns(spark, make_docs):
    df = make_docs([(i, "a b c d", "en", "ab"[i % 2], 7) for i in range(100)], extra=["size", "copies", "target"])
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == 150
    assert {r["copies"] for r in out.collect()} == {"own"}


def test_mixing_without_words(spark, make_docs):
    got = mixing.mix(make_docs([(1, None), (2, "")]))
    assert got.count() == 0 and mixing.mix(make_docs([])).count() == 0


LONG = "This line is long enough to be counted, Él says."


def line_rows():
    rows = [(i, f"{LONG}\nown {i}\n  {LONG.replace('T', 't', 1)}\t\n") for i in range(6)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, LONG.replace("É", "é")), (24, "x" * 39 + "\n" + "y" * 40)]
    rows += [(30 + i, "y" * 40 + "\r\nshort") for i in range(3)]
    return rows


def test_line_dedup(spark, make_docs, table_dir):
    rows = line_rows()
    got = QUERIES["op8_line_dedup"](spark, table_dir(make_docs(rows))).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.line_dedup(rows))
    assert {r["doc_id"]: r["n_dropped"] for r in got}[0] == 2


def test_line_dedup_keeps_columns_and_repeated_rows(spark, make_docs):
    df = make_docs(line_rows() + [(None, LONG), (3, line_rows()[3][1])], extra=["pos", "runs", "salt", "doc"])
    out = linededup.dedup_lines(df)
    rows = out.collect()
    assert set(df.columns) < set(out.columns) and len(rows) == df.count()
    assert {r["pos"] for r in rows} == {"own"}
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [""]
    assert len({r["kept"] for r in rows if r["doc_id"] == 3}) == 1
    assert linededup.dedup_lines(make_docs([])).count() == 0


def test_lines_of_repeated_and_missing_keys(spark, make_docs):
    """Rows of one key are one document; rows without a key are documents of their own texts."""
    line = "a line of more than forty characters, which documents share"
    rows = [(1, line), (2, line), (3, line + "\nx"), (3, line + "\ny"), (3, "z\n" + line)]
    kept = lambda rows: sorted((str(r["doc_id"]), r["text"], r["n_dropped"]) for r in linededup.dedup_lines(make_docs(rows)).collect())
    assert all(n == 0 for *_, n in kept(rows))                 # three documents hold it
    rows += [(4, line), (5, line)]
    assert {(k, n) for k, _, n in kept(rows)} == {("1", 1), ("2", 1), ("3", 1), ("4", 1), ("5", 0)}
    missing = [(None, f"{line}\n{i}") for i in range(4)]
    assert all(n == 0 for *_, n in kept(missing + [(None, line + "\n0")]))
    assert {(k, n) for k, _, n in kept(missing + [(7, line)])} == {("None", 1), ("7", 0)}


def test_bitmap_runs(spark):
    df = spark.createDataFrame([(1, 0, p) for p in (0, 1, 2, 5, 7, 8)], "doc long, body long, pos int")
    assert [tuple(x) for x in linededup.bitmaps(df).first()["runs"]] == [(0, 3), (5, 1), (7, 2)]


TEXTS = [None, "", "   \n\t", "one two", "a b c a b c a", "x y\nx y\n\nx y", "a $$ b # <tag> | %",
         "the of and " * 40, " ".join(f"word{i} the" for i in range(60)), "LOUD WORDS " * 40, "é ü ß one",
         "\n".join(f"the line number {i} is of its own making here" for i in range(30))]


def test_quality(spark, make_docs, table_dir):
    got = {r["doc_id"]: r for r in QUERIES["op9_quality_rules"](spark, table_dir(make_docs(list(enumerate(TEXTS))))).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        want = brute.quality(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert got[8]["kept"] and not got[9]["kept"]


def test_quality_keeps_extra_columns(spark, make_docs):
    df = make_docs([(1, "a b")], extra=["n_words", "kept", "_x"])
    r = quality.judge(df).first()
    assert r["n_words"] == 2 and r["kept"] is False and r["_x"] == "own"
    assert quality.judge(make_docs([])).count() == 0
