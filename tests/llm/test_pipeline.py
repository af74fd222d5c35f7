import hashlib
import random

import corpus_pipeline as P
from corpuslab.llm.queries import QUERIES  # noqa: F401
from tests.conftest import SMALL

from . import brute


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "mixing sources",
                                        "byte-level BPE"]
    held, at = {}, docs
    for name, stage in P.STAGES:
        at = stage(spark, at, SMALL)
        held[name] = at.collect()
        at = spark.createDataFrame(held[name], at.schema)
        if name != "byte-level BPE":
            assert at.columns == columns
    first = held["language ID"]
    assert {r["doc_id"] for r in first} <= set(texts) and len(first) >= 0.98 * len(texts)
    rows = [(r["doc_id"], r["text"]) for r in first]
    want = {k: s for k, _, _, s in brute.line_dedup(rows)}
    second = held["line dedup"]
    assert {r["doc_id"]: brute.sha(r["text"]) for r in second} == want
    assert all(r["n_chars"] == len(r["text"]) for r in second)
    groups = brute.jaccard_components([(r["doc_id"], r["text"]) for r in second])
    assert {r["doc_id"] for r in held["n-gram Jaccard join"]} == {c for _, _, c in groups}
    third = {r["doc_id"]: r["text"] for r in held["n-gram Jaccard join"]}
    mixed = held["mixing sources"]
    assert {r["doc_id"] for r in mixed} <= set(third)
    last = held["byte-level BPE"]
    assert sorted(r["doc_id"] for r in last) == sorted(r["doc_id"] for r in mixed)
    for r in last:
        assert r["decoded_sha256"] == hashlib.sha256(third[r["doc_id"]].encode()).hexdigest()
        assert r["n_tokens"] == len(r["ids"])
    whole = P.run(spark, SMALL)
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in whole.collect()) == sorted(
        (r["doc_id"], r["decoded_sha256"]) for r in last)


def test_odd_rows(spark, make_docs):
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice(["the", "of", "and", "thing", "was", "er", "on"]) + rng.choice("abcde") for _ in range(60))
    a = prose()
    rows = [(1, a, "en", "s", 1), (2, a, "en", None, None), (None, prose(), None, "s", 3), (3, None, "en", "s", 0), (4, "", None, None, 0),
            (5, prose(), "en", "t", 0), (5, prose(), "en", "t", 0), (6, "der und " * 50, "de", "t", 0), (7, "die nicht " * 40, "de", "t", 0)]
    docs = make_docs(rows, extra=["score", "size", "copies", "pos", "cls", "kept"])
    for _, stage in P.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        if stage is P.jaccard_join:
            ids = [r["doc_id"] for r in docs.collect()]
            assert ids.count(5) == 2 and 1 in ids and 2 not in ids and None in ids
    assert P.STAGES[4][1](spark, docs, "").count() == docs.count()


def test_jaccard_stage_decides_by_row(spark, make_docs):
    """Unlike texts of one doc_id all stay, each group of near copies keeps one row, rows without a doc_id too."""
    rng = random.Random(8)
    prose = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    t = [prose() for _ in range(40)]
    rows = [(3, t[0]), (5, t[0] + " end"), (5, t[1]), *[(9, x) for x in t[2:20]], (9, t[2] + " end"), (9, t[3]), (9, t[3]),
            (None, t[20]), (None, t[20] + " end"), (None, t[20]), (None, t[21]), (11, t[21] + " end"), (None, t[22]),
            *[(20 + i, t[30 + i]) for i in range(10)], *[(5, t[30 + i] + " end") for i in range(10)],
            (40, ""), (40, ""), (41, None), (None, " \n"), (None, " \n")]
    docs = make_docs(rows, extra=["_pe_row", "body", "label"])
    out = P.jaccard_join(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    wordless = [(k, x) for k, x in rows if not (x or "").strip()]
    assert sorted(map(str, (r for r in got if not (r[1] or "").strip()))) == sorted(map(str, wordless))
    texts = {}
    for k, x in got:
        if (x or "").strip():
            texts.setdefault((x.removesuffix(" end")), []).append(k)
    want = {t[0]: [3], t[1]: [5], **{x: [9] for x in t[2:20]}, t[20]: [None], t[21]: [11], t[22]: [None],
            **{t[30 + i]: [5] for i in range(10)}}
    assert texts == want


def test_empty_table(spark, make_docs, table_dir):
    assert P.run(spark, table_dir(make_docs([]))).count() == 0
