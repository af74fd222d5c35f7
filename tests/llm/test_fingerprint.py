import hashlib
import random

import numpy as np
import pytest

from corpuslab.llm import fingerprint as fp
from corpuslab.llm.queries import QUERIES
from tests.conftest import SMALL

from . import brute


def of(text):
    return fp.text_vector(text, fp.WordHashes())


def same(a, b):
    return np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_order_does_not_matter_but_multiplicity_does():
    parts = ["one two three four", "five", "", "six seven eight", "five"]
    shuffled = parts[::-1]
    assert same(of("\n".join(parts)), of("\n".join(shuffled)))
    assert not np.array_equal(of("\n".join(parts))[0], of("\n".join(parts[:-1]))[0])
    assert not np.array_equal(of("a\n\nb")[0], of("a\nb")[0])


def test_incremental_insertion_and_deletion():
    v = fp.insert(of("a b c d\nsecond line here"), "a new paragraph of words")
    assert same(v, of("second line here\na new paragraph of words\na b c d"))
    assert same(fp.delete(v, "second line here"), of("a b c d\na new paragraph of words"))
    assert same(fp.from_hex(fp.to_hex(v)), v)


def test_long_text_in_blocks():
    text = " ".join(f"w{i % 977}" for i in range(3 * fp.BLOCK))
    a = of(text)
    fp_block, fp.BLOCK = fp.BLOCK, 1000
    try:
        assert same(a, of(text))
    finally:
        fp.BLOCK = fp_block


def test_lanes_do_not_wrap():
    """Tens of thousands of equal triples are like more of the same."""
    assert fp.likeness(of("same old words " * 40_000), of("same old words " * 20_000)) > 0.99


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        new = t[:len(t) - half] + nxt[:half]
        a, b, c = (brute.fingerprint(x) for x in (t, new, nxt))
        out[k] = (len(t), hashlib.sha256(new.encode()).hexdigest(), brute.fingerprint_hex(a), brute.fingerprint_hex(b),
                  brute.likeness(a, b), brute.likeness(a, c))
    return out


def check(rows, source):
    want = expected(source)
    assert len(rows) == len(want)
    for r in rows:
        *texts, near_edited, near_next = want[r["doc_id"]]
        assert [r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]] == texts
        assert r["near_edited"] == pytest.approx(near_edited) and r["near_next"] == pytest.approx(near_next)


def test_query(spark):
    rows = QUERIES["op7_fingerprint"](spark, SMALL).collect()
    src = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert len(rows) == len(src)
    by_text = {}
    for k, t in src:
        by_text.setdefault(t, set()).add(next(r["fingerprint"] for r in rows if r["doc_id"] == k))
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([r["near_edited"] for r in rows]) > 0.4 > 0.1 > np.mean([r["near_next"] for r in rows])


def test_sparse_keys_nulls_and_empties(spark, make_docs, table_dir):
    rng = random.Random(6)
    prose = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(200))
    rows = [(10 ** 13, prose), (10 ** 13 + 1, prose + "\nmore of it\n\n" + prose[:300])]
    rows += [(rng.randrange(-10**12, 10**12), None if i % 7 == 0 else "" if i % 7 == 1 else f"text é {i} " * (i % 5 + 1))
            for i in range(300)]
    check(QUERIES["op7_fingerprint"](spark, table_dir(make_docs(rows))).collect(), rows)
    check(QUERIES["op7_fingerprint"](spark, table_dir(make_docs(rows[:1]))).collect(), rows[:1])


def test_repeated_and_null_keys(spark, make_docs):
    df = make_docs([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, "e")], extra=["key", "part", "last"])
    assert fp.fingerprint_edits(df).count() == 5
    assert fp.fingerprint_edits(make_docs([])).count() == 0
