import hashlib
import random

import pytest

from corpuslab.llm import pii
from corpuslab.llm.queries import QUERIES
from tests.conftest import SMALL

from . import brute


def run(spark, table_dir, df):
    return QUERIES["op6_personal_data"](spark, table_dir(df)).collect()


def check(rows, texts):
    for r in rows:
        want = brute.base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), texts[r["doc_id"]]
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("id:")] == [s for s in want.split(",") if s]
        for kind in brute.PII:
            assert r[f"n_{kind}"] == sum(s.startswith(kind) for s in spans)


def test_small_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    df = QUERIES["op6_personal_data"](spark, SMALL)
    check(df.collect(), texts)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hard_base_cases(spark, make_docs, table_dir):
    rng = random.Random(2)
    pieces = ["a@b.co", "x.y@d-e.f.g", "a@b.c.@d.e", "@", ".", "a@b", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.255",
              "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111111111", "+1 (988) 555-2485", "+12", "+1)(2 3",
              "123456789012 ", "٣٤", "é", " ", "\n", "-", "9", "%+-", "💥", "a" * 50, "1 2 3 4 5 6 7 8 9 0 1 8"]
    texts = {i: "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for i in range(400)}
    texts |= {1000: None, 1001: "", 1002: "a" * 60_000, 1003: "1" * 60_000, 1004: "1." * 20_000, 1005: "a." * 20_000 + "@b" + ".c" * 9000,
              1006: "x@y.zz " * 1500}
    check(run(spark, table_dir, make_docs(list(texts.items()))), texts)


def words(rng, n):
    return " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "the", "of"]) for _ in range(n))


def test_bootstrapping_discovers_by_context(spark, make_docs, table_dir):
    """Seeds teach "reach me"; the pattern finds a number no base pattern knows,
    its other occurrence follows, and ordinary numbers stay alone."""
    rng = random.Random(1)
    texts = {i: f"{words(rng, 30)} please reach-me-at user{i}@mail.example.org {words(rng, 20)}" for i in range(8)}
    texts[20] = f"{words(rng, 9)} please reach-me-at AB12-9911-77 {words(rng, 5)}"
    texts[21] = f"{words(rng, 9)} the AB12-9911-77, of {words(rng, 5)}"
    texts |= {30 + i: f"{words(rng, 20)} License, version 2{i}.0{i}123 {words(rng, 10)}" for i in range(5)}
    rows = run(spark, table_dir, make_docs(list(texts.items())))
    check(rows, texts)
    added = {r["doc_id"]: [texts[r["doc_id"]][int(s.split(":")[1]):int(s.split(":")[2])]
                           for s in r["spans"].split(",") if s.startswith("id:")] for r in rows}
    assert {k: v for k, v in added.items() if v} == {20: ["AB12-9911-77"], 21: ["AB12-9911-77"]}


@pytest.mark.parametrize("length", [11, 79, 80, 81, 92, 300])
def test_context_words_of_any_length(spark, make_docs, table_dir, length):
    """Long context words teach and find like short ones, as the last and as the last but one."""
    rng = random.Random(length)
    mark = "q" * (length - 4) + "mark"
    texts = {i: f"{words(rng, 9)} {mark} mail{i}@bank.example.org {words(rng, 6)}" for i in range(6)}
    texts |= {20 + i: f"{words(rng, 9)} {mark} \t of{i}x mail{i}@bank.example.org {words(rng, 6)}" for i in range(6)}
    texts[40] = f"{words(rng, 9)} {mark} ZX04-5512 {words(rng, 6)}"
    texts[41] = f"{words(rng, 9)} see AB04-5513{')' * 60} {words(rng, 6)}"
    texts |= {50 + i: f"{words(rng, 3)} see m{i}@x.org {words(rng, 3)}" for i in range(6)}
    rows = run(spark, table_dir, make_docs(list(texts.items())))
    check(rows, texts)
    found = {texts[r["doc_id"]][int(s.split(":")[1]):int(s.split(":")[2])] for r in rows for s in r["spans"].split(",") if s.startswith("id:")}
    assert found == {"ZX04-5512", "AB04-5513"}


def test_second_round_uses_discovered_instances(spark, make_docs, table_dir):
    rng = random.Random(3)
    ids = [f"ZX{i}04-551{i}" for i in range(4)]
    texts = {i: f"{words(rng, 12)} wire-to mail{i}@bank.example.org {words(rng, 6)}" for i in range(10)}
    texts |= {20 + i: f"{words(rng, 12)} wire-to {x} {words(rng, 6)}" for i, x in enumerate(ids)}
    texts |= {40 + i: f"{words(rng, 12)} account-no {x} {words(rng, 6)}" for i, x in enumerate(ids)}
    texts[60] = f"{words(rng, 12)} account-no QQ7788-100 {words(rng, 6)}"
    found = {r["doc_id"]: r["spans"] for r in run(spark, table_dir, make_docs(list(texts.items())))}
    assert "id:" in found[20] and "id:" in found[41] and "id:" in found[60]


def test_chain_of_six_hops(spark, make_docs, table_dir):
    """Each group of identifiers is only found by a pattern that the group before it teaches."""
    rng = random.Random(7)
    patterns = ["wire-to", "account-no", "member-ref", "badge-code", "locker-key", "parcel-mark", "vault-name"]
    ids = [[f"ZX{g}{i}04-55{i}1{g}" for i in range(3)] for g in range(len(patterns))]
    texts = {i: f"{words(rng, 12)} wire-to mail{i}@bank.example.org {words(rng, 6)}" for i in range(10)}
    for g, pattern in enumerate(patterns):
        for x in ids[g] + (ids[g - 1] * 2 if g else []):
            texts[len(texts)] = f"{words(rng, 12)} {pattern} {x} {words(rng, 6)}"
    rows = run(spark, table_dir, make_docs(list(texts.items())))
    check(rows, texts)
    found = {texts[r["doc_id"]][int(s.split(":")[1]):int(s.split(":")[2])]
             for r in rows for s in r["spans"].split(",") if s.startswith("id:")}
    assert found == {x for g in ids for x in g}


def test_repeated_rows_and_columns(spark, make_docs):
    df = make_docs([(1, "mail a@b.co now"), (1, "mail a@b.co now"), (None, "+1 (988) 555-2485")], extra=["base", "cands", "kind"])
    out = pii.find(df).collect()
    assert len(out) == 3 and sorted(len(r["base"]) for r in out) == [1, 1, 1]
    assert pii.find(make_docs([])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, pii.BLOCK, pii.BLOCK + 1, 3 * pii.BLOCK + 7])
def test_prefix_sums(spark, n):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([([i % 7 for i in range(n)],)], "v array<int>")
    want, at = [], 0
    for i in range(n):
        want.append(at)
        at += i % 7
    assert df.select(pii.prefix_sums(F.col("v"))).first()[0] == want
