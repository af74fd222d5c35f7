"""op11: places of the base phrases, and the method restated with plain loops."""

import collections
import math
import random
import re

from corpuslab.llm import licences
from corpuslab.llm.queries import QUERIES

from . import brute

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def cut(text):
    return tuple(WORD.findall((text or "").translate(brute.LOWER)))


def at(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i:i + len(phrase)] == phrase]


def expected(rows):
    texts = [cut(t) for _, t in rows]
    vocabulary = sorted({w for t in licences.TEMPLATES for w in cut(t.text)} | {w for p in BASE for w in p})
    df = collections.Counter(w for t in texts for w in set(t))
    idf = {w: math.log((len(texts) + 1) / (df[w] + 1)) + 1 for w in vocabulary}
    out = []
    for (key, _), words in zip(rows, texts):
        places = sorted((i, label) for p, label in BASE.items() for i in at(words, p))
        score, labels = (1.0 if places else 0.0), {label for _, label in places}
        for t in licences.TEMPLATES:
            own = cut(t.text)
            rare = sorted(set(own), key=lambda w: (-idf[w], w))
            rare = rare[:min(licences.RARE, -(-len(rare) // 2))]
            votes = [(i - j, w) for i, w in enumerate(words) if w in rare for j, x in enumerate(own) if x == w]
            for shift in (0, licences.SLACK // 2):
                bands = collections.defaultdict(list)
                for start, w in votes:
                    bands[(start + shift) // licences.SLACK].append((start, w))
                for members in bands.values():
                    share = sum(idf[w] for w in {w for _, w in members}) / sum(idf[w] for w in rare)
                    score = max(score, min(1.0, share))
                    low, high = min(members)[0], max(members)[0]
                    if share >= licences.LEAST and all(any(
                            low + at(own, cut(k))[0] - licences.SLACK <= i <= high + at(own, cut(k))[0] + licences.SLACK
                            for i in at(words, cut(k))) for k in t.keys):
                        labels.add(t.label)
        out.append((key, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
                    ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)), round(score, 6)))
    return out


def make_rows():
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(["the", "of", "and", "software", "license", "cc", "by", "all", "thing", "über"]) for _ in range(n))
    rows = [(1, None), (2, ""), (3, "..."), (None, "CC-BY"), (4, "general, PUBLIC license"), (4, "cc by cc by"), (5, "all rights"),
            (6, "ccby generalpublic license"), (7, "cc by cc by"), (8, filler(30_000))]
    for i, t in enumerate(licences.TEMPLATES):
        words = t.text.split()
        rows.append((100 + i, f"{filler(rng.randrange(60))} {t.text} {filler(20)}"))
        rows.append((200 + i, " ".join(w for w in words if rng.random() < 0.8)))
        rows.append((300 + i, " ".join(rng.sample(words, len(words)))))
    return rows


def test_against_plain_loops(spark, make_docs, table_dir):
    rows = make_rows()
    docs = make_docs(rows, extra=["key", "places", "label", "score", "t"])
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_license_scan"](spark, table_dir(docs)).collect() if r["doc_id"] != 4}
    want = {r[0]: r for r in expected(rows) if r[0] != 4}
    assert got == want
    whole = [want[100 + i][6].split(",") for i in range(len(licences.TEMPLATES))]
    assert all(t.label in labels for t, labels in zip(licences.TEMPLATES, whole))


def test_empty_and_repeated(spark, make_docs, table_dir):
    docs = make_docs([(4, "cc by"), (4, "cc by")])
    assert licences.scan(docs.limit(0)).count() == 0
    assert [r["n_base"] for r in QUERIES["op11_license_scan"](spark, table_dir(docs)).collect()] == [1, 1]


def test_shuffled_templates_are_not_found():
    index = licences.Index()
    for t in licences.TEMPLATES:
        words = t.text.split()[::-1]
        _, _, found, _ = licences.scan_texts(index, [" ".join(words).encode()])[0]
        assert t.label not in [label for _, label, _ in found]
