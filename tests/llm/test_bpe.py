import base64
import hashlib
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")

from corpuslab.llm import bpe  # noqa: E402
from corpuslab.llm.codepoints import LETTER, NUMBER, class_table  # noqa: E402

PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts):
    b = bpe.load_bpe(PATH)
    ids, counts = b.encode_texts(texts)
    out, at = [], 0
    for n in counts:
        out.append(ids[at:at + n].tolist())
        at += n
    assert bytes(b.decode_ids(ids)) == "".join(texts).encode()
    return out


PIECES = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "a", "Ab", "é", "1", "22", "!", " ", "漢",
          "😀", "'s", "'re", "…", "\r\n", "''", "ß", "٣", "é", " ", "the", " the"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), min_size=1, max_size=4))
def test_ids_equal_the_library(library, texts):
    assert encode(texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    assert encode([text]) == [library.encode_ordinary(text)]


def test_long_runs(library):
    for t in ["a" * 4000, "ab" * 2500, " " * 3000 + "x", "é" * 1500, "abc" * 300 + "\n" * 400, "1" * 999]:
        assert encode([t]) == [library.encode_ordinary(t)]


def test_full_cache_is_cleaned(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    for k in range(5):
        t = " ".join(f"w{k}x{i} the" for i in range(40))
        assert encode([t]) == [library.encode_ordinary(t)]


def test_classes_follow_the_library():
    table = class_table()
    ranks, n = {bytes([b]): b for b in range(256)}, 256
    for b in range(256):
        for x in (b"a", b"1"):
            ranks[bytes([b]) + x] = n
            n += 1
    probe = tiktoken.Encoding("probe", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for c in [*range(0x80, 0x3000, 7), *range(0x1C80, 0x1C90), *range(0x10D40, 0x10D90), *range(0x16D40, 0x16D80)]:
        if 0xD800 <= c < 0xE000 or unicodedata.category(chr(c)) == "Cs":
            continue
        letter = probe.encode_ordinary(chr(c) + "a")[-1] >= 256
        number = not letter and probe.encode_ordinary(chr(c) + "1")[-1] >= 256
        assert (table[c] == LETTER, table[c] == NUMBER) == (letter, number), hex(c)


def test_operator(spark, make_docs, library):
    texts = [None, "", "Hello world's end", "x" * 5000 + " \n\n y", "Hello world's end"]
    df = make_docs([(i, t) for i, t in enumerate(texts)], extra=["ids", "offsets"])
    coded = bpe.encode(df, PATH, decoded_col="decoded", keep_text=True)
    back = {r["doc_id"]: bytes(r["again"]) for r in bpe.decode(coded.select("doc_id", "ids"), PATH, bytes_col="again").collect()}
    for r in coded.collect():
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(t)
        assert bytes(r["decoded"]) == back[r["doc_id"]] == t.encode()
        assert len(r["offsets"]) == len(r["ids"]) and r["source"] == "s"
        ends = r["offsets"][1:] + [len(t.encode())]
        assert [t.encode()[a:b] for a, b in zip(r["offsets"], ends)] == [library.decode_single_token_bytes(i) for i in r["ids"]]


def test_query(spark, make_docs, table_dir, library):
    from corpuslab.llm.queries import QUERIES
    texts = {1: None, 2: "", 3: "a b c", 4: "Ünï çödé 12"}
    got = QUERIES["op2_byte_bpe"](spark, table_dir(make_docs(list(texts.items())))).collect()
    assert len(got) == 4
    for r in got:
        t = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(t)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_empty_table(spark, make_docs):
    assert bpe.encode(make_docs([]), PATH).count() == 0
