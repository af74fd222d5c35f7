import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslab.llm import chat
from corpuslab.llm.queries import QUERIES
from tests.conftest import SMALL

PIECES = chat.CONTROLS + ["\\", "\\\\", " ", "a", "\n", "é", "[", "<", "/INST]", "user", "assistant"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=9).map("".join)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXT), TEXT), max_size=4))
def test_round_trip(turns):
    rendered = "".join(chat.format_turn(r, t) for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(rendered)] == turns


def test_plain_text_is_not_escaped():
    assert chat.format_turn("user", "hi \\ there [x]") == "<s>[INST] hi \\ there [x] [/INST]"
    assert chat.format_turn("user", "see </s>") == "<s>[INST] see \\</s> [/INST]"


def expected(turns):
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def check(rows, source):
    convs = {}
    for c, n, r, t in sorted(source, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0)):
        convs.setdefault(c, []).append((r or "", t or ""))
    convs[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: tuple(r)[1:5] for r in rows}
    assert got == {c: expected(t) for c, t in convs.items()}


def test_query(spark):
    src = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = QUERIES["op5_chat_format"](spark, SMALL).collect()
    check(rows, src)
    assert all(r["formatted_chars"] >= r["loss_chars"] for r in rows)


def test_odd_rows(spark, table_dir):
    src = [(1, 0, "user", None), (1, 1, "assistant", "</s> \\"), (1, 2, None, "x"), (2, 5, "tool [TEXT]", "[/ROLE]\\"),
           (None, 0, "user", "no conversation"), (3, None, "user", "first"), (3, 0, "assistant", "é" * 50_000)]
    df = spark.createDataFrame([s + ("own",) for s in src], "conv_id long, turn long, role string, text string, formatted string")
    check(QUERIES["op5_chat_format"](spark, table_dir(df, "conversations")).collect(), src)
    twice = chat.read_back(chat.format_turns(df.unionByName(df))).collect()
    assert {r["conv_id"]: r["n_turns"] for r in twice}[1] == 6
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_loss_spans(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "[OUT] a"), (1, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    rows = chat.loss_spans(chat.format_turns(df)).collect()
    by = {r["turn"]: r for r in rows}
    (a, b), = by[0]["loss_spans"]
    assert by[0]["formatted"][a:b] == "\\[OUT] a" and by[1]["loss_spans"] == []
