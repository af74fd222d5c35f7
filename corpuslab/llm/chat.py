"""Chat formatting with a grammar round trip.

A turn is rendered as opener, body, closer by its role:

    user       <s>[INST] body [/INST]
    assistant  [OUT] body </s>
    any other  [ROLE] role [TEXT] body [/ROLE]

(one space at each inner edge).  The grammar's control strings are ``CONTROLS``.
Inside a body or role a control string is written with a backslash in front of
it, and backslashes that stand before a control string (or at the end of a body,
before the closer's control string) are doubled, so that the parser can tell
content from markup: an odd run of backslashes before a control string makes it
content.

Escaping is not done blindly.  A turn is rendered raw, parsed again by the
deterministic parser and compared with its source; if role, text or the parser's
end state differ, conflicting content is escaped and the turn is rendered again
until they are identical.  A turn's rendering starts and ends in the parser's
start state, so a conversation is the concatenation of its turns' renderings and
its parse the concatenation of their parses.

Contract: null text and null role are empty strings; turns are ordered by
(turn, role, text), null turns first; a null conv_id is a conversation of its
own; repeated rows are separate turns; an empty table stays empty.  Rendering
runs where the turns lie; only the digests stream one conversation's turns in
order, holding one turn at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The control strings of the template.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[TEXT]", "[/ROLE]"]
_CONTROL = "|".join(re.escape(c) for c in CONTROLS)
MARK = re.compile(rf"(?<!\\)(\\*+)({_CONTROL})")
TAIL = re.compile(r"(?<!\\)\\++\Z")


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    text = MARK.sub(lambda m: m[1] * 2 + "\\" + m[2], text)
    return TAIL.sub(lambda m: m[0] * 2, text)


def render_turn(role: str, text: str, escape_role: bool = False, escape_text: bool = False) -> str:
    body = escape(text) if escape_text else text
    if role == "user":
        return f"<s>[INST] {body} [/INST]"
    if role == "assistant":
        return f"[OUT] {body} </s>"
    return f"[ROLE] {escape(role) if escape_role else role} [TEXT] {body} [/ROLE]"


def _until(text: str, at: int, closer: str) -> tuple[str, int, int]:
    """(content, its end, index after the closer); content runs to the first
    control string that is not escaped, which must be the closer after a space."""
    out: list[str] = []
    begin = at
    while True:
        m = MARK.search(text, at)
        if not m:
            raise GrammarError("unclosed")
        slashes = len(m[1])
        out.append(text[at:m.start()])
        if slashes % 2:
            out.append("\\" * (slashes // 2) + m[2])
            at = m.end()
            continue
        if m[2] != closer:
            raise GrammarError(f"{m[2]} in content")
        out.append("\\" * (slashes // 2))
        content = "".join(out)
        if slashes or not content.endswith(" ") or m.start() - 1 < begin:
            raise GrammarError("no space before the closer")
        content = content[:-1]
        tail = TAIL.search(content)
        if tail:                                       # a final run of backslashes was doubled
            if len(tail[0]) % 2:
                raise GrammarError("odd run of backslashes at the end")
            content = content[:len(content) - len(tail[0]) // 2]
        return content, m.start() - 1, m.end()


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start and end of the body in the rendering) of every turn."""
    at = 0
    while at < len(text):
        if text.startswith("<s>[INST] ", at):
            body, end, nxt = _until(text, at + 10, "[/INST]")
            yield "user", body, at + 10, end
        elif text.startswith("[OUT] ", at):
            body, end, nxt = _until(text, at + 6, "</s>")
            yield "assistant", body, at + 6, end
        elif text.startswith("[ROLE] ", at):
            role, _, mid = _until(text, at + 7, "[TEXT]")
            if not text.startswith(" ", mid):
                raise GrammarError("no space after [TEXT]")
            body, end, nxt = _until(text, mid + 1, "[/ROLE]")
            if role in ("user", "assistant"):
                raise GrammarError("a plain role in the general form")
            yield role, body, mid + 1, end
        else:
            raise GrammarError("no opener")
        at = nxt


def _reads_back(rendered: str, role: str, text: str) -> bool:
    try:
        return [(r, t) for r, t, _, _ in parse(rendered)] == [(role, text)]
    except GrammarError:
        return False


def format_turn(role: str, text: str) -> str:
    """Render, reparse, compare; escape conflicting content until identical."""
    for escape_role, escape_text in ((False, False), (False, True), (True, False), (True, True)):
        rendered = render_turn(role, text, escape_role, escape_text)
        if _reads_back(rendered, role, text):
            return rendered
    raise GrammarError(f"no rendering of a turn of {role!r} reads back")


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", formatted_col: str = "formatted") -> DataFrame:
    """Rows (conv_id, turn, formatted): a conversation's formatted text is the
    concatenation of its rows by turn (ties: by role and text, ``tie``)."""
    src = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                    F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([src.schema["conv_id"], src.schema["turn"], T.StructField("tie", T.StringType()),
                           T.StructField(formatted_col, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            made = [format_turn(r, t) for r, t in zip(roles, texts)]
            ties = [r + "\n" + hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for r, t in zip(roles, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ties, pa.string()),
                                              pa.array(made, pa.string())],
                                             names=["conv_id", "turn", "tie", formatted_col])

    return src.mapInArrow(work, schema)


DIGESTS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def read_back(formatted: DataFrame, formatted_col: str = "formatted") -> DataFrame:
    """Parse the formatted conversations and digest what was read: turns, the
    text under the loss mask (assistant bodies, unescaped) and lengths."""
    ordered = (formatted.repartition("conv_id")
               .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "tie"))
    schema = T.StructType([formatted.schema["conv_id"], T.StructField("n_turns", T.LongType()),
                           T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                           T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    conv_type = pa.int64() if schema["conv_id"].dataType == T.LongType() else None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) if k else pa.array(c) for c, k in zip(cols, kinds)], names=DIGESTS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_conv, state, done = None, None, []

        def close() -> tuple:
            turns, loss, n, n_loss, chars = state
            return open_conv[0], n, turns.hexdigest(), n_loss, loss.hexdigest(), chars

        for batch in batches:
            convs = batch.column(batch.schema.get_field_index("conv_id"))
            texts = batch.column(batch.schema.get_field_index(formatted_col))
            for i in range(batch.num_rows):
                conv = (convs[i].as_py(),)
                if conv != open_conv:
                    if state:
                        done.append(close())
                        if len(done) >= 4096:
                            yield batch_of(done)
                            done = []
                    open_conv, state = conv, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                text = texts[i].as_py()
                for role, body, _, _ in parse(text):
                    state[0].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    state[2] += 1
                    if role == "assistant":
                        state[1].update(body.encode("utf-8", "surrogatepass"))
                        state[3] += len(body)
                state[4] += len(text)
        if state:
            done.append(close())
        if done:
            yield batch_of(done)

    return ordered.mapInArrow(work, schema)


def loss_spans(formatted: DataFrame, formatted_col: str = "formatted", spans_col: str = "loss_spans") -> DataFrame:
    """Add, per rendered turn, the [start, end) of its assistant bodies in it."""
    @F.udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
    def spans(text: str):
        return [(a, b) for role, _, a, b in parse(text or "") if role == "assistant"]

    return formatted.withColumn(spans_col, spans(F.col(formatted_col)))
