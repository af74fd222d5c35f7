"""Visible-text extraction from raw HTML (T14), block-list (T15), URL repair.

Contract of ``extract_nodes`` (our pinned parsing rule, golden-tested):

1. ``<script>`` / ``<style>`` elements and comments are removed; each leaves a
   node boundary behind.
2. The rest is split into tags and text runs.  A fold keeps a stack of open
   element names: a start tag pushes its lower-cased name, except void elements
   and self-closed tags; the start tag of a paragraph or other block
   (``P_CLOSERS``) first closes an open ``<p>`` (and everything opened inside
   it); an end tag pops up to its most recent match and is ignored when nothing
   matches.
3. A text run is kept when the element on top of the stack (its direct parent)
   is one of ``p``, ``em``, ``i``, ``b``; entities are decoded.

The fold is a single ``aggregate`` expression, so extraction is a map-only stage
over the page table with no Python worker.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import let

# The allow-list of parent elements and the default block-list terms.
ALLOWED_PARENTS = ["p", "em", "i", "b"]
BLOCKED_TERMS = ["Sign Up", "HuffPost", "Huffington"]

# HTML void elements (never pushed on the stack).
VOID_ELEMENTS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
                 "param", "source", "track", "wbr"]

# Start tags that close an open ``<p>``.
P_CLOSERS = ["address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
             "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main",
             "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"]

# Named character references, from the standard library's table; the few that
# make up nearly all references are looked up first.
COMMON_ENTITIES = ["amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "middot", "rsquo", "lsquo", "rdquo", "ldquo", "mdash",
                   "ndash", "hellip", "eacute"]
ENTITIES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
REFERENCE = "&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
# Code points 128-159 stand for the Windows-1252 characters, as in the HTML standard.
C1_TEXT = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))
REPLACEMENT = "\ufffd"

NOISE = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
TOKEN = r"<[/!?a-zA-Z][^>]*>|[^<]+|<"
START_NAME = r"^<([a-zA-Z][a-zA-Z0-9]*)"
END_NAME = r"^</\s*([a-zA-Z][a-zA-Z0-9]*)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _codepoint_char(code: Column) -> Column:
    """Character of a code point (any plane); U+FFFD where there is none."""
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (F.when(~F.coalesce(valid, F.lit(False)), F.lit(REPLACEMENT))
            .when(code.between(128, 159), F.substring(F.lit(C1_TEXT), (code - 127).cast("int"), F.lit(1))).otherwise(char))


def _reference_text(ref: Column) -> Column:
    """What a reference (without & and ;) stands for; an unknown name stays as it was."""
    digits = F.regexp_replace(ref, "^#[xX]?0*", "")
    # more digits than any code point has: no cast, no overflow, no character
    decimal = F.when(F.length(digits).between(1, 7), digits.try_cast("long"))
    hexa = F.when(F.length(digits).between(1, 6), F.conv(digits, 16, 10).try_cast("long"))
    named = F.lit(None).cast("string")
    for name in reversed(COMMON_ENTITIES):
        named = F.when(ref == name, F.lit(ENTITIES[name])).otherwise(named)
    table = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")
    known = F.coalesce(named, F.try_element_at(table, ref), F.concat(F.lit("&"), ref, F.lit(";")))
    return (F.when(ref.rlike("^#[xX]"), _codepoint_char(hexa)).when(ref.startswith("#"), _codepoint_char(decimal))
            .otherwise(known))


def decode_entities(c) -> Column:
    """Character references decoded in one pass, so decoded text is not decoded
    again; malformed and out-of-range references never fail a row."""
    s = _c(c)

    def decoded(refs: Column) -> Column:
        return let(F.split(s, REFERENCE, -1), lambda gaps: F.array_join(F.concat(F.array(F.get(gaps, F.lit(0))), F.transform(
            refs, lambda r, i: F.concat(_reference_text(r), F.get(gaps, i + 1)))), ""))

    return F.when(F.contains(s, F.lit("&")), let(F.regexp_extract_all(s, F.lit(REFERENCE), 1), decoded)).otherwise(s)


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _pop_to(stack: Column, name: Column) -> Column:
    """Stack with the most recent ``name`` and everything above it removed."""
    last = F.size(stack) - F.array_position(F.reverse(stack), name) + 1
    return F.slice(stack, F.lit(1), (last - 1).cast("int"))


def extract_nodes(html) -> Column:
    """Array of kept text nodes (entity-decoded), in document order."""
    allowed = _lit_array(ALLOWED_PARENTS)
    void, closers = _lit_array(VOID_ELEMENTS), _lit_array(P_CLOSERS)
    clean = F.regexp_replace(_c(html), NOISE, "<!>")
    tokens = F.regexp_extract_all(clean, F.lit(TOKEN), 0)
    init = F.struct(F.array().cast(T.ArrayType(T.StringType())).alias("stack"),
                    F.array().cast(T.ArrayType(T.StringType())).alias("out"),
                    F.lit("").alias("cur"))

    def flush(acc):
        parent = F.try_element_at(acc["stack"], F.lit(-1))
        keep = (F.length(acc["cur"]) > 0) & F.coalesce(F.array_contains(allowed, parent), F.lit(False))
        return F.when(keep, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])

    def step(acc, tok):
        is_tag = tok.startswith("<") & (F.length(tok) > 1)
        end_name = F.lower(F.regexp_extract(tok, END_NAME, 1))
        start_name = F.lower(F.regexp_extract(tok, START_NAME, 1))
        st = acc["stack"]
        after_end = F.when(F.array_contains(st, end_name), _pop_to(st, end_name)).otherwise(st)
        closes = F.array_contains(closers, start_name) & F.array_contains(st, F.lit("p"))
        base = F.when(closes, _pop_to(st, F.lit("p"))).otherwise(st)
        pushes = (F.length(start_name) > 0) & ~F.array_contains(void, start_name) & ~tok.endswith("/>")
        after_start = F.when(pushes, F.concat(base, F.array(start_name))).otherwise(base)
        new_stack = (F.when(F.length(end_name) > 0, after_end)
                     .when(F.length(start_name) > 0, after_start)
                     .otherwise(st))
        on_tag = F.struct(new_stack.alias("stack"), flush(acc).alias("out"), F.lit("").alias("cur"))
        on_text = F.struct(st.alias("stack"), acc["out"].alias("out"), F.concat(acc["cur"], tok).alias("cur"))
        return F.when(is_tag, on_tag).otherwise(on_text)

    raw_nodes = F.aggregate(tokens, init, step, lambda acc: flush(acc))
    return F.transform(raw_nodes, lambda n: decode_entities(n))


def drop_blocked(nodes, terms=None) -> Column:
    """Drop nodes containing any block-list term (case-sensitive substring)."""
    t = _lit_array(terms or BLOCKED_TERMS)
    return F.filter(_c(nodes), lambda n: ~F.exists(t, lambda term: F.contains(n, term)))


def extract_body(html, terms=None) -> Column:
    """T14 + T15 + T5: kept nodes joined by one space."""
    return F.array_join(drop_blocked(extract_nodes(html), terms), " ")


def extract_title(html) -> Column:
    """The page ``<title>`` (entity-decoded, stripped): the headline of a page."""
    raw = F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title", 1)
    return F.regexp_replace(decode_entities(raw), r"^\s+|\s+$", "")


def repair_url(url) -> Column:
    """T16, general form: a URL carrying a second full URL (an origin prefixed to
    it) is cut to start at the second scheme; others are unchanged."""
    u = _c(url)
    second = F.locate("http", u, 2)
    return F.when(second > 1, F.substring(u, second, F.length(u))).otherwise(u)


def drop_prefix(url, offset: int = 30) -> Column:
    """T16 literal form: drop the first ``offset`` characters."""
    return F.substring(_c(url), offset + 1, 1 << 30)
