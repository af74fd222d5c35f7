"""Personal data by bootstrapped contextual extraction, in the JVM.

Base entities (e-mail, IP, card, phone) come from fixed patterns with checks.
Their spans are found without user functions: ``split`` gives the gaps between
matches, ``regexp_extract_all`` the matches, and a blocked prefix sum over their
lengths the code-point positions.

The bootstrapping adds identifiers that no fixed pattern knows:

1. Every run of identifier-like words (with a digit or @) is a candidate instance; one
   that contains a base entity is a seed.
2. The words before a candidate (the last one, the last two) and a key inside
   its first word (``token=``) are its lexical patterns.  Patterns that precede
   fewer than ``MIN_INSTANCES`` different candidates are not specific enough.
   For the others all their occurrences in the corpus are counted.
3. Over the graph of patterns and instances, repeated until a round adds
   nothing: a pattern's confidence is the share of its occurrences that
   an accepted instance follows; patterns of at least ``MIN_INSTANCES`` accepted
   instances and ``MIN_CONFIDENCE`` are trusted; an instance's score is the
   noisy-or over its trusted patterns; instances above ``MIN_SCORE`` are accepted
   and induce further patterns in the next round.

Accepted instances that are no base entity are reported as kind ``id``; base
spans always stay.

Contract: a null text is the empty text (no spans); whole texts are searched;
every row is a document, repeated rows each get their spans; an empty table
stays empty; input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import let
from ..session import cut_lineage
from .bitmap import bitmap_filter
from .words import BLANKS, words

# The base patterns of the contract.  The quantifiers are made
# possessive and a match may only begin where a run begins (or where the last
# match ended), which finds the same leftmost matches in linear time.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(BASE)
ADDED = "id"
_BLANK = r"\x20\x09-\x0D"
# A run of words with a digit or an at sign, joined by single blanks.
_WORD = rf"[^{_BLANK}0-9@]*+[0-9@][^{_BLANK}]*+"
CANDIDATE = rf"(?<![^{_BLANK}]){_WORD}(?:\x20{_WORD})*+"
KEY = r"^[\"'(\[{<]*([A-Za-z][A-Za-z0-9_.-]*[=:])"
NEAR_CHARS = 80            # characters in which context words are looked for first
MIN_DIGITS = 2
MIN_ALNUM = 5
MIN_INSTANCES = 3
MIN_CONFIDENCE = 0.5
MIN_SCORE = 0.5
BLOCK = 256
FILTER_BITS = 1 << 18      # bits of the filter on patterns when the corpus is counted


def prefix_sums(values: Column) -> Column:
    """Exclusive running sums of an int array, block by block (an append per
    element only copies its block)."""
    def running(v: Column, first: Column) -> Column:
        return F.aggregate(v, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")),
                           lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
                           lambda a: a["out"])

    def blocked(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")),
                             lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        def of(bs: Column) -> Column:
            totals = F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
            return F.flatten(F.zip_with(bs, running(totals, F.lit(0)), lambda b, first: running(b, first)))
        return let(blocks, of)

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).when(
        F.size(values) <= BLOCK, running(values, F.lit(0))).otherwise(blocked(values))


def located(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` as (start, end, match, gap): code points, and
    the text between the match before and this one."""
    none = F.array().cast("array<struct<start:int,end:int,match:string,gap:string>>")

    def with_gaps(ms: Column) -> Column:
        def place(gaps: Column) -> Column:
            pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(ms)), ms,
                               lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
            def out(ps: Column) -> Column:
                firsts = prefix_sums(F.transform(ps, lambda p: F.char_length(p["gap"]) + F.char_length(p["match"])))
                return F.zip_with(ps, firsts, lambda p, at: F.struct(
                    (at + F.char_length(p["gap"])).alias("start"),
                    (at + F.char_length(p["gap"]) + F.char_length(p["match"])).alias("end"),
                    p["match"].alias("match"), p["gap"].alias("gap")))
            return let(pairs, out)
        return F.when(F.size(ms) == 0, none).otherwise(let(F.split(text, pattern, -1), place))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_gaps)


def luhn(digits: Column) -> Column:
    rev = F.reverse(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda a, i: a + let(
        F.substring(rev, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
        lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]+", "")
    n = F.char_length(digits)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind>> sorted by start, then kind as listed."""
    return F.sort_array(F.concat(*[_spans_of(text, kind) for kind in KINDS]))


def _spans_of(text: Column, kind: str) -> Column:
    hits = F.filter(located(text, BASE[kind]), lambda m: _valid(kind, m["match"]))
    spans = F.transform(hits, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                                                 m["end"].alias("end"), F.lit(kind).alias("kind")))
    need = {"email": "@", "phone": "+"}.get(kind)
    if need is None:
        return spans
    return F.when(F.contains(text, F.lit(need)), spans).otherwise(
        F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))


def _last_words(gap: Column) -> tuple[Column, Column]:
    """The last word of a text and the one before it, lower-cased; "" where there is none.
    Mostly they stand in its last characters; where one of them may begin earlier, the
    whole text is looked at."""
    near = F.substring(gap, F.lit(-NEAR_CHARS), F.lit(NEAR_CHARS))
    whole = F.char_length(gap) <= NEAR_CHARS
    both = rf"[{_BLANK}][^{_BLANK}]+[{_BLANK}]+[^{_BLANK}]+[{_BLANK}]*$"
    plain = F.rtrim(F.translate(gap, BLANKS, " " * len(BLANKS)))
    far_last = F.substring_index(plain, " ", -1)
    rest = F.rtrim(F.substring(plain, F.lit(1), F.char_length(plain) - F.char_length(far_last)))
    seen = whole | near.rlike(both)
    last = F.when(seen, F.regexp_extract(near, rf"([^{_BLANK}]+)[{_BLANK}]*$", 1)).otherwise(far_last)
    before = F.when(seen, F.regexp_extract(near, rf"([^{_BLANK}]+)[{_BLANK}]+[^{_BLANK}]+[{_BLANK}]*$", 1)).otherwise(
        F.substring_index(rest, " ", -1))
    return F.lower(last), F.lower(before)


def candidates(text: Column) -> Column:
    """array<struct<start, end, instance, word, pair, key>> of identifier-like runs."""
    def one(m: Column) -> Column:
        token = m["match"]
        key = F.regexp_extract(token, KEY, 1)
        lead = F.char_length(F.regexp_extract(F.substring(token, F.char_length(F.regexp_extract(token, KEY, 0)) + 1,
                                                          F.char_length(token)), r"^[\"'(\[{<]*", 0))
        skip = F.char_length(F.regexp_extract(token, KEY, 0)) + lead
        tail = F.char_length(token) - F.char_length(F.rtrim(token, F.lit("\"')]}>.,;:!?")))
        last, before = _last_words(m["gap"])
        return F.struct((m["start"] + skip).alias("start"), (m["end"] - tail).alias("end"),
                        F.lower(F.substring(token, skip + 1, F.char_length(token) - skip - tail)).alias("instance"),
                        last.alias("word"), before.alias("before"), F.lower(key).alias("key"))

    found = F.transform(located(text, CANDIDATE), one)
    return F.filter(found, lambda c: (F.contains(c["instance"], F.lit("@"))
                                      | (F.char_length(F.regexp_replace(c["instance"], "[^0-9]+", "")) >= MIN_DIGITS))
                    & (F.char_length(F.regexp_replace(c["instance"], r"[^\p{L}\p{N}]+", "")) >= MIN_ALNUM))


def _patterns(c: str) -> Column:
    word, before, key = F.col(f"{c}.word"), F.col(f"{c}.before"), F.col(f"{c}.key")
    return F.filter(F.array(
        F.when(key != "", F.concat(F.lit("k:"), key)),
        F.when((key == "") & (word != ""), F.concat(F.lit("w:"), word)),
        F.when((key == "") & (before != ""), F.concat(F.lit("p:"), before, F.lit(" "), word))), lambda p: p.isNotNull())


def _occurrences(df: DataFrame, text_col: str, eligible: DataFrame, edges: DataFrame) -> DataFrame:
    """(pattern, total): how often an eligible pattern occurs in the corpus.

    Words are not shuffled: a bitmap of fixed size with the eligible patterns'
    hashes lets almost nothing else past the scan, and the exact join follows
    on what is left, counted map-side first.
    """
    may_be = bitmap_filter(eligible, "pattern", FILTER_BITS)
    w = df.select(F.transform(words(F.col(text_col)), lambda x: F.lower(x)).alias("w")).select(
        F.explode_outer(F.zip_with(F.concat(F.array(F.lit(None).cast("string")), F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))),
                                   F.col("w"), lambda b, x: F.struct(b.alias("b"), x.alias("x")))).alias("p")).select("p.b", "p.x")
    both = w.select(F.concat(F.lit("w:"), F.col("x")).alias("one"),
                    F.concat(F.lit("p:"), F.col("b"), F.lit(" "), F.col("x")).alias("two"))
    near = both.where(may_be(F.col("one")) | may_be(F.col("two")))
    seen = near.select(F.explode_outer(F.array("one", "two")).alias("pattern")).where(may_be(F.col("pattern")))
    in_text = (seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
               .join(eligible, "pattern", "left_semi"))
    in_key = edges.where(F.col("pattern").startswith("k:")).groupBy("pattern").agg(F.sum("n").alias("total"))
    return in_text.unionByName(in_key)


def accepted_instances(found: DataFrame, df: DataFrame, text_col: str) -> DataFrame | None:
    """Instances that trusted patterns accept and that are no seed; None if there
    are none.  ``found``: one row per candidate with instance, seed, patterns."""
    edges = cut_lineage(found.select("instance", "seed", F.explode_outer("patterns").alias("pattern"))
                        .where(F.col("pattern").isNotNull())
                        .groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")))
    eligible = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances")).where(
        F.col("instances") >= MIN_INSTANCES).select("pattern")
    seeds = edges.groupBy("instance").agg(F.max("seed").alias("seed"))
    open_edges = edges.join(seeds.where("seed").select("instance"), "instance", "left_anti")
    hopeful = eligible.join(open_edges.select("pattern"), "pattern", "left_semi")   # may still discover something
    hopeful = cut_lineage(hopeful.distinct())
    if hopeful.isEmpty():
        return None
    graph = cut_lineage(edges.drop("seed").join(_occurrences(df, text_col, hopeful, edges), "pattern")
                        .join(seeds, "instance"))
    score = seeds.select("instance", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("score"))
    size = 0
    while True:                                                # accepted instances only grow
        weighed = graph.join(score, "instance")
        trusted = (weighed.groupBy("pattern").agg(
            (F.sum(F.when(F.col("score") >= MIN_SCORE, F.col("n")).otherwise(0)) / F.max("total")).alias("confidence"),
            F.count(F.when(F.col("score") >= MIN_SCORE, 1)).alias("accepted"))
            .where((F.col("accepted") >= MIN_INSTANCES) & (F.col("confidence") >= MIN_CONFIDENCE)))
        doubt = F.greatest(1 - F.least(F.col("confidence"), F.lit(1.0)), F.lit(1e-9))
        found_now = (graph.where(~F.col("seed")).join(trusted, "pattern").groupBy("instance")
                     .agg((1 - F.exp(F.sum(F.log(doubt)))).alias("score")))
        score = cut_lineage(seeds.where("seed").select("instance", F.lit(1.0).alias("score"))
                            .unionByName(found_now))
        added = score.where((F.col("score") >= MIN_SCORE)).join(seeds.where(~F.col("seed")), "instance", "left_semi")
        n = added.count()
        if n <= size:
            break
        size = n
    return added.select("instance") if n else None


def find(df: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, base, added): base spans and the spans that the patterns add, both
    array<struct<start, rank, end, kind>> sorted by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = cut_lineage(df.select(F.col(key_col), text.alias("_t")).select(
        key_col, F.monotonically_increasing_id().alias("_row"), base_spans(F.col("_t")).alias("base"),
        candidates(F.col("_t")).alias("cands")))
    one = scanned.where(F.size("cands") > 0).select("_row", "base", F.explode_outer("cands").alias("c"))
    inside = F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start")))
    found = one.select("_row", F.col("c.start").alias("start"), F.col("c.end").alias("end"),
                       F.col("c.instance").alias("instance"), inside.alias("seed"), _patterns("c").alias("patterns"))
    accepted = accepted_instances(found, df, text_col)
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    if accepted is None:
        return scanned.select(key_col, "base", empty.alias("added"))
    spans = (found.where(~F.col("seed")).join(accepted, "instance", "left_semi").groupBy("_row").agg(F.sort_array(
        F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(ADDED).alias("kind")))).alias("added")))
    return scanned.join(spans, "_row", "left").select(key_col, "base", F.coalesce("added", empty).alias("added"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                s["end"].cast("string"))), ",")
