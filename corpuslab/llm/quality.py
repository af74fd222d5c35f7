"""Quality rules: a threshold table compiled into one Spark projection.

Each row of ``RULES`` names a measure and the interval in which a text passes.
``compile_rules`` turns the table into one boolean expression over one struct of
measures, so a scan with one projection evaluates everything; there is no user
function and no shuffle.

Contract: a null text has no words and no lines; ratios over nothing are 0; a
text is judged whole, whatever its length; repeated rows are judged alike;
an empty table stays empty; input columns named like a measure are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import let
from .words import BLANK_RUN, words

# Very common words of the corpus languages.
STOP_WORDS = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on", "are", "with", "be",
              "der", "die", "und", "den", "von", "zu", "das", "nicht", "für", "auf", "ist", "ein", "eine", "in",
              "de", "la", "le", "les", "et", "des", "en", "un", "une", "du", "que", "pour", "dans",
              "el", "los", "las", "del", "se", "y", "por", "con", "para", "su"]


@dataclass(frozen=True)
class Rule:
    measure: str
    low: float | None
    high: float | None


BASE_RULES = (
    Rule("n_words", 50, None),
    Rule("repeat_ratio", None, 0.5),
)

RULES = (
    Rule("mean_word_chars", 2, 15),
    Rule("symbol_ratio", None, 0.3),
    Rule("upper_ratio", None, 0.5),
    Rule("stop_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("words_per_line", 1.5, None),
)


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more: window hashes are sorted with
    their positions, so equal windows are neighbours (no comparison of all pairs)."""
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        met = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                       | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(met, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    some = let(grams, lambda g: F.when(F.size(F.array_distinct(F.transform(g, lambda x: x["h"]))) == F.size(g), F.lit(0))
               .otherwise(let(F.sort_array(g), covered)))
    return F.when(F.size(w) >= 3, some).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """One struct with the counts of a text."""
    t = F.coalesce(text, F.lit(""))
    chars = F.char_length(t)

    def per_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"))

    def per_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"),
                        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return F.struct(
        let(words(t), per_words).alias("w"), let(lines, per_lines).alias("l"),
        F.char_length(F.regexp_replace(t, BLANK_RUN, "")).cast("long").alias("word_chars"),
        (chars - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (chars - F.char_length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long").alias("n_upper"))


def with_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    made = {}
    m = F.col("_q")
    for name, e in {"n_words": m["w"]["n_words"], "word_chars": m["word_chars"], "n_symbols": m["n_symbols"],
                    "n_dup_lines": m["l"]["n_dup_lines"], "n_repeat_words": m["w"]["n_repeat_words"],
                    "n_lines": m["l"]["n_lines"], "n_stop_words": m["w"]["n_stop_words"], "n_upper": m["n_upper"]}.items():
        made[name] = e
    return (df.withColumn("_q", measures(F.col(text_col)))
            .select(*[c for c in df.columns if c not in made], *[e.alias(n) for n, e in made.items()]))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


RATIOS = {"mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"),
          "upper_ratio": ("n_upper", "word_chars"), "stop_ratio": ("n_stop_words", "n_words"),
          "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"),
          "words_per_line": ("n_words", "n_lines")}


def compile_rules(rules) -> Column:
    """True where every rule of the table holds."""
    out = F.lit(True)
    for r in rules:
        value = _ratio(*RATIOS[r.measure]) if r.measure in RATIOS else F.col(r.measure)
        if r.low is not None:
            out = out & (value >= F.lit(r.low))
        if r.high is not None:
            out = out & (value <= F.lit(r.high))
    return out


def judge(df: DataFrame, text_col: str = "text", base=BASE_RULES, rules=RULES) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every text."""
    m = with_measures(df, text_col)
    return m.withColumn("base_failed", ~compile_rules(base)).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
