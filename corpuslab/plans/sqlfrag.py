"""DuckDB SQL fragments shared by the oracle statements.

They restate the library contracts (same fixed word lists and rules) in plain
SQL so that the oracle is an independent computation of the same definition.
"""

from __future__ import annotations

from ..functions.text import BASIC_ENGLISH_RULES, STOPWORDS_EN
from ..operators.lemma import NOUN_RULES, RARER


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


SW = str_list(STOPWORDS_EN)


def md5key(col: str, seed: int = 42) -> str:
    return f"md5(CAST({col} AS VARCHAR) || '|{seed}')"


def uniform(expr_parts: list, seed: int = 42) -> str:
    """Same draw as functions.hashing.uniform: first 32 bits of md5(parts|seed) / 2^32."""
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in expr_parts)
    return f"(CAST(('0x' || substr(md5({joined} || '|{seed}'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def clean_tokens(text: str) -> str:
    """T1 -> T2 -> T3 -> T4 on ``text``."""
    return (f"list_filter(regexp_extract_all(lower(regexp_replace({text}, '[^a-zA-Z]', ' ', 'g')), '\\S+'), "
            f"lambda t: NOT list_contains({SW}, t))")


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '\\S+')"


def word_count(text: str) -> str:
    return f"coalesce(len(regexp_extract_all({text}, '\\S+')), 0)"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def basic_english(text: str) -> str:
    x = f"lower({text})"
    for pat, rep in BASIC_ENGLISH_RULES:
        x = f"regexp_replace({x}, {lit(pat)}, {lit(rep)}, 'g')"
    return words(x)


def lemma_candidates_sql(words_rel: str) -> str:
    """Rows (word, cand, cpos) for every distinct word of relation ``words_rel(word)``."""
    parts = [f"SELECT word, word AS cand, 0 AS cpos FROM {words_rel}"]
    for i, (old, new) in enumerate(NOUN_RULES, start=1):
        parts.append(f"SELECT word, left(word, length(word) - {len(old)}) || {lit(new)} AS cand, {i} AS cpos "
                     f"FROM {words_rel} WHERE suffix(word, {lit(old)})")
    return "\nUNION ALL ".join(parts)


def lemma_map_ctes(tokens_rel: str, tokens_col: str, key: str = "doc_id") -> str:
    """CTEs ex(key,pos,word), lexw(word), w(word), lemmap(word, lemma) for a token relation."""
    return f"""
ex AS MATERIALIZED (SELECT {key}, unnest({tokens_col}) AS word, generate_subscripts({tokens_col}, 1) AS pos FROM {tokens_rel}),
lexw AS MATERIALIZED (SELECT word, count(*) AS freq FROM ex GROUP BY word HAVING count(*) >= 2),
w AS MATERIALIZED (SELECT DISTINCT word FROM ex),
cand AS ({lemma_candidates_sql('w')}),
best AS (SELECT word, cand AS lemma,
                row_number() OVER (PARTITION BY word ORDER BY length(cand), cpos, cand) AS rn
         FROM (SELECT c.word, c.cand, c.cpos FROM cand c JOIN lexw s ON s.word = c.cand LEFT JOIN lexw o ON o.word = c.word
               WHERE coalesce(o.freq, 0) <= {RARER} * s.freq)),
lemmap AS (SELECT w.word, coalesce(b.lemma, w.word) AS lemma FROM w LEFT JOIN best b ON b.word = w.word AND b.rn = 1)"""
