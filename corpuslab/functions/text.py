"""String and token scalar functions.

All of them are Column -> Column compositions of built-in expressions, so they
stay inside the JVM; the array lambdas (stop-word filter) are kept in their own
projection by the callers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop-word list of NLTK 3.7 (the list the cleaning
# step removes), in the corpus' own order.
STOPWORDS_EN = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him",
    "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's", "its",
    "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who",
    "whom", "this", "that", "that'll", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of",
    "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in",
    "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should",
    "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't",
    "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn",
    "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn",
    "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]

# The "basic_english" normaliser (lower-case first, then these
# pattern -> replacement steps in this order, then split on whitespace).
BASIC_ENGLISH_RULES = [
    (r"'", " '  "),
    (r'"', ""),
    (r"\.", " . "),
    (r"<br \/>", " "),
    (r",", " , "),
    (r"\(", " ( "),
    (r"\)", " ) "),
    (r"\!", " ! "),
    (r"\?", " ? "),
    (r"\;", " "),
    (r"\:", " "),
    (r"\s+", " "),
]

WS_TOKEN = r"\S+"
# Unicode word characters written as explicit classes so the JVM and RE2 agree.
WORD_CHARS = r"\p{L}\p{N}_"
TFIDF_TOKEN = r"[\p{L}\p{N}_]{2,}"
WORD_OR_PUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c) -> Column:
    """P10: cast to string; nulls stay null (documented deviation from str(None))."""
    return _c(c).cast("string")


def letters_only(c) -> Column:
    """Every character outside [a-zA-Z] becomes one space."""
    return F.regexp_replace(_c(c), r"[^a-zA-Z]", " ")


def lower(c) -> Column:
    """T2."""
    return F.lower(_c(c))


def words(c) -> Column:
    """Whitespace split without empty tokens (Python ``str.split()``)."""
    return F.regexp_extract_all(_c(c), F.lit(WS_TOKEN), 0)


def word_count(c) -> Column:
    """Number of whitespace-separated words; null text counts 0."""
    return F.coalesce(F.regexp_count(_c(c), F.lit(WS_TOKEN)), F.lit(0)).cast("long")


def drop_stopwords(tokens, stopwords=None) -> Column:
    """Keep tokens not in the (small, literal) stop-word list.

    A literal IN list becomes a hash-set lookup (InSet) in Catalyst, so the
    cost per token does not grow with the list."""
    sw = list(stopwords or STOPWORDS_EN)
    return F.filter(_c(tokens), lambda t: ~t.isin(sw))


def join_words(tokens, sep: str = " ") -> Column:
    """T5."""
    return F.array_join(_c(tokens), sep)


def strip(c) -> Column:
    """Trim every whitespace character at both ends."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def basic_english(c) -> Column:
    """Lower-case, apply the fixed rules in order, split on whitespace."""
    x = F.lower(_c(c))
    for pat, rep in BASIC_ENGLISH_RULES:
        x = F.regexp_replace(x, pat, rep)
    return words(x)


def word_tokens(c) -> Column:
    """Words and single punctuation marks as separate tokens."""
    return F.regexp_extract_all(_c(c), F.lit(WORD_OR_PUNCT), 0)


def tfidf_tokens(c) -> Column:
    """Lower-case words of two or more word characters."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TFIDF_TOKEN), 0)


SENTENCE_BREAK = "\u0001"


def sentences(c) -> Column:
    """Split after '.', '!' or '?' followed by whitespace; empty pieces dropped.

    The break is marked with a control character and then split on, so no
    look-behind is needed (the same rule runs in RE2-based engines)."""
    marked = F.regexp_replace(strip(_c(c)), r"([.!?])\s+", "$1" + SENTENCE_BREAK)
    return F.filter(F.split(marked, SENTENCE_BREAK), lambda s: F.length(s) > 0)


def newline_sentences(c) -> Column:
    """Strip, split into sentences, join them by newlines (what ROUGE-Lsum reads)."""
    return F.array_join(sentences(c), "\n")


def lead_sentence(c) -> Column:
    """First sentence (up to the first terminator followed by space or end);
    the whole stripped text when there is no terminator."""
    t = strip(_c(c))
    first = F.regexp_extract(t, r"(?s)^(.*?[.!?])(\s|$)", 1)
    return F.when(F.length(first) > 0, first).otherwise(t)


def token_count(tokens) -> Column:
    """T22."""
    return F.size(_c(tokens)).cast("long")
