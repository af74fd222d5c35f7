"""Porter stemmer with the usual extensions of the common Python toolkit.

A small per-word helper: operators call it once per distinct word.
"""

from __future__ import annotations

from functools import lru_cache

# Irregular forms.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
             "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
             "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
             "exceed": "exceed", "succeed": "succeed"}
# Fixed values: (suffix, replacement) of steps 2, 3 and the suffixes of step 4, in order.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
         ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
         ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
         ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
         "iti", "ous", "ive", "ize"]


def _consonant(w: str, i: int) -> bool:
    if w[i] in "aeiou":
        return False
    return w[i] != "y" or i == 0 or not _consonant(w, i - 1)


def _shape(w: str) -> str:
    out: list[str] = []
    for i, c in enumerate(w):
        vowel = c in "aeiou" or c == "y" and i > 0 and out[-1] == "c"
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    shape = _shape(w)
    return (len(w) >= 3 and shape[-3:] == "cvc" and w[-1] not in "wxy") or (len(w) == 2 and shape == "vc")


def _plural(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(old):
            return w[:len(w) - len(old)] + new
    return w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-3] + ("ie" if len(w) == 4 else "i")
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        if w.endswith(end) and _has_vowel(w[:-len(end)]):
            stem = w[:-len(end)]
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _cvc(stem) else stem
    return w


def _final_y(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and len(w) > 2 and _consonant(w, len(w) - 2) else w


def _replaced(w: str, rules) -> str:
    for old, new in rules:
        if w.endswith(old):
            stem = w[:len(w) - len(old)]
            if old == "logi":
                return stem + new if _measure(w[:-3]) > 0 else w
            if _measure(stem) > 0:
                return _replaced(stem + new, STEP2) if old == "alli" else stem + new
            return w
    return w


def _residue(w: str) -> str:
    for end in STEP4:
        if w.endswith(end):
            longer = [e for e in STEP4 if w.endswith(e)]
            end = max(longer, key=len)
            stem = w[:len(w) - len(end)]
            return stem if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")) else w
    return w


def _tidy(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or m == 1 and not _cvc(stem):
            w = stem
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@lru_cache(maxsize=100_000)
def porter_stem(word: str) -> str:
    """Stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _final_y(_past(_plural(word)))
    return _tidy(_residue(_replaced(_replaced(w, STEP2), STEP3)))
