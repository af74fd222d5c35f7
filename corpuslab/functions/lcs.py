"""Longest-common-subsequence helpers for ROUGE-L / ROUGE-Lsum.

Small per-row helpers run inside Arrow-batched pandas UDFs; Spark partitions
the pairs.  ``lcs_length`` is the bit-parallel formulation (one big-integer
update per token of the second sequence); ``lcs_positions`` keeps those bit rows
(m x n bits) and backtracks on them, as summary-level LCS needs.
"""

from __future__ import annotations

import re
from collections import Counter

_NON_ALNUM = re.compile(r"[^a-z0-9]+")


def rouge_tokens(text) -> list:
    """Lower-case, non-[a-z0-9] runs become spaces, split."""
    if text is None:
        return []
    return [t for t in _NON_ALNUM.sub(" ", str(text).lower()).split() if t]


def lcs_length(a, b) -> int:
    """|LCS(a, b)| by bit-vector dynamic programming over ``a``'s positions."""
    if len(a) == 0 or len(b) == 0:
        return 0
    masks = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def lcs_positions(ref, can) -> list:
    """Positions in ``ref`` of one LCS with ``can`` (backtrack prefers moving in
    ``can`` when the table ties, i.e. the last-match path)."""
    m, n = len(ref), len(can)
    masks = {}
    for j, x in enumerate(can):
        masks[x] = masks.get(x, 0) | (1 << j)
    full = (1 << n) - 1
    rises, v = [0], full                    # bit j of rises[i]: the table rises from column j to j + 1 in row i
    for x in ref:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rises.append(v ^ full)
    i, j, out = m, n, []
    here = rises[m].bit_count()             # table value at (i, j)
    while i > 0 and j > 0:
        if ref[i - 1] == can[j - 1]:
            out.append(i - 1)
            i -= 1
            j -= 1
            here -= 1
            continue
        left = here - (rises[i] >> (j - 1) & 1)
        above = (rises[i - 1] & ((1 << j) - 1)).bit_count()
        if left > above:
            j, here = j - 1, left
        else:
            i, here = i - 1, above
    out.reverse()
    return out


def _f(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def summary_lcs_scores(prediction, reference) -> tuple:
    """ROUGE-Lsum (precision, recall, fmeasure): newline-separated sentences,
    union LCS per reference sentence, hits clipped by token counts."""
    ref_sents = [rouge_tokens(s) for s in str(reference or "").split("\n") if len(s)]
    can_sents = [rouge_tokens(s) for s in str(prediction or "").split("\n") if len(s)]
    if not ref_sents or not can_sents:
        return 0.0, 0.0, 0.0
    m = sum(len(s) for s in ref_sents)
    n = sum(len(s) for s in can_sents)
    if m == 0 or n == 0:
        return 0.0, 0.0, 0.0
    cnt_r, cnt_c = Counter(), Counter()
    for s in ref_sents:
        cnt_r.update(s)
    for s in can_sents:
        cnt_c.update(s)
    hits = 0
    for r in ref_sents:
        union = sorted(set().union(*[lcs_positions(r, c) for c in can_sents]))
        for idx in union:
            tok = r[idx]
            if cnt_c[tok] > 0 and cnt_r[tok] > 0:
                hits += 1
                cnt_c[tok] -= 1
                cnt_r[tok] -= 1
    p, rc = hits / n, hits / m
    return p, rc, _f(p, rc)
