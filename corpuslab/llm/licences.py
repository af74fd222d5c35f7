"""License scans with a positional index of rare licence words.

*Templates* are licence texts and notices, each with a label, the key phrases
that have to stand in a text of that licence, and a positional index: word ->
(template, position).  Phrases (``PHRASES``) are templates that have to stand
word for word; every place of one is reported.

*Rare words.*  The corpus is counted once: in how many documents does each word
of the templates occur (a table as long as the templates' vocabulary)?  Of each
template the words of the highest inverse document frequency are its rare ones:
half of its distinct words, ``RARE`` at most (fixed by the template, whatever
the text).

*Look-up.*  Where a text has a rare word of a template, the word votes for the
place where the template would begin.  Votes of a template that agree up to
``SLACK`` words are one candidate; its coverage is the share of the template's
rare weight that voted.  A phrase is looked up by its rarest word and its other
words at their relative positions.

*Verification.*  A candidate with at least ``LEAST`` of the weight gives its
template's label if every key phrase stands in the text at its place in the
template, up to ``SLACK`` words.

Contract: null and empty texts have no words, no place, no label and score 0;
words are runs of a-z, 0-9 and all characters beyond ASCII, A-Z lower-cased;
texts are scanned whole; the score is the largest coverage of any candidate (a
phrase found: 1) to six digits; a template found twice gives its label once;
equal coverages need no choice.  Rows with one key, and null keys, are separate
rows; an empty table gives an empty table; only the named columns are read, so
other columns may have any name.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import byte_class, byte_slices, hashed_words

RARE = 12                   # rare words of a template, at most half of its words
LEAST = 0.5                 # share of the rare weight that a candidate needs
SLACK = 12                  # words by which a text may be out of step with the template
SLICE_BYTES = 1 << 19
WORD_BYTES = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


# Phrases that count wherever they stand word for word.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Licence notices and the operative parts of licence texts, as published.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except"
             " in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
             " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"
             " on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
             ("compliance with the license", "without warranties or conditions of any kind")),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Licensed under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
             " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
             " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
             ("to deal in the software without restriction",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
             " hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
             ("with or without fee is hereby granted",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
             " the following conditions are met: Redistributions of source code must retain the above copyright notice, this"
             " list of conditions and the following disclaimer.",
             ("redistributions of source code must retain the above copyright notice",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3",
             ("gnu general public license version 3",)),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2",
             ("gnu general public license version 2",)),
    Template("lgpl", "licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the GNU Affero General Public License", ("gnu affero general public license",)),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
             " General Public License as published by the Free Software Foundation, either version 3 of the License, or (at"
             " your option) any later version.", ("published by the free software foundation",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the"
             " MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
             ("mozilla public license v 2 0",)),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be"
             " held liable for any damages arising from the use of this software.",
             ("in no event will the authors be held liable",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy,"
             " modify, publish, use, compile, sell, or distribute this software",
             ("free and unencumbered software released into the public domain",)),
    Template("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"
             " to this work. CC0 1.0 Universal", ("waived all copyright and related or neighboring rights",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    Template("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ("cc by nc sa 4 0",)),
)


def template_words(text: str) -> list[str]:
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text))


def _word_hashes(words: list[str]) -> np.ndarray:
    return hashed_words([" ".join(words).encode()], WORD_BYTES)[0]


class Index:
    """Positional index over templates and phrases; ``df``: documents that hold each
    word of ``vocabulary``, of ``n_docs`` (none yet: all words weigh the same)."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, df: dict[int, int] | None = None, n_docs: int = 0):
        self.templates, self.phrases = templates, phrases
        texts = [template_words(t.text) for t in templates]
        keys = [[template_words(k) for k in t.keys] for t in templates]
        spelt = [template_words(p) for p, _ in phrases]
        self.vocabulary = sorted({w for t in [*texts, *spelt, *(k for ks in keys for k in ks)] for w in t})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        hashes = _word_hashes(self.vocabulary)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.idf = np.array([math.log((n_docs + 1) / ((df or {}).get(i, 0) + 1)) + 1 for i in range(len(self.vocabulary))])
        self.texts = [np.array([number[w] for w in t]) for t in texts]
        self.keys = [[np.array([number[w] for w in k]) for k in ks] for ks in keys]
        self.spelt = [np.array([number[w] for w in p]) for p in spelt]
        self.key_at = [[_find(t, k) for k in ks] for t, ks in zip(self.texts, self.keys)]
        self.rare, words, owners, places = [], [], [], []
        for t, text in enumerate(self.texts):
            distinct = sorted(set(text.tolist()), key=lambda i: (-self.idf[i], i))
            rare = distinct[:min(RARE, -(-len(distinct) // 2))]
            self.rare.append(float(self.idf[rare].sum()))
            for at, w in enumerate(text.tolist()):
                if w in rare:
                    words.append(w)
                    owners.append(t)
                    places.append(at)
        order = np.argsort(words, kind="stable")
        self.posting_word = np.array(words, dtype=np.int64)[order]
        self.posting_owner = np.array(owners, dtype=np.int64)[order]
        self.posting_place = np.array(places, dtype=np.int64)[order]
        every = np.arange(len(self.vocabulary))
        self.first = np.searchsorted(self.posting_word, every)
        self.count = np.searchsorted(self.posting_word, every, side="right") - self.first

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Number of every word in the vocabulary, -1 for the others."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.by_hash[at], -1)

    def places(self, ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Where a phrase stands (over all texts end to end): its rarest word is looked
        up and the others compared at their relative positions."""
        anchor = int(np.argmax(self.idf[phrase]))
        start = np.flatnonzero(ids == phrase[anchor]) - anchor
        start = start[(start >= 0) & (start + len(phrase) <= len(ids))]
        for k, w in enumerate(phrase):
            start = start[ids[start + k] == w]
        return start


def _find(text: np.ndarray, phrase: np.ndarray) -> int:
    """Position of a key phrase in its template."""
    for i in range(len(text) - len(phrase) + 1):
        if (text[i:i + len(phrase)] == phrase).all():
            return i
    raise ValueError("a key phrase must stand in its template")


def candidates(index: Index, ids: np.ndarray, owner: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, template, coverage, first and last place in the text of the template's
    beginning that its votes name) of every group of votes that agree up to SLACK words."""
    at = np.flatnonzero(ids >= 0)
    at = at[index.count[ids[at]] > 0]
    word = ids[at]
    times = index.count[word]
    vote = np.repeat(np.arange(len(at)), times)
    post = np.arange(len(vote)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(index.first[word], times)
    place = at[vote] - begin[owner[at[vote]]] - index.posting_place[post]
    doc, tmpl, word = owner[at][vote], index.posting_owner[post], word[vote]
    best: dict[tuple[int, int, int, int], float] = {}
    for shift in (0, SLACK // 2):                              # overlapping bands: any SLACK / 2 words fall into one
        band = (place + shift) // SLACK
        order = np.lexsort((word, band, tmpl, doc))
        d, t, b, w, p = doc[order], tmpl[order], band[order], word[order], place[order]
        if not len(d):
            return
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (b[1:] != b[:-1])])
        fresh = new | np.concatenate([[True], w[1:] != w[:-1]])
        first = np.flatnonzero(new)
        weight = np.add.reduceat(np.where(fresh, index.idf[w], 0.0), first)
        low, high = np.minimum.reduceat(p, first), np.maximum.reduceat(p, first)
        for i, g in enumerate(first.tolist()):
            key = (int(d[g]), int(t[g]), int(low[i]), int(high[i]))
            best[key] = min(1.0, float(weight[i]) / index.rare[key[1]])
    for (d, t, low, high), coverage in sorted(best.items()):
        yield d, t, coverage, low, high


def scan_texts(index: Index, texts: list[bytes]) -> list[tuple[int, list, list, float]]:
    """(words, phrase places, labels found with their places, score) of every text."""
    h, counts = hashed_words([t.lower() for t in texts], WORD_BYTES)
    owner = np.repeat(np.arange(len(texts)), counts)
    begin = np.cumsum(counts) - counts
    ids = index.ids(h) if len(h) else np.zeros(0, dtype=np.int64)
    places: list[list] = [[] for _ in texts]
    found: list[dict] = [{} for _ in texts]
    score = [0.0] * len(texts)

    def standing(phrase: np.ndarray) -> np.ndarray:
        start = index.places(ids, phrase)
        return start[owner[start] == owner[start + len(phrase) - 1]]

    for (_, label), phrase in zip(index.phrases, index.spelt):
        for s in standing(phrase).tolist():
            d = int(owner[s])
            places[d].append((s - int(begin[d]), len(phrase), label))
            score[d] = 1.0
    known: dict[bytes, np.ndarray] = {}
    for d, t, coverage, low, high in candidates(index, ids, owner, begin):
        score[d] = max(score[d], coverage)
        if coverage < LEAST:
            continue
        for key, at in zip(index.keys[t], index.key_at[t]):
            starts = known.setdefault(key.tobytes(), standing(key))
            i, j = np.searchsorted(starts, [begin[d] + low + at - SLACK, begin[d] + high + at + SLACK + 1])
            if not (owner[starts[i:j]] == d).any():
                break
        else:
            label = index.templates[t].label
            start = max(0, low)
            if label not in found[d] or (-coverage, start) < found[d][label]:
                found[d][label] = (-coverage, start)
    return [(int(n), sorted(p), sorted((s, label, -c) for label, (c, s) in f.items()), round(x, 6))
            for n, p, f, x in zip(counts.tolist(), places, found, score)]


# -- the corpus ---------------------------------------------------------------------
def document_frequencies(df: DataFrame, text_col: str, index: Index) -> tuple[dict[int, int], int]:
    """In how many texts each word of the vocabulary occurs, and the number of texts.
    The driver gets one row for each word of the templates."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(index.vocabulary)
        total = np.zeros(size + 1, dtype=np.int64)             # the last one counts the texts
        for batch in batches:
            for _, texts in byte_slices(batch, "t", SLICE_BYTES):
                h, counts = hashed_words([t.lower() for t in texts], WORD_BYTES)
                total[size] += len(texts)
                if len(h):
                    ids = index.ids(h)
                    has = np.unique(np.repeat(np.arange(len(texts)), counts)[ids >= 0] * size + ids[ids >= 0])
                    total[:size] += np.bincount(has % size, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1), pa.int32()), pa.array(total, pa.int64())],
                                         names=["word", "docs"])

    counted = df.select(F.col(text_col).alias("t")).mapInArrow(work, "word int, docs long")
    rows = {r["word"]: r["docs"] for r in counted.groupBy("word").agg(F.sum("docs").alias("docs")).collect()}
    return rows, rows.pop(len(index.vocabulary), 0)


def scan(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(key, n_words, places, found, score) of every row: the places (start, words,
    label) of the phrases, and the licences found (start, label, coverage)."""
    counts, n_docs = document_frequencies(df, text_col, Index(templates, phrases))
    index = Index(templates, phrases, counts, n_docs)
    kind = dict(df.select(key_col).dtypes)[key_col]
    place = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string())])
    licence = pa.struct([("start", pa.int64()), ("label", pa.string()), ("coverage", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in byte_slices(batch, "t", SLICE_BYTES):
                n, places, found, score = zip(*scan_texts(index, texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(n, pa.int64()),
                     pa.array([[dict(zip(("start", "words", "label"), x)) for x in p] for p in places], pa.list_(place)),
                     pa.array([[dict(zip(("start", "label", "coverage"), x)) for x in f] for f in found], pa.list_(licence)),
                     pa.array(score, pa.float64())], names=["key", "n_words", "places", "found", "score"])

    out = df.select(F.col(key_col).alias("key"), F.col(text_col).alias("t")).mapInArrow(
        work, f"key {kind}, n_words long, places array<struct<start: long, words: long, label: string>>, "
              "found array<struct<start: long, label: string, coverage: double>>, score double")
    return out.withColumnRenamed("key", key_col)
