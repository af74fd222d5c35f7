"""Language identification by averaged hashed subword embeddings.

A text is lower-cased; runs of letters are words, everything else is a word
boundary.  Its features are the character 2-, 3- and 4-grams that lie in one
word or touch one boundary, hashed into ``2 ** bits`` rows of an embedding
table.  The text's vector is the mean of its rows; a linear softmax over it
gives the language.  Embeddings and softmax are fitted together by stochastic
gradient descent in numpy on a bounded sample of labelled rows.

For prediction the two linear maps are folded into one table of per-feature
class scores in fixed point, so a text's sums are exact integers: the score
does not depend on batches, partitions or retries.

Rejection is calibrated on sampled rows that were kept from the fit: a
temperature makes the softmax probabilities match the observed errors there,
and the threshold is the probability above which ``1 - reject_share`` of those
rows lie, never above ``max_threshold``.

Contract: null text or text without a letter is ``und`` with score 0 and is
rejected; without any labelled row every text is ``und``; every whole text is
scored; rows keep their multiplicity and order does not matter; of classes with
the same score the first by code point is predicted; a model has at most
``max_classes`` languages (more are an error); input columns named like an output
column, or ``_lid``, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codepoints import LETTER, class_table, code_points, text_slices

UNDETERMINED = "und"
ORDERS = (2, 3, 4)
SLICE_CHARS = 1 << 19


@dataclass
class LangParams:
    bits: int = 16
    dim: int = 16
    per_class: int = 400          # most sampled rows of a language: the bound of the fit
    max_classes: int = 512        # most languages a model may have
    epochs: int = 12
    batch: int = 32
    rate: float = 8.0
    holdout: int = 5              # every fifth sampled row calibrates
    reject_share: float = 0.001
    max_threshold: float = 0.5
    seed: int = 7


@dataclass
class LangModel:
    classes: list[str]
    table: np.ndarray             # (2 ** bits + 1, classes) int32 fixed point; the last row is zero
    scale: float                  # fixed-point unit
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    params: LangParams = field(default_factory=LangParams)


def _features(codes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """For each order, the feature row at every position (``2 ** bits``: none).
    ``codes``: letters as they are, every boundary 0."""
    none = np.uint32(1 << bits)
    shift = np.uint32(32 - bits)
    inside = codes != 0
    rolled = codes.astype(np.uint32)
    n = len(codes)
    for order in range(2, ORDERS[-1] + 1):
        if n < order:
            return
        rolled = rolled[:n - order + 1] * np.uint32(0x01000193) + codes[order - 1:]
        first, last = inside[:n - order + 1], inside[order - 1:]
        ok = first | last
        for k in range(1, order - 1):
            ok = ok & inside[k:n - order + 1 + k]
        mixed = (rolled ^ (rolled >> np.uint32(15)) ^ np.uint32(order)) * np.uint32(0x9E3779B1)
        out = np.full(n, none, dtype=np.uint32)
        out[:n - order + 1] = np.where(ok, mixed >> shift, none)
        yield out


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text between two boundaries; 0 where no letter."""
    codes = code_points(text.lower())
    out = np.zeros(len(codes) + 2, dtype=np.uint32)
    out[1:-1] = np.where(class_table()[codes] == LETTER, codes, 0)
    return out


def text_counts(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature rows of a whole text and how often each occurs."""
    total = np.zeros((1 << bits) + 1, dtype=np.int64)
    codes = _letters(text)
    for at in range(0, len(codes), SLICE_CHARS):
        part = codes[at:at + SLICE_CHARS + ORDERS[-1] - 1]
        for rows in _features(part, bits):
            total += np.bincount(rows[:SLICE_CHARS], minlength=len(total))
    rows = np.flatnonzero(total[:-1])
    return rows.astype(np.int32), total[rows].astype(np.int32)


# -- training ---------------------------------------------------------------
def training_sample(df: DataFrame, key_col: str, text_col: str, lang_col: str, p: LangParams) -> pa.Table:
    """Feature counts of at most about ``per_class`` hash-chosen rows of each
    language (a share of them where there are more), as columns key, lang, rows,
    counts.  The share comes from a count over all labelled rows; a row's draw is a
    hash of its key and text, so rows of one key, or without one, are drawn one by one."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(key_col).cast("string").alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = labelled.groupBy("lang").count().limit(p.max_classes + 1).collect()
    if len(sizes) > p.max_classes:
        raise ValueError(f"more than {p.max_classes} languages")
    if not sizes:
        return pa.table({"key": [], "lang": [], "rows": [], "counts": []})
    draw = F.pmod(F.xxhash64(F.coalesce("key", F.lit("")), "text", F.lit(p.seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, p.per_class / r["count"]))]),
                         F.col("lang"))
    chosen = labelled.where(draw < share).dropDuplicates(["key", "lang", "text"])   # equal rows share a draw
    bits = p.bits

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, "text", SLICE_CHARS):
                got = [text_counts(t, bits) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)),
                     pa.array([g[0].tobytes() for g in got], pa.binary()),
                     pa.array([g[1].tobytes() for g in got], pa.binary())], names=["key", "lang", "rows", "counts"])

    return chosen.mapInArrow(work, "key string, lang string, rows binary, counts binary").toArrow()


def fit(sample: pa.Table, p: LangParams) -> LangModel | None:
    """Averaged embeddings and softmax by minibatch gradient descent."""
    rows = sorted(zip(*(sample.column(c).to_pylist() for c in ("lang", "key", "rows", "counts"))),
                  key=lambda r: (r[0], r[1] or "", r[2]))
    docs = [(lang, np.frombuffer(i, dtype=np.int32), np.frombuffer(c, dtype=np.int32)) for lang, _, i, c in rows]
    docs = [d for d in docs if len(d[1])]
    if not docs:
        return None
    classes = sorted({d[0] for d in docs})
    number = {c: k for k, c in enumerate(classes)}
    target = np.array([number[d[0]] for d in docs])
    size, n_classes = 1 << p.bits, len(classes)
    rng = np.random.default_rng(p.seed)
    held = np.zeros(len(docs), dtype=bool)
    held[p.holdout - 1::p.holdout] = True
    embed = (rng.standard_normal((size, p.dim)) / p.dim).astype(np.float32)
    soft = np.zeros((p.dim, n_classes), dtype=np.float32)
    bias = np.zeros(n_classes, dtype=np.float32)
    train = np.flatnonzero(~held)
    steps, step = p.epochs * -(-len(train) // p.batch), 0

    def dense(members: np.ndarray) -> np.ndarray:
        x = np.zeros((len(members), size), dtype=np.float32)
        for k, m in enumerate(members):
            x[k, docs[m][1]] = docs[m][2] / docs[m][2].sum()
        return x

    for _ in range(p.epochs):
        order = rng.permutation(train)
        for at in range(0, len(order), p.batch):
            members = order[at:at + p.batch]
            x = dense(members)
            mean = x @ embed
            logits = mean @ soft + bias
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(members)), target[members]] -= 1
            error = prob / len(members)
            rate = p.rate * (1 - step / steps)
            grad_mean = error @ soft.T
            soft -= rate * (mean.T @ error)
            bias -= 0.1 * rate * error.sum(axis=0)
            embed -= rate * 16 * (x.T @ grad_mean)
            step += 1
    scores = embed @ soft
    scale = float(max(1e-6, np.abs(scores).max())) / (1 << 20)
    table = np.zeros((size + 1, n_classes), dtype=np.int32)
    table[:-1] = np.rint(scores / scale)
    model = LangModel(classes, table, scale, bias.astype(np.float64), params=p)
    check = np.flatnonzero(held) if held.any() else train
    logits = np.array([_logits((table[docs[m][1]].astype(np.int64) * docs[m][2][:, None]).sum(axis=0),
                               int(docs[m][2].sum()), model) for m in check])
    _calibrate(model, logits, target[check])
    return model


def _logits(sums: np.ndarray, n: int, model: LangModel) -> np.ndarray:
    return sums.astype(np.float64) / max(1, n) * model.scale + model.bias


def _softmax(logits: np.ndarray, temperature: float) -> np.ndarray:
    z = logits / temperature
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _calibrate(model: LangModel, logits: np.ndarray, target: np.ndarray) -> None:
    best = None
    for t in np.geomspace(0.25, 8, 41):
        prob = _softmax(logits, t)[np.arange(len(target)), target]
        loss = -np.log(np.maximum(prob, 1e-12)).mean()
        if best is None or loss < best[0]:
            best = (loss, float(t))
    model.temperature = best[1]
    top = np.sort(_softmax(logits, model.temperature).max(axis=1))
    model.threshold = min(model.params.max_threshold, float(top[int(len(top) * model.params.reject_share)]))


# -- prediction -------------------------------------------------------------
def _score_texts(texts: list[str], model: LangModel) -> tuple[list[str], np.ndarray]:
    bits, n_classes = model.params.bits, len(model.classes)
    sums = np.zeros((len(texts), n_classes), dtype=np.int64)
    counts = np.zeros(len(texts), dtype=np.int64)
    width = max(1 << 14, (1 << 20) // n_classes)
    coded = [_letters(t) for t in texts]
    lettered = np.array([bool(c.any()) for c in coded])
    at = 0
    while at < len(coded):                                     # groups of texts of about ``width`` positions
        end, held = at + 1, len(coded[at])
        while end < len(coded) and held + len(coded[end]) <= width:
            held += len(coded[end])
            end += 1
        if end == at + 1:
            for lo in range(0, len(coded[at]), width):
                part = coded[at][lo:lo + width + ORDERS[-1] - 1]
                for rows in _features(part, bits):
                    rows = rows[:width]
                    sums[at] += model.table[rows].sum(axis=0, dtype=np.int64)
                    counts[at] += int((rows < 1 << bits).sum())
        else:
            group = np.concatenate(coded[at:end])              # every text begins and ends with a boundary
            starts = np.cumsum([0] + [len(c) for c in coded[at:end - 1]])
            for rows in _features(group, bits):
                sums[at:end] += np.add.reduceat(model.table[rows], starts, axis=0, dtype=np.int64)
                counts[at:end] += np.add.reduceat((rows < 1 << bits).astype(np.int64), starts)
        at = end
    logits = sums / np.maximum(counts, 1)[:, None] * model.scale + model.bias
    prob = _softmax(logits, model.temperature)
    best = prob.argmax(axis=1)
    langs = [model.classes[b] if has else UNDETERMINED for b, has in zip(best, lettered)]
    return langs, np.where(lettered, prob[np.arange(len(texts)), best], 0.0)


def predict(df: DataFrame, model: LangModel | None, text_col: str = "text", lang_out: str = "lang_pred",
            score_out: str = "score", rejected_out: str = "rejected") -> DataFrame:
    """Add the predicted language, its calibrated probability and whether the
    calibrated rule rejects the text."""
    if model is None:
        return (df.withColumn(lang_out, F.lit(UNDETERMINED)).withColumn(score_out, F.lit(0.0))
                .withColumn(rejected_out, F.lit(True)))
    shared = df.sparkSession.sparkContext.broadcast(model)     # 2 ** bits rows x classes, both bounded

    @F.pandas_udf("lang string, score double, rejected boolean")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            langs, scores = [], []
            for part in _runs(texts):
                a, b = _score_texts(part, m)
                langs.extend(a)
                scores.append(b)
            score = np.concatenate(scores) if scores else np.zeros(0)
            lang = pd.Series(langs, dtype=object)
            yield pd.DataFrame({"lang": lang, "score": score,
                                "rejected": ((lang == UNDETERMINED).to_numpy(dtype=bool) | (score < m.threshold))})

    made = {lang_out: "lang", score_out: "score", rejected_out: "rejected"}
    return (df.withColumn("_lid", scored(F.col(text_col)))     # only the text goes to Python, and no text comes back
            .select(*[c for c in df.columns if c not in made], *[F.col(f"_lid.{f}").alias(c) for c, f in made.items()]))


def _runs(texts: pd.Series) -> Iterator[list[str]]:
    """Consecutive texts of about SLICE_CHARS characters; null is the empty text."""
    part: list[str] = []
    held = 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        if part and held + len(t) > SLICE_CHARS:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def is_held_out(key: Column) -> Column:
    """Rows that never train: crc32 of the key as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3 == 1


def train(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          params: LangParams | None = None) -> LangModel | None:
    """Fit on the labelled rows that are not held out."""
    p = params or LangParams()
    return fit(training_sample(df.where(~is_held_out(F.col(key_col))), key_col, text_col, lang_col, p), p)
