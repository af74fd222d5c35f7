"""Byte-level BPE encoding and decoding of whole texts.

Pre-tokenisation uses no regex.  Code points map to classes; a class together
with its one-character look-ahead is a symbol, and every symbol is a transition
function on the few states of the splitter.  Function composition is
associative, so the state before every character comes from a blocked prefix
scan over precomputed composition tables, for all texts of a slice at once.
Each resulting slice is looked up in a bounded cache; the distinct slices that
miss are merged together, one vectorised lowest-rank merge per round.

Contract of the operators: a null text is the empty text (no ids, no bytes);
texts of any length are encoded whole; rows keep their multiplicity; an empty
table gives an empty table with the same schema; input columns named like an
output column are replaced by it.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .codepoints import APOSTROPHE, BLANK, LETTER, NUMBER, OTHER, SPACE, class_table, flat, text_slices

SLICE_CHARS = 1 << 17      # characters worked on at once
CACHE_PIECES = 120_000     # pieces remembered by a task
WIDE_PIECE = 64            # bytes from which a piece is merged by the heap

# Splitter symbols: a class with its look-ahead.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_PREFIX, S_LONE, S_RUN = range(8)
# Splitter states.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_PREFIX, IN_RUN, ONE_LEFT, TWO_LEFT = range(8)
RESET = 8                  # symbol + RESET: the same symbol at the start of a text


def _step(state: int, symbol: int) -> tuple[int, int]:
    """(next state, 1 if a piece starts at this character)."""
    if symbol >= RESET:
        return _step(FREE, symbol - RESET)
    if symbol == S_LETTER:
        if state == TWO_LEFT:
            return ONE_LEFT, 0
        if state == ONE_LEFT:
            return FREE, 0
        return IN_LETTERS, int(state not in (IN_LETTERS, AFTER_PREFIX))
    if symbol == S_NUMBER:
        return IN_NUMBERS, int(state not in (IN_NUMBERS, AFTER_PREFIX))
    if symbol in (S_OTHER, S_SHORT, S_LONG):
        if state in (IN_OTHERS, AFTER_PREFIX):
            return IN_OTHERS, 0
        return {S_OTHER: IN_OTHERS, S_SHORT: ONE_LEFT, S_LONG: TWO_LEFT}[symbol], 1
    if symbol == S_PREFIX:
        return AFTER_PREFIX, 1
    if symbol == S_LONE:
        return FREE, 1
    return IN_RUN, int(state != IN_RUN)


class _Splitter:
    """Transition tables, and the closure of the symbols' functions under
    composition (a small finite monoid), so that composing is one lookup."""

    def __init__(self):
        symbols = range(2 * RESET)
        self.next = np.array([[_step(s, c)[0] for c in symbols] for s in range(8)], dtype=np.uint8)
        self.starts = np.array([[_step(s, c)[1] for c in symbols] for s in range(8)], dtype=np.uint8)
        identity = tuple(range(8))
        functions = {identity: 0}
        order = [identity]
        for f in order:
            for c in symbols:
                g = tuple(int(self.next[s, c]) for s in f)
                if g not in functions:
                    functions[g] = len(order)
                    order.append(g)
        n = len(order)
        self.then_symbol = np.array([[functions[tuple(int(self.next[s, c]) for s in f)] for c in symbols]
                                     for f in order], dtype=np.uint16)
        self.compose = np.array([[functions[tuple(g[s] for s in f)] for g in order] for f in order], dtype=np.uint16)
        self.apply = np.array(order, dtype=np.uint8)
        self.n = n

    def piece_starts(self, symbols: np.ndarray) -> np.ndarray:
        """1 where a piece starts, by a blocked scan of transition functions."""
        n = len(symbols)
        width = 256 if n >= 1 << 14 else 32
        blocks = -(-n // width)
        padded = np.zeros(blocks * width, dtype=np.uint8)
        padded[:n] = symbols
        by_step = np.ascontiguousarray(padded.reshape(blocks, width).T)
        whole = np.zeros(blocks, dtype=np.uint16)               # function of each block
        for row in by_step:
            whole = self.then_symbol[whole, row]
        before = np.zeros(blocks, dtype=np.uint16)              # exclusive scan over the blocks
        before[1:] = whole[:-1]
        reach = 1
        while reach < blocks:
            before[reach:] = self.compose[before[:-reach], before[reach:]]
            reach *= 2
        state = self.apply[before, FREE]
        out = np.empty_like(by_step)
        for j, row in enumerate(by_step):
            out[j] = self.starts[state, row]
            state = self.next[state, row]
        return np.ascontiguousarray(out.T).reshape(-1)[:n]


@lru_cache(maxsize=1)
def _splitter() -> _Splitter:
    return _Splitter()


def _symbols(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Splitter symbol of every character; look-ahead never crosses a text."""
    cls = class_table()[codes]
    n = len(codes)
    last = np.zeros(n, dtype=bool)
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = True
    white = (cls == BLANK) | (cls == SPACE)
    follows = np.zeros(n, dtype=bool)                           # a non-white character follows
    follows[:-1] = ~white[1:]
    follows &= ~last
    out = np.full(n, S_OTHER, dtype=np.uint8)
    out[cls == LETTER] = S_LETTER
    out[cls == NUMBER] = S_NUMBER
    out[white] = S_RUN
    out[white & follows] = S_LONE
    out[(cls == BLANK) & follows] = S_PREFIX
    quotes = np.flatnonzero((cls == APOSTROPHE) & ~last)
    if len(quotes):
        one = codes[quotes + 1]
        room = ~last[quotes + 1]
        two = np.where(room, codes[np.minimum(quotes + 2, n - 1)], 0)
        # The contractions 's 't 'm 'd and 're 've 'll.
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
        out[quotes[((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
                   | ((one == ord("l")) & (two == ord("l")))]] = S_LONG
    first = offsets[:-1][np.diff(offsets) > 0]
    out[first] += RESET
    return out


def piece_offsets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Start of every piece in the joined texts, and the texts' offsets."""
    codes, offsets = flat(texts)
    if not len(codes):
        return np.zeros(0, dtype=np.int64), offsets
    return np.flatnonzero(_splitter().piece_starts(_symbols(codes, offsets))), offsets


class _PairRanks:
    """Rank of the concatenation of two tokens: an open-addressing table over
    all (left, right) splits of the vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        keys_, values_ = np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        size = 1 << self.bits
        self.slots = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.values = np.full(size, NONE, dtype=np.int32)
        todo, at = np.arange(len(keys_)), self._home(keys_)
        while len(todo):
            free = self.slots[at] == np.iinfo(np.uint64).max
            _, chosen = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            chosen = chosen[free[chosen]]
            self.slots[at[chosen]] = keys_[todo[chosen]]
            self.values[at[chosen]] = values_[todo[chosen]]
            left = np.ones(len(todo), dtype=bool)
            left[chosen] = False
            todo, at = todo[left], (at[left] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._home(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.values[at], NONE)
        todo = np.flatnonzero((found != keys) & (found != np.iinfo(np.uint64).max))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.slots) - 1)
            found = self.slots[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (found != np.iinfo(np.uint64).max)
            todo, at = todo[go], at[go]
        return out


NONE = np.iinfo(np.int32).max


class ByteBPE:
    """A byte-level vocabulary with ranks as ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = _PairRanks(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        size = max(ranks.values()) + 1
        self.token_lens = np.zeros(size, dtype=np.int64)
        for token, rank in ranks.items():
            self.token_lens[rank] = len(token)
        self.token_starts = np.concatenate([[0], np.cumsum(self.token_lens)[:-1]])
        self.token_bytes = np.zeros(int(self.token_lens.sum()), dtype=np.uint8)
        for token, rank in ranks.items():
            s = self.token_starts[rank]
            self.token_bytes[s:s + len(token)] = np.frombuffer(token, dtype=np.uint8)
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.piece_ids = np.zeros(0, dtype=np.int32)            # ids of the known pieces end to end
        self.piece_lens = np.zeros(0, dtype=np.int64)
        self.uses = np.zeros(0, dtype=np.int64)

    def _make_room(self):
        """Keep the pieces that were used again; all go if those fill the cache."""
        keep = self.uses > 1
        if keep.sum() > CACHE_PIECES // 2:
            self.forget()
            return
        flags = keep.tolist()
        self.known = dict(zip((p for p, k in zip(self.known, flags) if k), range(int(keep.sum()))))
        self.piece_ids = self.piece_ids[np.repeat(keep, self.piece_lens)]
        self.piece_lens = self.piece_lens[keep]
        self.uses = np.zeros(len(self.known), dtype=np.int64)

    # -- merging ------------------------------------------------------------
    def _merge_one(self, piece: bytes) -> list[int]:
        """Lowest-rank, leftmost merges with a heap: for very long pieces."""
        ids: list[int] = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        dead = bytearray(n)
        first = self.pairs.lookup(np.array(ids[:-1], dtype=np.int64), np.array(ids[1:], dtype=np.int64)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        memo: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            r = memo.get((a, b))
            if r is None:
                r = memo[a, b] = int(self.pairs.lookup(np.array([a]), np.array([b]))[0])
            return r

        while heap:
            r, i, a, b = heapq.heappop(heap)
            if dead[i] or ids[i] != a:
                continue
            j = right[i]
            if j >= n or ids[j] != b:
                continue
            ids[i] = r
            dead[j] = 1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                q = rank(r, ids[k])
                if q != NONE:
                    heapq.heappush(heap, (q, i, r, ids[k]))
            h = left[i]
            if h >= 0:
                q = rank(ids[h], r)
                if q != NONE:
                    heapq.heappush(heap, (q, h, ids[h], r))
        return [t for t, d in zip(ids, dead) if not d]

    def _merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merge equally wide pieces together; returns (ids end to end, counts)."""
        lens = np.array([len(p) for p in pieces], dtype=np.int64)
        width = int(lens.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        ids = self.byte_ids[raw]
        count = lens.copy()
        cols = np.arange(width)
        rank = np.full((len(pieces), width), NONE, dtype=np.int32)
        if width > 1:
            rank[:, :-1] = self.pairs.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), -1)
        rank[cols[None, :] >= (lens - 1)[:, None]] = NONE
        live = np.arange(len(pieces))
        part_ids, part_rank = ids, rank
        while len(live):
            at = part_rank.argmin(axis=1)
            rows = np.arange(len(live))
            best = part_rank[rows, at]
            go = best != NONE
            if not go.all():
                ids[live[~go]] = part_ids[~go]
                live, part_ids, part_rank, at, best = live[go], part_ids[go], part_rank[go], at[go], best[go]
                if not len(live):
                    break
                rows = np.arange(len(live))
            src = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width - 1)
            part_ids = np.take_along_axis(part_ids, src, axis=1)
            part_rank = np.take_along_axis(part_rank, src, axis=1)
            part_ids[rows, at] = best
            count[live] -= 1
            end = count[live]
            part_rank[rows, end - 1] = NONE
            has_right = at + 1 < end
            r = rows[has_right]
            part_rank[r, at[r]] = self.pairs.lookup(part_ids[r, at[r]], part_ids[r, at[r] + 1])
            has_left = at > 0
            r = rows[has_left]
            part_rank[r, at[r] - 1] = self.pairs.lookup(part_ids[r, at[r] - 1], part_ids[r, at[r]])
        return ids[cols[None, :] < count[:, None]], count

    def _learn(self, pieces: list[str]) -> None:
        """Encode distinct new pieces and add them to the cache."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        single = [self.ranks.get(b) for b in raw]
        groups: dict[int, list[int]] = {}
        results: list = [None] * len(pieces)
        for i, (b, rank) in enumerate(zip(raw, single)):
            if rank is not None:
                results[i] = [rank]
            elif len(b) >= WIDE_PIECE:
                results[i] = self._merge_one(b)
            else:
                groups.setdefault(-(-len(b) // 4), []).append(i)
        order: list[int] = [i for i, r in enumerate(results) if r is not None]
        ids = [np.array([t for i in order for t in results[i]], dtype=np.int32)]
        lens = [np.array([len(results[i]) for i in order], dtype=np.int64)]
        for members in groups.values():
            got, count = self._merge_many([raw[i] for i in members])
            ids.append(got.astype(np.int32))
            lens.append(count)
            order.extend(members)
        base = len(self.known)
        self.known.update(zip(map(pieces.__getitem__, order), range(base, base + len(order))))
        self.piece_ids = np.concatenate([self.piece_ids, *ids])
        self.piece_lens = np.concatenate([self.piece_lens, *lens])
        self.uses = np.concatenate([self.uses, np.zeros(len(order), dtype=np.int64)])

    # -- whole texts --------------------------------------------------------
    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text)."""
        starts, offsets = piece_offsets(texts)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        joined = "".join(texts)
        bounds = starts.tolist()
        bounds.append(len(joined))
        pieces = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
        if len(self.known) > CACHE_PIECES:
            self._make_room()
        found = list(map(self.known.get, pieces))
        if None in found:
            self._learn(list({p for p, k in zip(pieces, found) if k is None}))
            found = list(map(self.known.__getitem__, pieces))
        where = np.array(found, dtype=np.int64)
        self.uses += np.bincount(where, minlength=len(self.uses))
        known_starts = np.cumsum(self.piece_lens) - self.piece_lens
        lens = self.piece_lens[where]
        ends = np.cumsum(lens)
        ids = self.piece_ids[np.arange(int(ends[-1])) + np.repeat(known_starts[where] - (ends - lens), lens)]
        piece_text = np.searchsorted(offsets, starts, side="right") - 1
        return ids, np.bincount(piece_text, weights=lens, minlength=len(texts)).astype(np.int64)

    def byte_lens(self, ids: np.ndarray) -> np.ndarray:
        return self.token_lens[ids]

    def decode_ids(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids end to end."""
        lens = self.token_lens[ids]
        ends = np.cumsum(lens)
        if not len(ids):
            return np.zeros(0, dtype=np.uint8)
        return self.token_bytes[np.arange(int(ends[-1])) + np.repeat(self.token_starts[ids] - (ends - lens), lens)]


@lru_cache(maxsize=2)
def load_bpe(path: str) -> ByteBPE:
    """Read a rank file (base64 token, space, rank per line), once per worker."""
    with open(path, "rb") as f:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    if pa.types.is_binary(kind):
        return pa.Array.from_buffers(kind, len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def _passed_on(df: DataFrame, drop: set[str]) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in drop]


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", offsets_col: str = "offsets",
           decoded_col: str | None = None, keep_text: bool = False) -> DataFrame:
    """Add ``ids`` (array<int>) and ``offsets`` (start byte of every id in the
    UTF-8 text, array<int>).  With ``decoded_col`` the ids are decoded again in
    the same pass.  The text column is dropped unless ``keep_text``."""
    made = [ids_col, offsets_col] + ([decoded_col] if decoded_col else [])
    fields = _passed_on(df, set(made) | (set() if keep_text else {text_col}))
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())),
                           T.StructField(offsets_col, T.ArrayType(T.IntegerType()))]
                          + ([T.StructField(decoded_col, T.BinaryType())] if decoded_col else []))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for batch in batches:
            for start, texts in text_slices(batch, text_col, SLICE_CHARS):
                ids, counts = bpe.encode_texts(texts)
                lens = bpe.byte_lens(ids)
                ends = np.cumsum(lens)
                rows = np.repeat(np.arange(len(counts)), counts)
                base = np.zeros(len(counts), dtype=np.int64)
                firsts = np.cumsum(counts) - counts
                has = counts > 0
                base[has] = (ends - lens)[firsts[has]]
                spots = (ends - lens - base[rows]).astype(np.int32)
                cols = [batch.column(batch.schema.get_field_index(n)).slice(start, len(texts)) for n in names]
                cols += [_lists(ids, counts, pa.int32()), _lists(spots, counts, pa.int32())]
                if decoded_col:
                    sizes = np.bincount(rows, weights=lens, minlength=len(counts)).astype(np.int64)
                    cols.append(_lists(bpe.decode_ids(ids), sizes, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *made])
        bpe.forget()                                           # workers are reused by other operators

    return df.mapInArrow(work, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Replace ``ids`` by the bytes they stand for (null: no bytes)."""
    fields = _passed_on(df, {ids_col, bytes_col})
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField(bytes_col, T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            counts = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
            ids = np.asarray(lists.flatten(), dtype=np.int64)
            sizes = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=bpe.byte_lens(ids),
                                minlength=len(counts)).astype(np.int64)
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, _lists(bpe.decode_ids(ids), sizes, pa.binary())],
                                             names=[*names, bytes_col])

    return df.mapInArrow(work, schema)
