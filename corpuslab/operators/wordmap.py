"""Per-token lookups through a word table (shared by T8, J2, T21, L1, A17, A18).

Texts are dealt into blocks of consecutive rows of about ``BLOCK_TOKENS`` tokens; a block is
materialised, and moved, as one compressed Arrow stream.  The distinct words of a block are
joined to the table once (AQE broadcasts it when its measured size is under the threshold)
and meet the block's token arrays again in an Arrow function.  Positions never leave the row,
a word moves once a block however many of its texts hold it, and a block's size does not
depend on the number of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage

BLOCK_TOKENS = 1 << 20


def explode_tokens(df: DataFrame, key_cols, tokens_col: str, keep_cols=(),
                   pos_col: str = "pos", token_col: str = "token", outer: bool = False) -> DataFrame:
    """One row per (row key, position, token)."""
    fn = F.posexplode_outer if outer else F.posexplode
    return df.select(*key_cols, *keep_cols, fn(F.col(tokens_col)).alias(pos_col, token_col))


def packed_blocks(df: DataFrame, tokens_col: str) -> DataFrame:
    """(_block, _rows), materialised: rows of one partition whose tokens add up to no more
    than ``BLOCK_TOKENS`` and one text, as an Arrow stream (``block_rows``)."""
    most = BLOCK_TOKENS

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, tokens = TaskContext.get().partitionId() << 40, [], 0

        def leave() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                              names=["_block", "_rows"])

        for batch in batches:
            ends = np.cumsum(batch[tokens_col].value_lengths().to_numpy(zero_copy_only=False) + 1)      # a row counts too
            a, before = 0, 0
            while a < len(ends):
                b = max(int(np.searchsorted(ends, before + most - tokens, side="right")), a + (not held))
                if b > a:
                    held.append(batch.slice(a, b - a))
                    tokens += int(ends[b - 1]) - before
                    a, before = b, int(ends[b - 1])
                if a < len(ends):
                    yield leave()
                    number, tokens = number + 1, 0
        if held:
            yield leave()

    return cut_lineage(df.mapInArrow(packed, "_block long, _rows binary"))


def block_rows(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def token_blocks(df: DataFrame, tokens_col: str) -> DataFrame:
    """``df`` plus the number of the block of each row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = block_rows(packed.as_buffer())
                yield from t.append_column("_block", pa.array(np.full(len(t), block), pa.int64())).to_batches()

    return packed_blocks(df, tokens_col).mapInArrow(rows, T.StructType([*df.schema.fields, T.StructField("_block", T.LongType())]))


def over_blocks(df: DataFrame, tokens_col: str, mapping: DataFrame, from_col: str, fn: Callable, schema: T.StructType) -> DataFrame:
    """``fn(rows, sizes, at, known)`` for every block of ``df``: its rows as an Arrow table, their
    numbers of tokens, for each of the tokens laid end to end the row of ``known`` that has it
    (null: none has), and the rows of ``mapping`` met by a word of the block.

    ``mapping`` has one row per word; null arrays of ``tokens_col`` count as empty."""
    tokens = F.coalesce(F.col(tokens_col), F.array().cast(df.schema[tokens_col].dataType))
    laid = packed_blocks(df.withColumn(tokens_col, tokens), tokens_col)
    word = df.schema[tokens_col].dataType.elementType

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = block_rows(packed.as_buffer()).column(tokens_col).combine_chunks().flatten().unique().drop_null()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block), pa.int64()), words], names=["_block", "_tok"])

    words = laid.mapInArrow(distinct, T.StructType([T.StructField("_block", T.LongType()), T.StructField("_tok", word)]))
    found = words.join(mapping.withColumnRenamed(from_col, "_tok"), "_tok")

    def work(packed: pa.Table, known: pa.Table) -> pa.Table:
        if not len(packed):
            return empty
        rows = block_rows(packed.column("_rows")[0].as_buffer())
        toks = rows.column(tokens_col).combine_chunks()
        sizes = toks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at = pc.index_in(toks.flatten(), value_set=known.column("_tok").combine_chunks())
        return fn(rows, sizes, at, known)

    empty = to_arrow_schema(schema).empty_table()
    return laid.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(work, schema)


def lists(sizes: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.ListArray:
    """``values`` cut into lists of the given sizes."""
    mask = pa.array(null, pa.bool_()) if null is not None else None
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values, mask=mask)


def map_tokens(df: DataFrame, key_cols, tokens_col: str, mapping: DataFrame, from_col: str,
               to_col: str, out_col: str, default=None, keep_cols=()) -> DataFrame:
    """Replace every token by ``mapping[to_col]`` (``default``, a value, when missing).

    ``default=None`` keeps the token itself.  Rows with no tokens keep an empty array.
    ``mapping`` has one row per token.
    """
    names = [*key_cols, *keep_cols]
    value = mapping.schema[to_col].dataType
    schema = T.StructType([*df.select(*names).schema.fields, T.StructField(out_col, T.ArrayType(value))])

    def looked(rows: pa.Table, sizes: np.ndarray, at: pa.Array, known: pa.Table) -> pa.Table:
        got = known.column("_val").combine_chunks().take(at)
        got = pc.coalesce(got, rows.column("_toks").combine_chunks().flatten()) if default is None else pc.fill_null(got, default)
        return pa.Table.from_arrays([*(rows.column(n) for n in names), lists(sizes, got)], names=[*names, out_col])

    table = mapping.select(F.col(from_col), F.col(to_col).alias("_val"))
    return over_blocks(df.select(*names, F.col(tokens_col).alias("_toks")), "_toks", table, from_col, looked, schema)
