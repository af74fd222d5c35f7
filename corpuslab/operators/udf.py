"""User-function surface (D1-D4, D6): the hooks the reference exposes as
callbacks, each mapped onto Arrow-batched Spark primitives."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordmap import explode_tokens  # noqa: F401  (D6)


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """Batched row map adding columns: ``fn(iterator of pandas frames)``."""
    return df.mapInPandas(fn, schema)


def map_groups(df: DataFrame, key, fn, schema) -> DataFrame:
    """Per-group pandas callback (a collate step per ``batch_id``).  Only for
    groups of bounded size, such as fixed-size batches."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).applyInPandas(fn, schema)


def map_text(col, fn, return_type="string"):
    """D3: scalar pandas UDF fallback for a text callback (Series -> Series)."""
    return F.pandas_udf(fn, return_type)(col)


def eval_with(df: DataFrame, fn, cols, partials, finish, group=(), name: str = "value") -> DataFrame:
    """A metric callback over mergeable partials.

    ``fn(Series...) -> DataFrame`` gets one Arrow batch of one group and returns
    rows of the double columns ``partials``; those are summed by Spark (map-side
    first), and ``finish`` is an expression over the sums.  No group is ever
    gathered in one Python process.
    """
    group, cols = list(group), list(cols)

    def work(batches):
        for pdf in batches:
            parts = pdf.groupby(group, dropna=False, sort=False) if group else [((), pdf)]
            for key, part in parts:
                out = fn(*[part[c] for c in cols])[list(partials)].astype("float64")
                for k, g in zip(key if isinstance(key, tuple) else (key,), group):
                    out[g] = pd.Series([k] * len(out), dtype=part[g].dtype)
                yield out[[*group, *partials]]

    schema = T.StructType([*[df.schema[g] for g in group], *[T.StructField(p, T.DoubleType()) for p in partials]])
    sums = df.select(*group, *[c for c in cols if c not in group]).mapInPandas(work, schema)
    agg = [F.sum(p).alias(p) for p in partials]
    merged = sums.groupBy(*group).agg(*agg) if group else sums.agg(*agg)
    return merged.select(*group, finish.alias(name))
