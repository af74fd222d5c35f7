"""Catalogue of named queries and their SQL oracles.

Each entry is a ``(spark, sf_dir) -> DataFrame`` callable built from the
library operators, plus (where the semantics are expressible in SQL) the
equivalent DuckDB statement over the same tables.  Column names match between
the two; floating-point results are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DESCRIPTIONS: dict[str, str] = {}


def query(name: str, sql: str | None = None, ops: str = ""):
    """Register ``fn`` as query ``name`` with an optional oracle ``sql``."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        DESCRIPTIONS[name] = ops
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco
