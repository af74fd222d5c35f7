"""Schema / shape / non-null report in one aggregation pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """(column_name, dtype, non_null, rows): one scan, counts stacked into rows."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(F.col(c)).alias(f"_nn{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    dtypes = dict(df.dtypes)
    stack_args = ", ".join(f"'{c}', '{dtypes[c]}', _nn{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {stack_args}) AS (column_name, dtype, non_null)", "_rows AS rows")
