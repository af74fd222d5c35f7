"""A fixed-size bitmap filter, as an expression.

The filter is a bitmap of ``bits`` bits with the hashed values of a column; it
lets every value of the column pass and few others, so that a scan can drop rows
before an exact join.  Its size does not depend on the data: where the column
has many values more rows pass, and the join does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap_filter(values: DataFrame, column: str, bits: int):
    """A function of a Column (same type as ``column``): may it be among the values?"""
    def slot(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits)).cast("int")

    slots = values.select(slot(F.col(column)).alias("s")).agg(F.collect_set("s").alias("s")).first()["s"]
    longs = [0] * (bits // 64)                                 # at most ``bits`` numbers come to the driver
    for s in slots:
        longs[s // 64] |= 1 << (s % 64)
    # one expression from text: a literal each costs the driver many seconds
    table = F.expr("array(" + ", ".join(f"{x - (1 << 64) if x >> 63 else x}L" for x in longs) + ")")

    def may_be(c: Column) -> Column:
        return F.getbit(F.get(table, F.shiftright(slot(c), 6)), slot(c) % 64) == 1

    return may_be
