"""Rounding used for reported figures.

Engines round a double that sits exactly on a decimal tie differently (shortest
decimal form vs. binary value), so reported figures are nudged by 1e-10 before
rounding.  Every caller and the SQL oracle use the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUDGE = 1e-10


def r6(c, digits: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col + F.lit(NUDGE), digits)
