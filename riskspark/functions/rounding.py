"""Decimal rounding that gives the same double on every engine.

``round_half_away(x, d)`` scales by 10^d in double arithmetic, rounds half
away from zero, and scales back. Rounding the exact binary value instead
(``F.round``) can disagree with other engines on values that print as ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(x, d: int) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    scale = float(10 ** d)
    return F.round(c * F.lit(scale), 0) / F.lit(scale)


def cents(x) -> Column:
    return round_half_away(x, 2)
