"""Tie-robust rounding for reported doubles.

Sums of the same values in a different order can differ in the last bit; for values that sit
exactly on a rounding tie (common for means of short decimals) that flips the rounded digit.
Adding a fixed offset far above summation noise and far below half a rounding step moves
every exact-decimal value off the tie, so equal-up-to-noise inputs round identically.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIE_OFFSET = 3.1e-12
DIGITS = 9


def rounded(col, digits: int = DIGITS) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + F.lit(TIE_OFFSET), digits)
