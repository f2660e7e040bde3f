"""Partition-independent randomness.

``F.rand(seed)`` depends on how rows are partitioned, so every "random" choice here is a
function of an md5 digest over (seed, key...). The same expressions exist in DuckDB, which
lets the oracle reproduce every sample, shuffle and mask.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def md5_key(seed, *parts) -> Column:
    """md5 hex of ``seed:part1:part2...`` (all parts rendered as strings)."""
    cols = [_as_col(seed).cast("string")] + [_as_col(p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def hex_uniform(hex_col: Column, start: int = 1, digits: int = 8) -> Column:
    """Uniform in [0, 1) from ``digits`` hex digits of an md5 string starting at ``start`` (1-based)."""
    scale = float(16 ** digits)
    return F.conv(F.substring(hex_col, start, digits), 16, 10).cast("long") / F.lit(scale)


def hex_below(hex_col: Column, start: int, share: float, digits: int = 8) -> Column:
    """Whether the uniform that ``digits`` hex digits give is below ``share``; digits order as numbers do, so none is parsed."""
    bound = math.ceil(share * 16**digits)
    if bound >= 16**digits:
        return F.lit(True)
    return F.substring(hex_col, start, digits) < f"{bound:0{digits}x}"


def hex_int(hex_col: Column, start: int, digits: int) -> Column:
    """Integer value of ``digits`` hex digits of an md5 string starting at ``start`` (1-based)."""
    return F.conv(F.substring(hex_col, start, digits), 16, 10).cast("long")
