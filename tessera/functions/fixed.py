"""Fixed-point arithmetic on integer columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_shift(x: Column, n: int) -> Column:
    """x / 2^n, halves up."""
    return F.shiftright(x + F.lit((1 << n) >> 1), n)


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def div(x: Column, y: Column | int) -> Column:
    """Integer quotient, truncated toward zero; null for a zero divisor."""
    return F.call_function("div", x, F.nullif(y if isinstance(y, Column) else F.lit(y), F.lit(0)))


def rounded_div(x: Column, y: Column) -> Column:
    """(x + y div 2) div y for positive numbers."""
    return div(x + F.shiftright(y, 1), y)


def leb128_size(x: Column) -> Column:
    """Bytes of a non-negative integer in groups of seven bits."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(x < F.lit(1 << (7 * n)), F.lit(n)).otherwise(out)
    return out.cast("bigint")
