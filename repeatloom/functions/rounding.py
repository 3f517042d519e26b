"""Rounding of doubles by their exact binary value, ties to even, as Python rounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = 134217729.0  # 2**27 + 1


def round_half_even(x: Column, digits: int) -> Column:
    """x to ``digits`` decimals, for magnitudes below 2**52 / 10**digits.

    The product with the power of ten is taken as a double and its exact error, so a tie of
    the rounded product is told from a true one.
    """
    scale = float(10**digits)
    high2, low2 = (F.lit(v) for v in _split(scale))
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  # value is computed once

    def with_high(size: Column, high: Column) -> Column:
        low, product = size - high, size * F.lit(scale)
        error = low * low2 - (((product - high * high2) - low * high2) - high * low2)
        whole = F.floor(product).cast("double")
        over = product - whole - F.lit(0.5)
        up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
        return (whole + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(scale)

    def rounded(v: Column) -> Column:
        size = F.abs(v)
        new = once(size * F.lit(SPLIT) - (size * F.lit(SPLIT) - size), lambda high: with_high(size, high))
        return F.when(v < 0, -new).otherwise(new)

    return once(x.cast("double"), rounded)


def _split(x: float) -> tuple[float, float]:
    high = x * SPLIT - (x * SPLIT - x)
    return high, x - high


def plain_number(x: Column, digits: int) -> Column:
    """A rounded double as text without an exponent: at least one decimal, at most ``digits``."""
    return F.regexp_replace(x.cast(f"decimal(30,{digits})").cast("string"), r"(\.\d+?)0+$", "$1")
