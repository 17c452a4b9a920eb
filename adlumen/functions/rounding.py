"""Decimal rounding of the binary value, ties to even.

``F.round`` rounds the printed decimal form half-up, so 2.675 gives 2.68 although the stored value is
below the tie. Published scores are rounded from the stored value, so that is what is done here, with
plain arithmetic that stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_binary(value: Column, digits: int) -> Column:
    """``value`` rounded to ``digits`` decimals; exact for magnitudes below about a million."""
    scale = 10**digits
    x = value.cast("double")
    low = F.floor(x * F.lit(float(scale))).cast("double")
    # Sign of x - (low + 0.5)/scale without rounding error: the head of x has 24 significant bits,
    # so both products below are exact.
    head = x.cast("float").cast("double")
    rest = x - head
    doubled = F.lit(float(2 * scale))
    side = (head * doubled - (low * F.lit(2.0) + F.lit(1.0))) + rest * doubled
    up = (side > 0) | ((side == 0) & (F.pmod(low, F.lit(2.0)) == 1.0))
    return F.when(up, low + F.lit(1.0)).otherwise(low) / F.lit(float(scale))
