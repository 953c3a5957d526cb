"""Exact money and rounding.

Money is moved through the plans as BIGINT cents: sums are exact, order
independent and cheaper than wide decimals. Ratios reported "rounded to n
places" are rounded once, half away from zero, on the exact integer quotient
(``half_up_div``), so every engine that follows the same integer rule gets
bit-identical doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, FractionalType, IntegralType


def money_cents(value: Column, dtype: DataType) -> Column:
    """An amount column as BIGINT cents.

    Decimals with scale <= 2 convert exactly; longer ones and floating amounts
    are rounded to the nearest cent, halves away from zero.
    """
    if isinstance(dtype, DecimalType):
        return F.round(value * F.lit(100)).cast("bigint")
    if isinstance(dtype, IntegralType):
        return (value * F.lit(100)).cast("bigint")
    if isinstance(dtype, FractionalType):
        return F.round(value * F.lit(100.0)).cast("bigint")
    raise TypeError(f"amount column must be numeric, got {dtype}")


def half_up_div(num: Column, den: Column) -> Column:
    """``round(num / den)`` for integers, halves away from zero; null if den is 0/null.

    ``sign(num) * ((2*|num| + den) div (2*den))`` for den > 0. Callers scale
    ``num`` by ``10**places`` and divide the result by the same factor.
    """
    num_l = num.cast("bigint")
    den_l = den.cast("bigint")
    q = F.call_function(
        "div", F.abs(num_l) * F.lit(2) + den_l, den_l * F.lit(2)
    )
    signed = F.when(num_l < 0, -q).otherwise(q)
    return F.when(den_l > 0, signed)
