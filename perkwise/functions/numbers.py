"""Rounding and number text that agree with NumPy and Python to the last digit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean(col: Column) -> Column:
    """NaN becomes null, so both kinds of missing number behave alike."""
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


_SPLITTER = 134217729.0  # 2**27 + 1


def _halves(x):
    """A double as the sum of two with half the digits each (Veltkamp)."""
    high = x * _SPLITTER - (x * _SPLITTER - x)
    return high, x - high


def round_exact(col: Column, digits: int) -> Column:
    """Python's ``round(x, digits)``: half-even on the exact binary value.

    Scaling may land on a tie that the exact value misses; the error of the product (Dekker) tells
    on which side it lies.
    """
    scale = float(10**digits)
    x = col.cast("double")
    product = x * F.lit(scale)
    (high, low), (scale_high, scale_low) = _halves(x), _halves(scale)
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    nearest = F.rint(product)
    tie = F.abs(product - nearest) == 0.5
    whole = (
        F.when(tie & (error > 0), product + 0.5).when(tie & (error < 0), product - 0.5).otherwise(nearest)
    )
    # Beyond 2**52 a double has no fraction left to round.
    return F.when(F.abs(product) < 4503599627370496.0, whole / F.lit(scale)).otherwise(x)


def fixed_text(col: Column, digits: int) -> Column:
    """``format(x, '.Nf')``. The rounded value has no more than the wanted digits, so its text is exact."""
    return F.replace(F.format_number(round_exact(col, digits), digits), F.lit(","), F.lit(""))


def round_scaled(col: Column, digits: int) -> Column:
    """NumPy's ``round(x, digits)``: scale, round half-even, scale back."""
    factor = float(10**digits)
    return F.rint(col * F.lit(factor)) / F.lit(factor)


def percent_text(col: Column, digits: int) -> Column:
    """``format(x, '.N%')``."""
    return F.concat(fixed_text(col * F.lit(100.0), digits), F.lit("%"))


def ratio(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """Division in which a zero or missing denominator gives ``default``."""
    return F.when(
        denominator.isNull() | (denominator == 0), F.lit(default)
    ).otherwise(numerator.cast("double") / denominator)


def minmax(col: Column, low: Column, high: Column) -> Column:
    """Scale to [0, 1]; a constant column becomes zeros."""
    return F.coalesce((col - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))


def clip(col: Column, low: float, high: float) -> Column:
    """Limit to a range, keeping null."""
    return F.when(col < low, F.lit(low)).when(col > high, F.lit(high)).otherwise(col)
