"""Numeric column helpers: money, ratios, rounding, the normal curve."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five-term rational approximation of erf (Abramowitz and Stegun 7.1.26).
ERF_P = 0.3275911
ERF_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), 0)


def cents(amount: Column | str) -> Column:
    """Money as whole cents.

    Sums of cents are integers, so a total does not depend on the order in which
    tasks finish, and the aggregation stays on a primitive long.
    """
    return F.floor(col(amount) * F.lit(100.0) + F.lit(0.5))


def money(total_cents: Column) -> Column:
    """Summed cents back as currency units."""
    return total_cents / F.lit(100.0)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, null when the divisor is 0 (ANSI mode would raise)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def half_up(value: Column | str, places: int) -> Column:
    """Round half away from zero on the decimal digits, not on the binary double.

    Six decimals absorb the noise of double arithmetic before the rounding.
    """
    return F.round(col(value).cast("decimal(28,6)"), places).cast("double")


def clip(value: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(value), F.lit(low)), F.lit(high))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function; absolute error below 1e-7."""
    z = F.abs(x) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * z)
    poly = reduce(lambda acc, c: (acc + F.lit(c)) * t, reversed(ERF_COEFFICIENTS), F.lit(0.0))
    erf = F.lit(1.0) - poly * F.exp(-z * z)
    return F.lit(0.5) * (F.lit(1.0) + F.when(x < 0, -erf).otherwise(erf))
