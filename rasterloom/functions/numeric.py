"""Numeric helpers that keep IEEE and C-like semantics under ANSI SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def non_negative(v: Column) -> Column:
    """max(v, 0) with NaN going to 0: a comparison with NaN is true in SQL, so it is tested first."""
    return F.when(F.isnan(v) | ~(v > 0), F.lit(0.0)).otherwise(v)


def clamp01(v: Column) -> Column:
    return F.when(F.isnan(v) | ~(v > 0), F.lit(0.0)).when(v > 1, F.lit(1.0)).otherwise(v)


def over(a: Column, b: Column) -> Column:
    """a / b as IEEE 754 has it: infinities and NaN instead of an error."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return F.when(b != 0, a / b).when(F.isnan(a) | (a == 0) | F.isnan(b), nan).when(a > 0, inf).otherwise(-inf)


def round_away(v: Column, places: int) -> Column:
    """Decimal rounding, halves away from zero, in binary arithmetic as C has it: a value that goes to zero keeps its sign."""
    scale = 10.0**places
    x = v.cast("double") * scale
    size = F.abs(x)
    whole = F.floor(size).cast("double")
    rounded = F.signum(x) * (whole + F.when(size - whole >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0)))
    at_once = F.abs(x) == float("inf")  # also where only the scaled value is infinite
    return F.when(at_once, v.cast("double")).when(size < 2.0**52, rounded / scale).otherwise(x / scale)


def floor_div(a: Column, b: Column | int) -> Column:
    """Integer division that rounds towards minus infinity; b > 0."""
    b = b if isinstance(b, Column) else F.lit(b)
    return ((a - F.pmod(a, b)) / b).cast("long")


def sample_count(low: Column, high: Column, step: Column) -> Column:
    """Multiples of ``step`` in [low, high]."""
    return floor_div(high, step) - floor_div(low - 1, step)


def point_sample(at: Column, low: Column, high: Column, step: Column) -> Column:
    """The nearest preceding sampled coordinate in [low, high], or the first one; null for none."""
    first = low + F.pmod(-low, step)
    return F.when(first <= high, F.greatest(first, at - F.pmod(at, step)))
