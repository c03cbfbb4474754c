"""Conversions between pixel types: half, float, 8, 16 and 32-bit unsigned integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U8, U16, U32 = 255, 65535, 4294967295


def half_bits_to_float(bits: Column) -> Column:
    """The value of a binary16 bit pattern (0 to 65535), as double; exact."""
    sign = F.when(F.shiftright(bits, 15) % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, mantissa = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023).cast("double")
    normal = F.pow(F.lit(2.0), (exponent - 25).cast("double")) * (mantissa + 1024)
    special = F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == 0, mantissa * 2.0**-24).when(exponent == 31, special).otherwise(normal)


def float_to_half_bits(v: Column) -> Column:
    """The binary16 pattern nearest to ``v``, ties to even; overflow gives infinity, NaN 0x7E00."""
    v = v.cast("double")
    size = F.abs(v)
    negative = F.when(v == 0, v.cast("string").startswith("-")).otherwise(v < 0)  # the text shows the sign of zero
    sign = F.when(~F.isnan(v) & negative, F.lit(32768)).otherwise(F.lit(0)).cast("long")
    # the exponent of the value's binade, exact: log2 may be off by one near powers of two
    guess = F.floor(F.log2(F.greatest(size, F.lit(2.0**-30)))).cast("int")
    up, down = F.pow(F.lit(2.0), (guess + 1).cast("double")) <= size, F.pow(F.lit(2.0), guess.cast("double")) > size
    exponent = F.greatest(F.when(up, guess + 1).when(down, guess - 1).otherwise(guess), F.lit(-14))
    steps = F.rint(size * F.pow(F.lit(2.0), (F.lit(10) - exponent).cast("double"))).cast("long")
    # steps beyond 1024 carry into the exponent by themselves
    body = (exponent + 14).cast("long") * 1024 + steps
    return F.when(F.isnan(v), F.lit(0x7E00).cast("long")).otherwise(sign + F.when(size >= 65520, F.lit(0x7C00).cast("long")).otherwise(body))


def half_binade(v: Column) -> Column:
    """The power of two whose multiples from 1 to 2 hold ``v``; NaN where it has none or its unit is no double: 0, negatives, infinities."""
    v = v.cast("double")
    exponent = F.least(F.floor(F.log2(F.greatest(v, F.lit(2.0**-1064)))), F.lit(1023)).cast("double")
    return F.when((v >= 2.0**-1064) & (v < float("inf")), F.pow(F.lit(2.0), exponent)).otherwise(F.lit(float("nan")))


def to_unsigned(v: Column, top: int, normalized: bool = True) -> Column:
    """Scaled (or raw), clamped to 0..top, half to even; NaN gives 0."""
    v = v.cast("double")
    x = v * float(top) if normalized else v
    return F.when(F.isnan(v) | ~(x > 0), F.lit(0)).when(x >= top, F.lit(top)).otherwise(F.rint(x)).cast("long")


def from_unsigned(v: Column, top: int, normalized: bool = True) -> Column:
    """To a value of 0..1 (or raw): 8 and 16 bits multiply by the float32 reciprocal."""
    if not normalized:
        return v.cast("double")
    if top == U32:
        return v.cast("double") * (1.0 / top)
    return v.cast("float") * F.lit(1.0 / top).cast("float")


def unsigned_strict(v: Column) -> Column:
    """Truncation to 32 bits that refuses NaN, infinities, negatives and overflow: null there."""
    v = v.cast("double")
    return F.when(~F.isnan(v) & (v >= 0) & (v < 4294967296.0), F.floor(v)).cast("long")


#: Which requested pixel type a stored one may be read as, in the strict reader.
READABLE = {("HALF", "HALF"), ("HALF", "FLOAT"), ("UINT", "UINT"), ("FLOAT", "FLOAT")}


def half_bits_to_unsigned(bits: Column, normalized: bool = False) -> Column:
    """A binary16 pattern as 32-bit unsigned integer, by way of its value."""
    return to_unsigned(half_bits_to_float(bits), U32, normalized)


def unsigned_to_half_bits(v: Column, normalized: bool = False) -> Column:
    """A 32-bit unsigned integer as binary16 pattern, by way of its value as 32-bit float."""
    return float_to_half_bits(from_unsigned(v, U32, normalized).cast("float"))


def preview_byte(v: Column) -> Column:
    """0..255 of a display value: half to even, clamped; NaN gives 0."""
    return F.when(F.isnan(v), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), F.rint(F.greatest(F.least(v, F.lit(10.0)), F.lit(-10.0)) * 255)))).cast("long")
