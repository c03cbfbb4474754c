"""Channel names: layers, spectral channels, attribute bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECTRAL = r"^(S[0-3]|T)\.([+-]?[0-9]*[.,]?[0-9]*)nm$"
MAGIC = "762F3101"


def layer(name: Column) -> Column:
    """What stands before the last dot; null unless both sides have text."""
    leaf = F.substring_index(name, ".", -1)
    cut = F.length(name) - F.length(leaf) - 1
    return F.when((cut > 0) & (F.length(leaf) > 0), name.substr(F.lit(1), cut))


def leaf(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def in_layer(name: Column, chosen: str) -> Column:
    """The name within a layer, null if it lies elsewhere.

    An empty layer holds the names whose last dot is absent or first, and loses that dot.
    """
    if chosen:
        return F.when(F.startswith(name, F.lit(chosen + ".")), name.substr(F.lit(len(chosen) + 2), F.length(name)))
    last = F.length(name) - F.length(F.substring_index(name, ".", -1))  # 1-based place of the last dot, 0 for none
    return F.when(last <= 1, F.when(last == 1, name.substr(F.lit(2), F.length(name))).otherwise(name))


def spectral_kind(name: Column) -> Column:
    """'S0'..'S3' or 'T' of a spectral channel; null for others."""
    return F.when(wavelength(name).isNotNull(), F.regexp_extract(name, SPECTRAL, 1))


def wavelength(name: Column) -> Column:
    """The wavelength in nanometres; null unless the whole name is spectral and it is not negative."""
    text = F.translate(F.regexp_extract(name, SPECTRAL, 2), ",", ".")
    value = F.when(text.rlike(r"[0-9]"), text.try_cast("double"))
    return F.when(value >= 0, value)


def stokes(name: Column) -> Column:
    """0..3 of an S channel, null else (also for T)."""
    kind = spectral_kind(name)
    return F.when(F.startswith(kind, F.lit("S")), kind.substr(2, 1).cast("int"))


def wavelength_text(w: Column, carry: bool = True) -> Column:
    """``whole,micros`` with six digits; a full million carries over unless ``carry`` is off."""
    whole = F.floor(w).cast("long")
    micros = F.floor((w - whole) * 1_000_000 + 0.5).cast("long")
    if carry:
        whole, micros = F.when(micros >= 1_000_000, whole + 1).otherwise(whole), F.when(micros >= 1_000_000, F.lit(0)).otherwise(micros)
    return F.concat(whole.cast("string"), F.lit(","), F.lpad(micros.cast("string"), 6, "0"))


def spectral_name(kind: str, w: Column, component: Column | int = 0) -> Column:
    """A channel name for 'emissive', 'polarised' (with a Stokes component) or 'reflective'."""
    if kind == "reflective":
        return F.concat(F.lit("T."), wavelength_text(w), F.lit("nm"))
    c = component if isinstance(component, Column) else F.lit(component)
    c = F.lit(0) if kind == "emissive" else F.greatest(F.lit(0), F.least(F.lit(3), c))
    return F.concat(F.lit("S"), c.cast("string"), F.lit("."), wavelength_text(w), F.lit("nm"))


def little_endian(data: Column, size: int, signed: bool = True) -> Column:
    """An integer attribute of ``size`` bytes; null where the length differs."""
    value = F.conv(F.hex(_reversed(data, size)), 16, 10)
    if size == 8 and not signed:
        return F.when(F.octet_length(data) == size, value.cast("decimal(20,0)"))
    value = value.cast("decimal(20,0)")
    if signed:
        value = F.when(value >= 2 ** (8 * size - 1), value - F.lit(2 ** (8 * size)).cast("decimal(20,0)")).otherwise(value)
    return F.when(F.octet_length(data) == size, value.cast("long"))


def _reversed(data: Column, size: int) -> Column:
    return F.concat(*(F.substring(data, i, 1) for i in range(size, 0, -1)))


def little_endian_float(data: Column) -> Column:
    """A 32-bit float attribute, exactly, as double; null where the length differs."""
    bits = little_endian(data, 4, signed=False)
    sign = F.when(F.shiftright(bits, 31) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, fraction = F.shiftright(bits, 23).bitwiseAND(255), bits.bitwiseAND(0x7FFFFF).cast("double")
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    normal = (fraction + float(1 << 23)) * F.pow(F.lit(2.0), (exponent - 150).cast("double"))
    return sign * F.when(exponent == 0, fraction * 2.0**-149).when(exponent == 255, special).otherwise(normal)


def little_endian_double(data: Column) -> Column:
    """A 64-bit float attribute; null where the length differs."""
    low, top = little_endian(F.substring(data, 1, 4), 4, signed=False), little_endian(F.substring(data, 5, 4), 4, signed=False)
    sign = F.when(F.shiftright(top, 31) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, fraction = F.shiftright(top, 20).bitwiseAND(2047), top.bitwiseAND(0xFFFFF).cast("double") * 2.0**32 + low.cast("double")
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    # two factors, as 2 ** (exponent - 1075) alone may leave the range
    half = F.floor((exponent - 1075) / 2)
    normal = (fraction + 2.0**52) * F.pow(F.lit(2.0), half.cast("double")) * F.pow(F.lit(2.0), (exponent - 1075 - half).cast("double"))
    value = F.when(exponent == 0, fraction * 2.0**-1022 * 2.0**-52).when(exponent == 2047, special).otherwise(normal)
    return F.when(F.octet_length(data) == 8, sign * value)


def valid_name(name: Column, long_names: Column) -> Column:
    """UTF-8 bytes without NUL, 1 to 31 (or 255) of them."""
    text = F.when(F.is_valid_utf8(name), name)
    size = F.octet_length(name)
    most = F.when(long_names, 255).otherwise(31)
    return F.coalesce(text.isNotNull() & (size > 0) & (size <= most) & ~F.contains(text, F.lit("\0")), F.lit(False))


def is_image(content: Column) -> Column:
    """The file signature test."""
    return F.hex(F.substring(content, 1, 4)) == MAGIC


def version_fields(word: Column) -> dict[str, Column]:
    """Flags of a file's version word (a long)."""
    bit = lambda n: F.shiftright(word, n).bitwiseAND(1) == 1
    tiled, multipart = bit(9), bit(12)
    unknown = F.shiftright(word, 13) != 0
    status = F.when(word.bitwiseAND(255) != 2, F.lit("Unsupported")).when(unknown | bit(8), F.lit("Unsupported")).when(tiled & multipart, F.lit("Corrupt")).otherwise(F.lit("Success"))
    return {"version": word.bitwiseAND(255), "tiled": tiled, "long_names": bit(10), "non_image": bit(11), "multipart": multipart, "status": status}
