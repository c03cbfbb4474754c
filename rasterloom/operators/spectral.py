"""Spectral images: wavelengths, spectrum types, cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import names

MAX_WAVELENGTHS = 4096
TOLERANCE = 0.01


def distinct_wavelengths(sorted_values: Column) -> Column:
    """Ascending wavelengths; one is kept if it exceeds the last kept by more than the tolerance."""
    more = lambda kept, w: (w > F.element_at(kept, -1) + TOLERANCE) & (F.size(kept) < MAX_WAVELENGTHS)
    step = lambda kept, w: F.when(F.size(kept) == 0, F.array(w)).when(more(kept, w), F.concat(kept, F.array(w))).otherwise(kept)
    return F.aggregate(sorted_values, F.array().cast("array<double>"), step)


def distinct_wavelengths_any(values: Column) -> Column:
    """In the given order; one is dropped if it lies within the tolerance of any kept one; then sorted."""
    near = lambda kept, w: F.exists(kept, lambda k: F.abs(k - w) < TOLERANCE)
    step = lambda kept, w: F.when((w <= 0) | near(kept, w), kept).otherwise(F.concat(kept, F.array(w)))
    return F.array_sort(F.aggregate(values, F.array().cast("array<double>"), step))


def wavelengths(channels: DataFrame, group: str = "part") -> DataFrame:
    """(part, wavelengths) of (part, channel_idx, name)."""
    w = channels.select(group, names.wavelength(F.col("name")).alias("w")).where("w is not null")
    return w.groupBy(group).agg(distinct_wavelengths(F.array_sort(F.collect_list("w"))).alias("wavelengths"))


def wavelengths_any(channels: DataFrame, group: str = "part") -> DataFrame:
    w = channels.select(group, "channel_idx", names.wavelength(F.col("name")).alias("w")).where("w > 0")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("channel_idx", "w"))), lambda s: s["w"])
    return w.groupBy(group).agg(distinct_wavelengths_any(ordered).alias("wavelengths"))


def spectrum_type(channels: DataFrame, group: str = "part") -> DataFrame:
    """Reflective if any T channel, else Polarised if any S1-S3, else Emissive if any S0, else None."""
    kind = names.spectral_kind(F.col("name"))
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    name = F.when(has(kind == "T"), "Reflective").when(has(kind.isin("S1", "S2", "S3")), "Polarised").when(has(kind == "S0"), "Emissive").otherwise("None")
    return channels.groupBy(group).agg(name.alias("spectrum_type"))


def pixel_spectra(cube: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, y, x, spectrum): values in the order of their wavelengths; a null wavelength_idx stands for a pixel without any."""
    sampled = F.when(F.col("wavelength_idx").isNotNull(), F.struct("wavelength_idx", "value"))
    return cube.groupBy(*keys, "y", "x").agg(F.transform(F.array_sort(F.collect_list(sampled)), lambda s: s["value"]).alias("spectrum"))


def sample(spectrum: Column, index: Column) -> Column:
    """One value, 0.0 where the index is out of range."""
    return F.coalesce(F.get(spectrum, index.cast("int")), F.lit(0.0))


def cube(samples: DataFrame, axis: DataFrame, channels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, stokes, wavelength_idx, y, x, value) of samples (keys, name, y, x, value) on an axis (wavelength_idx, wavelength).

    channels: the header's (keys, channel_idx, name). A channel joins the first axis entry within the
    tolerance; where several join one entry, the last of the header counts; channels that match
    nothing are skipped. All of that is settled on the headers, so samples only meet their channel.
    The axis is at most 4096 rows.
    """
    listed = channels.select(*keys, "channel_idx", "name", names.wavelength(F.col("name")).alias("w"), F.coalesce(names.stokes(F.col("name")), F.lit(0)).alias("stokes")).where("w is not null")
    bins = axis.select("wavelength_idx", "wavelength", F.explode(F.sequence(F.floor((F.col("wavelength") - TOLERANCE) * 50), F.floor((F.col("wavelength") + TOLERANCE) * 50))).alias("bin"))
    matched = listed.join(F.broadcast(bins), (F.floor(listed["w"] * 50) == bins["bin"]) & (F.abs(listed["w"] - bins["wavelength"]) < TOLERANCE))
    first = matched.groupBy(*keys, "stokes", "channel_idx", "name").agg(F.min("wavelength_idx").alias("wavelength_idx"))
    last = first.groupBy(*keys, "stokes", "wavelength_idx").agg(F.max_by("name", "channel_idx").alias("name"))
    return samples.select(*keys, "name", "y", "x", "value").join(last, [*keys, "name"]).select(*keys, "stokes", "wavelength_idx", "y", "x", "value")


def cube_channels(cube_: DataFrame, kind: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, name, y, x, value) of a cube (keys, wavelength, y, x, value), with formatted channel names."""
    return cube_.select(*keys, names.spectral_name(kind, F.col("wavelength")).alias("name"), "y", "x", "value")


def clashing_names(axis: DataFrame, kind: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, name, n): channel names that several wavelengths of an axis (keys, wavelength) are formatted to."""
    named = axis.select(*keys, names.spectral_name(kind, F.col("wavelength")).alias("name"))
    return named.groupBy(*keys, "name").agg(F.count("*").alias("n")).where("n > 1")


#: Attribute names of spectral metadata.
SPECTRAL_ATTRIBUTES = ("spectralLayoutVersion", "ROOT/units", "emissiveUnits", "polarisationHandedness")


def units(attributes: Column) -> Column:
    """The units attribute of a map of attributes, the root's first."""
    return F.coalesce(F.try_element_at(attributes, F.lit("ROOT/units")), F.try_element_at(attributes, F.lit("emissiveUnits")))


def with_spectral_attributes(attributes: Column, version: str, unit: str, handedness: str | None = None) -> Column:
    """An attribute array (structs of name and value) with the spectral ones replaced."""
    new = [("spectralLayoutVersion", version), ("emissiveUnits", unit)] + ([("polarisationHandedness", handedness)] if handedness else [])
    kept = F.filter(attributes, lambda a: ~a["name"].isin(*SPECTRAL_ATTRIBUTES))
    return F.concat(kept, F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in new)))
