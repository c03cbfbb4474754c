"""Layers, planar and interleaved forms, subsampled and luminance-chroma channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import names
from rasterloom.functions.color import DEFAULT_LUMINANCE, to_rgba_luma_chroma
from rasterloom.functions.numeric import non_negative, point_sample

#: Channel names of an interleaved image by its number of channels.
PLANAR_NAMES = {1: ("Y",), 2: ("R", "G"), 3: ("R", "G", "B"), 4: ("R", "G", "B", "A")}


def layers(channels: DataFrame) -> DataFrame:
    """Distinct layers with the index of their first channel (channel_idx, name -> layer, first_idx)."""
    layer = names.layer(F.col("name"))
    return channels.where(layer.isNotNull()).groupBy(layer.alias("layer")).agg(F.min("channel_idx").alias("first_idx"))


def layer_channels(channels: DataFrame, layer: str) -> DataFrame:
    """The channels of a layer with their names inside it."""
    return channels.withColumn("inner_name", names.in_layer(F.col("name"), layer)).where("inner_name is not null")


def interleave(samples: DataFrame, channels: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per pixel from (keys, y, x, channel, value); the list of channels is given, never inferred."""
    return samples.groupBy(*keys, "y", "x").agg(*(F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c) for c in channels))


def deinterleave(pixels: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, y, x, channel, value) from pixels; channels are named by their number."""
    parts = PLANAR_NAMES[len(columns)]
    return pixels.select(*keys, "y", "x", F.explode(F.array(*(F.struct(F.lit(n).alias("channel"), F.col(c).alias("value")) for n, c in zip(parts, columns, strict=True)))).alias("s")).select(*keys, "y", "x", "s.channel", "s.value")


def rgba(samples: DataFrame, preview: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, y, x, r, g, b, a) of a layer's (y, x, channel, value).

    A lone channel is repeated in all four (with ``preview`` alpha is 1 instead); else R, G and B are
    needed and a missing A is 1.
    """
    one = samples.groupBy(*keys, "y", "x").agg(F.count("*").alias("n"), F.max("value").alias("only"), *(F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c.lower()) for c in "RGBA"))
    lone = F.col("n") == 1
    bad = F.raise_error("InvalidData: a layer needs the channels R, G and B")
    color = [F.when(lone, F.col("only")).when(F.col(c).isNull(), bad.cast("double")).otherwise(F.col(c)).alias(c) for c in "rgb"]
    alpha = F.when(lone, F.lit(1.0) if preview else F.col("only")).otherwise(F.coalesce("a", F.lit(1.0))).alias("a")
    return one.select(*keys, "y", "x", *color, alpha)


def is_luminance_chroma(channels: DataFrame) -> DataFrame:
    """Per part: has Y, RY and BY, and none of R, G, B (part, name, deep)."""
    has = lambda n: F.bool_or(F.col("name") == n)
    return channels.groupBy("part").agg((has("Y") & has("RY") & has("BY") & ~has("R") & ~has("G") & ~has("B") & ~F.bool_or("deep")).alias("luminance_chroma"))


def subsample(pixels: DataFrame, xs: int, ys: int) -> DataFrame:
    """The pixels where a channel of that sampling has samples."""
    return pixels.where((F.pmod("x", F.lit(xs)) == 0) & (F.pmod("y", F.lit(ys)) == 0))


def point_expand(grid: DataFrame, samples: DataFrame, window: tuple[int, int, int, int], xs: int, ys: int, value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Every pixel of ``grid`` (keys, y, x) with the value of its nearest preceding sample, 0 for none.

    An equi-join on the aligned coordinate: no range join is needed. window: min_x, min_y,
    max_x, max_y.
    """
    x0, y0, x1, y1 = (F.lit(v).cast("long") for v in window)
    keyed = grid.select(*keys, "y", "x", point_sample(F.col("x"), x0, x1, F.lit(xs).cast("long")).alias("sx"), point_sample(F.col("y"), y0, y1, F.lit(ys).cast("long")).alias("sy"))
    values = samples.select(*keys, F.col("x").alias("sx"), F.col("y").alias("sy"), value)
    return keyed.join(values, [*keys, "sx", "sy"], "left").select(*keys, "y", "x", F.coalesce(value, F.lit(0.0)).alias(value))


def _neighbours(at: Column, first: int, step: int, count: int) -> tuple[Column, Column, Column]:
    """Lower and upper sampled coordinate and the fraction between them, clamped at the ends."""
    grid = non_negative((at - first) / step)
    low = F.least(F.floor(grid), F.lit(count - 1))
    high = F.least(low + 1, F.lit(count - 1))
    return low * step + first, high * step + first, F.when(low == high, F.lit(0.0)).otherwise(grid - low)


def upsample_bilinear(grid: DataFrame, samples: DataFrame, window: tuple[int, int, int, int], xs: int, ys: int, values: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Every pixel of ``grid`` (keys, y, x) with bilinearly interpolated values of a full grid of ``samples``.

    Each sample learns its right, lower and diagonal neighbours (itself at the ends) from its line and
    column; a pixel then meets the one sample above and left of it by an equi-join.
    """
    x0, y0, x1, y1 = window
    fx, fy = x0 + -x0 % xs, y0 + -y0 % ys
    nx, ny = (x1 - fx) // xs + 1, (y1 - fy) // ys + 1
    lx, _, tx = _neighbours(F.col("x"), fx, xs, nx)
    ly, _, ty = _neighbours(F.col("y"), fy, ys, ny)
    line, column = Window.partitionBy(*keys, "sy").orderBy("sx"), Window.partitionBy(*keys, "sx").orderBy("sy")
    beside = lambda c, w: F.coalesce(F.lead(c).over(w), F.col(c))
    some = range(len(values))
    cells = samples.select(*keys, F.col("x").alias("sx"), F.col("y").alias("sy"), *(F.col(v).alias(f"_a{i}") for i, v in enumerate(values)))
    cells = cells.select("*", *(beside(f"_a{i}", line).alias(f"_b{i}") for i in some))
    cells = cells.select("*", *(beside(f"_{c}{i}", column).alias(f"_{c}{i}_") for c in "ab" for i in some))
    placed = grid.select(*keys, "y", "x", lx.cast("long").alias("sx"), ly.cast("long").alias("sy"), tx.alias("_tx"), ty.alias("_ty"))
    x, y = F.col("_tx"), F.col("_ty")
    across = lambda i, end: F.col(f"_a{i}{end}") * (1 - x) + F.col(f"_b{i}{end}") * x
    mixed = [(across(i, "") * (1 - y) + across(i, "_") * y).alias(v) for i, v in enumerate(values)]
    return placed.join(cells, [*keys, "sx", "sy"]).select(*keys, "y", "x", *mixed)


def luma_chroma_to_rgba(luma: DataFrame, chroma: DataFrame, weights=DEFAULT_LUMINANCE, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, y, x, r, g, b, a) of full-size luminance (y, x, luma, alpha) and chroma (y, x, ry, by)."""
    r, g, b = to_rgba_luma_chroma(F.col("luma"), F.col("ry"), F.col("by"), weights)
    return luma.join(chroma, [*keys, "y", "x"]).select(*keys, "y", "x", r.alias("r"), g.alias("g"), b.alias("b"), F.coalesce("alpha", F.lit(1.0)).alias("a"))


def canonical_order(channels: DataFrame, part: str = "part") -> DataFrame:
    """Rank of each channel in its part by the bytes of its name; a repeated name is an error."""
    w = Window.partitionBy(part).orderBy("name")
    again = F.count("*").over(Window.partitionBy(part, "name")) > 1
    place = F.row_number().over(w) - 1
    return channels.withColumn("place", F.when(again, F.raise_error("InvalidArgument: repeated channel name").cast("int")).otherwise(place).cast("long"))
