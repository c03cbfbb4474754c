"""Whole-image conveniences on top of ``frames``: RGBA, layers, spectral cubes, summaries, a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import names
from rasterloom.operators import channels, spectral
from rasterloom.sources import frames

_KEYS = ("file_id", "part_index", "level_x", "level_y")


def layer_samples(samples: DataFrame, layer: str | None = None) -> DataFrame:
    """Samples of one layer under their names inside it; all samples if ``layer`` is None."""
    if layer is None:
        return samples
    return samples.withColumn("channel", names.in_layer(F.col("channel"), layer)).where("channel is not null")


def rgba(samples: DataFrame, layer: str | None = None, preview: bool = False) -> DataFrame:
    """(file_id, part_index, level_x, level_y, y, x, r, g, b, a) of flat samples."""
    own = layer_samples(samples, layer)
    return channels.rgba(own, preview, keys=_KEYS)


def load_rgba(spark: SparkSession, path: str, layer: str | None = None, preview: bool = False) -> DataFrame:
    """The first part's base level as RGBA pixels; a layer without channels gives no rows."""
    samples = frames.read_images(spark, path).where("part_index = 0 and level_x = 0 and level_y = 0")
    return rgba(samples, layer, preview).drop("part_index", "level_x", "level_y")


def load_multipart(spark: SparkSession, path: str) -> DataFrame:
    """Samples of all parts; a deep part anywhere is unsupported."""
    deep = F.col("part_type").startswith("deep")
    checked = frames.read_images(spark, path, "header").groupBy("file_id").agg(F.bool_or(deep).alias("deep"))
    checked = checked.select("file_id", F.when(F.col("deep"), F.raise_error("Unsupported: a deep part")).otherwise(F.lit(True)).cast("boolean").alias("flat"))
    return frames.read_images(spark, path).join(checked.where("flat"), "file_id").drop("flat")


def rgba_samples(pixels: DataFrame, components: int) -> DataFrame:
    """(file_id, y, x, channel, value) to save of interleaved pixels (r, g, b, a): 1 is named A, 3 and 4 are colours."""
    wanted = {1: [("A", "r")], 3: [("R", "r"), ("G", "g"), ("B", "b")], 4: [("R", "r"), ("G", "g"), ("B", "b"), ("A", "a")]}
    if components not in wanted:
        raise ValueError("InvalidArgument: 1, 3 or 4 components")
    listed = F.array(*(F.struct(F.lit(n).alias("channel"), F.col(c).alias("value")) for n, c in wanted[components]))
    return pixels.select("file_id", "y", "x", F.explode(listed).alias("s")).select("file_id", "y", "x", "s.*")


def encode_rgba(pixels: DataFrame, components: int = 4, half: bool = False, small: bool = False) -> DataFrame:
    """(file_id, content): ZIP, or no compression for images below 16 x 16 (``small``)."""
    return frames.encode_images(rgba_samples(pixels, components), "NONE" if small else "ZIP", "HALF" if half else "FLOAT")


def layers(headers: DataFrame) -> DataFrame:
    """(file_id, part_index, layer, first_idx): layers in the order of their first channel."""
    listed = headers.select("file_id", "part_index", F.posexplode("channels").alias("channel_idx", "c")).select("file_id", "part_index", "channel_idx", F.col("c.name").alias("name"))
    layer = names.layer(F.col("name"))
    return listed.where(layer.isNotNull()).groupBy("file_id", "part_index", layer.alias("layer")).agg(F.min("channel_idx").alias("first_idx"))


def spectral_cube(samples: DataFrame, headers: DataFrame, wavelengths: list[float]) -> DataFrame:
    """(file_id, stokes, wavelength_idx, y, x, value) of the first parts' spectral channels on a given axis; later channels overwrite earlier ones."""
    s = samples.where("part_index = 0 and level_x = 0 and level_y = 0").withColumnRenamed("channel", "name")
    listed = headers.where("part_index = 0").select("file_id", F.posexplode("channels").alias("channel_idx", "c")).select("file_id", "channel_idx", F.col("c.name").alias("name"))
    axis = samples.sparkSession.createDataFrame(list(enumerate(wavelengths)), "wavelength_idx long, wavelength double")
    return spectral.cube(s, axis, listed, keys=("file_id",))


def describe(headers: DataFrame) -> DataFrame:
    """One line of text per part: name, type, size, compression and channels."""
    size = F.concat_ws("x", F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1)
    box = F.format_string("(%d, %d)-(%d, %d)", "min_x", "min_y", "max_x", "max_y")
    listed = F.array_join(F.transform("channels", lambda c: F.concat(c["name"], F.lit(":"), c["pixel_type"], F.when((c["x_sampling"] != 1) | (c["y_sampling"] != 1), F.concat_ws("x", F.lit(" "), c["x_sampling"], c["y_sampling"])).otherwise(F.lit("")))), ", ")
    title = F.when(F.col("name") == "", F.concat(F.lit("part "), F.col("part_index").cast("string"))).otherwise(F.col("name"))
    return headers.select("file_id", "part_index", F.concat_ws(" | ", title, "part_type", size, box, "compression", "line_order", listed).alias("summary"))


def rename_part(samples: DataFrame, headers: DataFrame, index: int, name: str) -> DataFrame:
    """Samples with part_name, as ``encode_images`` takes it: that of their header, of part ``index`` the new one."""
    given = F.when(F.col("part_index") == index, F.lit(name)).otherwise(F.col("name")).alias("part_name")
    return samples.join(headers.select("file_id", "part_index", given), ["file_id", "part_index"])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of sample images: sample_id, kind, relative_path."""
    return spark.read.schema("sample_id string, kind string, relative_path string").option("header", True).csv(path)
