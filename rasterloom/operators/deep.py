"""Deep rasters: a variable number of samples per pixel, held as counts and prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Lines whose totals are added up at once where an image is one of its own.
LINES = 4096


def _in_row(keys: tuple[str, ...] = ()):
    return Window.partitionBy(*keys, "y").orderBy("x")


def row_cumulative(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Inclusive running count per row (keys, y, x, cnt -> + row_cum); ``keys`` tell images apart."""
    return counts.withColumn("row_cum", F.sum("cnt").over(_in_row(keys).rowsBetween(Window.unboundedPreceding, 0)))


def counts_from_cumulative(table: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The counts of a per-row running count; a decrease is an error (keys, y, x, row_cum -> + cnt)."""
    before = F.coalesce(F.lag("row_cum").over(_in_row(keys)), F.lit(0))
    cnt = F.col("row_cum") - before
    return table.withColumn("cnt", F.when(cnt < 0, F.raise_error("Corrupt: cumulative counts decrease")).otherwise(cnt))


def _starts(totals: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, at, start): the exclusive prefix sum of ``total`` along ``at`` within the keys."""
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, at, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))


def sample_offsets(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Exclusive prefix sum in row-major order within each image (+ off).

    Three levels, so that no window spans an image: sums within a line, a prefix over the line
    totals of each band of LINES lines, and one over the totals of an image's bands.
    """
    rows = counts.groupBy(*keys, F.floor(F.col("y") / LINES).alias("band"), "y").agg(F.sum("cnt").alias("total"))
    bands = _starts(rows.groupBy(*keys, "band").agg(F.sum("total").alias("total")).withColumn("_all", F.lit(0)), [*keys, "_all"], "band")
    lines = _starts(rows, [*keys, "band"], "y").join(bands.select(*keys, "band", F.col("start").alias("below")), [*keys, "band"])
    inside = row_cumulative(counts, keys).join(lines, [*keys, "y"])
    return inside.select(*keys, "y", "x", "cnt", (F.col("below") + F.col("start") + F.col("row_cum") - F.col("cnt")).alias("off"))


def sampled_offsets(counts: DataFrame, x_sampling: int, y_sampling: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Offsets of a subsampled channel; pixels without a sample have count 0 at the insertion offset."""
    here = (F.pmod("x", F.lit(x_sampling)) == 0) & (F.pmod("y", F.lit(y_sampling)) == 0)
    return sample_offsets(counts.withColumn("cnt", F.when(here, F.col("cnt")).otherwise(F.lit(0).cast("long"))), keys)


def statistics(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pixel locations, non-empty pixels, most samples in a pixel, all samples; of each image, with ``keys``."""
    return counts.groupBy(*keys).agg(F.count("*").alias("pixel_locations"), F.count_if(F.col("cnt") > 0).alias("non_empty_pixels"), F.max("cnt").alias("max_samples"), F.sum("cnt").alias("total_samples"))
