"""Separable resampling: per-axis weights joined to the pixels, one axis after the other."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILTERS = ("box", "triangle", "catmullrom", "mitchell")
EDGES = ("clamp", "reflect", "wrap")
#: Distance that each filter reaches.
RADIUS = {"box": 0.5, "triangle": 1.0, "catmullrom": 2.0, "mitchell": 2.0}
#: B and C of the cubic family.
CUBIC = {"catmullrom": (0.0, 0.5), "mitchell": (1 / 3, 1 / 3)}


def kernel(name: str, distance: float) -> float:
    d = abs(distance)
    if name == "box":
        return 1.0 if d <= 0.5 else 0.0
    if name == "triangle":
        return max(0.0, 1.0 - d)
    b, c = CUBIC[name]
    if d < 1:
        return ((12 - 9 * b - 6 * c) * d**3 + (-18 + 12 * b + 6 * c) * d**2 + 6 - 2 * b) / 6
    if d < 2:
        return ((-b - 6 * c) * d**3 + (6 * b + 30 * c) * d**2 + (-12 * b - 48 * c) * d + 8 * b + 24 * c) / 6
    return 0.0


def edge(index: int, size: int, mode: str) -> int:
    if 0 <= index < size:
        return index
    if size == 1:
        return 0
    if mode == "clamp":
        return 0 if index < 0 else size - 1
    if mode == "wrap":
        return index % size
    index %= 2 * size - 2
    return index if index < size else 2 * size - 2 - index


def axis_weights(source: int, target: int, name: str, mode: str) -> list[tuple[int, int, float]]:
    """(target index, source index, weight): normalised per target index."""
    scale = max(1.0, source / target)
    reach, out = RADIUS[name] * scale, []
    for i in range(target):
        center = (i + 0.5) * (source / target) - 0.5
        low, high = math.ceil(center - reach), math.floor(center + reach)
        sums: dict[int, float] = {}
        for j in range(low, max(low, high) + 1):
            k = edge(j, source, mode)
            sums[k] = sums.get(k, 0.0) + kernel(name, (center - j) / scale)
        total = sum(sums.values())
        if total == 0:
            out.append((i, min(sums), 1.0))
        else:
            out += [(i, k, w / total) for k, w in sorted(sums.items()) if w]
    return out


def weight_table(spark: SparkSession, source: int, target: int, name: str, mode: str) -> DataFrame:
    """An axis' weights; their number follows the image's side, so they may be broadcast."""
    return spark.createDataFrame(axis_weights(source, target, name, mode), "d long, s long, w double")


def resize(pixels: DataFrame, values: list[str], size: tuple[int, int], target: tuple[int, int], name: str = "mitchell", mode: str = "clamp", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, y, x, values): every image (told apart by ``keys``) resized from ``size`` to ``target`` (width, height).

    Each pass multiplies with an axis' weights and sums by target pixel; partial sums are
    made before the shuffle. Sums are in double precision.
    """
    spark = pixels.sparkSession
    across = weight_table(spark, size[0], target[0], name, mode)
    down = weight_table(spark, size[1], target[1], name, mode)
    rows = pixels.join(F.broadcast(across), F.col("x") == F.col("s")).groupBy(*keys, "y", F.col("d").alias("x")).agg(*(F.sum(F.col(v) * F.col("w")).alias(v) for v in values))
    return rows.join(F.broadcast(down), F.col("y") == F.col("s")).groupBy(*keys, F.col("d").alias("y"), "x").agg(*(F.sum(F.col(v) * F.col("w")).alias(v) for v in values))


def resize_alpha(pixels: DataFrame, size: tuple[int, int], target: tuple[int, int], name: str = "mitchell", mode: str = "clamp", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, y, x, r, g, b, a) resized with colours weighted by alpha; colours of alpha 0 become 0."""
    c = F.col
    lifted = pixels.select(*keys, "y", "x", *((c(v) * c("a")).alias(v) for v in "rgb"), "a")
    small = resize(lifted, ["r", "g", "b", "a"], size, target, name, mode, keys)
    return small.select(*keys, "y", "x", *(F.when(c("a") != 0, c(v) / c("a")).otherwise(F.lit(0.0)).alias(v) for v in "rgb"), "a")
