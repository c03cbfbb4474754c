"""Block planning: levels, tiles, chunk counts and header sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rows of a scanline block by compression.
LINES = {"NONE": 1, "RLE": 1, "ZIPS": 1, "ZIP": 16, "PXR24": 16, "PIZ": 32, "B44": 32, "B44A": 32, "DWAA": 32, "HTJ2K32": 32, "ZSTD": 32, "DWAB": 256, "HTJ2K256": 256}
# Bytes of a sample by pixel type.
BYTES = {"UINT": 4, "HALF": 2, "FLOAT": 4}


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def lines_per_block(compression: Column) -> Column:
    return lookup(LINES, compression)


def ceil_div(a: Column, b: Column) -> Column:
    return ((a + b - 1 - F.pmod(a + b - 1, b)) / b).cast("long")


def level_size(size: Column, level: Column, round_up: Column) -> Column:
    """The size after halving ``level`` times, 1 at least."""
    step = F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))
    return F.greatest(F.lit(1).cast("long"), F.when(round_up, ceil_div(size, step)).otherwise(((size - F.pmod(size, step)) / step).cast("long")))


def level_count(size: Column, round_up: Column) -> Column:
    """Levels down to size 1: in integers, so that powers of two come out exact."""
    levels = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda k: level_size(size, k, round_up) == 1)
    return F.array_min(levels) + 1


def chunk_header_bytes(tiled: Column, deep: Column, multipart: Column) -> Column:
    base = F.when(deep & tiled, 40).when(deep, 28).when(tiled, 20).otherwise(8)
    return base + F.when(multipart, 4).otherwise(0)


#: Fixed value: window coordinates lie between its negative and itself, both excluded.
WINDOW_LIMIT = 1073741823


def window_in_range(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """A window's coordinates are ones that a file may have."""
    return (min_x > -WINDOW_LIMIT) & (min_y > -WINDOW_LIMIT) & (max_x < WINDOW_LIMIT) & (max_y < WINDOW_LIMIT)


def sampling_divides(min_x: Column, min_y: Column, width: Column, height: Column, xs: Column, ys: Column) -> Column:
    """A flat scanline part's channel: its sampling divides the window's corner and size."""
    return (min_x % xs == 0) & (width % xs == 0) & (min_y % ys == 0) & (height % ys == 0)


def contains(a: str, b: str) -> Column:
    """Box a (columns a_min_x ...) holds box b."""
    c = F.col
    return (c(f"{a}_min_x") <= c(f"{b}_min_x")) & (c(f"{a}_min_y") <= c(f"{b}_min_y")) & (c(f"{a}_max_x") >= c(f"{b}_max_x")) & (c(f"{a}_max_y") >= c(f"{b}_max_y"))
