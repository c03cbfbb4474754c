"""Blocks of images: plans, lookups and completeness checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo
from rasterloom.functions.numeric import floor_div, sample_count


def levels(headers: DataFrame) -> DataFrame:
    """Resolution levels of tiled headers: one, along the diagonal (MIP), or all pairs (RIP)."""
    c = F.col
    w, h = c("max_x") - c("min_x") + 1, c("max_y") - c("min_y") + 1
    nx, ny = geo.level_count(w, c("round_up")), geo.level_count(h, c("round_up"))
    count_x = F.when(c("mode") == "ONE", 1).when(c("mode") == "MIP", F.greatest(nx, ny)).otherwise(nx)
    tiled = headers.where("tile_x is not null").withColumn("level_x", F.explode(F.sequence(F.lit(0), count_x - 1)))
    other = F.when(c("mode") == "RIP", F.sequence(F.lit(0), ny - 1)).otherwise(F.array(c("level_x")))
    both = tiled.withColumn("level_y", F.explode(other))
    return both.select(*(c(n) for n in headers.columns), c("level_x").cast("long").alias("level_x"), c("level_y").cast("long").alias("level_y"), geo.level_size(w, c("level_x"), c("round_up")).alias("width"), geo.level_size(h, c("level_y"), c("round_up")).alias("height"))


def tiled_blocks(headers: DataFrame) -> DataFrame:
    """Tiles of all levels, clipped; regions begin at the data window's corner on every level."""
    c, lv = F.col, levels(headers)
    across, down = geo.ceil_div(c("width"), c("tile_x")), geo.ceil_div(c("height"), c("tile_y"))
    zero = F.lit(0).cast("long")
    tiles = lv.withColumn("ty", F.explode(F.sequence(zero, down - 1))).withColumn("tx", F.explode(F.sequence(zero, across - 1)))
    x0, y0 = c("min_x") + c("tx") * c("tile_x"), c("min_y") + c("ty") * c("tile_y")
    x1 = x0 + F.least(c("tile_x"), c("width") - c("tx") * c("tile_x")) - 1
    y1 = y0 + F.least(c("tile_y"), c("height") - c("ty") * c("tile_y")) - 1
    return tiles.select("*", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def scanline_blocks(headers: DataFrame) -> DataFrame:
    c = F.col
    lines = geo.lines_per_block(c("compression")).cast("long")
    count = geo.ceil_div(c("max_y") - c("min_y") + 1, lines)
    plan = headers.where("tile_x is null").withColumn("block_index", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    y0 = c("min_y") + c("block_index") * lines
    return plan.select("*", c("min_x").alias("x0"), y0.alias("y0"), c("max_x").alias("x1"), F.least(y0 + lines - 1, c("max_y")).alias("y1"))


def uncompressed_bytes(plan: DataFrame, channels: DataFrame) -> DataFrame:
    """Bytes of each block (id, block_index) of a plan; channels: id, type, xs, ys."""
    c = F.col
    n = sample_count(c("x0"), c("x1"), c("xs")) * sample_count(c("y0"), c("y1"), c("ys")) * geo.lookup(geo.BYTES, c("type"))
    return plan.join(channels, "id").groupBy("id", "block_index").agg(F.sum(n).alias("bytes"))


def locate_scanlines(rows: DataFrame, plan: DataFrame, min_y: int, lines: int) -> DataFrame:
    """Rows (y) with their block: the block's index is arithmetic, so the join is an equi-join."""
    return rows.withColumn("block_index", floor_div(F.col("y") - min_y, lines)).join(plan, "block_index")


def overlapping(left: DataFrame, right: DataFrame, cell: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of regions (keys, id, x0, y0, x1, y1; inclusive) that overlap, with the common region.

    Regions are dealt to the cells of a grid and meet there by an equi-join; a pair counts in
    the cell of its common region's first corner only.
    """
    c = F.col

    def dealt(df: DataFrame, s: str) -> DataFrame:
        named = df.select(*keys, *(c(n).alias(f"{s}_{n}") for n in ("id", "x0", "y0", "x1", "y1")))
        gx = F.sequence(F.floor(c(f"{s}_x0") / cell), F.floor(c(f"{s}_x1") / cell))
        gy = F.sequence(F.floor(c(f"{s}_y0") / cell), F.floor(c(f"{s}_y1") / cell))
        return named.withColumn("gx", F.explode(gx)).withColumn("gy", F.explode(gy))

    both = dealt(left, "l").join(dealt(right, "r"), [*keys, "gx", "gy"])
    x0, y0 = F.greatest("l_x0", "r_x0"), F.greatest("l_y0", "r_y0")
    x1, y1 = F.least("l_x1", "r_x1"), F.least("l_y1", "r_y1")
    first = (F.floor(x0 / cell) == c("gx")) & (F.floor(y0 / cell) == c("gy"))
    return both.where((x0 <= x1) & (y0 <= y1) & first).select(*keys, c("l_id").alias("a"), c("r_id").alias("b"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def level_status(regions: DataFrame, levels: DataFrame, cell: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, status) of each level (keys, x0, y0, x1, y1) that regions (keys, id, x0, y0, x1, y1) should cover.

    'Outside' if a region leaves its level, 'Overlapping' if two regions meet, 'Incomplete' if regions
    leave samples out, else 'Complete'. Ids tell the regions of a level apart.
    """
    c = F.col
    area = (c("x1") - c("x0") + 1) * (c("y1") - c("y0") + 1)
    window = levels.select(*keys, *(c(n).alias(f"w_{n}") for n in ("x0", "y0", "x1", "y1")))
    leaves = (c("x0") < c("w_x0")) | (c("y0") < c("w_y0")) | (c("x1") > c("w_x1")) | (c("y1") > c("w_y1"))
    own = regions.join(window, [*keys]).groupBy(*keys).agg(F.bool_or(leaves).alias("leaves"), F.sum(area).alias("covered"))
    meeting = overlapping(regions, regions, cell, keys).where("a < b").select(*keys, F.lit(True).alias("meet")).distinct()
    status = F.when(c("leaves"), "Outside").when(c("meet"), "Overlapping").when(F.coalesce("covered", F.lit(0)) < c("size"), "Incomplete").otherwise("Complete")
    return levels.select(*keys, area.alias("size")).join(own, [*keys], "left").join(meeting, [*keys], "left").select(*keys, status.alias("status"))


def missing(planned: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """Planned blocks that were never written."""
    return planned.join(written, keys, "left_anti")


def repeated(written: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks written more than once."""
    return written.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
