"""Block planning, pruning, block lookups and completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo
from rasterloom.functions.numeric import floor_div, sample_count
from rasterloom.operators import blocks
from rasterloom.plans.catalog import query
from rasterloom.plans.views import PIXELS_SQL, pixels, table, values_sql, with_rows, with_rows_sql

#: id, part type, compression, window, tile size, level mode, round up, multipart, deep
_HEADERS = [
    (0, "ZIP", -4, -5, 3, 11, None, None, None, False, False, False),
    (1, "ZIP", -2, 4, 3, 23, None, None, None, False, False, False),
    (2, "PIZ", 0, 0, 1919, 1079, None, None, None, False, True, False),
    (3, "NONE", -2, -3, 1, 0, 2, 2, "ONE", False, False, False),
    (4, "NONE", -2, -3, 1, 0, 2, 2, "MIP", False, False, False),
    (5, "NONE", -2, -3, 1, 0, 2, 2, "RIP", False, False, False),
    (6, "ZSTD", 4, -7, 8, -5, 4, 2, "MIP", True, False, False),
    (7, "ZSTD", 4, -7, 8, -5, 4, 2, "RIP", True, True, False),
    (8, "ZIP", -1, 3, 2, 21, None, None, None, False, False, True),
    (9, "ZSTD", 1, -2, 7, 0, 3, 2, "MIP", False, False, True),
    (10, "HTJ2K256", 0, 0, 300, 1200, None, None, None, False, False, False),
]
#: An order is a header, too: scanlines or tiles.
_ORDERS = {
    "id": "o_orderkey + 11",
    "compression": "CASE o_custkey % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'ZIP' WHEN 2 THEN 'PIZ' WHEN 3 THEN 'ZIPS' ELSE 'B44' END",
    "min_x": "o_custkey % 9 - 4",
    "min_y": "o_orderkey % 7 - 3",
    "max_x": "o_custkey % 9 - 4 + o_orderkey % 40",
    "max_y": "o_orderkey % 7 - 3 + o_custkey % 30",
    "tile_x": "CASE WHEN o_orderkey % 2 = 0 THEN 2 + o_custkey % 6 END",
    "tile_y": "CASE WHEN o_orderkey % 2 = 0 THEN 3 + o_orderkey % 4 END",
    "mode": "CASE WHEN o_orderkey % 2 = 1 THEN NULL WHEN o_custkey % 3 = 0 THEN 'ONE' WHEN o_custkey % 3 = 1 THEN 'MIP' ELSE 'RIP' END",
    "round_up": "o_custkey % 2 = 1",
    "multipart": "o_orderkey % 5 = 0",
    "deep": "o_custkey % 7 = 0",
}
_HEADERS_SQL = with_rows_sql("h0", _HEADERS, "orders", _ORDERS) + ", h AS (SELECT *, max_x - min_x + 1 AS w, max_y - min_y + 1 AS hh FROM h0)"
_LINES_SQL = "CASE compression " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in geo.LINES.items()) + " END"
_SIZE_SQL = "greatest(1, CASE WHEN round_up THEN ({n} + (1::BIGINT << {l}) - 1) // (1::BIGINT << {l}) ELSE {n} >> {l} END)"
#: levels(id, lx, ly, lw, lh) of tiled headers
_LEVELS_SQL = (
    f"k AS (SELECT range::INT AS l FROM range(32)), cx AS (SELECT id, min(l) + 1 AS nx FROM h, k WHERE {_SIZE_SQL.format(n='w', l='l')} = 1 GROUP BY id), cy AS (SELECT id, min(l) + 1 AS ny FROM h, k WHERE {_SIZE_SQL.format(n='hh', l='l')} = 1 GROUP BY id), "
    "lv AS (SELECT h.*, a.l AS lx, b.l AS ly FROM h JOIN cx USING (id) JOIN cy USING (id), k a, k b WHERE tile_x IS NOT NULL AND CASE mode WHEN 'ONE' THEN a.l = 0 AND b.l = 0 WHEN 'MIP' THEN a.l = b.l AND a.l < greatest(nx, ny) ELSE a.l < nx AND b.l < ny END), "
    f"levels AS (SELECT *, {_SIZE_SQL.format(n='w', l='lx')} AS lw, {_SIZE_SQL.format(n='hh', l='ly')} AS lh FROM lv)"
)
_TILES_SQL = (
    "tiles AS (SELECT l.id, lx, ly, tx.range AS tx, ty.range AS ty, min_x + tx.range * tile_x AS x0, min_y + ty.range * tile_y AS y0, least(tile_x, lw - tx.range * tile_x) AS bw, least(tile_y, lh - ty.range * tile_y) AS bh, multipart, deep "
    "FROM levels l, range(50) tx, range(50) ty WHERE tx.range < (lw + tile_x - 1) // tile_x AND ty.range < (lh + tile_y - 1) // tile_y)"
)
_SCAN_SQL = f"scan AS (SELECT id, b.range AS block, min_x, max_x, min_y + b.range * {_LINES_SQL} AS y0, least(min_y + (b.range + 1) * {_LINES_SQL} - 1, max_y) AS y1, multipart, deep FROM h, range(2000) b WHERE tile_x IS NULL AND b.range < (hh + {_LINES_SQL} - 1) // {_LINES_SQL})"
_SCHEMA = "id long, compression string, min_x long, min_y long, max_x long, max_y long, tile_x long, tile_y long, mode string, round_up boolean, multipart boolean, deep boolean"


def _headers(spark, sf_dir):
    return with_rows(spark, sf_dir, _HEADERS, _SCHEMA, "orders", _ORDERS)


@query("level_sizes", f"WITH {_HEADERS_SQL}, {_LEVELS_SQL} SELECT id::BIGINT AS id, lx::BIGINT AS level_x, ly::BIGINT AS level_y, lw::BIGINT AS width, lh::BIGINT AS height FROM levels")
def _levels(spark, sf_dir):
    return blocks.levels(_headers(spark, sf_dir)).select("id", "level_x", "level_y", "width", "height")


for _mode in ("mip", "rip"):

    @query(f"{_mode}_levels", f"WITH {_HEADERS_SQL}, {_LEVELS_SQL} SELECT id::BIGINT AS id, count(*)::BIGINT AS levels, max(lx)::BIGINT AS last_x, max(ly)::BIGINT AS last_y FROM levels WHERE mode = '{_mode.upper()}' GROUP BY 1")
    def _mode_levels(spark, sf_dir, mode=_mode):
        return blocks.levels(_headers(spark, sf_dir).where(F.col("mode") == mode.upper())).groupBy("id").agg(F.count("*").alias("levels"), F.max("level_x").alias("last_x"), F.max("level_y").alias("last_y"))


@query("level_count", "SELECT n::BIGINT AS size, (floor(log2(n::DOUBLE + 1e-9)) + 1)::BIGINT AS down, (ceil(log2(n::DOUBLE - 1e-9)) + 1)::BIGINT AS up FROM range(1, 5000) t(n)")
def _level_count(spark, sf_dir):
    n = F.col("id")
    return spark.range(1, 5000).select(n.alias("size"), geo.level_count(n, F.lit(False)).cast("long").alias("down"), geo.level_count(n, F.lit(True)).cast("long").alias("up"))


@query("block_plan_scanline", f"WITH {_HEADERS_SQL}, {_SCAN_SQL} SELECT id::BIGINT AS id, block, min_x::BIGINT AS x0, y0::BIGINT AS y0, max_x::BIGINT AS x1, y1::BIGINT AS y1 FROM scan")
def _scanlines(spark, sf_dir):
    return blocks.scanline_blocks(_headers(spark, sf_dir)).select("id", F.col("block_index").alias("block"), "x0", "y0", "x1", "y1")


@query("block_plan_tiled", f"WITH {_HEADERS_SQL}, {_LEVELS_SQL}, {_TILES_SQL} SELECT id::BIGINT AS id, lx::BIGINT AS level_x, ly::BIGINT AS level_y, tx AS tile_x, ty AS tile_y, x0::BIGINT AS x0, y0::BIGINT AS y0, (x0 + bw - 1)::BIGINT AS x1, (y0 + bh - 1)::BIGINT AS y1 FROM tiles")
def _tiled(spark, sf_dir):
    return blocks.tiled_blocks(_headers(spark, sf_dir)).select("id", "level_x", "level_y", F.col("tx").alias("tile_x"), F.col("ty").alias("tile_y"), "x0", "y0", "x1", "y1")


@query("chunk_counts", f"WITH {_HEADERS_SQL}, {_LEVELS_SQL}, {_TILES_SQL}, {_SCAN_SQL} SELECT id::BIGINT AS id, count(*)::BIGINT AS chunks FROM (SELECT id FROM tiles UNION ALL SELECT id FROM scan) GROUP BY 1")
def _chunks(spark, sf_dir):
    h = _headers(spark, sf_dir)
    both = blocks.scanline_blocks(h).select("id").unionAll(blocks.tiled_blocks(h).select("id"))
    return both.groupBy("id").agg(F.count("*").alias("chunks"))


@query("chunk_header_bytes", f"WITH {_HEADERS_SQL} SELECT id::BIGINT AS id, (CASE WHEN deep AND tile_x IS NOT NULL THEN 40 WHEN deep THEN 28 WHEN tile_x IS NOT NULL THEN 20 ELSE 8 END + CASE WHEN multipart THEN 4 ELSE 0 END)::BIGINT AS bytes FROM h")
def _header_bytes(spark, sf_dir):
    return _headers(spark, sf_dir).select("id", geo.chunk_header_bytes(F.col("tile_x").isNotNull(), F.col("deep"), F.col("multipart")).cast("long").alias("bytes"))


#: channels of every header: name, pixel type, sampling
_CHANNELS = [("A", "HALF", 1, 1), ("S", "FLOAT", 2, 3), ("U", "UINT", 2, 2)]
_COUNT = "(floor(({hi}) / {s}::DOUBLE) - floor(({lo} - 1) / {s}::DOUBLE))"


@query(
    "uncompressed_bytes",
    f"WITH {_HEADERS_SQL}, {_SCAN_SQL}, {values_sql('c', ['name', 'type_', 'xs', 'ys'], _CHANNELS)} SELECT id::BIGINT AS id, block, sum({_COUNT.format(lo='min_x', hi='max_x', s='xs')} * {_COUNT.format(lo='y0', hi='y1', s='ys')} * CASE type_ WHEN 'HALF' THEN 2 ELSE 4 END)::BIGINT AS bytes FROM scan, c GROUP BY 1, 2",
)
def _bytes(spark, sf_dir):
    listed = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(xs).cast("long").alias("xs"), F.lit(ys).cast("long").alias("ys")) for n, t, xs, ys in _CHANNELS)))
    c = _headers(spark, sf_dir).select("id", listed.alias("c")).select("id", "c.*")
    return blocks.uncompressed_bytes(blocks.scanline_blocks(_headers(spark, sf_dir)), c).select("id", F.col("block_index").alias("block"), "bytes")


@query("sample_location_counts", f"SELECT lo::BIGINT AS lo, s::BIGINT AS s, ({_COUNT.format(lo='lo', hi='lo + 12', s='s')})::BIGINT AS n FROM range(-20, 20) a(lo), range(1, 6) b(s)")
def _locations(spark, sf_dir):
    both = spark.range(-20, 20).select(F.col("id").alias("lo"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("s"))
    return both.select("lo", "s", sample_count(F.col("lo"), F.col("lo") + 12, F.col("s")).alias("n"))


_BLOCKS_SQL = f"{PIXELS_SQL}, bl AS (SELECT y // 16 AS block_index, min(y) AS y0, max(y) AS y1 FROM px GROUP BY 1)"


def _pixel_blocks(spark, sf_dir):
    """Blocks of 16 lines of the image: one row each."""
    return pixels(spark, sf_dir).groupBy(floor_div(F.col("y"), 16).alias("block_index")).agg(F.min("y").alias("y0"), F.max("y").alias("y1"))


@query("scanline_block_lookup", f"WITH {_BLOCKS_SQL} SELECT y, x, block_index::BIGINT AS block_index, y0, y1 FROM px JOIN bl ON block_index = y // 16")
def _lookup(spark, sf_dir):
    return blocks.locate_scanlines(pixels(spark, sf_dir), _pixel_blocks(spark, sf_dir), 0, 16).select("y", "x", "block_index", "y0", "y1")


@query("scanline_range_prune", f"WITH {_BLOCKS_SQL} SELECT block_index::BIGINT AS block_index, y, x, value FROM px JOIN bl ON block_index = y // 16 WHERE y BETWEEN 5 AND 9")
def _prune(spark, sf_dir):
    """Lines 5 to 9: only blocks that overlap are taken, then only the lines."""
    some = _pixel_blocks(spark, sf_dir).where((F.col("y0") <= 9) & (F.col("y1") >= 5))
    wanted = pixels(spark, sf_dir).where(F.col("y").between(5, 9))
    return blocks.locate_scanlines(wanted, some, 0, 16).select("block_index", "y", "x", "value")


@query("tile_lookup", f"WITH {PIXELS_SQL} SELECT y, x, x // 32 AS tile_x, y // 32 AS tile_y, (y // 32 * 4 + x // 32)::BIGINT AS block_index FROM px")
def _tile(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumn("tile_x", floor_div(F.col("x"), 32)).withColumn("tile_y", floor_div(F.col("y"), 32)).withColumn("level_x", F.lit(0)).withColumn("level_y", F.lit(0))
    keys = ["tile_x", "tile_y", "level_x", "level_y"]
    tiles = p.select(*keys).distinct().withColumn("block_index", F.col("tile_y") * 4 + F.col("tile_x"))
    return p.join(tiles, keys).select("y", "x", "tile_x", "tile_y", "block_index")


#: An order is a region of 13 x 5 samples.
_REGIONS = "r AS (SELECT o_orderkey AS k, o_orderkey * 37 % 997 AS x0, o_orderkey // 10 AS y0, o_orderkey * 37 % 997 + 12 AS x1, o_orderkey // 10 + 4 AS y1 FROM orders)"


def _regions_of(spark, sf_dir):
    x0, y0 = F.col("o_orderkey") * 37 % 997, F.expr("o_orderkey div 10")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 12).alias("x1"), (y0 + 4).alias("y1"))


@query(
    "region_overlap_join",
    f"WITH {_REGIONS} SELECT a.k::BIGINT AS a, b.k::BIGINT AS b, greatest(a.x0, b.x0)::BIGINT AS x0, greatest(a.y0, b.y0)::BIGINT AS y0, least(a.x1, b.x1)::BIGINT AS x1, least(a.y1, b.y1)::BIGINT AS y1 FROM r a JOIN r b ON a.k < b.k AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1",
)
def _overlap(spark, sf_dir):
    r = _regions_of(spark, sf_dir)
    return blocks.overlapping(r, r, 16).where("a < b")


@query("box_contains", f"WITH {_REGIONS} SELECT k::BIGINT AS id, x0 <= 20 AND y0 <= 3 AND x1 >= 22 AND y1 >= 5 AS inside FROM r")
def _contains(spark, sf_dir):
    r = _regions_of(spark, sf_dir).withColumnsRenamed({"x0": "a_min_x", "y0": "a_min_y", "x1": "a_max_x", "y1": "a_max_y"})
    box = {"b_min_x": 20, "b_min_y": 3, "b_max_x": 22, "b_max_y": 5}
    return r.withColumns({k: F.lit(v) for k, v in box.items()}).select("id", geo.contains("a", "b").alias("inside"))


@query("missing_blocks_anti_join", "SELECT o_orderkey AS block FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _missing(spark, sf_dir):
    planned = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block"))
    return blocks.missing(planned, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block")), ["block"])


@query("repeated_blocks", "SELECT l_orderkey AS block, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _repeated(spark, sf_dir):
    return blocks.repeated(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block")), ["block"])


_REGIONS_SQL = (
    "r AS (SELECT o_orderkey // 10 AS image, o_orderkey % 10 AS id, o_orderkey % 5 * 8 + (o_custkey % 23 = 0)::INT AS x0, o_orderkey % 10 // 5 * 2 AS y0 FROM orders WHERE o_custkey % 29 <> 0), "
    "o AS (SELECT DISTINCT a.image FROM r a JOIN r b ON a.image = b.image AND a.id < b.id AND a.x0 <= b.x0 + 7 AND b.x0 <= a.x0 + 7 AND a.y0 <= b.y0 + 1 AND b.y0 <= a.y0 + 1)"
)


@query(
    "level_regions",
    f"WITH {_REGIONS_SQL}, g AS (SELECT image, max(x0) AS far, count(*) AS n FROM r GROUP BY 1), i AS (SELECT DISTINCT o_orderkey // 10 AS image FROM orders) SELECT i.image, CASE WHEN far > 32 THEN 'Outside' WHEN i.image IN (SELECT image FROM o) THEN 'Overlapping' WHEN coalesce(n, 0) < 10 THEN 'Incomplete' ELSE 'Complete' END AS status FROM i LEFT JOIN g ON g.image = i.image",
)
def _level_regions(spark, sf_dir):
    """Levels of 40 x 4 samples in ten regions each, some of them moved or left out."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    x0, y0 = k % 5 * 8 + (F.col("o_custkey") % 23 == 0).cast("int"), F.expr("o_orderkey % 10 div 5") * 2
    image = F.expr("o_orderkey div 10").alias("image")
    regions = orders.where("o_custkey % 29 <> 0").select(image, (k % 10).alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 7).alias("x1"), (y0 + 1).alias("y1"))
    levels = orders.select(image).distinct().select("image", *(F.lit(v).cast("long").alias(n) for n, v in (("x0", 0), ("y0", 0), ("x1", 39), ("y1", 3))))
    return blocks.level_status(regions, levels, 16, ("image",))


_FAR = "(o_orderkey % 3000 - 1500) * 1000000 + o_orderkey % 2"


@query("window_validation", f"WITH w AS (SELECT o_orderkey, CASE o_orderkey % 100 WHEN 0 THEN -1073741823 WHEN 1 THEN -1073741822 WHEN 2 THEN 1073741822 - 9 WHEN 3 THEN 1073741823 - 9 ELSE {_FAR} END AS x FROM orders) SELECT o_orderkey AS id, x BETWEEN -1073741822 AND 1073741822 - 9 AS ok FROM w")
def _window_validation(spark, sf_dir):
    """Windows of 10 columns whose coordinates may lie beyond what files can have."""
    x = F.expr(f"CASE o_orderkey % 100 WHEN 0 THEN -1073741823 WHEN 1 THEN -1073741822 WHEN 2 THEN 1073741822 - 9 WHEN 3 THEN 1073741823 - 9 ELSE {_FAR} END")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), geo.window_in_range(x, F.lit(0), x + 9, F.lit(9)).alias("ok"))


_SAMPLING = {"min_x": "l_partkey % 7 - 3", "min_y": "l_orderkey % 5 - 2", "width": "l_suppkey % 6 + 1", "height": "l_partkey % 4 + 1", "xs": "l_linenumber % 3 + 1", "ys": "l_orderkey % 2 + 1"}
_SAMPLING_SQL = ", ".join(f"{v} AS {k}" for k, v in _SAMPLING.items())


@query("sampling_validation", f"WITH c AS (SELECT l_orderkey, l_linenumber, {_SAMPLING_SQL} FROM lineitem) SELECT l_orderkey AS image, l_linenumber AS channel, min_x % xs = 0 AND width % xs = 0 AND min_y % ys = 0 AND height % ys = 0 AS ok FROM c")
def _sampling_validation(spark, sf_dir):
    """A line item is a channel: does its sampling fit the window?"""
    c = table(spark, sf_dir, "lineitem")
    return c.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("channel"), geo.sampling_divides(*(F.expr(v) for v in _SAMPLING.values())).alias("ok"))


@query("tile_slices", f"WITH {PIXELS_SQL} SELECT y // 8 AS tile_y, x // 16 AS tile_x, count(*)::BIGINT AS samples, round(sum(value), 4) AS total FROM px GROUP BY 1, 2")
def _slices(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return p.groupBy(floor_div(F.col("y"), 8).alias("tile_y"), floor_div(F.col("x"), 16).alias("tile_x")).agg(F.count("*").alias("samples"), F.round(F.sum("value"), 4).alias("total"))
