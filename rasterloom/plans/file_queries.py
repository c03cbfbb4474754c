"""Queries through real image files: written, read back, and compared with what went in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterloom.operators import channels
from rasterloom.plans.catalog import query
from rasterloom.plans.views import PIXELS_SQL, pixels, table
from rasterloom.sources import frames, images

_LOCAL: dict[str, str] = {}


def _folder(spark) -> str:
    """A folder that executors share: below spark.checkpoint.dir, or a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="rasterloom-"))
    return f"{base.rstrip('/')}/images-{uuid.uuid4().hex[:12]}"


#: Images of 10 lines: the whole table is dealt to as many as it needs.
_LINES = 10
_LONG = f"WITH {PIXELS_SQL}, long AS (SELECT y, x, 'R' AS channel, r AS value FROM px UNION ALL SELECT y, x, 'G', g FROM px) SELECT (y // {_LINES})::VARCHAR AS image, (y % {_LINES})::BIGINT AS y, x::BIGINT AS x, channel, {{v}} AS value FROM long"


def _images(spark, sf_dir, compression: str, pixel_type: str = "FLOAT", tiles=None, **more):
    long = channels.deinterleave(pixels(spark, sf_dir), ["r", "g"])
    named = long.select(F.expr(f"y div {_LINES}").cast("string").alias("file_id"), (F.col("y") % _LINES).cast("int").alias("y"), F.col("x").cast("int").alias("x"), "channel", "value")
    return frames.encode_images(named, compression, pixel_type, tiles, **more)


def _pixels(spark, sf_dir):
    """The pixels as images of 10 lines, with the names that files take."""
    return pixels(spark, sf_dir).select(F.expr(f"y div {_LINES}").cast("string").alias("file_id"), (F.col("y") % _LINES).cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value", *"rgba")


def _shown(samples, *more):
    return samples.select(*more, F.regexp_extract("file_id", r"(\d+)(\.exr)?$", 1).alias("image"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "channel", "value")


for _codec in ("NONE", "RLE", "ZIPS", "ZIP", "ZSTD", "PIZ"):

    @query(f"image_roundtrip_{_codec.lower()}", _LONG.format(v="value::FLOAT::DOUBLE"))
    def _round_trip(spark, sf_dir, codec=_codec):
        """Every pixel through files in memory, 32-bit float, without loss."""
        files = _images(spark, sf_dir, codec).select(F.col("file_id").alias("path"), "content")
        return _shown(frames.decode_images(files))


@query("image_roundtrip_tiled", _LONG.format(v="value::FLOAT::DOUBLE"))
def _tiled(spark, sf_dir):
    files = _images(spark, sf_dir, "ZIP", tiles=(32, 4)).select(F.col("file_id").alias("path"), "content")
    return _shown(frames.decode_images(files))


#: A 32-bit float rounded to 15 bits of fraction, ties away from zero.
_PXR24 = "CASE WHEN v = 0 THEN 0 ELSE floor(v / pow(2, floor(log2(v)) - 15) + 0.5) * pow(2, floor(log2(v)) - 15) END"


@query("image_roundtrip_pxr24", _LONG.format(v=_PXR24).replace("FROM long", "FROM (SELECT y, x, channel, value::FLOAT::DOUBLE AS v FROM long)"))
def _pxr24(spark, sf_dir):
    """24-bit floats: the values are rounded to 15 bits of fraction."""
    files = _images(spark, sf_dir, "PXR24").select(F.col("file_id").alias("path"), "content")
    return _shown(frames.decode_images(files))


_NEAR_SQL = f"WITH {PIXELS_SQL} SELECT (y // {_LINES})::VARCHAR AS image, (y % {_LINES})::BIGINT AS y, x::BIGINT AS x, 'Z' AS channel, 1 + ((x // 4) % 8 * 8 + x % 4 + y % {_LINES} % 4 * 2) / 1024.0::DOUBLE AS value FROM px"

for _codec in ("B44", "B44A"):

    @query(f"image_roundtrip_{_codec.lower()}", _NEAR_SQL)
    def _b44(spark, sf_dir, codec=_codec):
        """Half values whose neighbours differ little, which the lossy 4 x 4 blocks keep exactly."""
        p = _pixels(spark, sf_dir)
        value = 1 + (F.expr("x div 4") % 8 * 8 + F.col("x") % 4 + F.col("y") % 4 * 2) / 1024.0
        files = frames.encode_images(p.select("file_id", "y", "x", F.lit("Z").alias("channel"), value.alias("value")), codec, "HALF")
        return _shown(frames.decode_images(files.select(F.col("file_id").alias("path"), "content")))


@query("image_roundtrip_multipart", _LONG.format(v="value::FLOAT::DOUBLE").replace("AS x, channel, ", "AS x, CASE channel WHEN 'R' THEN 0 ELSE 1 END::BIGINT AS part, channel, "))
def _multipart(spark, sf_dir):
    """Two parts in each file, a channel in each."""
    long = channels.deinterleave(_pixels(spark, sf_dir).select("file_id", "y", "x", *"rg"), ["r", "g"], ("file_id",))
    part = F.when(F.col("channel") == "R", 0).otherwise(1)
    files = frames.encode_images(long.withColumn("part_index", part).withColumn("part_name", F.concat(F.lit("part "), "channel")), "ZSTD")
    back = frames.decode_images(files.select(F.col("file_id").alias("path"), "content"))
    return _shown(back, F.col("part_index").cast("long").alias("part"))


@query("image_part_renamed", f"WITH {PIXELS_SQL}, n(part, name) AS (VALUES (0, 'part R'), (1, 'renamed')) SELECT DISTINCT (y // {_LINES})::VARCHAR AS image, part::BIGINT AS part, name FROM px, n")
def _renamed(spark, sf_dir):
    """Files of two parts, read and written again with another name of the second."""
    long = channels.deinterleave(_pixels(spark, sf_dir).select("file_id", "y", "x", *"rg"), ["r", "g"], ("file_id",))
    part = F.when(F.col("channel") == "R", 0).otherwise(1)
    files = frames.encode_images(long.withColumn("part_index", part).withColumn("part_name", F.concat(F.lit("part "), "channel")), "ZSTD").select(F.col("file_id").alias("path"), "content")
    again = frames.encode_images(images.rename_part(frames.decode_images(files), frames.decode_images(files, "header"), 1, "renamed"), "ZSTD")
    return frames.decode_images(again.select(F.col("file_id").alias("path"), "content"), "header").select(F.col("file_id").alias("image"), F.col("part_index").cast("long").alias("part"), "name")


@query("image_roundtrip_decreasing", _LONG.format(v="value::FLOAT::DOUBLE"))
def _decreasing(spark, sf_dir):
    """Files whose last lines come first."""
    return _shown(frames.decode_images(_images(spark, sf_dir, "ZIPS", line_order="DECREASING_Y").select(F.col("file_id").alias("path"), "content")))


@query("image_line_order", f"WITH {PIXELS_SQL}, f AS (SELECT y // {_LINES} AS image, max(y % {_LINES}) AS last FROM px GROUP BY 1) SELECT image::VARCHAR AS image, b::BIGINT AS block, (last - b)::BIGINT AS place FROM f, range({_LINES}) t(b) WHERE b <= last")
def _line_order(spark, sf_dir):
    """Where the blocks of such files lie."""
    found = frames.decode_images(_images(spark, sf_dir, "ZIPS", line_order="DECREASING_Y").select(F.col("file_id").alias("path"), "content"), "blocks")
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("file_offset")) - 1
    return found.select(F.col("file_id").alias("image"), F.col("block_index").cast("long").alias("block"), place.cast("long").alias("place"))


for _name, _order in (("image_missing_offsets", "INCREASING_Y"), ("image_missing_offsets_decreasing", "DECREASING_Y")):

    @query(_name, _LONG.format(v="value::FLOAT::DOUBLE"))
    def _no_offsets(spark, sf_dir, order=_order):
        """Files whose table of offsets, which lies before the first chunk, is all zero: chunks are found by a walk."""
        files = _images(spark, sf_dir, "ZIPS", line_order=order).select(F.col("file_id").alias("path"), "content")
        tables = frames.decode_images(files, "blocks").groupBy(F.col("file_id").alias("path")).agg(F.min("file_offset").alias("first"), (F.count("*") * 8).alias("size"))
        zeros = F.unhex(F.repeat(F.lit("00"), F.col("size").cast("int")))
        broken = F.overlay("content", zeros, (F.col("first") - F.col("size") + 1).cast("int"), F.col("size").cast("int"))
        return _shown(frames.decode_images(files.join(tables, "path").select("path", broken.alias("content"))))


_SIDES = "w AS (SELECT y // 10 AS image, max(y % 10) + 1 AS h FROM px GROUP BY 1)"

for _mode, _pairs in (("mip", [(k, k) for k in range(7)]), ("rip", [(a, b) for a in range(7) for b in range(4)])):
    _values = ", ".join(f"({a}, {b})" for a, b in _pairs)

    @query(
        f"image_roundtrip_{_mode}",
        f"WITH {PIXELS_SQL}, {_SIDES}, l(lx, ly) AS (VALUES {_values}) SELECT px.y // 10 || '' AS image, lx::BIGINT AS lx, ly::BIGINT AS ly, (px.y % 10 >> ly)::BIGINT AS y, (x >> lx)::BIGINT AS x, value::FLOAT::DOUBLE AS value "
        "FROM px JOIN w ON w.image = px.y // 10, l WHERE x % (1 << lx) = 0 AND px.y % 10 % (1 << ly) = 0 AND x >> lx < greatest(1, 100 >> lx) AND px.y % 10 >> ly < greatest(1, h >> ly)"
        + (" AND (1 << lx) <= greatest(100, h)" if _mode == "mip" else " AND (1 << ly) <= h"),
    )
    def _levels_kept(spark, sf_dir, mode=_mode, pairs=_pairs):
        """Every resolution level of tiled files: the pixels at multiples of a power of two."""
        listed = F.explode(F.array(*(F.struct(F.lit(a).alias("level_x"), F.lit(b).alias("level_y")) for a, b in pairs)))
        p = _pixels(spark, sf_dir).select("file_id", "y", "x", "value", listed.alias("l")).select("file_id", "y", "x", "value", "l.*")
        height = F.max("y").over(Window.partitionBy("file_id")) + 1
        p = p.withColumn("h", height).where("x % (1 << level_x) = 0 and y % (1 << level_y) = 0").withColumn("x", F.expr("x >> level_x")).withColumn("y", F.expr("y >> level_y"))
        p = p.where("x < greatest(1, 100 >> level_x) and y < greatest(1, h >> level_y)")
        files = frames.encode_images(p.withColumn("channel", F.lit("Z")), "ZIP", tiles=(32, 4), levels=mode.upper())
        back = frames.decode_images(files.select(F.col("file_id").alias("path"), "content"))
        return _shown(back, F.col("level_x").cast("long").alias("lx"), F.col("level_y").cast("long").alias("ly")).drop("channel")


_DEEP_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


@query(
    "image_roundtrip_deep",
    f"WITH s AS (SELECT l_orderkey, count(*)::BIGINT AS cnt, list(l_extendedprice::FLOAT::DOUBLE ORDER BY {_DEEP_ORDER}) AS z, list(l_quantity::FLOAT::DOUBLE ORDER BY {_DEEP_ORDER}) AS a FROM lineitem GROUP BY 1) "
    "SELECT l_orderkey // 1000 || '' AS image, (l_orderkey // 100 % 10)::BIGINT AS y, (l_orderkey % 100)::BIGINT AS x, cnt, c AS channel, CASE c WHEN 'Z' THEN z ELSE a END AS samples FROM s, (VALUES ('A'), ('Z')) t(c)",
)
def _deep(spark, sf_dir):
    """Deep scanline files: an order is a pixel, its line items are its samples."""
    rows = F.array_sort(F.collect_list(F.struct(*_DEEP_ORDER.split(", "))))
    k = F.col("l_orderkey")
    p = table(spark, sf_dir, "lineitem").groupBy(k).agg(rows.alias("s"))
    of = lambda n: F.transform("s", lambda s: s[n].cast("double"))
    both = F.explode(F.array(F.struct(F.lit("A").alias("channel"), of("l_quantity").alias("samples")), F.struct(F.lit("Z").alias("channel"), of("l_extendedprice").alias("samples"))))
    p = p.select(F.expr("l_orderkey div 1000").cast("string").alias("file_id"), (F.expr("l_orderkey div 100") % 10).cast("int").alias("y"), (k % 100).cast("int").alias("x"), both.alias("c")).select("file_id", "y", "x", "c.*")
    files = frames.encode_deep(p, "ZIPS").select(F.col("file_id").alias("path"), "content")
    back = frames.decode_images(files, "deep").where("cnt > 0")
    return back.select(F.col("file_id").alias("image"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "cnt", "channel", "samples")


@query("image_sink", _LONG.format(v="value::FLOAT::DOUBLE"))
def _sink(spark, sf_dir):
    """Files written by the data source's sink, replaced by a second write, and read by its reader."""
    folder = _folder(spark)
    frames.register(spark)
    files = _images(spark, sf_dir, "ZSTD")
    files.write.format("exr").mode("append").save(folder)
    files.write.format("exr").mode("overwrite").save(folder)
    return _shown(spark.read.format("exr").load(folder))


@query(
    "image_attributes",
    f"WITH {PIXELS_SQL}, n(name, type_name, bytes) AS (VALUES ('channels', 'chlist', 37), ('compression', 'compression', 1), ('dataWindow', 'box2i', 16), ('displayWindow', 'box2i', 16), ('lineOrder', 'lineOrder', 1), ('pixelAspectRatio', 'float', 4), ('screenWindowCenter', 'v2f', 8), ('screenWindowWidth', 'float', 4)) SELECT DISTINCT (y // {_LINES})::VARCHAR AS image, name, type_name, bytes::BIGINT AS bytes FROM px, n",
)
def _attributes(spark, sf_dir):
    """Every attribute of every header."""
    files = _images(spark, sf_dir, "NONE").select(F.col("file_id").alias("path"), "content")
    return frames.decode_images(files, "header").select(F.col("file_id").alias("image"), F.inline("attributes")).select("image", "name", "type_name", F.octet_length("data").cast("long").alias("bytes"))


@query("image_load_layer", _LONG.format(v="value::FLOAT::DOUBLE").replace("FROM long", "FROM long WHERE channel = 'R'"))
def _layer(spark, sf_dir):
    """The samples of one layer of files with two, under their names inside it."""
    long = channels.deinterleave(_pixels(spark, sf_dir).select("file_id", "y", "x", *"rg"), ["r", "g"], ("file_id",))
    named = long.withColumn("channel", F.when(F.col("channel") == "R", "beauty.R").otherwise("depth.Z"))
    files = frames.encode_images(named, "ZSTD").select(F.col("file_id").alias("path"), "content")
    return _shown(images.layer_samples(frames.decode_images(files), "beauty"))


@query("image_spectral_cube", f"WITH {PIXELS_SQL}, w(i, factor) AS (VALUES (0, 1), (1, 3)) SELECT (y // {_LINES})::VARCHAR AS image, 0::BIGINT AS stokes, i::BIGINT AS wavelength_idx, (y % {_LINES})::BIGINT AS y, x::BIGINT AS x, (r * factor)::FLOAT::DOUBLE AS value FROM px, w")
def _spectral_cube(spark, sf_dir):
    """Spectral channels of files onto an axis; of two that join one entry the later of the header counts."""
    given = [("S0.400,000000nm", 1), ("S0.500,000000nm", 2), ("S0.500,005000nm", 3), ("S0.900,000000nm", 4)]
    listed = F.explode(F.array(*(F.struct(F.lit(n).alias("channel"), (F.col("r") * k).alias("value")) for n, k in given)))
    p = _pixels(spark, sf_dir).select("file_id", "y", "x", listed.alias("c")).select("file_id", "y", "x", "c.*")
    files = frames.encode_images(p, "ZSTD").select(F.col("file_id").alias("path"), "content")
    cube = images.spectral_cube(frames.decode_images(files), frames.decode_images(files, "header"), [400.0, 500.0])
    return cube.select(F.col("file_id").alias("image"), F.col("stokes").cast("long").alias("stokes"), F.col("wavelength_idx").cast("long").alias("wavelength_idx"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "value")


@query("image_block_index", f"WITH {PIXELS_SQL}, f AS (SELECT DISTINCT y // {_LINES} AS image FROM px) SELECT image::VARCHAR AS image, b::BIGINT AS block, b::BIGINT AS min_y, 99::BIGINT AS max_x FROM f, range({_LINES}) t(b)")
def _index(spark, sf_dir):
    files = _images(spark, sf_dir, "NONE").select(F.col("file_id").alias("path"), "content")
    return frames.decode_images(files, "blocks").select(F.col("file_id").alias("image"), F.col("block_index").cast("long").alias("block"), F.col("min_y").cast("long").alias("min_y"), F.col("max_x").cast("long").alias("max_x"))


@query("image_headers", f"WITH {PIXELS_SQL} SELECT (y // {_LINES})::VARCHAR AS image, 'scanlineimage' AS part_type, 'ZSTD' AS compression, 'G:FLOAT,R:FLOAT' AS channels, max(y % {_LINES})::BIGINT AS max_y, 1::BIGINT AS chunks FROM px GROUP BY 1")
def _headers(spark, sf_dir):
    files = _images(spark, sf_dir, "ZSTD").select(F.col("file_id").alias("path"), "content")
    named = F.array_join(F.transform("channels", lambda c: F.concat_ws(":", c["name"], c["pixel_type"])), ",")
    return frames.decode_images(files, "header").select(F.col("file_id").alias("image"), "part_type", "compression", named.alias("channels"), F.col("max_y").cast("long").alias("max_y"), F.col("chunk_count").cast("long").alias("chunks"))


@query("image_files_line_range", _LONG.format(v="value::FLOAT::DOUBLE").replace("FROM long", f"FROM long WHERE y % {_LINES} BETWEEN 3 AND 5 AND channel = 'G'"))
def _line_range(spark, sf_dir):
    """Files in a folder, read by the data source: lines 3 to 5 of one channel, other blocks skipped."""
    folder = _folder(spark)
    frames.write_images(_images(spark, sf_dir, "ZIPS"), folder)
    return _shown(spark.read.format("exr").option("min_y", 3).option("max_y", 5).option("channels", "G").load(folder))


@query("image_signature", f"WITH {PIXELS_SQL} SELECT DISTINCT (y // {_LINES})::VARCHAR AS image, true AS is_image FROM px")
def _signature(spark, sf_dir):
    return _images(spark, sf_dir, "NONE").select(F.col("file_id").alias("image"), frames.is_image(F.col("content")).alias("is_image"))


@query("image_load_rgba", f"WITH {PIXELS_SQL} SELECT (y // {_LINES})::VARCHAR AS image, y % {_LINES} AS y, x, r::FLOAT::DOUBLE AS r, g::FLOAT::DOUBLE AS g, b::FLOAT::DOUBLE AS b, 1.0::DOUBLE AS a FROM px")
def _load_rgba(spark, sf_dir):
    """Interleaved pixels saved as three channels and loaded as RGBA."""
    p = pixels(spark, sf_dir).select(F.expr(f"y div {_LINES}").cast("string").alias("file_id"), (F.col("y") % _LINES).cast("int").alias("y"), F.col("x").cast("int").alias("x"), *"rgba")
    files = images.encode_rgba(p, 3).select(F.col("file_id").alias("path"), "content")
    back = images.rgba(frames.decode_images(files))
    return back.select(F.col("file_id").alias("image"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *"rgba")


@query("image_layers", f"WITH {PIXELS_SQL}, n(name) AS (VALUES ('beauty.B'), ('beauty.R'), ('depth.Z'), ('root')) SELECT DISTINCT (y // {_LINES})::VARCHAR AS image, split_part(name, '.', 1) AS layer, CASE split_part(name, '.', 1) WHEN 'beauty' THEN 0 ELSE 2 END::BIGINT AS first_idx FROM px, n WHERE name <> 'root'")
def _layers(spark, sf_dir):
    """Layers of files with channels beauty.B, beauty.R, depth.Z and root."""
    rows = pixels(spark, sf_dir).select(F.expr(f"y div {_LINES}").cast("string").alias("file_id"), (F.col("y") % _LINES).cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.explode(F.array(*map(F.lit, ("beauty.B", "beauty.R", "depth.Z", "root")))).alias("channel"), "value")
    files = frames.encode_images(rows, "ZSTD").select(F.col("file_id").alias("path"), "content")
    found = images.layers(frames.decode_images(files, "header"))
    return found.select(F.col("file_id").alias("image"), "layer", F.col("first_idx").cast("long").alias("first_idx"))


@query("image_summaries", f"WITH {PIXELS_SQL} SELECT (y // {_LINES})::VARCHAR AS image, 'part 0 | scanlineimage | 100x' || (max(y % {_LINES}) + 1) || ' | (0, 0)-(99, ' || max(y % {_LINES}) || ') | RLE | INCREASING_Y | G:FLOAT, R:FLOAT' AS summary FROM px GROUP BY 1")
def _summaries(spark, sf_dir):
    files = _images(spark, sf_dir, "RLE").select(F.col("file_id").alias("path"), "content")
    return images.describe(frames.decode_images(files, "header")).select(F.col("file_id").alias("image"), "summary")
