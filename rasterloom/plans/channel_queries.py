"""Layers, channel forms, subsampling, luminance-chroma and header projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import names
from rasterloom.operators import channels
from rasterloom.plans.catalog import query
from rasterloom.plans.views import IMAGES_SQL, LINES, PIXELS_SQL, images, literal, pixels, table, values_sql

_NAMES_SQL = "cn AS (SELECT p_partkey AS channel_idx, replace(p_name, ' ', '.') AS name FROM part)"
_LAST = "(length(name) - length(split_part(name, '.', -1)))"


def _names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("channel_idx"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("name"))


@query("layers_distinct", f"WITH {_NAMES_SQL} SELECT left(name, {_LAST} - 1) AS layer, min(channel_idx) AS first_idx FROM cn WHERE {_LAST} > 1 AND {_LAST} < length(name) GROUP BY 1")
def _layers(spark, sf_dir):
    return channels.layers(_names(spark, sf_dir))


@query("layer_channels", f"WITH {_NAMES_SQL} SELECT channel_idx, name, substr(name, 7) AS inner_name FROM cn WHERE starts_with(name, 'small.')")
def _layer(spark, sf_dir):
    return channels.layer_channels(_names(spark, sf_dir), "small")


_ODD = [(0, "R"), (1, ".G"), (2, "beauty.B"), (3, "a.b.c"), (4, "x."), (5, ".."), (6, "Beauty.B"), (7, "beauty."), (8, "beautyB")]


@query("layer_root_channels", f"WITH {values_sql('cn', ['channel_idx', 'name'], _ODD)} SELECT channel_idx::BIGINT AS channel_idx, name, CASE WHEN {_LAST} = 1 THEN substr(name, 2) ELSE name END AS inner_name FROM cn WHERE {_LAST} <= 1")
def _root(spark, sf_dir):
    return channels.layer_channels(literal(spark, _ODD, "channel_idx long, name string"), "")


@query("layer_leaf_split", f"WITH {values_sql('cn', ['channel_idx', 'name'], _ODD)} SELECT channel_idx::BIGINT AS channel_idx, CASE WHEN {_LAST} > 1 AND {_LAST} < length(name) THEN left(name, {_LAST} - 1) END AS layer, split_part(name, '.', -1) AS leaf FROM cn")
def _leaf(spark, sf_dir):
    return literal(spark, _ODD, "channel_idx long, name string").select("channel_idx", names.layer(F.col("name")).alias("layer"), names.leaf(F.col("name")).alias("leaf"))


_LONG_SQL = f"{PIXELS_SQL}, long AS (SELECT y, x, 'R' AS channel, r AS value FROM px UNION ALL SELECT y, x, 'G', g FROM px UNION ALL SELECT y, x, 'B', b FROM px UNION ALL SELECT y, x, 'A', a FROM px)"


def _long(spark, sf_dir):
    return channels.deinterleave(pixels(spark, sf_dir), list("rgba"))


@query("planar_unpivot", f"WITH {_LONG_SQL} SELECT y, x, channel, round(value, 9) AS value FROM long")
def _planar(spark, sf_dir):
    return _long(spark, sf_dir).withColumn("value", F.round("value", 9))


@query("interleave_pivot", f"WITH {PIXELS_SQL} SELECT y, x, round(r, 9) AS R, round(g, 9) AS G, round(b, 9) AS B, round(a, 9) AS A FROM px")
def _pivot(spark, sf_dir):
    return channels.interleave(_long(spark, sf_dir), list("RGBA")).select("y", "x", *(F.round(c, 9).alias(c) for c in "RGBA"))


@query("layer_rgba_expand", f"WITH {PIXELS_SQL} SELECT y, x, round(r, 9) AS r, round(g, 9) AS g, round(b, 9) AS b, 1.0::DOUBLE AS a FROM px")
def _rgba(spark, sf_dir):
    """Three channels: alpha defaults to 1."""
    return channels.rgba(_long(spark, sf_dir).where("channel <> 'A'")).select("y", "x", *(F.round(c, 9).alias(c) for c in "rgba"))


for _preview in (False, True):

    @query("layer_rgba_single" + "_preview" * _preview, f"WITH {PIXELS_SQL} SELECT y, x, round(r, 9) AS r, round(r, 9) AS g, round(r, 9) AS b, {'1.0::DOUBLE' if _preview else 'round(r, 9)'} AS a FROM px")
    def _single(spark, sf_dir, preview=_preview):
        one = _long(spark, sf_dir).where("channel = 'R'")
        return channels.rgba(one, preview).select("y", "x", *(F.round(c, 9).alias(c) for c in "rgba"))


@query("sample_point_read", f"WITH {PIXELS_SQL} SELECT y, x, value FROM px WHERE y = 3 AND x = 7")
def _point(spark, sf_dir):
    return pixels(spark, sf_dir).where("y = 3 and x = 7").select("y", "x", "value")


@query("subsample_filter", f"WITH {PIXELS_SQL} SELECT y, x, value FROM px WHERE x % 2 = 0 AND y % 3 = 0")
def _subsample(spark, sf_dir):
    return channels.subsample(pixels(spark, sf_dir), 2, 3).select("y", "x", "value")


@query("point_expand", f"WITH {PIXELS_SQL} SELECT p.y, p.x, s.value FROM px p JOIN px s ON s.y = p.y - p.y % 3 AND s.x = p.x - p.x % 2")
def _expand(spark, sf_dir):
    p = pixels(spark, sf_dir)
    top = 10**9  # the window's lower end holds all rows of any scale
    return channels.point_expand(p, channels.subsample(p, 2, 3), (0, 0, 99, top), 2, 3)


_HEIGHT = LINES
_BILINEAR = (
    f"WITH {IMAGES_SQL}, s AS (SELECT image, y, x, g, b FROM im WHERE x % 2 = 0 AND y % 2 = 0), p AS (SELECT image, y, x, r, a, "
    f"least(x // 2, 49) * 2 AS lx, least(x // 2 + 1, 49) * 2 AS hx, CASE WHEN x // 2 >= 49 THEN 0 ELSE x % 2 / 2.0::DOUBLE END AS tx, "
    f"least(y // 2, {_HEIGHT // 2 - 1}) * 2 AS ly, least(y // 2 + 1, {_HEIGHT // 2 - 1}) * 2 AS hy, CASE WHEN y // 2 >= {_HEIGHT // 2 - 1} THEN 0 ELSE y % 2 / 2.0::DOUBLE END AS ty FROM im), "
    "u AS (SELECT p.*, {g} AS ry, {b} AS by_ FROM p JOIN s s00 ON s00.image = p.image AND s00.x = lx AND s00.y = ly JOIN s s10 ON s10.image = p.image AND s10.x = hx AND s10.y = ly JOIN s s01 ON s01.image = p.image AND s01.x = lx AND s01.y = hy JOIN s s11 ON s11.image = p.image AND s11.x = hx AND s11.y = hy) "
).replace("{g}", "(s00.g * (1 - tx) + s10.g * tx) * (1 - ty) + (s01.g * (1 - tx) + s11.g * tx) * ty").replace("{b}", "(s00.b * (1 - tx) + s10.b * tx) * (1 - ty) + (s01.b * (1 - tx) + s11.b * tx) * ty")


def _chroma(spark, sf_dir):
    p = images(spark, sf_dir)
    up = channels.upsample_bilinear(p.select("image", "y", "x"), channels.subsample(p, 2, 2), (0, 0, 99, _HEIGHT - 1), 2, 2, ["g", "b"], ("image",))
    return p, up


@query("chroma_bilinear_upsample", _BILINEAR + "SELECT image, y, x, round(ry, 6) AS ry, round(by_, 6) AS by FROM u")
def _bilinear(spark, sf_dir):
    return _chroma(spark, sf_dir)[1].select("image", "y", "x", F.round("g", 6).alias("ry"), F.round("b", 6).alias("by"))


@query(
    "luma_chroma_to_rgba",
    _BILINEAR + "SELECT image, y, x, round((ry + 1) * r, 6) AS r, round((r - (ry + 1) * r * 0.2126::DOUBLE - (by_ + 1) * r * 0.0722::DOUBLE) / 0.7152::DOUBLE, 6) AS g, round((by_ + 1) * r, 6) AS b, round(a, 6) AS a FROM u",
)
def _luma(spark, sf_dir):
    p, up = _chroma(spark, sf_dir)
    luma = p.select("image", "y", "x", F.col("r").alias("luma"), F.col("a").alias("alpha"))
    out = channels.luma_chroma_to_rgba(luma, up.select("image", "y", "x", F.col("g").alias("ry"), F.col("b").alias("by")), keys=("image",))
    return out.select("image", "y", "x", *(F.round(c, 6).alias(c) for c in "rgba"))


_PARTS = [(0, "Y", False), (0, "RY", False), (0, "BY", False), (1, "R", False), (1, "Y", False), (1, "RY", False), (1, "BY", False), (2, "Y", True), (2, "RY", True), (2, "BY", True), (3, "Y", False)]


@query("is_luminance_chroma", f"WITH {values_sql('c', ['part', 'name', 'deep'], _PARTS)} SELECT part::BIGINT AS part, bool_or(name = 'Y') AND bool_or(name = 'RY') AND bool_or(name = 'BY') AND NOT bool_or(name IN ('R', 'G', 'B')) AND NOT bool_or(deep) AS luminance_chroma FROM c GROUP BY part")
def _is_luma(spark, sf_dir):
    return channels.is_luminance_chroma(literal(spark, _PARTS, "part long, name string, deep boolean"))


@query("channel_sort_utf8", "SELECT p_brand AS part, p_partkey || '.' || p_name AS name, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey || '.' || p_name) - 1)::BIGINT AS place FROM part")
def _sorted(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.col("p_brand").alias("part"), F.concat(F.col("p_partkey").cast("string"), F.lit("."), F.col("p_name")).alias("name"))
    return channels.canonical_order(c)


@query(
    "level_sort",
    "SELECT p_partkey AS id, (row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3, p_size % 2, p_partkey * 7 % 5, p_partkey))::BIGINT AS place FROM part",
)
def _level_sort(spark, sf_dir):
    """Blocks of many files, each file's in the order of level, then place."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("level_y", "level_x", "min_y", "min_x")
    k, size = F.col("p_partkey"), F.col("p_size")
    b = table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_brand").alias("file"), (size % 3).alias("level_y"), (size % 2).alias("level_x"), (k * 7 % 5).alias("min_y"), k.alias("min_x"))
    return b.select("id", F.row_number().over(w).cast("long").alias("place"))


@query("multipart_union", f"WITH {PIXELS_SQL} SELECT 0::BIGINT AS part_index, y, x, value FROM px WHERE y < 5 UNION ALL SELECT 1::BIGINT, y, x, r FROM px WHERE y >= 5")
def _union(spark, sf_dir):
    p = pixels(spark, sf_dir)
    one = p.where("y < 5").select(F.lit(0).cast("long").alias("part_index"), "y", "x", "value")
    two = p.where("y >= 5").select(F.lit(1).cast("long").alias("part_index"), "y", "x", F.col("r").alias("value"))
    return one.unionByName(two)


_BLOBS = [("a", "string", b"hello"), ("b", "int", (-5).to_bytes(4, "little", signed=True)), ("c", "int", (70000).to_bytes(4, "little")), ("d", "int", b"\x01\x02"), ("e", "box2i", bytes(range(40)))]


@query(
    "attribute_decode",
    "SELECT * FROM (VALUES ('a', 'hello'), ('b', '-5'), ('c', '70000'), ('d', '0102'), ('e', '" + bytes(range(32)).hex().upper() + " ...')) t(name, shown)",
)
def _attributes(spark, sf_dir):
    """Strings and integers by their type; anything else as hexadecimal of 32 bytes at most."""
    df = literal(spark, [(n, t, bytearray(d)) for n, t, d in _BLOBS], "name string, type_name string, data binary")
    data = F.col("data")
    dump = F.concat(F.hex(F.substring(data, 1, 32)), F.when(F.octet_length(data) > 32, F.lit(" ...")).otherwise(F.lit("")))
    number = names.little_endian(data, 4)
    shown = F.when(F.col("type_name") == "string", F.decode(data, "UTF-8")).when((F.col("type_name") == "int") & number.isNotNull(), number.cast("string")).otherwise(dump)
    return df.select("name", shown.alias("shown"))


_WORDS = [2, 2 | 1 << 9, 2 | 1 << 10 | 1 << 11, 2 | 1 << 12, 2 | 1 << 9 | 1 << 12, 3, 2 | 1 << 13]


@query(
    "version_flags",
    f"WITH {values_sql('w', ['word'], [(w,) for w in _WORDS])} SELECT word::BIGINT AS word, (word & 255)::BIGINT AS version, (word >> 9) & 1 = 1 AS tiled, (word >> 10) & 1 = 1 AS long_names, (word >> 11) & 1 = 1 AS non_image, (word >> 12) & 1 = 1 AS multipart, "
    "CASE WHEN word & 255 <> 2 OR word >> 13 <> 0 THEN 'Unsupported' WHEN (word >> 9) & 1 = 1 AND (word >> 12) & 1 = 1 THEN 'Corrupt' ELSE 'Success' END AS status FROM w",
)
def _flags(spark, sf_dir):
    fields = names.version_fields(F.col("word"))
    return literal(spark, [(w,) for w in _WORDS], "word long").select("word", *(c.alias(n) for n, c in fields.items()))
