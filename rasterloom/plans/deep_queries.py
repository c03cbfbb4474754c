"""Deep rasters, predictors, runs and byte segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterloom.operators import bytesops, deep
from rasterloom.plans.catalog import query
from rasterloom.plans.views import DEEP_IMAGES_SQL, DEEP_SQL, IMAGES_SQL, PIXELS_SQL, deep_images, deep_pixels, images, pixels, table

_CUM = "sum(cnt) OVER (PARTITION BY image, y ORDER BY x ROWS UNBOUNDED PRECEDING)::BIGINT"
_BELOW = "coalesce(sum(cnt) OVER (PARTITION BY image ORDER BY y, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT"
_IMAGE = ("image",)


@query("deep_counts", f"WITH {DEEP_SQL} SELECT y, x, cnt FROM dp")
def _counts(spark, sf_dir):
    return deep_pixels(spark, sf_dir)


@query("deep_row_cumulative", f"WITH {DEEP_IMAGES_SQL} SELECT image, y, x, cnt, {_CUM} AS row_cum FROM di")
def _row_cumulative(spark, sf_dir):
    return deep.row_cumulative(deep_images(spark, sf_dir), _IMAGE)


@query("deep_counts_from_cumulative", f"WITH {DEEP_IMAGES_SQL} SELECT image, y, x, {_CUM} AS row_cum, cnt FROM di")
def _back(spark, sf_dir):
    return deep.counts_from_cumulative(deep.row_cumulative(deep_images(spark, sf_dir), _IMAGE).drop("cnt"), _IMAGE)


@query("deep_sample_offsets", f"WITH {DEEP_IMAGES_SQL} SELECT image, y, x, cnt, {_BELOW} AS off FROM di")
def _offsets(spark, sf_dir):
    return deep.sample_offsets(deep_images(spark, sf_dir), _IMAGE)


@query("deep_sample_offsets_whole", f"WITH {DEEP_SQL} SELECT y, x, cnt, coalesce(sum(cnt) OVER (ORDER BY y, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM dp")
def _whole_offsets(spark, sf_dir):
    """The table as one image, whose lines grow with it."""
    return deep.sample_offsets(deep_pixels(spark, sf_dir))


@query(
    "deep_sampled_offsets",
    f"WITH {DEEP_IMAGES_SQL}, s AS (SELECT image, y, x, CASE WHEN x % 2 = 0 AND y % 3 = 0 THEN cnt ELSE 0 END AS cnt FROM di) SELECT image, y, x, cnt::BIGINT AS cnt, {_BELOW} AS off FROM s",
)
def _sampled(spark, sf_dir):
    return deep.sampled_offsets(deep_images(spark, sf_dir), 2, 3, _IMAGE)


@query("deep_statistics", f"WITH {DEEP_SQL} SELECT count(*)::BIGINT AS pixel_locations, count(*) FILTER (cnt > 0)::BIGINT AS non_empty_pixels, max(cnt) AS max_samples, sum(cnt)::BIGINT AS total_samples FROM dp")
def _statistics(spark, sf_dir):
    return deep.statistics(deep_pixels(spark, sf_dir))


@query("deep_row_totals", f"WITH {DEEP_SQL} SELECT y, sum(cnt)::BIGINT AS samples, max(cnt) AS most FROM dp GROUP BY 1")
def _row_totals(spark, sf_dir):
    return deep_pixels(spark, sf_dir).groupBy("y").agg(F.sum("cnt").alias("samples"), F.max("cnt").alias("most"))


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


@query(
    "deep_samples_long",
    f"SELECT l_orderkey // 100 AS y, l_orderkey % 100 AS x, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1)::BIGINT AS s, l_extendedprice AS z, l_quantity AS a FROM lineitem",
)
def _samples(spark, sf_dir):
    """Row-interleaved samples as planar streams: one row per sample, a column per channel."""
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", "))
    return table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 100").alias("y"), (F.col("l_orderkey") % 100).alias("x"), (F.row_number().over(w) - 1).cast("long").alias("s"), F.col("l_extendedprice").alias("z"), F.col("l_quantity").alias("a"))


@query(
    "deep_pixel_arrays",
    f"SELECT l_orderkey // 100 AS y, l_orderkey % 100 AS x, count(*)::BIGINT AS cnt, list(l_quantity ORDER BY {_ORDER}) AS samples FROM lineitem GROUP BY ALL",
)
def _arrays(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct(*_ORDER.split(", "))))
    return table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey div 100").alias("y"), (F.col("l_orderkey") % 100).alias("x")).agg(F.count("*").alias("cnt"), F.transform(rows, lambda s: s["l_quantity"]).alias("samples"))


@query(
    "deep_sample_slice",
    f"WITH a AS (SELECT l_orderkey, list(l_quantity ORDER BY {_ORDER}) AS s FROM lineitem GROUP BY 1) SELECT l_orderkey // 100 AS y, l_orderkey % 100 AS x, s[2:3] AS part FROM a",
)
def _slice(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct(*_ORDER.split(", "))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("s")).select(F.expr("l_orderkey div 100").alias("y"), (F.col("l_orderkey") % 100).alias("x"), F.slice(F.transform("s", lambda s: s["l_quantity"]), 2, 2).alias("part"))


_BYTES_SQL = f"{IMAGES_SQL}, b AS (SELECT image, y, x, (round_even(value, 0)::BIGINT % 256) AS v FROM im)"


def _bytes(spark, sf_dir):
    return images(spark, sf_dir).select("image", "y", "x", F.pmod(F.rint("value").cast("long"), F.lit(256)).alias("v"))


_DELTA = "CASE WHEN lag(v) OVER (PARTITION BY image, y ORDER BY x) IS NULL THEN v ELSE (v - lag(v) OVER (PARTITION BY image, y ORDER BY x) + 384) % 256 END"


@query("predictor_delta", f"WITH {_BYTES_SQL} SELECT image, y, x, ({_DELTA})::BIGINT AS d FROM b")
def _delta(spark, sf_dir):
    return bytesops.delta(_bytes(spark, sf_dir), "v", "d", _IMAGE).select("image", "y", "x", "d")


@query("predictor_undo", f"WITH {_BYTES_SQL} SELECT image, y, x, v::BIGINT AS v FROM b")
def _undo(spark, sf_dir):
    return bytesops.undo_delta(bytesops.delta(_bytes(spark, sf_dir), "v", "d", _IMAGE).drop("v"), "d", "v", _IMAGE).select("image", "y", "x", "v")


@query(
    "byte_reorder",
    f"WITH {_BYTES_SQL} SELECT image, y, CASE WHEN x % 2 = 0 THEN x // 2 ELSE 50 + x // 2 END AS x, v::BIGINT AS v FROM b",
)
def _reorder(spark, sf_dir):
    """Even bytes to the first half of a row of 100, odd ones to the second."""
    return bytesops.deinterleave(_bytes(spark, sf_dir), 100, _IMAGE)


@query("pxr24_row_delta", f"WITH {PIXELS_SQL}, u AS (SELECT y, x, round_even(value * 1000, 0)::BIGINT AS v FROM px), d AS (SELECT y, x, ((v - coalesce(lag(v) OVER (PARTITION BY y ORDER BY x), 0)) % 4294967296 + 4294967296) % 4294967296 AS d FROM u) SELECT y, x, d, d >> 16 & 255 AS high, d >> 8 & 255 AS mid, d & 255 AS low FROM d")
def _pxr24(spark, sf_dir):
    """Plain difference modulo 2**32 per row, then byte planes, the most significant first."""
    w = Window.partitionBy("y").orderBy("x")
    v = F.rint(F.col("value") * 1000).cast("long")
    d = pixels(spark, sf_dir).select("y", "x", v.alias("v")).withColumn("d", F.pmod(F.col("v") - F.coalesce(F.lag("v").over(w), F.lit(0)), F.lit(4294967296)))
    return d.select("y", "x", "d", F.shiftright("d", 16).bitwiseAND(255).alias("high"), F.shiftright("d", 8).bitwiseAND(255).alias("mid"), F.col("d").bitwiseAND(255).alias("low"))


@query(
    "rle_runs",
    "WITH t AS (SELECT event_id // 1000 AS image, event_id // 100 % 10 AS y, event_id % 100 AS x, user_id % 2 AS v FROM events), g AS (SELECT image, y, x, v, row_number() OVER (PARTITION BY image, y ORDER BY x) - row_number() OVER (PARTITION BY image, y, v ORDER BY x) AS k FROM t) SELECT image, y, v, min(x) AS first_x, count(*)::BIGINT AS length FROM g GROUP BY image, y, v, k",
)
def _runs(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.expr("event_id div 1000").alias("image"), (F.expr("event_id div 100") % 10).alias("y"), (F.col("event_id") % 100).alias("x"), (F.col("user_id") % 2).alias("v"))
    return bytesops.runs(t, _IMAGE).select("image", "y", "v", "first_x", "length")


#: Byte segments: an order is a piece of a source of 40; every third begins late, every fourth ends early.
_SEGMENTS_SQL = "s AS (SELECT o_orderkey // 40 AS source, 100 * (o_orderkey % 40) + CASE WHEN o_orderkey % 3 = 0 THEN 20 ELSE 0 END AS start_, 100 * (o_orderkey % 40) + CASE WHEN o_orderkey % 4 = 0 THEN 90 ELSE 100 END AS end_ FROM orders)"


def _segments(spark, sf_dir):
    k = F.col("o_orderkey")
    begin = 100 * (k % 40)
    return table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 40").alias("source"), (begin + F.when(k % 3 == 0, 20).otherwise(0)).alias("start"), (begin + F.when(k % 4 == 0, 90).otherwise(100)).alias("end"))


@query(
    "segment_merge",
    f"WITH {_SEGMENTS_SQL}, b AS (SELECT source, start_, end_, CASE WHEN lag(end_) OVER (PARTITION BY source ORDER BY start_) = start_ THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT source, start_, end_, sum(new) OVER (PARTITION BY source ORDER BY start_) AS n FROM b) SELECT source, min(start_)::BIGINT AS segment_start, max(end_)::BIGINT AS segment_end, count(*)::BIGINT AS pieces FROM g GROUP BY source, n",
)
def _merge(spark, sf_dir):
    return bytesops.merge_segments(_segments(spark, sf_dir)).select("source", "segment_start", "segment_end", "pieces")


@query(
    "segment_first_gap",
    f"WITH {_SEGMENTS_SQL}, b AS (SELECT source, end_, lead(start_) OVER (PARTITION BY source ORDER BY start_) AS nxt FROM s) SELECT source, min(end_)::BIGINT AS gap_start, arg_min(nxt, end_)::BIGINT AS gap_end FROM b WHERE nxt > end_ GROUP BY source",
)
def _gap(spark, sf_dir):
    return bytesops.first_gap(_segments(spark, sf_dir)).select("source", "gap_start", "gap_end")


#: Ranges: line items on the axis of their part keys, as wide as their quantity.
_RANGES_SQL = "r AS (SELECT l_orderkey * 10 + l_linenumber AS id, 1000 * l_orderkey + 7 * l_linenumber AS start_, 1000 * l_orderkey + 7 * l_linenumber + 1 + l_quantity::BIGINT AS end_ FROM lineitem)"


@query("segment_overlaps", f"WITH {_RANGES_SQL} SELECT a.id::BIGINT AS a, b.id::BIGINT AS b FROM r a JOIN r b ON a.start_ // 1000 = b.start_ // 1000 AND a.id < b.id AND a.start_ < b.end_ AND b.start_ < a.end_")
def _overlaps(spark, sf_dir):
    begin = 1000 * F.col("l_orderkey") + 7 * F.col("l_linenumber")
    r = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), begin.cast("long").alias("start"), (begin + 1 + F.col("l_quantity").cast("long")).cast("long").alias("end"))
    return bytesops.overlaps(r, r, cell=100).where("a < b")


@query("symbol_histogram", f"WITH {_BYTES_SQL} SELECT v::BIGINT AS symbol, count(*)::BIGINT AS n FROM b GROUP BY 1")
def _symbols(spark, sf_dir):
    return _bytes(spark, sf_dir).groupBy(F.col("v").alias("symbol")).agg(F.count("*").alias("n"))


@query("used_value_range", f"WITH {_BYTES_SQL} SELECT image, y, min(v) FILTER (v <> 0)::BIGINT AS least, max(v) FILTER (v <> 0)::BIGINT AS most, count(DISTINCT v)::BIGINT AS used FROM b GROUP BY 1, 2")
def _used(spark, sf_dir):
    some = F.when(F.col("v") != 0, F.col("v"))
    return _bytes(spark, sf_dir).groupBy("image", "y").agg(F.min(some).alias("least"), F.max(some).alias("most"), F.countDistinct("v").alias("used"))
