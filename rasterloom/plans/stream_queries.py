"""Queries through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.plans.catalog import query
from rasterloom.plans.file_queries import _folder
from rasterloom.plans.sampling_queries import _TARGET, _WIDTH, _resize_sql
from rasterloom.plans.views import LINES, images, table
from rasterloom.streaming import rows

#: Time spans in which events arrive.
_SPANS = 4


def _resized(spark, sf_dir, pixel_type=None):
    """Images arrive line by line in several files; each target line leaves once its sources are there."""
    folder = _folder(spark)
    lines = images(spark, sf_dir).groupBy("image", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "value"))), lambda s: s["value"]).alias("values"))
    lines = lines.select("image", F.col("y").cast("int").alias("y"), "values")
    lines.repartition(4, "y").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    small = rows.run_to_end(rows.resize_rows(stream, (_WIDTH, LINES), _TARGET, pixel_type=pixel_type), folder).where("status = 'Success'")
    return small.select("image", F.col("y").cast("long").alias("y"), F.posexplode("values").alias("x", "value")).select("image", "y", F.col("x").cast("long").alias("x"), "value")


_DOWN_SQL = _resize_sql("mitchell", "clamp", ["value"])


@query("stream_resize_rows", _DOWN_SQL + "SELECT image, y, x, round(value, 6) AS value FROM down")
def _resize(spark, sf_dir):
    return _resized(spark, sf_dir).withColumn("value", F.round("value", 6))


@query("stream_resize_rows_u32", _DOWN_SQL + "SELECT image, y, x, round_even(greatest(value, 0), 0)::BIGINT AS value FROM down")
def _resize_whole(spark, sf_dir):
    """The same into whole numbers, as unsigned samples hold them."""
    return _resized(spark, sf_dir, "UINT").withColumn("value", F.col("value").cast("long"))


@query(
    "stream_byte_ranges",
    "SELECT (l_orderkey % 50)::VARCHAR AS source, sum(length(l_returnflag || l_linestatus))::BIGINT AS bytes, 'Success' AS status FROM lineitem GROUP BY 1",
)
def _ranges(spark, sf_dir):
    """Pieces of 50 sources arrive in any order and end as one range each."""
    from pyspark.sql import Window

    folder = _folder(spark)
    piece = F.concat("l_returnflag", "l_linestatus")
    order = Window.partitionBy("source").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    pieces = table(spark, sf_dir, "lineitem").withColumn("source", (F.col("l_orderkey") % 50).cast("string")).withColumn("data", piece.cast("binary"))
    pieces = pieces.withColumn("offset", F.coalesce(F.sum(F.octet_length("data")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    events = pieces.select("source", F.xxhash64("l_orderkey", "offset").alias("seq"), "offset", "data")
    events.repartition(4, "seq").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    out = rows.run_to_end(rows.assemble_ranges(stream), folder)
    # the state after the last micro-batch: one range from 0 per source
    return out.groupBy("source").agg(F.max(F.col("end") - F.col("start")).alias("bytes"), F.max_by("status", F.col("end") - F.col("start")).alias("status"))


@query(
    "stream_event_windows",
    "SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
)
def _windows(spark, sf_dir):
    """An extra on event time: tumbling windows with a watermark, in update mode over all input.

    Events arrive in order of time spans, in any order within one; the watermark stays a span
    behind, so that no event is late and windows of earlier spans are let go. A watermark needs
    instants: times without a zone are taken as UTC, and given back without a zone.
    """
    folder = _folder(spark)
    source = table(spark, sf_dir, "events").where("ts is not null").select("ts", "event_type", "value")
    zoned = source.schema["ts"].dataType.simpleString() == "timestamp"
    if not zoned:
        source = source.withColumn("ts", F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp"))
    low, high = source.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    low, span = low or 0, 1 if low is None else (high - low) // _SPANS + 1
    nth = F.expr(f"(unix_micros(ts) - {low}L) div {span}L")
    for k in range(_SPANS):
        source.where(nth == k).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    last = rows.last_updates(rows.count_windows(stream, "1 hour", f"{span} microseconds"), folder, ["hour", "event_type"])
    hour = F.col("hour") if zoned else F.expr("timestampadd(HOUR, cast(unix_seconds(hour) div 3600 as int), TIMESTAMP_NTZ'1970-01-01 00:00:00')").alias("hour")
    return last.select(hour, "event_type", "n", F.round("total", 2).alias("total"))
