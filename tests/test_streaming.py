"""Streaming state: byte ranges and row-wise resampling."""

from __future__ import annotations

import numpy as np

from rasterloom.streaming.rows import Ranges, assemble_ranges, count_windows, last_updates, narrowed, resize_rows, run_to_end


def test_ranges():
    r = Ranges()
    assert r.supply(10, b"abcd") == r.supply(17, b"hij") == "Success"
    assert r.missing(10, 20) == (14, 3)
    assert r.supply(14, b"efg") == "Success" and r.missing(10, 20) is None and r.parts == {10: b"abcdefghij"}
    assert r.supply(12, b"cde") == "Success" and r.parts == {10: b"abcdefghij"}
    assert r.supply(12, b"xyz") == "Conflict" and r.parts == {10: b"abcdefghij"}
    assert r.supply(8, b"89ab") == "Success" and r.parts == {8: b"89abcdefghij"}
    assert Ranges(budget=3).supply(0, b"abcd") == "OutOfMemory"
    assert Ranges().missing(5, 9) == (5, 4)


def test_conflict_in_a_stream(spark, tmp_path):
    events = spark.createDataFrame([("s", 1, 0, bytearray(b"ab")), ("s", 2, 1, bytearray(b"X")), ("s", 3, 2, bytearray(b"cd"))], "source string, seq long, offset long, data binary")
    events.write.parquet(f"{tmp_path}/in")
    out = run_to_end(assemble_ranges(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")), f"file://{tmp_path}/run").collect()
    assert sorted((r.start, r.end, r.status) for r in out) == [(0, 4, "Success"), (1, 2, "Conflict")]


def test_rows_in_any_order(spark, tmp_path):
    rows = spark.createDataFrame([(0, y, [float(y)] * 4) for y in (3, 0, 2, 1, 2)] + [(1, 0, [1.0] * 4)], "image long, y int, values array<double>")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = run_to_end(resize_rows(stream, (4, 4), (2, 2), "box"), f"file://{tmp_path}/run").collect()
    assert sorted((r.image, r.y, tuple(r["values"])) for r in out if r.status == "Success") == [(0, 0, (0.5, 0.5)), (0, 1, (2.5, 2.5))]
    assert [(r.image, r.y, r["values"], r.status) for r in out if r.status != "Success"] == [(0, 2, None, "Rejected")]


def test_late_and_foreign_rows_are_rejected(spark, tmp_path):
    for k, part in enumerate([[0, 1], [1, 2, 9, -1], [3, 3], [0]]):
        rows = spark.createDataFrame([(0, y, [float(y)] * 4) for y in part], "image long, y int, values array<double>")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = run_to_end(resize_rows(stream, (4, 4), (2, 2), "box", pixel_type="UINT"), f"file://{tmp_path}/run").collect()
    assert sorted((r.y, tuple(r["values"])) for r in out if r.status == "Success") == [(0, (0.0, 0.0)), (1, (2.0, 2.0))]
    assert sorted(r.y for r in out if r.status == "Rejected") == [-1, 0, 1, 3, 9]


def test_narrowed():
    v = np.array([np.nan, -1.0, 0.5, 1.5, 2.5, 5e9, np.inf])
    assert narrowed(v, "UINT").tolist() == [0, 0, 0, 2, 2, 4294967295, 4294967295]
    assert narrowed(np.array([1.0002, 1e6, 65519.0]), "HALF").tolist() == [1.0, np.inf, 65504.0]
    assert narrowed(np.array([0.1]), "FLOAT").tolist() == [float(np.float32(0.1))]


def test_windows_in_update_mode(spark, tmp_path):
    """A window is updated over micro-batches; what the watermark has passed is late."""
    schema = "ts timestamp, event_type string, value double"
    parts = [[("2024-01-01 00:10:00", 1.0)], [("2024-01-01 00:50:00", 2.0), ("2024-01-01 05:00:00", 4.0)], [("2024-01-01 05:30:00", 8.0)], [("2024-01-01 00:20:00", 16.0), ("2024-01-01 04:30:00", 32.0)]]
    for part in parts:
        spark.createDataFrame([(ts, v) for ts, v in part], "ts string, value double").selectExpr("cast(ts as timestamp) ts", "'a' event_type", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    windows = count_windows(stream, "1 hour", "1 hour")
    assert windows.isStreaming
    out = last_updates(windows, f"file://{tmp_path}/run", ["hour", "event_type"]).collect()
    assert sorted((r.hour.hour, r.n, r.total) for r in out) == [(0, 2, 3.0), (4, 1, 32.0), (5, 2, 12.0)]


def test_event_windows_is_a_stream(spark):
    """The registered query goes through Structured Streaming."""
    from rasterloom.plans import catalog, stream_queries

    made, real = [], stream_queries.rows.last_updates
    stream_queries.rows.last_updates = lambda stream, *rest: made.append(stream) or real(stream, *rest)
    try:
        assert catalog.load()[0]["stream_event_windows"](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        stream_queries.rows.last_updates = real
    assert [x.isStreaming for x in made] == [True] and "EventTimeWatermark" in made[0]._jdf.queryExecution().logical().toString()
