"""Operators on the literal fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import blocks, bytesops, channels, deep, spectral

HEADER = "id long, compression string, min_x long, min_y long, max_x long, max_y long, tile_x long, tile_y long, mode string, round_up boolean"


def counts(spark, rows, x0=0, y0=0):
    return spark.createDataFrame([(y0 + j, x0 + i, n) for j, row in enumerate(rows) for i, n in enumerate(row)], "y long, x long, cnt long")


def test_deep_2x2(spark):
    c = counts(spark, [[1, 2], [0, 1]], -1, 4)
    assert sorted((r.y, r.x, r.row_cum) for r in deep.row_cumulative(c).collect()) == [(4, -1, 1), (4, 0, 3), (5, -1, 0), (5, 0, 1)]
    back = deep.counts_from_cumulative(deep.row_cumulative(c).drop("cnt"))
    assert sorted((r.y, r.x, r.cnt) for r in back.collect()) == [(4, -1, 1), (4, 0, 2), (5, -1, 0), (5, 0, 1)]
    assert tuple(deep.statistics(c).first()) == (4, 3, 2, 4)


def test_decreasing_counts_fail(spark):
    bad = spark.createDataFrame([(0, 0, 3), (0, 1, 2)], "y long, x long, row_cum long")
    with pytest.raises(Exception, match="Corrupt"):
        deep.counts_from_cumulative(bad).collect()


def test_deep_subsampled(spark):
    c = counts(spark, [[5 * j + i + 1 for i in range(5)] for j in range(4)], -2, -3)
    dense = {(r.y, r.x): (r.off, r.cnt) for r in deep.sample_offsets(c).collect()}
    assert dense[-3, -1] == (1, 2) and sum(n for _, n in dense.values()) == 210
    s = {(r.y, r.x): (r.off, r.cnt) for r in deep.sampled_offsets(c, 2, 3).collect()}
    at = lambda k: s[-3 + k // 5, -2 + k % 5]
    assert [at(k) for k in (1, 15, 16, 19)] == [(1, 0), (9, 16), (25, 0), (43, 20)]
    assert sum(n for _, n in s.values()) == 63


def test_predictor_round_trip(spark):
    rows = spark.createDataFrame([(y, x, (x * 37 + y * 91) % 256) for y in range(3) for x in range(50)], "y long, x long, v long")
    there = bytesops.delta(rows, "v", "d")
    back = bytesops.undo_delta(there.drop("v"), "d", "v")
    assert sorted((r.y, r.x, r.v) for r in back.collect()) == sorted((r.y, r.x, r.v) for r in rows.collect())


@pytest.mark.parametrize(("mode", "up", "levels", "tiles", "last"), [("ONE", False, 1, 4, 0), ("MIP", False, 3, 6, 2), ("RIP", False, 9, 16, 2)])
def test_tile_levels(spark, mode, up, levels, tiles, last):
    h = spark.createDataFrame([(0, "NONE", -2, -3, 1, 0, 2, 2, mode, up)], HEADER)
    lv = blocks.levels(h).collect()
    assert len(lv) == levels and max(r.level_x for r in lv) == last
    assert blocks.tiled_blocks(h).count() == tiles


def test_scanline_blocks(spark):
    h = spark.createDataFrame([(0, "ZIP", -4, -5, 3, 11, None, None, None, False)], HEADER)
    assert sorted((r.y0, r.y1) for r in blocks.scanline_blocks(h).collect()) == [(-5, 10), (11, 11)]
    one = spark.createDataFrame([(0, "HALF", 1, 1)], "id long, type string, xs long, ys long")
    assert sorted(r.bytes for r in blocks.uncompressed_bytes(blocks.scanline_blocks(h), one).collect()) == [16, 256]


def test_absolute_sampling(spark):
    h = spark.createDataFrame([(0, "HTJ2K256", -3, -4, 2, 3, None, None, None, False)], HEADER)
    kinds = spark.createDataFrame([(0, "HALF", 1, 1), (0, "FLOAT", 2, 3)], "id long, type string, xs long, ys long")
    assert blocks.uncompressed_bytes(blocks.scanline_blocks(h), kinds).first().bytes == 48 * 2 + 9 * 4


def test_point_expansion(spark):
    grid = spark.createDataFrame([(y, x) for y in (0, 1) for x in range(4)], "y long, x long")
    s = spark.createDataFrame([(y, x, 10.0 * (1 + x // 2 + 2 * y)) for y in (0, 1) for x in (0, 2)], "y long, x long, value double")
    got = [r.value for r in channels.point_expand(grid, s, (0, 0, 3, 1), 2, 1).orderBy("y", "x").collect()]
    assert got == [10, 10, 20, 20, 30, 30, 40, 40]
    none = channels.point_expand(spark.createDataFrame([(1, 1)], "y long, x long"), s, (1, 1, 1, 1), 2, 3)
    assert none.first().value == 0.0


def test_luma_chroma(spark):
    grid = [(y, x) for y in (6, 7) for x in range(-4, 0)]
    luma = spark.createDataFrame([(y, x, 0.5, 0.75) for y, x in grid], "y long, x long, luma double, alpha double")
    chroma = spark.createDataFrame([(6, x, 1.0, -1.0) for x in (-4, -2)], "y long, x long, ry double, by double")
    up = channels.upsample_bilinear(luma.select("y", "x"), chroma, (-4, 6, -1, 7), 2, 2, ["ry", "by"])
    for r in channels.luma_chroma_to_rgba(luma, up).collect():
        assert (r.r, r.b, r.a) == (1.0, 0.0, 0.75) and r.g == pytest.approx((0.5 - 0.2126) / 0.7152)


def test_rgba_needs_colours(spark):
    df = spark.createDataFrame([(0, 0, "R", 1.0), (0, 0, "G", 1.0)], "y long, x long, channel string, value double")
    with pytest.raises(Exception, match="InvalidData"):
        channels.rgba(df).collect()
    with pytest.raises(Exception, match="repeated"):
        channels.canonical_order(spark.createDataFrame([(0, "R"), (0, "R")], "part long, name string")).collect()


def test_wavelength_folds(spark):
    names = [(0, i, f"S0.{w}nm") for i, w in enumerate(("700", "480.015", "480.0", "480.008", "550"))]
    df = spark.createDataFrame(names, "part long, channel_idx long, name string")
    assert spectral.wavelengths(df).first().wavelengths == [480.0, 480.015, 550.0, 700.0]
    assert spectral.wavelengths_any(df).first().wavelengths == [480.0, 480.015, 550.0, 700.0]
    near = spark.createDataFrame([(0, 0, "S0.480nm"), (0, 1, "S0.480.009nm"), (0, 2, "S0.480.018nm")], "part long, channel_idx long, name string")
    assert spectral.wavelengths(near).first().wavelengths == [480.0, 480.018]


def test_segments(spark):
    s = spark.createDataFrame([(0, 10, 14), (0, 17, 20)], "source long, start long, end long")
    assert tuple(bytesops.first_gap(s).first())[1:] == (14, 17)
    s = s.unionAll(spark.createDataFrame([(0, 14, 17)], s.schema))
    assert [tuple(r)[1:] for r in bytesops.merge_segments(s).collect()] == [(10, 20, 3)]
    assert bytesops.first_gap(s).count() == 0


def test_images_stay_apart(spark):
    """Two images in one table: every operator with keys gives each what it gives it alone."""
    from rasterloom.operators import deep, spectral

    def alike(operator, rows, schema, **more):
        both = spark.createDataFrame([(k, *r) for k in ("a", "b") for r in (rows if k == "a" else rows[::2])], "image string, " + schema)
        got = operator(both, keys=("image",), **more)
        for k in "ab":
            own = got.where(F.col("image") == k).drop("image").collect()
            alone = operator(both.where(F.col("image") == k).drop("image"), **more).collect()
            assert sorted(map(tuple, own), key=repr) == sorted(map(tuple, alone), key=repr)

    counts = [(y, x, (3 * y + x) % 4) for y in range(-2, 5000, 997) for x in range(5)]
    schema = "y long, x long, cnt long"
    alike(deep.row_cumulative, counts, schema)
    alike(deep.sample_offsets, counts, schema)
    alike(lambda df, keys=(): deep.sampled_offsets(df, 2, 3, keys), counts, schema)
    alike(deep.statistics, counts, schema)
    alike(lambda df, keys=(): deep.counts_from_cumulative(deep.row_cumulative(df, keys).drop("cnt"), keys), counts, schema)
    alike(lambda df, keys=(): bytesops.delta(df, "cnt", "d", keys), counts, schema)
    alike(lambda df, keys=(): bytesops.undo_delta(df, "cnt", "d", keys), counts, schema)
    alike(lambda df, keys=(): bytesops.runs(df.withColumnRenamed("cnt", "v"), keys), counts, schema)
    samples = [(y, x, c, float(y + x)) for y in range(3) for x in range(4) for c in "RG"]
    alike(lambda df, keys=(): channels.interleave(df, ["R", "G"], keys), samples, "y long, x long, channel string, value double")
    cube = [(i, y, 0, float(i * y)) for i in range(4) for y in range(3)]
    alike(spectral.pixel_spectra, cube, "wavelength_idx long, y long, x long, value double")


def test_merged_segments_have_a_limit(spark):
    s = spark.createDataFrame([(0, 10 * k, 10 * k + 10) for k in range(7)] + [(0, 90, 150), (0, 150, 155)], "source long, start long, end long")
    got = sorted(tuple(r)[1:] for r in bytesops.merge_segments(s, most_length=30).collect())
    assert got == [(0, 30, 3), (30, 60, 3), (60, 70, 1), (90, 150, 1), (150, 155, 1)]
