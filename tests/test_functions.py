"""Function libraries against literal vectors and numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import color, convert, geometry, names
from rasterloom.operators import lut, resample


def values(spark, column, rows, schema="v double"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_all_half_patterns(spark):
    bits = np.arange(65536, dtype=np.uint16)
    got = spark.range(65536).select(convert.half_bits_to_float(F.col("id")).alias("v"), convert.float_to_half_bits(convert.half_bits_to_float(F.col("id"))).alias("b")).collect()
    want = bits.view(np.float16).astype(float)
    v = np.array([r.v for r in got])
    assert ((v == want) | (np.isnan(v) & np.isnan(want))).all()
    assert (np.signbit(v) == np.signbit(want))[~np.isnan(want)].all()
    assert [r.b for r in got] == [0x7E00 if np.isnan(x) else int(b) for b, x in zip(bits, want, strict=True)]


def test_half_rounding_matches_numpy(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(0, 10.0**e, 300) for e in range(-9, 6)] + [np.array([0.0, -0.0, 65504, 65519.99, 65520, 1e9, -1e9, 2.0**-24, 2.0**-25, 3 * 2.0**-25, np.inf, -np.inf, np.nan, 1 + 2.0**-11, 1 + 3 * 2.0**-11])])
    got = values(spark, convert.float_to_half_bits(F.col("v")), [(float(x),) for x in v])
    with np.errstate(over="ignore"):
        want = v.astype(np.float16).view(np.uint16)
    assert all(g == (0x7E00 if np.isnan(x) else w) for g, w, x in zip(got, want, v, strict=True))


def test_unsigned_conversions(spark):
    rows = [(-1.0,), (0.4 / 65535,), (2.0,), (0.50001 / 65535,), (float("nan"),), (1.5 / 65535,), (2.5 / 65535,)]
    assert values(spark, convert.to_unsigned(F.col("v"), convert.U16), rows) == [0, 0, 65535, 1, 0, 2, 2]
    assert values(spark, convert.to_unsigned(F.col("v"), convert.U32, False), [(1.5,), (-1.0,), (4294967296.0,), (float("inf"),)]) == [2, 0, 4294967295, 4294967295]
    assert values(spark, convert.unsigned_strict(F.col("v")), [(1.9,), (-0.1,), (float("nan"),), (4294967296.0,)]) == [1, None, None, None]
    assert values(spark, convert.preview_byte(F.col("v")), [(0.5,), (1.5,), (-1.0,), (float("nan"),)]) == [128, 255, 0, 0]


@pytest.mark.parametrize("curve", color.CURVES)
def test_transfer_round_trip(spark, curve):
    ramp = [(i / 63,) for i in range(64)]
    got = values(spark, color.decode(color.encode(F.col("v"), curve), curve), ramp)
    assert np.allclose(got, [r[0] for r in ramp], atol=0.002)


def test_transfer_negatives(spark):
    rows = [(-0.5,), (float("nan"),)]
    for curve in color.CURVES:
        assert values(spark, color.encode(F.col("v"), curve), rows)[0] == pytest.approx(values(spark, color.encode(F.lit(0.0), curve), rows)[0])
    for curve, kept in (("srgb", True), ("rec709", True), ("hlg", True), ("gamma22", False), ("pq", False)):
        got = values(spark, color.decode(F.col("v"), curve), rows[:1])[0]
        assert (got != 0) == kept


def test_tone_maps(spark):
    v = [(0.0,), (0.5,), (1.0,), (4.0,), (100.0,)]
    for name in ("reinhard", "aces"):
        got = values(spark, color.TONE_MAPS[name](F.col("v")), v)
        assert got[0] == 0 and got == sorted(got) and got[-1] <= 1
    assert values(spark, color.hable(F.col("v")), [(11.2,)]) == [pytest.approx(1.0)]
    assert values(spark, color.reinhard_extended(F.col("v"), color.ToneMap(white=4)), [(4.0,)]) == [pytest.approx(1.0)]
    assert values(spark, color.reinhard(F.col("v")), [(-1.0,)]) == [float("-inf")]


def test_matrices():
    assert np.allclose(color.color_matrix("srgb", "xyz") @ [1, 1, 1], [0.95047, 1, 1.08883], atol=1e-3)
    for a in color.TO_XYZ:
        for b in color.TO_XYZ:
            assert np.allclose(color.color_matrix(a, b) @ color.color_matrix(b, a), np.eye(3), atol=1e-4)
    assert color.apply_matrix(color.color_matrix("srgb", "xyz"), ["one", "two"]) == ["one", "two"]
    assert np.allclose(color.luminance_weights((0.64, 0.33), (0.3, 0.6), (0.15, 0.06), (0.3127, 0.329)), color.DEFAULT_LUMINANCE, atol=1e-3)
    assert color.luminance_weights((0.1, 0.1), (0.2, 0.2), (0.3, 0.3), (0.3, 0.3)) == color.DEFAULT_LUMINANCE


def test_level_chains(spark):
    def sizes(n, up):
        count = values(spark, geometry.level_count(F.lit(n), F.lit(up)), [(0.0,)])[0]
        return [values(spark, geometry.level_size(F.lit(n).cast("long"), F.lit(k), F.lit(up)), [(0.0,)])[0] for k in range(count)]

    assert sizes(5, True) == [5, 3, 2, 1] and sizes(3, True) == [3, 2, 1] and sizes(5, False) == [5, 2, 1] and sizes(1, True) == [1]


def test_spectral_names(spark):
    rows = [("S0.550,000000nm",), ("S2.480,250000nm",), ("T.700.5nm",), ("R",), ("S0.550,0nm.trailing",), ("S4.1nm",), ("T.-1nm",)]
    got = spark.createDataFrame(rows, "n string").select(names.wavelength(F.col("n")), names.stokes(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(550.0, 0), (480.25, 2), (700.5, None), (None, None), (None, None), (None, None), (None, None)]
    for w, kind, component, want in ((550.0, "emissive", 0, "S0.550,000000nm"), (400.5, "polarised", 9, "S3.400,500000nm"), (700.0, "reflective", 0, "T.700,000000nm"), (599.9999999, "emissive", 0, "S0.600,000000nm")):
        assert values(spark, names.spectral_name(kind, F.col("v"), component), [(w,)]) == [want]


def test_layers(spark):
    rows = [("beauty.R",), ("R",), (".G",), ("a.b.c",), ("x.",)]
    got = spark.createDataFrame(rows, "n string").select(names.layer(F.col("n")), names.in_layer(F.col("n"), ""), names.in_layer(F.col("n"), "beauty")).collect()
    assert [tuple(r) for r in got] == [("beauty", None, "R"), (None, "R", None), (None, "G", None), ("a.b", None, None), (None, None, None)]


def test_attribute_integers(spark):
    rows = [(bytearray((-2).to_bytes(4, "little", signed=True)),), (bytearray(b"\x01"),)]
    df = spark.createDataFrame(rows, "d binary")
    assert [r[0] for r in df.select(names.little_endian(F.col("d"), 4)).collect()] == [-2, None]
    top = spark.createDataFrame([(bytearray(b"\xff" * 8),)], "d binary")
    assert int(top.select(names.little_endian(F.col("d"), 8, signed=False)).first()[0]) == 2**64 - 1


def test_cube_text():
    cube = lut.parse_cube("TITLE \"t\"\nLUT_3D_SIZE 2\n" + "\n".join("0 0 0 # c" for _ in range(8)))
    assert cube.size == 2 and cube.title == "t"
    with pytest.raises(NotImplementedError):
        lut.parse_cube("LUT_1D_SIZE 4")
    for bad in ("LUT_3D_SIZE 2\n0 0 0", "LUT_3D_SIZE x", "LUT_3D_SIZE 300", "1 2"):
        with pytest.raises(ValueError, match="Corrupt"):
            lut.parse_cube(bad)


def test_lut_identity_and_edges(spark):
    cube = lut.from_function(2, lambda r, g, b: (r, g, b))
    rows = [(0.25, 0.5, 0.75), (0.5, 0.5, 0.5), (-1.0, 2.0, float("nan")), (0.9, 0.1, 0.1)]
    for tetrahedral in (False, True):
        pixels = spark.createDataFrame(rows, "r double, g double, b double")
        got = [tuple(r) for r in lut.apply(pixels, cube, tetrahedral=tetrahedral).collect()]
        assert np.allclose(got, [(0.25, 0.5, 0.75), (0.5, 0.5, 0.5), (0, 1, 0), (0.9, 0.1, 0.1)], atol=1e-5)


def test_large_tables_interpolate_alike(spark):
    """Tables beyond a plan's literals take another way with the same values."""
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, v)) for i, v in enumerate(rng.random((50, 3)) * 1.2 - 0.1)] + [(50, 0.5, 0.5, 0.25), (51, 0.0, 1.0, float("nan"))]
    pixels = spark.createDataFrame(rows, "n long, r double, g double, b double")
    for size in (lut.LITERAL_SIZE, lut.LITERAL_SIZE + 1):
        cube = lut.from_function(size, lambda r, g, b: (r * r, g * b, 1 - b))
        for tetrahedral in (False, True):
            want = lut.interpolate(cube, np.array([r[1:] for r in rows]), tetrahedral)
            got = [tuple(r)[1:] for r in lut.apply(pixels, cube, tetrahedral=tetrahedral).orderBy("n").collect()]
            assert np.allclose(got, want, atol=1e-9)


def test_weights():
    for name in resample.FILTERS:
        for mode in resample.EDGES:
            for source, target in ((17, 9), (8, 8), (5, 12), (1, 4), (4, 1)):
                sums = {}
                for d, s, w in resample.axis_weights(source, target, name, mode):
                    assert 0 <= s < source
                    sums[d] = sums.get(d, 0) + w
                assert sorted(sums) == list(range(target)) and np.allclose(list(sums.values()), 1)
    assert resample.axis_weights(8, 8, "triangle", "clamp") == [(i, i, 1.0) for i in range(8)]
    assert [resample.edge(i, 4, "reflect") for i in range(-4, 9)] == [2, 3, 2, 1, 0, 1, 2, 3, 2, 1, 0, 1, 2]
    assert [resample.edge(i, 4, "wrap") for i in (-1, 4, 9)] == [3, 0, 1]


def test_resize_means(spark):
    df = spark.createDataFrame([(y, x, float(8 * y + x)) for y in range(6) for x in range(8)], "y long, x long, value double")
    got = {(r.y, r.x): r.value for r in resample.resize(df, ["value"], (8, 6), (4, 3), "box").collect()}
    assert got == {(y, x): pytest.approx(8 * (2 * y + 0.5) + 2 * x + 0.5) for y in range(3) for x in range(4)}
