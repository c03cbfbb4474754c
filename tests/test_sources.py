"""Image files: codecs, headers, flat, tiled, multipart and deep round trips, damage, the data source."""

from __future__ import annotations

import glob
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import codecs, exr, frames

CHANNELS = [("A", "HALF", 1, 1, False), ("F", "FLOAT", 1, 1, False), ("S", "HALF", 2, 2, False), ("U", "UINT", 1, 1, False)]
LOSSLESS = ("NONE", "RLE", "ZIPS", "ZIP", "ZSTD", "PIZ")


def planes(part: exr.Part, block: exr.Block, seed: int = 0) -> dict[str, np.ndarray]:
    rng, out = np.random.default_rng(seed + block.index), {}
    for r in part.rows(block):
        name, kind, *_ = part.channels[r.channel]
        v = np.linspace(0, 3, r.width) + rng.normal(0, 0.01, r.width).round(3)
        out.setdefault(name, []).append((v * 1000 if kind == "UINT" else v).clip(0).astype(codecs.DTYPES[kind]))
    return {n: np.stack(v) for n, v in out.items()}


def written(part: exr.Part) -> tuple[bytes, dict[int, dict]]:
    given = {b.index: planes(part, b) for b in part.blocks()}
    return exr.assemble([part], [{b.index: exr.encode_block(part, b, given[b.index]) for b in part.blocks()}]), given


@pytest.mark.parametrize("compression", [*LOSSLESS, "PXR24", "B44", "B44A"])
@pytest.mark.parametrize("tiles", [None, (8, 4, "ONE", "DOWN"), (8, 4, "MIP", "UP"), (8, 4, "RIP", "DOWN")])
def test_round_trip(compression, tiles):
    part = exr.Part(kind="tiledimage" if tiles else "scanlineimage", compression=compression, window=(-4, -6, 17, 20), display=(0, 0, 9, 9), tiles=tiles, channels=list(CHANNELS), attributes=[("comments", "string", b"hello")])
    data, given = written(part)
    source = exr.Bytes(data)
    file = exr.parse(source)
    (back,) = file.parts
    assert (back.window, back.tiles, back.compression, back.channels) == (part.window, tiles, compression, CHANNELS)
    assert ("comments", "string", b"hello") in back.attributes
    off = 0.0 if compression in LOSSLESS else 0.001 if compression == "PXR24" else 0.5
    for b in back.blocks():
        got = exr.read_block(source, file, back, b)
        assert set(got) <= {c[0] for c in CHANNELS}
        for n, v in got.items():
            assert np.abs(v.astype(float) - given[b.index][n].astype(float)).max() <= off * max(1, np.abs(v.astype(float)).max() if n != "U" else 0)


@pytest.mark.parametrize("compression", LOSSLESS[:5])
def test_deep_round_trip(compression):
    part = exr.Part(kind="deepscanline", name="deep", compression=compression, window=(0, 0, 127, 2), display=(0, 0, 127, 2), channels=[("A", "HALF", 1, 1, False), ("Z", "FLOAT", 1, 1, False)])
    chunks, given = {}, {}
    for b in part.blocks():
        h = b.box[3] - b.box[1] + 1
        n = np.array([[0 if i % 5 == 0 else i % 3 + 1 for i in range(128)]] * h)
        v = {c: np.arange(n.sum()).astype(codecs.DTYPES[k]) for c, k, *_ in part.channels}
        chunks[b.index], given[b.index] = exr.encode_deep_block(part, b, n, v), (n, v)
    source = exr.Bytes(exr.assemble([part], [chunks]))
    file = exr.parse(source)
    assert file.version & exr.NON_IMAGE
    for b in file.parts[0].blocks():
        n, v = exr.read_deep_block(source, file, file.parts[0], b)
        assert (n == given[b.index][0]).all() and all((v[c] == given[b.index][1][c]).all() for c in v)


def test_multipart():
    parts = [exr.Part(name="beauty", compression="NONE", window=(0, 0, 2, 1), display=(0, 0, 2, 1), channels=[("R", "FLOAT", 1, 1, False)]), exr.Part(name="mip", kind="tiledimage", compression="ZIP", window=(5, -2, 9, 0), display=(5, -2, 9, 0), tiles=(3, 2, "MIP", "DOWN"), channels=[("G", "HALF", 1, 1, False), ("B", "HALF", 1, 1, False)])]
    parts[1].channels.sort()
    chunks = [{b.index: exr.encode_block(p, b, planes(p, b)) for b in p.blocks()} for p in parts]
    source = exr.Bytes(exr.assemble(parts, chunks))
    file = exr.parse(source)
    assert file.multipart and [p.name for p in file.parts] == ["beauty", "mip"]
    for p in file.parts:
        for b in p.blocks():
            got, want = exr.read_block(source, file, p, b), planes(p, b)
            assert all((got[n] == want[n]).all() for n in want)
    parts[1].name = "beauty"
    with pytest.raises(ValueError, match="differ"):
        exr.assemble(parts, chunks)


def test_missing_offsets_are_found_again():
    part = exr.Part(compression="ZIPS", window=(0, 0, 3, 7), display=(0, 0, 3, 7), channels=[("Y", "HALF", 1, 1, False)])
    data, given = written(part)
    n = len(part.blocks())
    offsets = exr.parse(exr.Bytes(data)).parts[0].offsets
    table = data.index(struct.pack(f"<{n}Q", *offsets))
    source = exr.Bytes(data[:table] + bytes(8 * n) + data[table + 8 * n :])
    file = exr.parse(source)
    assert file.parts[0].offsets == offsets
    cut = exr.Bytes(source.data[: offsets[4]])
    short = exr.parse(cut)
    assert [o == 0 for o in short.parts[0].offsets] == [False] * 4 + [True] * 4
    with pytest.raises(exr.Corrupt, match="missing"):
        exr.read_block(cut, short, short.parts[0], short.parts[0].blocks()[5])


def test_damage():
    part = exr.Part(compression="ZIP", window=(0, 0, 9, 9), display=(0, 0, 9, 9), channels=[("Y", "FLOAT", 1, 1, False)])
    data, _ = written(part)
    for bad in (b"", data[:6], data[:40], b"x" + data[1:]):
        with pytest.raises(exr.Corrupt):
            exr.parse(exr.Bytes(bad))
    for word in (3, 2 | 1 << 13):
        with pytest.raises(exr.Unsupported):
            exr.parse(exr.Bytes(data[:4] + struct.pack("<I", word) + data[8:]))
    with pytest.raises(exr.Corrupt):
        exr.parse(exr.Bytes(data[:4] + struct.pack("<I", 2 | exr.TILED | exr.MULTIPART) + data[8:]))
    flat = {b.index: exr.encode_block(part, b, {"Y": np.zeros((10, 10))}) for b in part.blocks()}
    broken = bytearray(exr.assemble([part], [flat]))
    broken[-10:] = bytes(10)
    source = exr.Bytes(bytes(broken))
    file = exr.parse(source)
    with pytest.raises(exr.Corrupt):
        exr.read_block(source, file, file.parts[0], file.parts[0].blocks()[0])
    with pytest.raises(ValueError, match="missing"):
        exr.assemble([part], [{}])
    with pytest.raises(exr.Unsupported):
        codecs.encode("DWAA", b"x" * 100, [])
    with pytest.raises(exr.Unsupported):
        codecs.decode("HTJ2K32", b"x", 100, [])


@pytest.mark.parametrize("data", [b"", b"a", b"aaaa", bytes(300), bytes(range(256)) * 2, b"ab" * 100 + b"c" * 130 + b"dd", b"x" * 129 + b"y", b"x" * 131])
def test_runs_and_predictor(data):
    assert codecs.rle_decode(codecs.rle_encode(np.frombuffer(data, np.uint8)), len(data)) == data
    assert codecs.unpredict(codecs.predict(data).tobytes()) == data


def test_float_24():
    bits = np.array([0x3F800000, 0x3F80007F, 0x3F800080, 0x3F8000FF, 0x7F800000, 0x7F800001, 0x7FC00000, 0xFF800000, 0x7F7FFFFF, 0x80000000], np.uint32)
    assert codecs.float_to_24(bits).tolist() == [0x3F8000, 0x3F8000, 0x3F8001, 0x3F8001, 0x7F8000, 0x7F8001, 0x7FC000, 0xFF8000, 0x7F7FFF, 0x800000]


def test_real_image(spark):
    found = glob.glob("/root/.pyenv/versions/*/lib/python3.*/test/**/python.exr", recursive=True)
    if not found:
        pytest.skip("the sample isn't on this machine")
    head = frames.read_images(spark, found[0], "header").first()
    assert (head.part_type, head.compression, head.max_x, head.max_y, [c.name for c in head.channels], head.chunk_count) == ("scanlineimage", "NONE", 15, 15, list("ABGR"), 16)
    assert frames.read_images(spark, found[0]).count() == 4 * 256
    first = frames.read_images(spark, found[0], "blocks").orderBy("block_index").first()
    assert first.file_offset == 459 and not first.is_missing


def test_data_source(spark, tmp_path):
    rows = [(i, y, x, c, float(y * 10 + x + i)) for i in range(3) for y in range(20) for x in range(5) for c in "RG"]
    df = spark.createDataFrame(rows, "i int, y int, x int, channel string, value double").selectExpr("concat('im', i) file_id", "y", "x", "channel", "value")
    folder = f"file://{tmp_path}/images"
    frames.write_images(frames.encode_images(df, "ZIPS"), folder).collect()
    frames.register(spark)
    back = spark.read.format("exr").option("blocks_per_task", 4).option("whole_bytes", 0).load(folder)
    assert back.count() == len(rows) and back.rdd.getNumPartitions() == 15
    assert spark.read.format("exr").load(folder).rdd.getNumPartitions() == 1  # small files share a task
    some = spark.read.format("exr").option("min_y", 7).option("max_y", 8).option("channels", "G").option("whole_bytes", 0).load(folder)
    assert some.count() == 3 * 2 * 5 and some.rdd.getNumPartitions() == 3
    assert spark.read.format("exr").option("mode", "header").load(folder).count() == 3
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("exr").option("blocks_per_task", 4).option("whole_bytes", 0).option("pushdown", "true").load(folder).where("y >= 16 and channel = 'R'")
        assert pushed.count() == 3 * 4 * 5 and pushed.rdd.getNumPartitions() == 3
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_sink(spark, tmp_path):
    """Files appear as a whole or not at all; overwriting replaces what was there."""
    folder, at = f"file://{tmp_path}/out", tmp_path / "out"
    frames.register(spark)
    files = spark.createDataFrame([(f"im{i}", bytes([i])) for i in range(6)], "file_id string, content binary").repartition(3)
    files.write.format("exr").mode("append").save(folder)
    assert sorted(p.name for p in at.iterdir()) == [f"im{i}.exr" for i in range(6)]
    assert (at / "im4.exr").read_bytes() == b"\x04"
    broken = files.selectExpr("file_id", "if(file_id = 'im5', raise_error('broken'), unhex('ff')) content")
    twice = files.selectExpr("'im1' file_id", "content")
    for bad in (broken, twice):
        with pytest.raises(Exception, match="broken|twice"):
            bad.write.format("exr").mode("append").save(folder)
        assert sorted(p.name for p in at.iterdir()) == [f"im{i}.exr" for i in range(6)] and (at / "im1.exr").read_bytes() == b"\x01"
    files.where("file_id <= 'im1'").write.format("exr").mode("overwrite").save(folder)
    assert sorted(p.name for p in at.iterdir()) == ["im0.exr", "im1.exr"]
    with pytest.raises(Exception, match="file_id and content"):
        files.select("content").write.format("exr").mode("append").save(folder)


def test_one_tile_of_one_level(spark, tmp_path):
    rows = [("im", ly, y, x, float(100 * ly + 10 * y + x)) for ly in range(4) for y in range(max(1, 8 >> ly)) for x in range(max(1, 8 >> ly))]
    df = spark.createDataFrame(rows, "file_id string, level_y int, y int, x int, value double").selectExpr("file_id", "level_y as level_x", "level_y", "y", "x", "'Z' channel", "value")
    folder = f"file://{tmp_path}/images"
    frames.write_images(frames.encode_images(df, "ZIP", tiles=(4, 4), levels="MIP"), folder)
    one = spark.read.format("exr").option("level_x", 0).option("tile_x", 1).option("tile_y", 0).load(folder)
    assert sorted((r.y, r.x, r.value) for r in one.collect()) == [(y, x, 10.0 * y + x) for y in range(4) for x in range(4, 8)]
    assert sorted(r.value for r in spark.read.format("exr").option("level_y", 2).load(folder).collect()) == [200, 201, 210, 211]
    with pytest.raises(Exception, match="outside level"):
        frames.encode_images(df.withColumn("x", F.col("x") + F.col("level_x") * 9), tiles=(4, 4), levels="MIP").collect()
    with pytest.raises(ValueError, match="levels"):
        frames.encode_images(df, levels="RIP")


def test_run_lengths_round_trip():
    from rasterloom.sources import codecs

    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 127, 128, 129, 130, 131, 255, 256, 257, 258, 5000):
        for values in (1, 2, 3, 256):
            for longest in (1, 4, 400):
                data = np.repeat(rng.integers(0, values, n), rng.integers(1, longest + 1, n))[:n].astype(np.uint8)
                packed = codecs.rle_encode(data)
                assert codecs.rle_decode(packed, n) == data.tobytes()
                if n:
                    with pytest.raises(codecs.Corrupt):
                        codecs.rle_decode(packed, n + 1)
                    with pytest.raises(codecs.Corrupt):
                        codecs.rle_decode(packed[:-1], n)


def test_permissive_mode(spark, tmp_path):
    (tmp_path / "bad.exr").write_bytes(b"nothing")
    assert frames.read_images(spark, f"file://{tmp_path}", "header", fail_fast=False).first().status == "Corrupt"
    assert frames.read_images(spark, f"file://{tmp_path}", fail_fast=False).count() == 0
    with pytest.raises(Exception, match="ends early|not an image"):
        frames.read_images(spark, f"file://{tmp_path}").collect()


@pytest.mark.parametrize("top", [3, 255, (1 << 14) - 1, 1 << 14, 65535])
@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (2, 2), (5, 3), (16, 16), (33, 17), (32, 100)])
def test_wavelet_round_trip(top, shape):
    from rasterloom.sources import piz

    plane = np.random.default_rng(top).integers(0, top + 1, shape)
    assert (piz.unwavelet(piz.wavelet(plane, top), top) == plane).all()


@pytest.mark.parametrize("symbols", [[0], [7], [1, 1, 1], [5] * 700, [1, 2, 3] * 50 + [9] * 300 + [65535], list(range(3000)), [0] * 99_999 + [1], [x for k in range(20) for x in [k * 321] * 2**k if k < 14]])
def test_huffman_round_trip(symbols):
    from rasterloom.sources import piz

    s = np.array(symbols, np.uint16)
    data = piz.huffman(s)
    assert (piz.unhuffman(data, len(s)) == s).all()
    for bad in (data[:10], data[:-1]):
        with pytest.raises(piz.BadData):
            piz.unhuffman(bad, len(s))


def test_huffman_long_codes():
    from rasterloom.sources import piz

    s = np.repeat(np.arange(18), [2**k for k in range(18)])  # code lengths up to 18
    np.random.default_rng(0).shuffle(s)
    assert (piz.unhuffman(piz.huffman(s.astype(np.uint16)), len(s)) == s).all()
