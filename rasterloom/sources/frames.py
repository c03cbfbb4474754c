"""Image files as DataFrames: readers over any file system, a data source, and a writer.

``read_images`` reads whole files through Spark's ``binaryFile`` (every store Spark knows);
``ExrDataSource`` (format "exr") plans ranges of blocks as partitions, so one large file is read by
many tasks, and skips parts, levels and lines that options or pushed filters exclude.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from rasterloom.shipping import ship
from rasterloom.sources import exr

SAMPLE = "file_id string, part_index int, level_x int, level_y int, y int, x int, channel string, value double"
PART = "file_id string, part_index int, name string, part_type string, compression string, line_order string, min_x int, min_y int, max_x int, max_y int, tile_x long, tile_y long, level_mode string, rounding string, channels array<struct<name:string,pixel_type:string,x_sampling:int,y_sampling:int,plinear:boolean>>, attributes array<struct<name:string,type_name:string,data:binary>>, chunk_count int, status string"
BLOCK = "file_id string, part_index int, block_index int, is_tiled boolean, is_deep boolean, level_x int, level_y int, tile_x int, tile_y int, min_x int, min_y int, max_x int, max_y int, file_offset long, is_missing boolean"
DEEP = "file_id string, part_index int, level_x int, level_y int, y int, x int, cnt long, channel string, samples array<double>"
SCHEMAS = {"samples": SAMPLE, "header": PART, "blocks": BLOCK, "deep": DEEP}
_NAMES = {k: [x.split()[0] for x in v.replace("array<struct<", "").split(", ")] for k, v in SCHEMAS.items() if k in ("samples", "blocks", "deep")}


def _samples(file_id: str, part: exr.Part, block: exr.Block, source, file: exr.File, channels: set[str] | None, low: int, high: int) -> Iterator[pa.RecordBatch]:
    for name, y, x, value in exr.samples(source, file, part, block):
        if channels is not None and name not in channels:
            continue
        keep = (y >= low) & (y <= high)
        n = int(keep.sum())
        if n:
            same = [pa.repeat(pa.scalar(file_id), n), *(pa.repeat(pa.scalar(v, pa.int32()), n) for v in (part.index, block.level_x, block.level_y))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(y[keep].astype(np.int32)), pa.array(x[keep].astype(np.int32)), pa.repeat(pa.scalar(name), n), pa.array(value[keep].astype(np.float64))], _NAMES["samples"])


def _deep(file_id: str, part: exr.Part, block: exr.Block, source, file: exr.File) -> Iterator[pa.RecordBatch]:
    counts, values = exr.read_deep_block(source, file, part, block)
    x0, y0, *_ = block.box
    h, w = counts.shape
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts.reshape(-1))]).astype(np.int32))
    n = h * w
    for name, v in values.items():
        same = [pa.repeat(pa.scalar(file_id), n), *(pa.repeat(pa.scalar(k, pa.int32()), n) for k in (part.index, block.level_x, block.level_y))]
        yield pa.RecordBatch.from_arrays([*same, pa.array(np.repeat(np.arange(y0, y0 + h, dtype=np.int32), w)), pa.array(np.tile(np.arange(x0, x0 + w, dtype=np.int32), h)), pa.array(counts.reshape(-1)), pa.repeat(pa.scalar(name), n), pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.float64)))], _NAMES["deep"])


def _header_row(file_id: str, p: exr.Part) -> tuple:
    tiles = p.tiles or (None,) * 4
    return (file_id, p.index, p.name, p.kind, p.compression, p.line_order, *p.window, *tiles, [dict(zip(("name", "pixel_type", "x_sampling", "y_sampling", "plinear"), c, strict=True)) for c in p.channels], [{"name": n, "type_name": t, "data": d} for n, t, d in p.attributes], len(p.offsets), "Success")


def _block_rows(file_id: str, p: exr.Part) -> list[tuple]:
    return [(file_id, p.index, b.index, p.tiled, p.deep, b.level_x, b.level_y, b.tile_x, b.tile_y, *b.box, p.offsets[b.index], p.offsets[b.index] == 0) for b in p.blocks()]


def _rows(mode: str, file_id: str, source) -> Iterator[pa.RecordBatch]:
    file = exr.parse(source)
    schema = _arrow(SCHEMAS[mode])
    for p in file.parts:
        if mode == "header":
            yield _batch([_header_row(file_id, p)], schema)
        elif mode == "blocks":
            yield _batch(_block_rows(file_id, p), schema)
        else:
            for b in p.blocks():
                if mode == "deep" and p.deep:
                    yield from _deep(file_id, p, b, source, file)
                elif mode == "samples" and not p.deep:
                    yield from _samples(file_id, p, b, source, file, None, -(1 << 31), 1 << 31)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_parsed(ddl))


def _parsed(ddl: str):
    from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

    kinds = {"string": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType(), "binary": BinaryType()}

    def one(t: str):
        if t in kinds:
            return kinds[t]
        inner = t[6:-1]
        if inner.startswith("struct<"):
            return ArrayType(StructType([StructField(n, kinds[k]) for n, k in (f.split(":") for f in inner[7:-1].split(","))]))
        return ArrayType(kinds[inner])

    return StructType([StructField(*(lambda n, t: (n, one(t)))(*c.split(" ", 1))) for c in ddl.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def decode_images(files: DataFrame, mode: str = "samples", fail_fast: bool = True) -> DataFrame:
    """Rows of images given as (path, content).

    A damaged or unsupported file raises, or (``fail_fast`` off) gives no rows but, in header
    mode, one whose status names the error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(SCHEMAS[mode])
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                file_id = path.as_py()
                try:
                    yield from _rows(mode, file_id, exr.Bytes(content.as_py()))
                except (exr.Corrupt, exr.Unsupported) as e:
                    if fail_fast:
                        raise
                    if mode == "header":
                        row = [None] * len(schema)
                        row[0], row[-1] = file_id, type(e).__name__
                        yield _batch([tuple(row)], schema)

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, SCHEMAS[mode])


def read_images(spark: SparkSession, path: str, mode: str = "samples", fail_fast: bool = True) -> DataFrame:
    """All images below ``path``: mode samples, header, blocks or deep."""
    return decode_images(spark.read.format("binaryFile").load(path), mode, fail_fast)


LEVELS = ("ONE", "MIP", "RIP")


def _plain_parts(table: pa.Table, compression: str, pixel_type: str, tiles, levels: str, rounding: str, line_order: str) -> tuple[list[exr.Part], list[dict[int, bytes]]]:
    """The flat parts of one image's samples, with their chunks."""
    part_of, lx, ly, y, x, value = (table.column(n).to_numpy() for n in ("part_index", "level_x", "level_y", "y", "x", "value"))
    channel, names = np.array(table.column("channel").to_pylist()), np.array(table.column("part_name").to_pylist())
    parts, chunks = [], []
    for k in np.unique(part_of):
        own = part_of == k
        base = own & (lx == 0) & (ly == 0)
        window = (int(x[base].min()), int(y[base].min()), int(x[base].max()), int(y[base].max()))
        part = exr.Part(index=len(parts), name=str(names[own][0]), kind="tiledimage" if tiles else "scanlineimage", compression=compression, line_order=line_order, window=window, display=window, tiles=(*tiles, levels, rounding) if tiles else None)
        part.channels = [(str(n), pixel_type, 1, 1, False) for n in sorted(set(channel[own].tolist()), key=str.encode)]
        w, h = window[2] - window[0] + 1, window[3] - window[1] + 1
        planes = {}
        for level in {(b.level_x, b.level_y) for b in part.blocks()}:
            shape = exr.level_size(h, level[1], rounding), exr.level_size(w, level[0], rounding)
            for n, *_ in part.channels:
                plane, at = np.zeros(shape), own & (lx == level[0]) & (ly == level[1]) & (channel == n)
                if at.any() and (y[at].max() - window[1] >= shape[0] or x[at].max() - window[0] >= shape[1]):
                    raise ValueError(f"InvalidArgument: a sample outside level {level}")
                plane[y[at] - window[1], x[at] - window[0]] = value[at]
                planes[level, n] = plane
        cut = lambda b, p, w=window: p[b.box[1] - w[1] : b.box[3] - w[1] + 1, b.box[0] - w[0] : b.box[2] - w[0] + 1]
        chunks.append({b.index: exr.encode_block(part, b, {n: cut(b, planes[(b.level_x, b.level_y), n]) for n, *_ in part.channels}) for b in part.blocks()})
        parts.append(part)
    return parts, chunks


def _with_defaults(samples: DataFrame, defaults: dict) -> DataFrame:
    """``samples`` with the columns that it lacks."""
    return samples.select("*", *(v.alias(n) for n, v in defaults.items() if n not in samples.columns))


def encode_images(samples: DataFrame, compression: str = "ZIP", pixel_type: str = "FLOAT", tiles: tuple[int, int] | None = None, levels: str = "ONE", rounding: str = "DOWN", line_order: str = "INCREASING_Y") -> DataFrame:
    """(file_id, content) of (file_id, y, x, channel, value): one image file each.

    Optional columns: part_index and part_name (several parts make a multipart file; names must
    differ), level_x and level_y (with ``tiles`` and ``levels`` MIP or RIP; samples of a level lie at
    the window's corner). An image's samples meet in one task, as its file must be written in one
    piece; images are spread. Pixels without a row are 0. ``line_order``: DECREASING_Y puts the last
    lines first in the file; RANDOM_Y is for tiles only.
    """
    if line_order not in exr.LINE_ORDERS or (line_order == "RANDOM_Y" and not tiles):
        raise ValueError("InvalidArgument: the line order is INCREASING_Y, DECREASING_Y, or with tiles RANDOM_Y")
    if levels not in LEVELS or (levels != "ONE" and not tiles):
        raise ValueError("InvalidArgument: levels are ONE, or with tiles MIP or RIP")

    def build(table: pa.Table) -> pa.Table:
        parts, chunks = _plain_parts(table, compression, pixel_type, tiles, levels, rounding, line_order)
        return pa.table({"file_id": [table.column("file_id")[0].as_py()], "content": pa.array([exr.assemble(parts, chunks)], pa.binary())})

    ship(samples.sparkSession)
    zero = F.lit(0)
    whole = _with_defaults(samples, {"part_index": zero, "part_name": F.lit(""), "level_x": zero, "level_y": zero})
    columns = [*(F.col(n).cast("int") for n in ("part_index", "level_x", "level_y")), "part_name", "y", "x", "channel", "value"]
    return whole.select("file_id", *columns).groupBy("file_id").applyInArrow(build, "file_id string, content binary")


def encode_deep(samples: DataFrame, compression: str = "ZIPS", pixel_type: str = "FLOAT") -> DataFrame:
    """(file_id, content) of deep samples (file_id, y, x, channel, samples): one deep scanline file each.

    ``samples`` is a pixel's list of values; the channels of a pixel need lists of one length.
    Pixels without a row have no samples.
    """

    def build(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        channel, lists = np.array(table.column("channel").to_pylist()), table.column("samples").to_pylist()
        window = (int(x.min()), int(y.min()), int(x.max()), int(y.max()))
        part = exr.Part(name="deep", kind="deepscanline", compression=compression, window=window, display=window)
        part.channels = [(str(n), pixel_type, 1, 1, False) for n in sorted(set(channel.tolist()), key=str.encode)]
        w, h = window[2] - window[0] + 1, window[3] - window[1] + 1
        counts, values = None, {}
        for n, *_ in part.channels:
            at = np.flatnonzero(channel == n)
            at = at[np.lexsort((x[at], y[at]))]
            own = np.zeros((h, w), np.int64)
            own[y[at] - window[1], x[at] - window[0]] = [len(lists[i]) for i in at]
            if counts is not None and (own != counts).any():
                raise ValueError("InvalidArgument: the channels of a pixel have different numbers of samples")
            counts, values[n] = own, [np.array([v for i in at[y[at] == line + window[1]] for v in lists[i]]) for line in range(h)]
        chunks = {}
        for b in part.blocks():
            low, high = b.box[1] - window[1], b.box[3] - window[1] + 1
            chunks[b.index] = exr.encode_deep_block(part, b, counts[low:high], {n: np.concatenate(v[low:high]) for n, v in values.items()})
        return pa.table({"file_id": [table.column("file_id")[0].as_py()], "content": pa.array([exr.assemble([part], [chunks])], pa.binary())})

    ship(samples.sparkSession)
    return samples.select("file_id", "y", "x", "channel", "samples").groupBy("file_id").applyInArrow(build, "file_id string, content binary")


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Write (file_id, content) as files of a folder; returns their paths.

    Through the ``exr`` sink: files appear under their final names once all of them are written.
    """
    register(images.sparkSession)
    images.select("file_id", "content").write.format("exr").mode("append").save(folder)
    return images.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.exr").load(folder).select("path")


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    """Whole files."""

    paths: list[str]


@dataclass
class Range(InputPartition):
    path: str
    part: int
    first: int
    last: int


class _Reader(DataSourceReader):
    """Options: part, channels ("R,G"), min_y, max_y, level_x, level_y, tile_x, tile_y, blocks_per_task,
    whole_bytes (up to this size files are not split, and go together to a task).
    """

    def __init__(self, options):
        self.path = options["path"]
        self.mode = options.get("mode", "samples")
        self.part = int(options["part"]) if "part" in options else None
        self.channels = set(options["channels"].split(",")) if "channels" in options else None
        self.low, self.high = int(options.get("min_y", -(1 << 31))), int(options.get("max_y", 1 << 31))
        self.levels = {k: int(options[k]) for k in ("level_x", "level_y", "tile_x", "tile_y") if k in options}
        self.step = int(options.get("blocks_per_task", 64))
        self.whole = int(options.get("whole_bytes", 32 << 20))

    def _files(self) -> list[tuple[str, int]]:
        """(path, size) of the image files below the path."""
        where, root = filesystem(self.path)
        info = where.get_file_info(root)
        if info.type == fs.FileType.File:
            return [(self.path, info.size)]
        base = self.path.rstrip("/")
        found = [(f.path[len(root.rstrip("/")) :], f.size) for f in where.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.base_name.endswith(".exr") and "/_staging-" not in f.path]
        return sorted((base + rest, size) for rest, size in found)

    def partitions(self) -> list[InputPartition]:
        """Small files go together to a task, unopened; large ones are split by blocks, their headers read side by side."""
        out: list[InputPartition] = []
        large, group, held = [], [], 0
        for path, size in self._files():
            if self.mode == "samples" and size > self.whole:
                large.append(path)
                continue
            if group and held + size > self.whole:
                out.append(Files(group))
                group, held = [], 0
            group.append(path)
            held += size
        if group:
            out.append(Files(group))
        with ThreadPoolExecutor(16) as pool:
            for ranges in pool.map(self._ranges, large):
                out += ranges
        return out

    def _ranges(self, path: str) -> list[InputPartition]:
        where, name = filesystem(path)
        out: list[InputPartition] = []
        with where.open_input_file(name) as source:
            for p in exr.parse(source).parts:
                if self._wants(p):
                    wanted = [b.index for b in p.blocks() if self._takes(b)]
                    out += [Range(path, p.index, wanted[k], wanted[min(k + self.step, len(wanted)) - 1]) for k in range(0, len(wanted), self.step)]
        return out

    def _wants(self, part: exr.Part) -> bool:
        return not part.deep and self.part in (None, part.index)

    def _takes(self, b: exr.Block) -> bool:
        return b.box[3] >= self.low and b.box[1] <= self.high and all(getattr(b, k) == v for k, v in self.levels.items())

    def read(self, r: InputPartition) -> Iterator[pa.RecordBatch]:
        for path in r.paths if isinstance(r, Files) else [r.path]:
            where, name = filesystem(path)
            with where.open_input_file(name) as source:
                if self.mode != "samples":
                    yield from _rows(self.mode, path, source)
                    continue
                file = exr.parse(source)
                for part in file.parts if isinstance(r, Files) else [file.parts[r.part]]:
                    if not self._wants(part):
                        continue
                    for b in part.blocks() if isinstance(r, Files) else part.blocks()[r.first : r.last + 1]:
                        if self._takes(b):
                            yield from _samples(path, part, b, source, file, self.channels, self.low, self.high)


class _PushdownReader(_Reader):
    """Takes filters on part, level, channel and line; Spark checks them again."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            match f:
                case EqualTo(("part_index",), v):
                    self.part = v
                case EqualTo((("level_x" | "level_y") as name,), v):
                    self.levels[name] = v
                case EqualTo(("channel",), v):
                    self.channels = {v} if self.channels is None else self.channels & {v}
                case In(("channel",), v):
                    self.channels = set(v) if self.channels is None else self.channels & set(v)
                case EqualTo(("y",), v):
                    self.low, self.high = max(self.low, v), min(self.high, v)
                case GreaterThan(("y",), v) | GreaterThanOrEqual(("y",), v):
                    self.low = max(self.low, v)
                case LessThan(("y",), v) | LessThanOrEqual(("y",), v):
                    self.high = min(self.high, v)
            yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Writes (file_id, content) rows as files.

    A task writes under fresh names in a staging folder; only what committed tasks report is
    moved to ``<file_id>.exr``, so that failed or repeated attempts leave nothing there. Overwriting
    removes the folder's other image files at that point. A file_id given twice is an error.
    """

    def __init__(self, options, schema, overwrite: bool):
        if schema.names != ["file_id", "content"]:
            raise ValueError("InvalidArgument: the columns file_id and content are needed; frames.encode_images makes them")
        self.folder, self.overwrite = options["path"].rstrip("/"), overwrite
        self.staging = f"{self.folder}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = filesystem(self.staging)
        where.create_dir(root, recursive=True)
        files = []
        for batch in iterator:
            for file_id, content in zip(batch.column(0), batch.column(1), strict=True):
                name = uuid.uuid4().hex
                with where.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(content.as_buffer())
                files.append((name, file_id.as_py()))
        return Written(files)

    def commit(self, messages) -> None:
        files = [f for m in messages if m for f in m.files]
        if len({f for _, f in files}) != len(files):
            self.abort(messages)
            raise ValueError("InvalidArgument: a file_id is given twice")
        where, root = filesystem(self.folder)
        where.create_dir(root, recursive=True)
        _, staged = filesystem(self.staging)
        for name, file_id in files:
            where.move(f"{staged}/{name}", f"{root}/{file_id}.exr")
        if self.overwrite:
            new = {f"{f}.exr" for _, f in files}
            for old in where.get_file_info(fs.FileSelector(root)):
                if old.base_name.endswith(".exr") and old.base_name not in new:
                    where.delete_file(old.path)
        self.abort(messages)

    def abort(self, messages) -> None:
        where, staged = filesystem(self.staging)
        if where.get_file_info(staged).type == fs.FileType.Directory:
            where.delete_dir(staged)


class ExrDataSource(DataSource):
    """``spark.read.format("exr")`` and ``df.write.format("exr")``: register with ``register(spark)``.

    With ``option("pushdown", "true")``, and spark.sql.python.filterPushdown.enabled on, filters
    choose the blocks that are read.
    """

    @classmethod
    def name(cls) -> str:
        return "exr"

    def schema(self):
        return SCHEMAS[self.options.get("mode", "samples")]

    def reader(self, schema):
        # Spark refuses a reader with pushFilters unless spark.sql.python.filterPushdown.enabled is on
        return (_PushdownReader if self.options.get("pushdown", "").lower() == "true" else _Reader)(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ExrDataSource)


def is_image(content):
    """The signature test as a Column."""
    return F.hex(F.substring(content, 1, 4)) == "762F3101"
