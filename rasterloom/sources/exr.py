"""The image file format: headers, chunk tables, flat and deep blocks, and a writer.

Works on anything with ``read_at(n, offset)`` and ``size()``; a header or a block is read without
the rest of the file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from rasterloom.sources import codecs
from rasterloom.sources.codecs import Corrupt, Unsupported

# The file signature, version and flag bits, and enumerations of the format.
MAGIC = 20000630
TILED, LONG_NAMES, NON_IMAGE, MULTIPART = 1 << 9, 1 << 10, 1 << 11, 1 << 12
LINE_ORDERS = ("INCREASING_Y", "DECREASING_Y", "RANDOM_Y")
LEVEL_MODES = ("ONE", "MIP", "RIP")
ROUNDINGS = ("DOWN", "UP")
PART_TYPES = ("scanlineimage", "tiledimage", "deepscanline", "deeptile")
LINES = {"NONE": 1, "RLE": 1, "ZIPS": 1, "ZIP": 16, "PXR24": 16, "PIZ": 32, "B44": 32, "B44A": 32, "DWAA": 32, "HTJ2K32": 32, "ZSTD": 32, "DWAB": 256, "HTJ2K256": 256}
REQUIRED = ("channels", "compression", "dataWindow", "displayWindow", "lineOrder", "pixelAspectRatio", "screenWindowCenter", "screenWindowWidth")

Box = tuple[int, int, int, int]  # min_x, min_y, max_x, max_y; inclusive
Channel = tuple[str, str, int, int, bool]  # name, pixel type, x and y sampling, perceptually linear


@dataclass(frozen=True)
class Limits:
    """Ceilings that fail a file instead of truncating it."""

    parts: int = 1024
    channels: int = 4096
    attribute_bytes: int = 16 << 20
    blocks: int = 8 << 20
    dimension: int = 1 << 20
    block_bytes: int = 256 << 20


class Bytes:
    """A file in memory."""

    def __init__(self, data: bytes):
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def read_at(self, n: int, offset: int) -> bytes:
        return self.data[offset : offset + n]


@dataclass(frozen=True)
class Block:
    index: int
    level_x: int
    level_y: int
    tile_x: int
    tile_y: int
    box: Box


@dataclass
class Part:
    index: int = 0
    name: str = ""
    kind: str = "scanlineimage"
    compression: str = "ZIP"
    line_order: str = "INCREASING_Y"
    window: Box = (0, 0, 0, 0)
    display: Box = (0, 0, 0, 0)
    aspect: float = 1.0
    center: tuple[float, float] = (0.0, 0.0)
    width: float = 1.0
    tiles: tuple[int, int, str, str] | None = None  # x, y, level mode, rounding
    channels: list[Channel] = field(default_factory=list)
    attributes: list[tuple[str, str, bytes]] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)

    @property
    def tiled(self) -> bool:
        return self.kind in ("tiledimage", "deeptile")

    @property
    def deep(self) -> bool:
        return self.kind.startswith("deep")

    @property
    def plain(self) -> bool:
        """No channel is subsampled."""
        return all(c[2] == c[3] == 1 for c in self.channels)

    def blocks(self) -> list[Block]:
        x0, y0, x1, y1 = self.window
        if not self.tiled:
            n = LINES[self.compression]
            return [Block(k, 0, 0, 0, k, (x0, y, x1, min(y + n - 1, y1))) for k, y in enumerate(range(y0, y1 + 1, n))]
        tw, th, mode, rounding = self.tiles
        w, h = x1 - x0 + 1, y1 - y0 + 1
        nx, ny = level_count(w, rounding), level_count(h, rounding)
        pairs = {"ONE": [(0, 0)], "MIP": [(k, k) for k in range(max(nx, ny))], "RIP": [(a, b) for b in range(ny) for a in range(nx)]}[mode]
        out = []
        for lx, ly in pairs:
            lw, lh = level_size(w, lx, rounding), level_size(h, ly, rounding)
            for ty in range(-(-lh // th)):
                for tx in range(-(-lw // tw)):
                    a, b = x0 + tx * tw, y0 + ty * th
                    out.append(Block(len(out), lx, ly, tx, ty, (a, b, a + min(tw, lw - tx * tw) - 1, b + min(th, lh - ty * th) - 1)))
        return out

    def rows(self, block: Block) -> list[codecs.Row]:
        return codecs.layout(self.channels, block.box)


def level_size(size: int, level: int, rounding: str) -> int:
    return max(1, -(-size // (1 << level)) if rounding == "UP" else size >> level)


def level_count(size: int, rounding: str) -> int:
    k = 0
    while level_size(size, k, rounding) > 1:
        k += 1
    return k + 1


@dataclass
class File:
    version: int
    parts: list[Part]

    @property
    def multipart(self) -> bool:
        return bool(self.version & MULTIPART)


class _Cursor:
    """Sequential reads over ``read_at``, a chunk at a time."""

    def __init__(self, source, chunk: int = 1 << 16):
        self.source, self.at, self.chunk, self.base, self.held = source, 0, chunk, 0, b""

    def take(self, n: int) -> bytes:
        a = self.at - self.base
        if a < 0 or a + n > len(self.held):
            self.base, a = self.at, 0
            self.held = self.source.read_at(max(n, self.chunk), self.at)
        out = self.held[a : a + n]
        if len(out) != n:
            raise Corrupt("the file ends early")
        self.at += n
        return out

    def text(self, most: int) -> str:
        out = bytearray()
        while (c := self.take(1)) != b"\0":
            out += c
            if len(out) > most:
                raise Corrupt("a name is too long")
        try:
            return out.decode()
        except UnicodeDecodeError as e:
            raise Corrupt("a name isn't UTF-8") from e

    def unpack(self, form: str) -> tuple:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))


def interpret_version(word: int) -> int:
    if word & 0xFF != 2 or word & ~(0xFF | TILED | LONG_NAMES | NON_IMAGE | MULTIPART):
        raise Unsupported(f"version field {word:#x}")
    if word & TILED and word & MULTIPART:
        raise Corrupt("both the tiled and the multipart flag")
    return word


def _pick(table: tuple[str, ...], code: int) -> str:
    if code >= len(table):
        raise Corrupt(f"code {code} of {table[0]}...")
    return table[code]


def _channels(data: bytes, limits: Limits) -> list[Channel]:
    cursor, out = _Cursor(Bytes(data)), []
    while name := cursor.text(255):
        kind, linear, xs, ys = cursor.unpack("iB3xii")
        if kind < 0 or xs < 1 or ys < 1:
            raise Corrupt(f"channel {name}")
        out.append((name, _pick(codecs.PIXEL_TYPES, kind), xs, ys, bool(linear)))
        if len(out) > limits.channels:
            raise Unsupported("too many channels")
    out.sort(key=lambda c: c[0].encode())
    if not out or len({c[0] for c in out}) != len(out):
        raise Corrupt("no channels, or one twice")
    return out


def _part(raw: dict[str, tuple[str, bytes]], index: int, version: int, limits: Limits) -> Part:
    missing = [n for n in REQUIRED if n not in raw]
    if missing:
        raise Corrupt(f"missing attributes {missing}")

    def get(name: str, form: str) -> tuple:
        data = raw[name][1]
        if len(data) != struct.calcsize("<" + form):
            raise Corrupt(f"attribute {name} has another size")
        return struct.unpack("<" + form, data)

    p = Part(index=index, channels=_channels(raw["channels"][1], limits))
    p.compression = _pick(codecs.COMPRESSIONS, get("compression", "B")[0])
    p.line_order = _pick(LINE_ORDERS, get("lineOrder", "B")[0])
    p.window, p.display = get("dataWindow", "4i"), get("displayWindow", "4i")
    (p.aspect,), p.center, (p.width,) = get("pixelAspectRatio", "f"), get("screenWindowCenter", "2f"), get("screenWindowWidth", "f")
    w, h = p.window[2] - p.window[0] + 1, p.window[3] - p.window[1] + 1
    if w < 1 or h < 1 or max(w, h) > limits.dimension:
        raise Corrupt("data window")
    p.kind = raw["type"][1].decode() if "type" in raw else ("tiledimage" if version & TILED else "scanlineimage")
    if p.kind not in PART_TYPES:
        raise Unsupported(f"part type {p.kind}")
    p.name = raw["name"][1].decode() if "name" in raw else ""
    if p.tiled:
        if "tiles" not in raw:
            raise Corrupt("missing attribute tiles")
        tx, ty, mode = get("tiles", "IIB")
        if not tx or not ty:
            raise Corrupt("tile size")
        p.tiles = (tx, ty, _pick(LEVEL_MODES, mode & 15), _pick(ROUNDINGS, mode >> 4))
    p.attributes = [(n, t, d) for n, (t, d) in raw.items()]
    return p


def parse(source, limits: Limits = Limits()) -> File:
    """Headers and chunk tables; no block is read."""
    cursor = _Cursor(source)
    magic, word = cursor.unpack("iI")
    if magic != MAGIC:
        raise Corrupt("not an image file")
    version = interpret_version(word)
    most = 255 if version & LONG_NAMES else 31
    parts = []
    while True:
        raw: dict[str, tuple[str, bytes]] = {}
        while name := cursor.text(most):
            kind, (size,) = cursor.text(most), cursor.unpack("i")
            if not 0 <= size <= limits.attribute_bytes or name in raw:
                raise Corrupt(f"attribute {name}")
            raw[name] = (kind, cursor.take(size))
        if not raw:
            break
        parts.append(_part(raw, len(parts), version, limits))
        if len(parts) > limits.parts:
            raise Unsupported("too many parts")
        if not version & MULTIPART:
            break
    if not parts:
        raise Corrupt("no parts")
    for p in parts:
        n = len(p.blocks())
        if n > limits.blocks:
            raise Unsupported("too many blocks")
        p.offsets = list(cursor.unpack(f"{n}Q"))
    file = File(version, parts)
    if any(o == 0 for p in parts for o in p.offsets):
        _reconstruct(source, file, cursor.at)
    return file


def _chunk_head(file: File, part: Part) -> str:
    return ("i" if file.multipart else "") + ("4i" if part.tiled else "i") + ("3Q" if part.deep else "i")


def _reconstruct(source, file: File, at: int) -> None:
    """Fill missing offsets by walking the chunks in the order of the file."""
    where = [{(b.tile_x, b.tile_y, b.level_x, b.level_y) if p.tiled else b.box[1]: b.index for b in p.blocks()} for p in file.parts]
    size = source.size()
    while at < size:
        try:
            k = struct.unpack("<i", source.read_at(4, at))[0] if file.multipart else 0
            part = file.parts[k]
            form = "<" + _chunk_head(file, part)
            head = struct.unpack(form, source.read_at(struct.calcsize(form), at))[1 if file.multipart else 0 :]
            key = tuple(head[:4]) if part.tiled else head[0]
            index = where[k][key]
        except (struct.error, IndexError, KeyError):
            return
        part.offsets[index] = part.offsets[index] or at
        body = sum(head[-3:-1]) if part.deep else head[-1]
        at += struct.calcsize(form) + body


def _head(source, file: File, part: Part, block: Block) -> tuple[tuple, int]:
    at = part.offsets[block.index]
    if at == 0:
        raise Corrupt(f"block {block.index} is missing")
    form = "<" + _chunk_head(file, part)
    data = source.read_at(struct.calcsize(form), at)
    if len(data) != struct.calcsize(form):
        raise Corrupt("a chunk head is cut off")
    head = struct.unpack(form, data)
    if file.multipart and head[0] != part.index:
        raise Corrupt("a chunk of another part")
    head = head[1:] if file.multipart else head
    if (tuple(head[:4]) != (block.tile_x, block.tile_y, block.level_x, block.level_y)) if part.tiled else head[0] != block.box[1]:
        raise Corrupt("a chunk of another block")
    return head, at + len(data)


def read_block(source, file: File, part: Part, block: Block, limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """Samples per channel: an array (sampled lines, sampled columns)."""
    head, at = _head(source, file, part, block)
    rows = part.rows(block)
    size = codecs.canonical_size(rows)
    if size > limits.block_bytes or not 0 <= head[-1] <= limits.block_bytes:
        raise Unsupported("a block is too large")
    payload = source.read_at(head[-1], at)
    if len(payload) != head[-1]:
        raise Corrupt("a payload is cut off")
    data = codecs.decode(part.compression, payload, size, rows)
    if part.plain:  # every line has every channel: planes are columns of one array
        h = block.box[3] - block.box[1] + 1
        lines, place, planes = np.frombuffer(data, np.uint8).reshape(h, -1), 0, {}
        for name, kind, *_ in part.channels:
            width = codecs.SIZES[kind] * (block.box[2] - block.box[0] + 1)
            planes[name] = np.ascontiguousarray(lines[:, place : place + width]).view(codecs.DTYPES[kind])
            place += width
        return planes
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(part.channels[r.channel][0], []).append(np.frombuffer(data, codecs.DTYPES[r.kind], r.width, r.start))
    return {n: np.stack(v) for n, v in out.items()}


def read_deep_block(source, file: File, part: Part, block: Block) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Counts (lines, columns) and each channel's samples, in the order of lines and columns."""
    head, at = _head(source, file, part, block)
    packed_counts, packed, plain = head[-3:]
    x0, y0, x1, y1 = block.box
    w, h = x1 - x0 + 1, y1 - y0 + 1
    table = codecs.decode(part.compression, source.read_at(packed_counts, at), 4 * w * h)
    running = np.frombuffer(table, "<i4").reshape(h, w).astype(np.int64)
    counts = np.diff(running, axis=1, prepend=0)
    if (counts < 0).any():
        raise Corrupt("cumulative counts decrease")
    data = codecs.decode(part.compression, source.read_at(packed, at + packed_counts), plain)
    if plain != counts.sum() * sum(codecs.SIZES[c[1]] for c in part.channels):
        raise Corrupt("the deep samples have another size")
    out, place = {c[0]: [] for c in part.channels}, 0
    for line in counts.sum(axis=1):
        for name, kind, *_ in part.channels:
            out[name].append(np.frombuffer(data, codecs.DTYPES[kind], int(line), place))
            place += int(line) * codecs.SIZES[kind]
    return counts, {n: np.concatenate(v) for n, v in out.items()}


def samples(source, file: File, part: Part, block: Block) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(channel, y, x, values) of a flat block, flattened."""
    for name, plane in read_block(source, file, part, block).items():
        _, _, xs, ys, _ = next(c for c in part.channels if c[0] == name)
        x0, y0, x1, y1 = block.box
        gx, gy = np.arange(x0 + -x0 % xs, x1 + 1, xs), np.arange(y0 + -y0 % ys, y1 + 1, ys)
        yield name, np.repeat(gy, len(gx)), np.tile(gx, len(gy)), plane.reshape(-1)


def header_bytes(part: Part, multipart: bool, chunks: int) -> bytes:
    def attribute(name: str, kind: str, data: bytes) -> bytes:
        return name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(data)) + data

    listed = b"".join(n.encode() + b"\0" + struct.pack("<iB3xii", codecs.PIXEL_TYPES.index(k), linear, xs, ys) for n, k, xs, ys, linear in part.channels) + b"\0"
    out = [
        attribute("channels", "chlist", listed),
        attribute("compression", "compression", bytes([codecs.COMPRESSIONS.index(part.compression)])),
        attribute("dataWindow", "box2i", struct.pack("<4i", *part.window)),
        attribute("displayWindow", "box2i", struct.pack("<4i", *part.display)),
        attribute("lineOrder", "lineOrder", bytes([LINE_ORDERS.index(part.line_order)])),
        attribute("pixelAspectRatio", "float", struct.pack("<f", part.aspect)),
        attribute("screenWindowCenter", "v2f", struct.pack("<2f", *part.center)),
        attribute("screenWindowWidth", "float", struct.pack("<f", part.width)),
    ]
    if part.tiles:
        x, y, mode, rounding = part.tiles
        out.append(attribute("tiles", "tiledesc", struct.pack("<IIB", x, y, LEVEL_MODES.index(mode) | ROUNDINGS.index(rounding) << 4)))
    if multipart or part.deep:
        out += [attribute("name", "string", part.name.encode()), attribute("type", "string", part.kind.encode()), attribute("chunkCount", "int", struct.pack("<i", chunks))]
    if part.deep:
        out.append(attribute("version", "int", struct.pack("<i", 1)))
    known = {*REQUIRED, "tiles", "name", "type", "chunkCount", "version"}
    out += [attribute(n, t, d) for n, t, d in part.attributes if n not in known]
    return b"".join(out) + b"\0"


def encode_block(part: Part, block: Block, planes: dict[str, np.ndarray]) -> bytes:
    """A flat block's chunk without the part number: planes as ``read_block`` gives them."""
    rows = part.rows(block)
    place = struct.pack("<4i", block.tile_x, block.tile_y, block.level_x, block.level_y) if part.tiled else struct.pack("<i", block.box[1])
    if part.plain and set(planes) == {c[0] for c in part.channels}:
        shape = (block.box[3] - block.box[1] + 1, block.box[2] - block.box[0] + 1)
        if any(np.shape(p) != shape for p in planes.values()):
            raise ValueError("InvalidArgument: a plane has another size")
        lines = [np.ascontiguousarray(planes[n], codecs.DTYPES[k]).view(np.uint8) for n, k, *_ in part.channels]
        payload = codecs.encode(part.compression, np.concatenate(lines, axis=1).tobytes(), rows)
        return place + struct.pack("<i", len(payload)) + payload
    at, parts = dict.fromkeys(planes, 0), []
    needed = {part.channels[r.channel][0] for r in rows}  # a subsampled channel may have no line here
    if not needed <= set(planes) <= {c[0] for c in part.channels}:
        raise ValueError("InvalidArgument: planes and channels differ")
    for r in rows:
        name = part.channels[r.channel][0]
        line = np.asarray(planes[name][at[name]]).astype(codecs.DTYPES[r.kind])
        if len(line) != r.width:
            raise ValueError("InvalidArgument: a plane has another width")
        parts.append(line.tobytes())
        at[name] += 1
    payload = codecs.encode(part.compression, b"".join(parts), rows)
    return place + struct.pack("<i", len(payload)) + payload


def encode_deep_block(part: Part, block: Block, counts: np.ndarray, values: dict[str, np.ndarray]) -> bytes:
    starts = np.concatenate([[0], np.cumsum(counts.sum(axis=1))])
    data = b"".join(np.asarray(values[n][starts[i] : starts[i + 1]]).astype(codecs.DTYPES[k]).tobytes() for i in range(len(counts)) for n, k, *_ in part.channels)
    table = codecs.encode(part.compression, np.cumsum(counts, axis=1).astype("<i4").tobytes())
    payload = codecs.encode(part.compression, data)
    place = struct.pack("<4i", block.tile_x, block.tile_y, block.level_x, block.level_y) if part.tiled else struct.pack("<i", block.box[1])
    return place + struct.pack("<3Q", len(table), len(payload), len(data)) + table + payload


def assemble(parts: list[Part], chunks: list[dict[int, bytes]], force_multipart: bool = False) -> bytes:
    """A file of parts and their chunks by block index; every block is needed exactly once."""
    names = [p.name for p in parts]
    multipart = force_multipart or len(parts) > 1
    if multipart and len(set(names)) != len(names):
        raise ValueError("InvalidArgument: part names must differ")
    for p, own in zip(parts, chunks, strict=True):
        p.channels = sorted(p.channels, key=lambda c: c[0].encode())
        if set(own) != set(range(len(p.blocks()))):
            raise ValueError("InvalidArgument: blocks are missing or unknown")
    long = any(len(n.encode()) > 31 for p in parts for n in [*(c[0] for c in p.channels), *(a[0] for a in p.attributes)])
    deep = any(p.deep for p in parts)
    word = 2 | (LONG_NAMES if long else 0) | (NON_IMAGE if deep else 0) | (MULTIPART if multipart else 0)
    if not multipart and not deep and parts[0].tiled:
        word |= TILED
    head = struct.pack("<iI", MAGIC, word) + b"".join(header_bytes(p, multipart, len(c)) for p, c in zip(parts, chunks, strict=True)) + (b"\0" if multipart else b"")
    at = len(head) + 8 * sum(map(len, chunks))
    tables, body = [], []
    for k, own in enumerate(chunks):
        blocks, order, offsets = parts[k].blocks(), range(len(own)), [0] * len(own)
        if parts[k].line_order == "DECREASING_Y":  # the table goes by block all the same
            order = sorted(order, key=lambda i, b=blocks: (b[i].level_y, b[i].level_x, -b[i].box[1], b[i].tile_x))
        for i in order:
            data = (struct.pack("<i", k) if multipart else b"") + own[i]
            offsets[i] = at
            body.append(data)
            at += len(data)
        tables += offsets
    return head + struct.pack(f"<{len(tables)}Q", *tables) + b"".join(body)
