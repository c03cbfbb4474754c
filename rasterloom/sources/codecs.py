"""Block codecs: canonical bytes (line by line, channel by channel) to payloads and back.

NONE, RLE, ZIPS, ZIP, ZSTD, PIZ, PXR24, B44 and B44A work both ways. DWAA, DWAB and HTJ2K blocks
raise ``Unsupported`` (unless a writer stored them raw).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import zstandard

from rasterloom.sources import piz

# Compression codes of the format.
COMPRESSIONS = ("NONE", "RLE", "ZIPS", "ZIP", "PIZ", "PXR24", "B44", "B44A", "DWAA", "DWAB", "HTJ2K256", "HTJ2K32", "ZSTD")
PIXEL_TYPES = ("UINT", "HALF", "FLOAT")
SIZES = {"UINT": 4, "HALF": 2, "FLOAT": 4}
DTYPES = {"UINT": np.dtype("<u4"), "HALF": np.dtype("<f2"), "FLOAT": np.dtype("<f4")}


#: Deflate level: the format's libraries use a fast one, as the predictor does most of the work.
LEVEL = 4


class Unsupported(ValueError):
    pass


class Corrupt(ValueError):
    pass


@dataclass(frozen=True)
class Row:
    """One channel's samples in one line: where they are in the canonical bytes."""

    channel: int
    kind: str
    width: int
    start: int


def layout(channels: list[tuple[str, str, int, int, bool]], box: tuple[int, int, int, int]) -> list[Row]:
    """Rows of a block; channels (name, kind, xs, ys, linear) in canonical order, box inclusive."""
    x0, y0, x1, y1 = box
    rows, at = [], 0
    for y in range(y0, y1 + 1):
        for i, (_, kind, xs, ys, _) in enumerate(channels):
            if y % ys == 0 and (n := x1 // xs - (x0 - 1) // xs):
                rows.append(Row(i, kind, n, at))
                at += n * SIZES[kind]
    return rows


def canonical_size(rows: list[Row]) -> int:
    return rows[-1].start + rows[-1].width * SIZES[rows[-1].kind] if rows else 0


def predict(data: bytes) -> np.ndarray:
    """Even bytes, then odd ones, as biased differences."""
    b = np.frombuffer(data, np.uint8)
    t = np.concatenate([b[0::2], b[1::2]])
    out = t.copy()
    out[1:] = t[1:] - t[:-1] + np.uint8(128)
    return out


_LANES, _LOW = np.uint64(0x0001000100010001), np.uint64(0x00FF00FF00FF00FF)
_SHIFT, _TOP = np.uint64(8), np.uint64(48)


def byte_sums(d: np.ndarray) -> np.ndarray:
    """Prefix sums of bytes modulo 256, eight bytes at a time.

    Odd and even bytes of a word are lanes of 16 bits, so sums of its eight bytes don't run over; only
    one total a word is summed one after another.
    """
    words = np.zeros(-(-len(d) // 8), "<u8")
    words.view(np.uint8)[: len(d)] = d
    odd = words >> _SHIFT & _LOW
    sums = ((words & _LOW) + odd) * _LANES  # of pairs, up to each lane
    total = (sums >> _TOP).astype(np.uint8)
    sums += (np.cumsum(total, dtype=np.uint8) - total).astype(np.uint64) * _LANES
    even = sums - odd & _LOW
    sums &= _LOW
    sums <<= _SHIFT
    sums |= even
    return sums.view(np.uint8)[: len(d)]


def unpredict(data: bytes) -> bytes:
    d = np.frombuffer(data, np.uint8) + np.uint8(128)  # modulo 256, as the sums are
    if not len(d):
        return b""
    d[:1] -= np.uint8(128)
    t = byte_sums(d)
    out, half = np.empty_like(t), (len(t) + 1) // 2
    out[0::2], out[1::2] = t[:half], t[half:]
    return out.tobytes()


_MIN_RUN, _MAX_RUN = 3, 128


def _pieces(starts: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches cut into pieces of ``most`` and a rest."""
    number = -(-lengths // most)
    nth = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    return np.repeat(starts, number) + nth * most, np.minimum(np.repeat(lengths, number) - nth * most, most)


def rle_encode(data: np.ndarray) -> bytes:
    """Runs of 3 to 128 equal bytes, and literals between them."""
    if not len(data):
        return b""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(data)) + 1])
    lengths = np.diff(np.append(starts, len(data)))
    long = lengths >= _MIN_RUN
    starts, lengths = starts[long], lengths[long]
    tail = lengths % _MAX_RUN
    lengths -= np.where(tail < _MIN_RUN, tail, 0)  # a tail too short for a run joins the literals
    between = np.concatenate([[0], starts + lengths])
    gaps = np.append(starts, len(data)) - between
    run_at, run_n = _pieces(starts, lengths, _MAX_RUN)
    text_at, text_n = _pieces(between, gaps, 127)
    at, n = np.concatenate([run_at, text_at]), np.concatenate([run_n, text_n])
    order = np.argsort(at)
    run = (np.arange(len(at)) < len(run_at))[order]
    at, n = at[order], n[order]
    # a run keeps its first byte, a literal all of its bytes, and each has a count before it
    keep = np.repeat(~run, n)
    keep[at[run]] = True
    size = np.where(run, 2, n + 1)
    place = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    value = np.ones(len(out), bool)
    value[place] = False
    out[value] = data[keep]
    out[place] = np.where(run, n - 1, 256 - n)
    return out.tobytes()


#: Bytes of an operation by its first.
_STEP = [2] * 128 + [257 - c for c in range(128, 256)]


def rle_decode(data: bytes, size: int) -> bytes:
    if not data:
        if size:
            raise Corrupt("the run lengths give another size")
        return b""
    code = np.frombuffer(data, np.uint8)
    heads, at, end = [], 0, len(data)
    while at < end:  # an operation says where the next one lies
        heads.append(at)
        at += _STEP[data[at]]
    heads = np.array(heads)
    run = code[heads] < 128
    if heads[-1] + 1 >= end and run[-1]:
        raise Corrupt("a run has no value")
    n = np.where(run, code[heads].astype(np.int64) + 1, 256 - code[heads].astype(np.int64))
    if at > end:  # literals that the end cuts off
        n[-1] -= at - end
    if n.sum() != size:
        raise Corrupt("the run lengths give another size")
    times = np.ones(end, np.int64)
    times[heads] = 0
    times[heads[run] + 1] = n[run]
    return np.repeat(code, times).tobytes()


def float_to_24(bits: np.ndarray) -> np.ndarray:
    """32-bit float patterns rounded to 24 bits; infinities stay, NaN stays NaN."""
    sign, body = bits >> 31 << 23, bits & 0x7FFFFFFF
    rounded = (body + (body & 0x80)) >> 8
    rounded = np.where(rounded >= 0x7F8000, body >> 8, rounded)  # don't round up to infinity
    nan = (body > 0x7F800000) & (body >> 8 == 0x7F8000)
    return (sign | np.where(nan, 0x7F8001, np.where(body >= 0x7F800000, body >> 8, rounded))).astype(np.uint32)


_PLANES = {"UINT": 4, "HALF": 2, "FLOAT": 3}


def pxr24_encode(data: bytes, rows: list[Row]) -> bytes:
    parts = []
    for r in rows:
        raw = data[r.start : r.start + r.width * SIZES[r.kind]]
        v = np.frombuffer(raw, "<u2" if r.kind == "HALF" else "<u4").astype(np.uint32)
        if r.kind == "FLOAT":
            v = float_to_24(v)
        d = v.copy()
        d[1:] -= v[:-1]
        parts += [(d >> np.uint32(8 * k) & np.uint32(255)).astype(np.uint8).tobytes() for k in reversed(range(_PLANES[r.kind]))]
    return zlib.compress(b"".join(parts), LEVEL)


def pxr24_decode(payload: bytes, rows: list[Row]) -> bytes:
    data, at, out = np.frombuffer(_inflate(payload), np.uint8), 0, []
    for r in rows:
        planes = _PLANES[r.kind]
        if at + planes * r.width > len(data):
            raise Corrupt("PXR24 planes are cut off")
        d = np.zeros(r.width, np.uint32)
        for k in range(planes):
            d = d << np.uint32(8) | data[at + k * r.width : at + (k + 1) * r.width]
        at += planes * r.width
        if r.kind == "FLOAT":
            d = d << np.uint32(8)
        v = np.cumsum(d, dtype=np.uint32)
        out.append((v & np.uint32(0xFFFF)).astype("<u2").tobytes() if r.kind == "HALF" else v.astype("<u4").tobytes())
    return b"".join(out)


def _ordered(h: np.ndarray) -> np.ndarray:
    """Half patterns as integers in the order of their values; NaN and infinities as 0."""
    h = h.astype(np.int64)
    t = np.where(h & 0x8000, ~h & 0xFFFF, h | 0x8000)
    return np.where(h & 0x7C00 == 0x7C00, 0x8000, t)


#: The sample that each of a block's fifteen differences starts from, and the one it leads to.
_B44_FROM = np.array([0, 4, 8, 0, 4, 8, 12, 1, 5, 9, 13, 2, 6, 10, 14])
_B44_TO = np.array([4, 8, 12, 1, 5, 9, 13, 2, 6, 10, 14, 3, 7, 11, 15])


def b44_pack(blocks: np.ndarray, flat: bool) -> bytes:
    """Blocks (n, 16) of half patterns, row by row, in 14 bytes each, or 3 where ``flat`` allows and all are equal."""
    t = _ordered(blocks).astype(np.int64)
    x = (t.max(axis=1, keepdims=True) - t) << 1
    n = len(t)
    shift, first, run = np.zeros(n, np.int64), t[:, 0].copy(), np.zeros((n, 15), np.int64)
    open_, s = np.arange(n), 0
    while len(open_):
        # distances from the largest value, rounded half to even at this precision
        own = x[open_]
        d = (own + ((1 << s) - 1) + ((own >> (s + 1)) & 1)) >> (s + 1) if s else own >> 1
        steps = d[:, _B44_FROM] - d[:, _B44_TO] + 32
        fits = (steps >= 0).all(axis=1) & (steps <= 63).all(axis=1)
        done = open_[fits]
        shift[done], run[done] = s, steps[fits]
        if s:
            first[done] = t[done].max(axis=1) - (d[fits, 0] << s)
        open_, s = open_[~fits], s + 1
    fields = np.concatenate([shift[:, None], run], axis=1).reshape(n, 4, 4)
    f0, f1, f2, f3 = (fields[:, :, k] for k in range(4))
    out = np.zeros((n, 14), np.uint8)
    out[:, 0], out[:, 1] = first >> 8 & 255, first & 255
    out[:, 2::3], out[:, 3::3], out[:, 4::3] = f0 << 2 | f1 >> 4, (f1 & 15) << 4 | f2 >> 2, (f2 & 3) << 6 | f3
    keep = np.ones((n, 14), bool)
    if flat:
        equal = (run == 32).all(axis=1)
        out[equal, 2] = 0xFC
        keep[equal, 3:] = False
    return out[keep].tobytes()


def b44_unpack(payload: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """The half patterns (n, 16) of n blocks from ``at`` on, and where they end."""
    starts, end = [], len(payload)
    for _ in range(n):
        if at + 3 > end:
            raise Corrupt("a B44 block is cut off")
        starts.append(at)
        at += 3 if payload[at + 2] >= 13 << 2 else 14
    if at > end:
        raise Corrupt("a B44 block is cut off")
    data = np.frombuffer(payload + bytes(14), np.uint8)[np.array(starts, np.int64)[:, None] + np.arange(14)].astype(np.int64)
    b = data[:, 2:].reshape(n, 4, 3)
    fields = np.stack([b[:, :, 0] >> 2, (b[:, :, 0] & 3) << 4 | b[:, :, 1] >> 4, (b[:, :, 1] & 15) << 2 | b[:, :, 2] >> 6, b[:, :, 2] & 63], axis=2).reshape(n, 16)
    flat = data[:, 2] >= 13 << 2
    steps = np.where(flat[:, None], 0, (fields[:, 1:] - 32) << np.where(flat, 0, fields[:, 0])[:, None])
    t = np.zeros((n, 16), np.int64)
    t[:, 0] = data[:, 0] << 8 | data[:, 1]
    for k, (one, other) in enumerate(zip(_B44_FROM, _B44_TO, strict=True)):
        t[:, other] = t[:, one] + steps[:, k]
    t &= 0xFFFF
    return np.where(t & 0x8000, t & 0x7FFF, ~t & 0xFFFF).astype(np.uint16), at


def _planes(data: bytes, rows: list[Row]) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for r in rows:
        out.setdefault(r.channel, []).append(data[r.start : r.start + r.width * SIZES[r.kind]])
    return out


def b44_encode(data: bytes, rows: list[Row], flat: bool) -> bytes:
    kinds, out = {r.channel: r.kind for r in rows}, []
    for channel, lines in sorted(_planes(data, rows).items()):
        if kinds[channel] != "HALF":
            out += lines
            continue
        plane = np.stack([np.frombuffer(x, "<u2") for x in lines])
        padded = np.pad(plane, ((0, -len(lines) % 4), (0, -plane.shape[1] % 4)), mode="edge")
        h, w = padded.shape
        out.append(b44_pack(padded.reshape(h // 4, 4, w // 4, 4).swapaxes(1, 2).reshape(-1, 16), flat))
    return b"".join(out)


def b44_decode(payload: bytes, rows: list[Row]) -> bytes:
    kinds, widths, heights = {}, {}, {}
    for r in rows:
        kinds[r.channel], widths[r.channel] = r.kind, r.width
        heights[r.channel] = heights.get(r.channel, 0) + 1
    at, planes = 0, {}
    for channel in sorted(kinds):
        w, h = widths[channel], heights[channel]
        if kinds[channel] != "HALF":
            size = SIZES[kinds[channel]] * w
            planes[channel] = [payload[at + k * size : at + (k + 1) * size] for k in range(h)]
            at += size * h
            continue
        down, across = -(-h // 4), -(-w // 4)
        blocks, at = b44_unpack(payload, at, down * across)
        plane = blocks.reshape(down, across, 4, 4).swapaxes(1, 2).reshape(4 * down, 4 * across)
        planes[channel] = [row.astype("<u2").tobytes() for row in plane[:h, :w]]
    taken = {c: iter(lines) for c, lines in planes.items()}
    return b"".join(next(taken[r.channel]) for r in rows)


def _word_planes(rows: list[Row]) -> list[tuple[int, int, int]]:
    """Lines, columns and 16-bit words of a sample, by channel."""
    lines: dict[int, list[Row]] = {}
    for r in rows:
        lines.setdefault(r.channel, []).append(r)
    return [(len(own), own[0].width, SIZES[own[0].kind] // 2) for _, own in sorted(lines.items())]


def piz_encode(data: bytes, rows: list[Row]) -> bytes:
    planes = _planes(data, rows)
    return piz.encode([np.frombuffer(b"".join(planes[c]), "<u2").reshape(shape) for c, shape in zip(sorted(planes), _word_planes(rows), strict=True)])


def piz_decode(payload: bytes, rows: list[Row]) -> bytes:
    try:
        planes = piz.decode(payload, _word_planes(rows))
    except piz.BadData as e:
        raise Corrupt(str(e)) from e
    lines = {c: iter(p) for c, p in zip(sorted({r.channel for r in rows}), planes, strict=True)}
    return b"".join(next(lines[r.channel]).astype("<u2").tobytes() for r in rows)


def _inflate(payload: bytes) -> bytes:
    try:
        return zlib.decompress(payload)
    except zlib.error as e:
        raise Corrupt(f"bad zlib data: {e}") from e


def encode(compression: str, data: bytes, rows: list[Row] | None = None) -> bytes:
    """A block's payload; the canonical bytes themselves where packing doesn't pay.

    ``rows`` None: a deep block, whose bytes have no planes.
    """
    match compression:
        case "NONE":
            return data
        case "RLE":
            packed = rle_encode(predict(data))
        case "ZIPS" | "ZIP":
            packed = zlib.compress(predict(data), LEVEL)
        case "ZSTD":
            packed = zstandard.ZstdCompressor(level=3).compress(data)
        case "PIZ" if rows is not None:
            packed = piz_encode(data, rows)
        case "PXR24" if rows is not None:
            packed = pxr24_encode(data, rows)
        case "B44" | "B44A" if rows is not None:
            return b44_encode(data, rows, compression == "B44A")
        case _:
            raise Unsupported(f"{compression} can't be written")
    return packed if len(packed) < len(data) else data


def decode(compression: str, payload: bytes, size: int, rows: list[Row] | None = None) -> bytes:
    """The canonical bytes of a payload."""
    b44 = compression in ("B44", "B44A")
    if len(payload) == size and not (b44 and rows is not None) or compression == "NONE":
        if len(payload) != size:
            raise Corrupt("an uncompressed block has another size")
        return payload
    match compression:
        case "RLE":
            return unpredict(rle_decode(payload, size))
        case "ZIPS" | "ZIP":
            data = unpredict(_inflate(payload))
        case "ZSTD":
            try:
                data = zstandard.ZstdDecompressor().decompress(payload, max_output_size=max(1, size))
            except zstandard.ZstdError as e:
                raise Corrupt(f"bad zstandard data: {e}") from e
        case "PIZ" if rows is not None:
            data = piz_decode(payload, rows)
        case "PXR24" if rows is not None:
            data = pxr24_decode(payload, rows)
        case "B44" | "B44A" if rows is not None:
            data = b44_decode(payload, rows)
        case _:
            raise Unsupported(f"{compression} can't be read")
    if len(data) != size:
        raise Corrupt("the block decodes to another size")
    return data
