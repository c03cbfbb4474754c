"""PIZ blocks: a table of used values, a 2D Haar-like wavelet, and canonical Huffman codes.

The wavelet works on whole strided grids, coding on whole arrays of symbols; decoding looks up
every bit position at once and then follows the chain of code lengths.
"""

from __future__ import annotations

import heapq
import itertools
import struct

import numpy as np

# Fixed values of the format: symbols, code lengths and the codes of zero runs in the length table.
SYMBOLS = 1 << 16
LONGEST = 58
SHORT_RUN, LONG_RUN, SHORTEST_LONG = 59, 63, 6
LOOKUP = 14


class BadData(ValueError):
    pass


def value_table(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of used values (0 isn't stored) and the values in the order of their new numbers."""
    used = np.zeros(SYMBOLS, bool)
    used[words] = True
    used[0] = False
    return np.packbits(used, bitorder="little"), np.concatenate([[0], np.flatnonzero(used)]).astype(np.uint16)


def _pair(a: np.ndarray, b: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Mean and difference of two arrays of 16-bit values held as int64."""
    if wide:
        a = (a + 0x8000) & 0xFFFF
        mean, diff = (a + b) >> 1, a - b
        return np.where(diff < 0, (mean + 0x8000) & 0xFFFF, mean), diff & 0xFFFF
    a, b = _signed(a), _signed(b)
    return (a + b) >> 1 & 0xFFFF, (a - b) & 0xFFFF


def _unpair(low: np.ndarray, high: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    if wide:
        b = (low - (high >> 1)) & 0xFFFF
        return (high + b - 0x8000) & 0xFFFF, b
    h = _signed(high)
    a = _signed(low) + (h & 1) + (h >> 1)
    return a & 0xFFFF, (a - h) & 0xFFFF


def _signed(v: np.ndarray) -> np.ndarray:
    return np.where(v & 0x8000, v - 0x10000, v)


def _quads(plane: np.ndarray, p: int) -> tuple[tuple[slice, slice], ...]:
    """Grids of the four corners of all whole squares of side 2p."""
    ny, nx = (n // (2 * p) * 2 * p for n in plane.shape)
    y0, y1, x0, x1 = slice(0, ny, 2 * p), slice(p, ny, 2 * p), slice(0, nx, 2 * p), slice(p, nx, 2 * p)
    return (y0, x0), (y0, x1), (y1, x0), (y1, x1)


def _edges(plane: np.ndarray, p: int) -> list[tuple[tuple, tuple]]:
    """Pairs along an odd last column and an odd last line."""
    ny, nx = (n // (2 * p) * 2 * p for n in plane.shape)
    out = []
    if plane.shape[1] & p:
        out.append(((slice(0, ny, 2 * p), nx), (slice(p, ny, 2 * p), nx)))
    if plane.shape[0] & p:
        out.append(((ny, slice(0, nx, 2 * p)), (ny, slice(p, nx, 2 * p))))
    return out


def wavelet(plane: np.ndarray, top: int) -> np.ndarray:
    a, wide, p = plane.astype(np.int64), top >= 1 << 14, 1
    while 2 * p <= min(a.shape):
        c00, c01, c10, c11 = _quads(a, p)
        low0, high0 = _pair(a[c00], a[c01], wide)
        low1, high1 = _pair(a[c10], a[c11], wide)
        a[c00], a[c10] = _pair(low0, low1, wide)
        a[c01], a[c11] = _pair(high0, high1, wide)
        for one, two in _edges(a, p):
            a[one], a[two] = _pair(a[one], a[two], wide)
        p *= 2
    return a


def unwavelet(plane: np.ndarray, top: int) -> np.ndarray:
    a, wide, p = plane.astype(np.int64), top >= 1 << 14, 1
    while 4 * p <= min(a.shape):
        p *= 2
    while p and 2 * p <= min(a.shape):
        for one, two in _edges(a, p):
            a[one], a[two] = _unpair(a[one], a[two], wide)
        c00, c01, c10, c11 = _quads(a, p)
        low0, low1 = _unpair(a[c00], a[c10], wide)
        high0, high1 = _unpair(a[c01], a[c11], wide)
        a[c00], a[c01] = _unpair(low0, high0, wide)
        a[c10], a[c11] = _unpair(low1, high1, wide)
        p //= 2
    return a


def _lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    order = itertools.count()
    heap = [(n, next(order), [s]) for s, n in counts.items()]
    heapq.heapify(heap)
    out = dict.fromkeys(counts, 0)
    while len(heap) > 1:
        n, _, a = heapq.heappop(heap)
        m, _, b = heapq.heappop(heap)
        for s in a:
            out[s] += 1
        for s in b:
            out[s] += 1
        heapq.heappush(heap, (n + m, next(order), a + b))
    if max(out.values()) > LONGEST:
        raise BadData("codes are too long")
    return out


def _codes(lengths: dict[int, int]) -> dict[int, int]:
    """Canonical codes: longer ones first, equal lengths in the order of symbols."""
    number = [0] * (LONGEST + 1)
    for n in lengths.values():
        number[n] += 1
    first, code = [0] * (LONGEST + 1), 0
    for n in range(LONGEST, 0, -1):
        first[n], code = code, (code + number[n]) >> 1
    out = {}
    for s in sorted(lengths):
        out[s] = first[lengths[s]]
        first[lengths[s]] += 1
    return out


def _bits(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bits of a series of codes, most significant first."""
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return (np.repeat(codes, lengths) >> (np.repeat(lengths, lengths) - 1 - place) & 1).astype(np.uint8)


def huffman(symbols: np.ndarray) -> bytes:
    if not len(symbols):
        return b""
    values, n = np.unique(symbols, return_counts=True)
    counts = dict(zip(values.tolist(), n.tolist(), strict=True))
    low, run = min(counts), max(counts) + 1
    lengths = _lengths(counts | {run: 1})
    codes = _codes(lengths)
    # the table of lengths, with runs of zeros shortened
    table: list[tuple[int, int]] = []
    s = low
    while s <= run:
        if s in lengths:
            table.append((lengths[s], 6))
            s += 1
            continue
        z = 1
        while z < 255 + SHORTEST_LONG and s + z not in lengths:
            z += 1
        table += [(0, 6)] if z == 1 else [(SHORT_RUN + z - 2, 6)] if z < SHORTEST_LONG else [(LONG_RUN, 6), (z - SHORTEST_LONG, 8)]
        s += z
    packed = np.packbits(_bits(*(np.array(x) for x in zip(*table, strict=True))))
    # runs of up to 256 equal symbols: as often as that is shorter, a code, the run code and a count
    edge = np.flatnonzero(np.diff(symbols)) + 1
    begin = np.concatenate([[0], edge])
    size = np.diff(np.append(begin, len(symbols)))
    pieces = -(-size // 256)
    own = np.repeat(symbols[begin], pieces).astype(np.int64)
    place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    length = np.minimum(np.repeat(size, pieces) - 256 * place, 256)
    of_code, of_length = np.zeros(SYMBOLS + 1, np.int64), np.zeros(SYMBOLS + 1, np.int64)
    of_code[list(codes)], of_length[list(codes)] = list(codes.values()), [lengths[s] for s in codes]
    short = of_length[own] + lengths[run] + 8 < of_length[own] * (length - 1)
    times = np.where(short, 3, length)
    which = np.repeat(np.arange(len(own)), times)
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    second, third = short[which] & (step == 1), short[which] & (step == 2)
    out_codes = np.where(second, codes[run], np.where(third, length[which] - 1, of_code[own[which]]))
    out_lengths = np.where(second, lengths[run], np.where(third, 8, of_length[own[which]]))
    bits = _bits(out_codes, out_lengths)
    return struct.pack("<5I", low, run, len(packed), len(bits), 0) + packed.tobytes() + np.packbits(bits).tobytes()


def unhuffman(data: bytes, size: int) -> np.ndarray:
    if not data:
        if size:
            raise BadData("no codes")
        return np.zeros(0, np.uint16)
    if len(data) < 20:
        raise BadData("the code header is cut off")
    low, run, _, bits, _ = struct.unpack("<5I", data[:20])
    if not low <= run <= SYMBOLS:
        raise BadData("symbols out of range")
    at, held, have, lengths, s = 20, 0, 0, {}, low

    def take(n: int) -> int:
        nonlocal at, held, have
        while have < n:
            if at >= len(data):
                raise BadData("the length table is cut off")
            held, at, have = (held << 8 | data[at]) & 0xFFFF, at + 1, have + 8
        have -= n
        return held >> have & ((1 << n) - 1)

    while s <= run:
        n = take(6)
        if n == LONG_RUN:
            s += take(8) + SHORTEST_LONG
        elif n >= SHORT_RUN:
            s += n - SHORT_RUN + 2
        else:
            if n:
                lengths[s] = n
            s += 1
    if s != run + 1 or at + (bits + 7) // 8 > len(data):
        raise BadData("bad lengths or cut-off codes")
    codes = _codes(lengths)
    table_s, table_n, long = np.zeros(1 << LOOKUP, np.int64), np.zeros(1 << LOOKUP, np.int64), {}
    for s, n in lengths.items():
        if n <= LOOKUP:
            first = codes[s] << (LOOKUP - n)
            table_s[first : first + (1 << (LOOKUP - n))], table_n[first : first + (1 << (LOOKUP - n))] = s, n
        else:
            long[n, codes[s]] = s
    body = np.frombuffer(data, np.uint8, (bits + 7) // 8, at)
    b = np.concatenate([body, np.zeros(8, np.uint8)]).astype(np.int64)
    word = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    place = np.arange(bits)
    window = word[place >> 3] >> (32 - LOOKUP - (place & 7)) & ((1 << LOOKUP) - 1)
    symbol, step = table_s[window].tolist(), table_n[window].tolist()
    whole = int.from_bytes(body.tobytes(), "big") if long else 0
    total, out, counts, p = 8 * len(body), [], [], 0
    while p < bits:
        s, n = symbol[p], step[p]
        if not n:  # a code longer than the lookup
            for n in range(LOOKUP + 1, min(LONGEST, bits - p) + 1):
                s = long.get((n, whole >> (total - p - n) & ((1 << n) - 1)))
                if s is not None:
                    break
            else:
                raise BadData("unknown code")
        p += n
        if s == run:
            if p + 8 > bits or not out:
                raise BadData("a run is cut off")
            counts[-1] += int(word[p >> 3] >> (24 - (p & 7)) & 255)
            p += 8
        else:
            out.append(s)
            counts.append(1)
    found = np.repeat(np.array(out, np.uint16), counts)
    if p != bits or len(found) != size:
        raise BadData("the codes give another size")
    return found


def encode(planes: list[np.ndarray]) -> bytes:
    """Planes of uint16 (lines, columns, words of a sample), one per channel."""
    flat = np.concatenate([p.reshape(-1) for p in planes]) if planes else np.zeros(0, np.uint16)
    bitmap, values = value_table(flat)
    number = np.zeros(SYMBOLS, np.uint16)
    number[values] = np.arange(len(values))
    top, coded = len(values) - 1, []
    for plane in planes:
        v = number[plane]
        coded.append(np.stack([wavelet(v[:, :, k], top) for k in range(v.shape[2])], axis=2).astype(np.uint16).reshape(-1))
    data = huffman(np.concatenate(coded) if coded else flat)
    some = np.flatnonzero(bitmap)
    lo, hi = (int(some[0]), int(some[-1])) if len(some) else (len(bitmap) - 1, 0)
    return struct.pack("<2H", lo, hi) + (bitmap[lo : hi + 1].tobytes() if lo <= hi else b"") + struct.pack("<i", len(data)) + data


def decode(payload: bytes, shapes: list[tuple[int, int, int]]) -> list[np.ndarray]:
    if len(payload) < 8:
        raise BadData("the block is cut off")
    lo, hi = struct.unpack("<2H", payload[:4])
    bitmap, at = np.zeros(SYMBOLS // 8, np.uint8), 4
    if lo <= hi:
        if hi >= len(bitmap) or len(payload) < at + hi - lo + 5:
            raise BadData("bad value table")
        bitmap[lo : hi + 1] = np.frombuffer(payload, np.uint8, hi - lo + 1, at)
        at += hi - lo + 1
    used = np.unpackbits(bitmap, bitorder="little").astype(bool)
    used[0] = False
    values = np.concatenate([[0], np.flatnonzero(used)]).astype(np.uint16)
    (n,) = struct.unpack("<i", payload[at : at + 4])
    data = payload[at + 4 : at + 4 + n]
    if n < 0 or len(data) != n:
        raise BadData("the codes are cut off")
    flat, place, out = unhuffman(data, sum(a * b * c for a, b, c in shapes)), 0, []
    for h, w, k in shapes:
        v = flat[place : place + h * w * k].reshape(h, w, k)
        place += h * w * k
        plane = np.stack([unwavelet(v[:, :, i], len(values) - 1) for i in range(k)], axis=2)
        if plane.size and int(plane.max()) >= len(values):
            raise BadData("a value outside the table")
        out.append(values[plane])
    return out
