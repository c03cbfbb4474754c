"""Vectorised word hashing over Arrow string batches.

Words are the runs matching ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Every
word gets a 64-bit hash of its UTF-8 bytes, eight at a time; no Python object is
made for a word. Blocks bound memory: about ``BLOCK_BYTES`` of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For comparisons that ignore punctuation: all ASCII but letters and digits.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n."""
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (xor-shift and multiply rounds)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(32)
    return x


@dataclass
class Words:
    """Words of consecutive texts: ``rows[i]:rows[i + 1]`` are those of text i."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    data: np.ndarray


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rebased to 0) and UTF-8 bytes; nulls count as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0 or offsets is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return o - o[0], d


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    offsets, _ = text_buffers(texts)
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
        end = min(max(end, begin + 1), len(texts))
        yield begin, end
        begin = end


def hash_words(texts: pa.Array, apart: np.ndarray = _SPACE) -> Words:
    """Hashes and byte spans of all words of ``texts`` (one block); ``apart``: the bytes between words."""
    offsets, data = text_buffers(texts)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), none, none, np.zeros(len(texts) + 1, np.int64), data)
    solid = ~apart[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a text's first byte, and the end
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(starts, offsets)
    return Words(_hashes(data, starts, ends - starts), starts, ends, rows, data)


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash the byte spans, eight bytes of every span at a time."""
    padded = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    out = mix((eight[starts] & _MASK[np.minimum(lengths, 8)]) + U64(_BASE))
    more, at = np.flatnonzero(lengths > 8), 8
    with np.errstate(over="ignore"):
        while len(more):
            left = lengths[more] - at
            chunk = eight[starts[more] + at] & _MASK[np.minimum(left, 8)]
            out[more] = mix(out[more] * U64(_BASE) + chunk)
            more, at = more[left > 8], at + 8
        return mix(out + lengths.astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each text, with row offsets.

    A text with fewer words, but any, has its whole sequence as one shingle.
    """
    h, rows = words.hashes, words.rows
    counts = np.diff(rows)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_rows = np.concatenate([[0], np.cumsum(number)])
    total = int(out_rows[-1])
    if total == 0:
        return np.zeros(0, U64), out_rows
    # word index at which each shingle begins
    begin = np.arange(total) - np.repeat(out_rows[:-1], number) + np.repeat(rows[:-1], number)
    left = np.repeat(rows[1:], number) - begin  # words from there to the text's end
    p = powers(0xC2B2AE3D27D4EB4F, size + 1)
    padded = np.concatenate([h, np.zeros(size, U64)])
    acc = np.zeros(total, U64)
    with np.errstate(over="ignore"):
        for j in range(size):
            term = padded[begin + j] * p[j]
            if (counts < size).any():
                term[left <= j] = 0
            acc += term
        acc += np.minimum(left, size).astype(U64) * p[size]
    return mix(acc), out_rows


def distinct_sets(hashes: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each row."""
    return [np.unique(hashes[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
