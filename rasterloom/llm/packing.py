"""Hierarchical multi-length packing of token ids into training windows.

Documents are cut into full windows of the largest context size; what remains is routed
to the smallest context size (tier) that holds it. Each tier is packed from its longest
pieces down; the gap of a long window is filled with the longest fitting pieces of
shorter tiers, and last with a cut of one, so windows come out full. A block of documents
is packed at a time and what is left over joins the next block; only the end of a
partition has short windows, whose sizes are powers of two. Windows of one tier are dealt
to step groups that hold the same number of ids.

The work needs no shuffle: a partition's windows depend on that partition alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterloom.llm import files
from rasterloom.llm.encoding import encoder_for
from rasterloom.llm.shared import bounded_batches

TIERS = (2048, 1024, 512, 256)
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, window long, step_id long, ids binary"
NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "window", "step_id", "ids"]
KINDS = [pa.int64()] * 8 + [pa.binary()]


class Packer:
    """Packs pieces (document, start, length); ``emit(window, pieces)`` gets each window."""

    def __init__(self, tiers: tuple[int, ...], emit):
        if not tiers or any(t & (t - 1) or t < 1 for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
            raise ValueError("tiers are descending powers of two")
        self.tiers, self.emit = tiers, emit
        self.pool: list[list] = [[] for _ in range(tiers[0] + 1)]
        self.mask = 0  # bit n: a piece of length n waits

    def put(self, doc, start: int, length: int) -> None:
        if length:
            self.pool[length].append((doc, start))
            self.mask |= 1 << length

    def take(self, length: int):
        doc, start = self.pool[length].pop()
        if not self.pool[length]:
            self.mask &= ~(1 << length)
        return doc, start

    def add(self, doc, n: int) -> None:
        """Full windows at once; the remainder waits in its tier."""
        top, at = self.tiers[0], 0
        while n - at >= top:
            self.emit(top, [(doc, at, top)])
            at += top
        self.put(doc, at, n - at)

    def _fill(self, gap: int, pieces: list) -> int:
        """Fill a window's gap; returns what stays open, 0 unless nothing waits."""
        while gap and self.mask:
            fit = (self.mask & ((1 << (gap + 1)) - 1)).bit_length() - 1
            if fit > 0:
                doc, start = self.take(fit)
                pieces.append((doc, start, fit))
                gap -= fit
            else:  # only longer pieces wait: cut the shortest
                length = (self.mask & -self.mask).bit_length() - 1
                doc, start = self.take(length)
                pieces.append((doc, start, gap))
                self.put(doc, start + gap, length - gap)
                gap = 0
        return gap

    def pack(self) -> None:
        """Pack each tier, longest first; an unfilled window's pieces wait on."""
        for k, size in enumerate(self.tiers):
            floor = self.tiers[k + 1] if k + 1 < len(self.tiers) else 0
            while (longest := self.mask.bit_length() - 1) > floor:
                doc, start = self.take(longest)
                pieces = [(doc, start, longest)]
                if self._fill(size - longest, pieces):
                    for piece in pieces:
                        self.put(*piece)
                    return
                self.emit(size, pieces)

    def finish(self) -> None:
        """The rest, less than a window: windows of powers of two."""
        self.pack()
        left = sum(len(x) * n for n, x in enumerate(self.pool))
        while left:
            size = min(1 << (left.bit_length() - 1), self.tiers[0])
            pieces: list = []
            self._fill(size, pieces)
            self.emit(size, pieces)
            left -= size


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_ids: int = 1 << 15, block_ids: int = 1 << 20) -> DataFrame:
    """One row per piece of a document in a window, with the piece's ``ids``.

    docs: doc_id, text (null: empty); other columns are ignored. Every document ends with
    ``end_id``, so an empty one is a piece of one id; an empty table gives no rows. Rows
    with equal doc_id are packed as separate documents. ``sequence_id`` numbers windows
    (partition, then order); ``window`` is the context size, which the ids fill
    exactly; ``step_id`` groups windows of one size that hold ``step_ids`` ids together; groups are
    counted off per partition, whose last group of each size may hold fewer.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = encoder_for(tokenizer), np.array([end_id], "<u4").tobytes()
        base, rows = files.partition_id() << 40, []
        windows: dict[int, int] = {}
        made = 0

        def emit(window: int, pieces: list) -> None:
            nonlocal made
            nth = windows[window] = windows.get(window, -1) + 1
            step = base | (window.bit_length() << 34) | nth // max(1, step_ids // window)
            offset = 0
            for (doc_id, ids), start, length in pieces:
                rows.append((doc_id, start, length, len(ids) // 4, base | made, offset, window, step, ids[4 * start : 4 * (start + length)]))
                offset += length
            made += 1

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)
            rows.clear()
            return done

        packer, held = Packer(tiers, emit), 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(keys), 256):
                for key, ids in zip(keys[a : a + 256], encoder.encode([x or "" for x in texts[a : a + 256].to_pylist()]), strict=True):
                    ids += tail
                    packer.add((key, ids), len(ids) // 4)
                    held += len(ids) // 4
                    if held >= block_ids:
                        packer.pack()
                        held = 0
                if len(rows) >= 2000:
                    yield out()
        packer.finish()
        if rows:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
