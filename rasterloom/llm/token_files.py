"""Token-id files: one zstandard frame a document, with a trailing seek table.

A file is a series of independent zstandard frames (the little-endian unsigned 32-bit
ids of one document each), a skippable frame with the documents' ids, and the seek
table of the zstandard seekable format: a skippable frame holding, per frame, its
compressed size, its plain size and the low 32 bits of the XXH64 of its plain bytes,
then the number of frames, a descriptor byte and a magic number. A reader that wants
some documents reads the tail, then only their frames.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import files
from rasterloom.llm.encoding import encoder_for
from rasterloom.llm.shared import bounded_batches, materialize

# Fixed values of the zstandard frame and seekable formats.
SKIPPABLE_INDEX = 0x184D2A5B
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

MANIFEST = "partition int, seq int, path string, n_docs long, n_ids long, n_bytes long"
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("sum", "<u4")])


def checksum(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class TokenFileWriter:
    """Append documents, then ``close``; memory holds 21 bytes a document."""

    def __init__(self, path: str, level: int = 3):
        where, name = files.filesystem(path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        self.path, self.out = path, where.open_output_stream(name, compression=None)
        self.pack = zstandard.ZstdCompressor(level=level)
        self.ids, self.entries, self.n_ids, self.n_bytes = [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.pack.compress(ids)
        self.out.write(frame)
        self.ids.append(doc_id)
        self.entries.append((len(frame), len(ids), checksum(ids)))
        self.n_ids += len(ids) // 4
        self.n_bytes += len(frame)

    def close(self) -> None:
        known = np.array([x is not None for x in self.ids], np.uint8)
        index = known.tobytes() + np.array([x or 0 for x in self.ids], "<i8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        entries = np.array([*self.entries, (len(index) + 8, 0, checksum(b""))], ENTRY)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, entries.nbytes + 9) + entries.tobytes())
        self.out.write(struct.pack("<IBI", len(entries), CHECKSUM_FLAG, SEEKABLE_MAGIC))
        self.out.close()


class TokenFileReader:
    """Random access to the documents of one file."""

    def __init__(self, path: str):
        where, name = files.filesystem(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{path}: no seek table with checksums ({size} bytes, {frames} {flags} {magic:x})")
        table = frames * ENTRY.itemsize
        head = self.file.read_at(8 + table, size - 9 - table - 8)
        if struct.unpack("<II", head[:8]) != (SKIPPABLE_SEEK, table + 9):
            raise ValueError(f"{path}: bad seek table")
        entries = np.frombuffer(head[8:], ENTRY)
        offsets = np.concatenate([[0], np.cumsum(entries["packed"], dtype=np.int64)])
        index = self.file.read_at(int(entries["packed"][-1]), int(offsets[-2]))
        n = frames - 1
        if struct.unpack("<II", index[:8]) != (SKIPPABLE_INDEX, 9 * n):
            raise ValueError(f"{path}: bad document index")
        self.known = np.frombuffer(index, np.uint8, n, 8).astype(bool)
        self.doc_ids = np.frombuffer(index, "<i8", n, 8 + n)
        self.entries, self.offsets, self.path = entries[:-1], offsets, path
        self.unpack = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.entries)

    def doc_id(self, k: int) -> int | None:
        return int(self.doc_ids[k]) if self.known[k] else None

    def _plain(self, k: int, frame: bytes) -> bytes:
        plain = self.unpack.decompress(frame, max_output_size=max(1, int(self.entries["plain"][k])))
        if len(plain) != self.entries["plain"][k] or checksum(plain) != self.entries["sum"][k]:
            raise ValueError(f"{self.path}: frame {k} is damaged")
        return plain

    def read(self, k: int) -> bytes:
        """The ids of document ``k`` of the file; no other frame is read."""
        return self._plain(k, self.file.read_at(int(self.entries["packed"][k]), int(self.offsets[k])))

    def scan(self, chunk: int = 4 << 20) -> Iterator[tuple[int, bytes]]:
        """All documents in order, reading about ``chunk`` bytes at a time."""
        k = 0
        while k < len(self):
            end = max(k + 1, int(np.searchsorted(self.offsets, self.offsets[k] + chunk, "right")) - 1)
            end = min(end, len(self))
            data = self.file.read_at(int(self.offsets[end] - self.offsets[k]), int(self.offsets[k]))
            for i in range(k, end):
                a = int(self.offsets[i] - self.offsets[k])
                yield i, self._plain(i, data[a : a + int(self.entries["packed"][i])])
            k = end


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, max_file_bytes: int = 256 << 20) -> DataFrame:
    """Write the token ids of ``docs`` (doc_id, text) and return the manifest.

    Documents lie in ascending ``doc_id`` order (nulls first; equal ids by text): files
    by (partition, seq), documents within a file in its order. A null text is empty; each
    document ends with ``end_id``. Texts are range-partitioned once, before encoding, so
    that ids are written where they are made.
    """
    bounded_batches(docs.sparkSession)
    schema = docs.sparkSession.createDataFrame([], MANIFEST).schema

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = encoder_for(tokenizer), np.array([end_id], "<u4").tobytes()
        out, seq, rows = None, 0, []

        def close() -> None:
            out.close()
            rows.append((files.partition_id(), seq, out.path, len(out.ids), out.n_ids, out.n_bytes))

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(keys), 256):
                part = texts[a : a + 256].to_pylist()
                for key, ids in zip(keys[a : a + 256], encoder.encode(part), strict=True):
                    if out is None:
                        out = TokenFileWriter(files.new_file(folder, ".tok.zst"))
                    out.add(key, ids + tail)
                    if out.n_bytes >= max_file_bytes:
                        close()
                        out, seq = None, seq + 1
        if out is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["partition", "seq", "path", "n_docs", "n_ids", "n_bytes"]).cast(_arrow(schema))

    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(write, schema), "token-manifest")


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before), n_tokens, ids."""
    bounded_batches(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, rows, held = TokenFileReader(path), [], 0
                for k, ids in reader.scan():
                    rows.append((reader.doc_id(k), start, len(ids) // 4, ids))
                    start += len(ids) // 4
                    held += len(ids)
                    if held > 4 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    placed = files.total_before(manifest, "n_ids", ["partition", "seq"], "start").select("path", "start")
    return files.spread(placed).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])
