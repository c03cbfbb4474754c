"""WARC archives of zstandard frames with a shared dictionary.

An archive begins with a skippable frame that holds the dictionary; then comes one
zstandard frame per record. Reading loads the dictionary, decodes record by record and
checks each record's headers, lengths and digests. Archives made elsewhere can be read, too:
records of any standard type, with any record ids.

Records with equal payloads are written in full once, as ``response``; the others are
``revisit`` records that name it and carry the payload's length in their HTTP head.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import files
from rasterloom.llm.shared import bounded_batches, materialize

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"
OTHER_TYPES = ("warcinfo", "request", "metadata", "resource", "conversion", "continuation")

MANIFEST = "path string, n_records long, n_bytes long"
SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, refers_to_id string, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    """The page that a record id names; None where it names none or is of another form."""
    m = re.fullmatch(r"<urn:page:(-?\d{1,19})>", record or "")
    return int(m[1]) if m and -(1 << 63) <= int(m[1]) < 1 << 63 else None


def make_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record; a revisit has the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    digest = sha1_base32(payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", NO_DATE), ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")]
    if revisit:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line!r}")
        if name.lower() in out and name.lower() != "warc-concurrent-to":  # the only one that may be repeated
            raise ValueError(f"header {name} is repeated")
        out[name.lower()] = value.strip()
    return out


def _http(head: bytes) -> dict[str, str]:
    """Fields of an HTTP head, those that are repeated joined by commas; what is no field is left out."""
    out: dict[str, str] = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def parse_record(data: bytes) -> tuple:
    """A record's row (as SCHEMA); raises ValueError where it isn't valid.

    The payload of a response is what follows its HTTP head, that of a revisit null, that of
    other records their whole block. Lengths and digests that a record states must be right; of HTTP
    heads only those of bodies sent as they are. A response without a payload digest gets one.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version not in (VERSION, b"WARC/1.0") or not gap:
        raise ValueError("no WARC header")
    fields = _fields(lines)
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"missing headers {sorted(missing)}")
    length = _length(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    block = rest[:length]
    if _differs(fields.get("warc-block-digest"), block):
        raise ValueError("the block's digest differs")
    kind, said, refers = fields["warc-type"], fields.get("warc-payload-digest"), fields.get("warc-refers-to")
    payload: bytes | None = block
    size: int | None = length
    if kind in ("response", "revisit"):
        start, gap, payload = block.partition(b"\r\n\r\n")
        is_http = start.startswith(b"HTTP/")
        if is_http and not gap or not is_http and fields.get("content-type", "").startswith("application/http") and block:
            raise ValueError("no HTTP head")
        http = _http(start) if is_http else {}
        payload = payload if is_http else block
        plain = "transfer-encoding" not in http
        stated = _length(http["content-length"]) if plain and "content-length" in http else None
        if kind == "revisit":
            if payload or refers is None and "warc-refers-to-target-uri" not in fields and "warc-profile" not in fields:
                raise ValueError("a revisit has a payload or refers to nothing")
            payload, size = None, stated
        else:
            size = len(payload)
            if plain and (stated not in (None, size) or _differs(said, payload)):
                raise ValueError("the payload's length or digest differs")
    elif kind not in OTHER_TYPES:
        raise ValueError(f"unknown record type {kind}")
    digest = said.removeprefix("sha1:") if said else None if payload is None else sha1_base32(payload)
    record = fields["warc-record-id"]
    return page_of(record), fields.get("warc-target-uri"), kind, size, digest, page_of(refers), record, refers, payload


def _length(text: str) -> int:
    if not re.fullmatch(r"[0-9]+", text):
        raise ValueError(f"bad length {text!r}")
    return int(text)


def _differs(said: str | None, data: bytes) -> bool:
    """Whether a stated SHA-1 isn't that of ``data``; digests of other kinds aren't checked."""
    return said is not None and said.startswith("sha1:") and said != f"sha1:{sha1_base32(data)}"


def train_dictionary(samples: list[bytes], size: int = 1 << 15) -> bytes:
    """A dictionary from a few samples; empty where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class ArchiveWriter:
    def __init__(self, path: str, dictionary: bytes, level: int = 3):
        where, name = files.filesystem(path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        self.path, self.out = path, where.open_output_stream(name, compression=None)
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
        known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, **known)
        self.n_records = self.n_bytes = 0

    def add(self, record: bytes) -> None:
        frame = self.pack.compress(record)
        self.out.write(frame)
        self.n_records += 1
        self.n_bytes += len(frame)

    def close(self) -> None:
        self.out.close()


_STEP = 1 << 14


def read_archive(path: str, chunk: int = 1 << 20, most_bytes: int = (1 << 31) - 1) -> Iterator[bytes]:
    """The records' bytes, a frame each; memory holds a chunk and one record.

    A record beyond ``most_bytes``, by default what a binary value can hold, raises ValueError.
    """
    where, name = files.filesystem(path)
    with where.open_input_stream(name, compression=None) as file:
        head = file.read(8)
        magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{path}: no leading dictionary frame")
        dictionary = file.read(size)
        if len(dictionary) != size:
            raise ValueError(f"{path}: the dictionary is cut off")
        if dictionary[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary, max_output_size=1 << 27)
        known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        unpack = zstandard.ZstdDecompressor(**known)
        frame, parts, held = None, [], 0
        while data := file.read(chunk):
            view, at = memoryview(data), 0
            while at < len(view):  # by small steps: what lies behind a frame's end is copied
                frame = frame or unpack.decompressobj()
                fed = view[at : at + _STEP]
                parts.append(frame.decompress(fed))
                held += len(parts[-1])
                if held > most_bytes:
                    raise ValueError(f"{path}: a record of more than {most_bytes} bytes")
                at += len(fed) - (len(frame.unused_data) if frame.eof else 0)
                if frame.eof:
                    yield b"".join(parts)
                    frame, parts, held = None, [], 0
        if frame is not None:
            raise ValueError(f"{path}: the last record is cut off")


def write_archives(pages: DataFrame, folder: str, dictionary_rows: int = 256, min_dedup_bytes: int = 0, max_file_bytes: int = 256 << 20) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the manifest.

    A null html is an empty payload and a null url an empty one. Of records with equal
    payloads of at least ``min_dedup_bytes`` the one with the largest page_id (rows that
    share it alike) is the response. A payload whose rows all lack a page_id is written
    in full each time. The dictionary is trained on ``dictionary_rows`` payloads, a
    bound on what the driver gets; it changes file sizes only. Payloads aren't
    shuffled by digest: only (page_id, digest) is, and its result meets the pages by
    page_id, so that no task gets all copies.
    """
    bounded_batches(pages.sparkSession)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    wanted = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    thin = pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("size")).where(F.col("page_id").isNotNull() & (F.col("size") >= min_dedup_bytes))
    firsts = thin.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    again = thin.join(firsts, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    again = materialize(again, "warc-revisits")
    rows = wanted.join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")
    some = pages.where("html is not null").select(F.substring("html", 1, 20_000).alias("start")).limit(dictionary_rows).collect()
    dictionary = train_dictionary([make_record(0, "", x.start.encode(), None, False) for x in some])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or ArchiveWriter(files.new_file(folder, ".warc.zst"), dictionary)
                out.add(make_record(page_id, url, payload, refers_to, refers_to is not None))
                if out.n_bytes >= max_file_bytes:
                    out.close()
                    done.append(out)
                    out = None
        if out:
            out.close()
            done.append(out)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x.path for x in done]), pa.array([x.n_records for x in done], pa.int64()), pa.array([x.n_bytes for x in done], pa.int64())], ["path", "n_records", "n_bytes"])

    return materialize(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives, as SCHEMA; a damaged record stops the read."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    bounded_batches(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for record in read_archive(path):
                    rows.append(parse_record(record))
                    held += len(record)
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.spread(manifest.select("path")).mapInArrow(read, SCHEMA)
