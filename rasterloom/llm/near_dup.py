"""Near-duplicate documents by Circulant MinHash.

A document is the set of its distinct word shingles. Documents with equal sets form a
class at once. Each class gets a signature from two permutations of a 32-bit universe: the
first scatters the shingles, the second is applied after a circular shift, one position
further for each coordinate. Bands of coordinates put classes into buckets.

A bucket's pairs are never listed. Members are compared with one leader per bucket. Where
a bucket still spans several components after that, its members meet again by prefix
filter: two sets with a link share one of their rarest shingles, and sets that merely have
a passage in common don't. There, too, members are compared with one leader per shingle
first, and only then are pairs across components compared that pass the length and
positional filters. Every comparison is an exact Jaccard test on full sets, so components
hold confirmed links only, and members of a bucket with a link end in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import setjoin
from rasterloom.llm import wordhash as wh
from rasterloom.llm.components import components
from rasterloom.llm.shared import bounded_batches, drop, materialize

U32 = np.uint32


def row_signatures(values: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of the non-empty sets between offsets: (sets, coordinates) of uint32."""
    first, count = offsets[:-1], len(offsets) - 1
    out = np.empty((count, coordinates), U32)
    scattered = (wh.mix(values) >> np.uint64(32)).astype(U32)
    step = 1 << 16  # values at a time, to stay in a core's cache
    begin = 0
    while begin < count:
        end = max(begin + 1, min(count, int(np.searchsorted(offsets, first[begin] + step, "right")) - 1))
        part, at = scattered[first[begin] : offsets[end]], first[begin:end] - first[begin]
        v, w = np.empty_like(part), np.empty_like(part)
        for k in range(coordinates):
            np.add(part, U32(k), out=v)
            np.multiply(v, U32(0x9E3779B1), out=v)
            np.right_shift(v, U32(16), out=w)
            np.bitwise_xor(v, w, out=v)
            np.multiply(v, U32(0x85EBCA6B), out=v)
            out[begin:end, k] = np.minimum.reduceat(v, at)
        begin = end
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets."""
    if not sets:
        return np.empty((0, coordinates), U32)
    return row_signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), coordinates)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band; equal values of different bands get different hashes."""
    part = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), part.shape[:2]) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(rows):
            acc = wh.mix(acc + part[:, :, j] * np.uint64(0xC2B2AE3D27D4EB4F))
    return acc.view(np.int64)


def default_bands(percent: int) -> tuple[int, int]:
    """Bands and rows that miss a pair at the limit with a chance below one in a million."""
    for rows in (8, 7, 6, 5, 4, 3, 2, 1):
        for bands in range(4, 120 // rows + 1):
            if (1 - (percent / 100) ** rows) ** bands < 1e-6:
                return bands, rows
    raise ValueError("the similarity is too low for 120 coordinates")


def _texts_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingle set of each text, block by block."""
    for a, b in wh.blocks(texts):
        yield from wh.distinct_sets(*wh.shingles(wh.hash_words(texts.slice(a, b - a)), size))


def sketch(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the set (two longs), one long per band."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_shingles", "key_1", "key_2", *(f"band_{i}" for i in range(bands))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in wh.blocks(texts):
                sets = wh.distinct_sets(*wh.shingles(wh.hash_words(texts.slice(a, b - a)), size))
                n = np.array([len(s) for s in sets])
                keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
                some = np.flatnonzero(n)
                h = np.zeros((len(sets), bands), np.int64)
                if len(some):
                    h[some] = band_hashes(signatures([sets[i] for i in some], bands * rows), bands, rows)
                columns = [ids.slice(a, b - a).cast(pa.int64()), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), *(pa.array(np.ascontiguousarray(h[:, i])) for i in range(bands))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    full = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yes = np.zeros(len(a), bool)
            for i, one in enumerate(_texts_sets(batch.column(2), size)):
                text = batch.column(3)[i].as_py()
                if other is None or text != last:
                    last, other = text, next(_texts_sets(batch.column(3).slice(i, 1), size))
                small, large = (one, other) if len(one) <= len(other) else (other, one)
                if len(small) and 100 * len(small) >= percent * len(large):
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    yes[i] = 100 * both >= percent * (len(small) + len(large) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[yes]), pa.array(b[yes])], ["a", "b"])

    return full.mapInArrow(run, "a long, b long")


def prefixes(texts: DataFrame, size: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """(token, id, c, n, at): the prefix tokens of each set of ``texts`` (doc_id, text, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, c = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            for a, b in wh.blocks(texts):
                found = []
                for i, one in zip(range(a, b), _texts_sets(texts.slice(a, b - a), size), strict=True):
                    keys = np.sort(setjoin.ordered_keys(one, ranks))[: max(0, setjoin.prefix_length(len(one), percent))]
                    found.append((keys, np.full(len(keys), ids[i]), np.full(len(keys), c[i]), np.full(len(keys), len(one)), np.arange(len(keys))))
                keys, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *(pa.array(x) for x in rest)], ["token", "id", "c", "n", "at"])

    return texts.mapInArrow(run, "token long, id long, c long, n long, at long")


def split_documents(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) from a doc_id whose rows differ to the classes of all its rows: it is one document."""
    least, most = F.min(F.struct("key_1", "key_2")), F.max(F.struct("key_1", "key_2"))
    several = sketches.where("doc_id is not null").groupBy("doc_id").agg(least.alias("least"), most.alias("most"), F.count("*").alias("n")).where("n > 1 and least <> most").select("doc_id")
    rows = sketches.join(several, "doc_id").where("n_shingles > 0").join(classes.select("key_1", "key_2", "id"), ["key_1", "key_2"])
    return rows.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int | None = None, rows: int | None = None, broadcast_ids: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * |A and B| >= percent * |A or B| over their distinct
    ``size``-word shingles; ``component_id`` is the smallest doc_id that links reach and
    ``kept`` says whether the row's doc_id is that. Null, empty and white-space texts have
    an empty set: linked with nothing and kept. Rows that share a doc_id are one
    document, linked with whatever any of its texts is linked with. A row without doc_id takes no part: component_id null, kept. Repeated rows
    stay. Further columns are ignored; an empty table gives an empty result.

    Up to ``broadcast_ids`` ids of candidates are broadcast to pick their texts; more are
    joined by a shuffle.
    """
    if bands is None or rows is None:
        bands, rows = default_bands(percent)
    spark = docs.sparkSession
    sketches = materialize(sketch(docs, size, bands, rows), "sketch")
    classes = sketches.where("n_shingles > 0 and doc_id is not null").groupBy("key_1", "key_2").agg(F.min("doc_id").alias("id"), *(F.min(f"band_{i}").alias(f"band_{i}") for i in range(bands)))
    classes = materialize(classes, "classes")
    banded = classes.select("id", F.explode(F.array(*(f"band_{i}" for i in range(bands)))).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last").drop("last")
    members = materialize(banded.join(shared, "bucket"), "members")

    wanted = materialize(members.select(F.col("id").alias("doc_id")).distinct(), "candidates")
    few = wanted.count() <= broadcast_ids
    picked = lambda ids: F.broadcast(ids) if few else ids
    texts = materialize(docs.select("doc_id", "text").join(picked(wanted), "doc_id"), "texts")

    tried = materialize(members.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    of = components(materialize(confirmed(tried, texts, size, percent).unionAll(split_documents(sketches, classes)), "confirmed"))

    # buckets that still span components: their members meet again by rare shingles
    named = lambda rows, of: rows.join(of.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    labelled = named(members.select("bucket", "id"), of)
    mixed = labelled.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bucket")
    active = materialize(labelled.join(mixed, "bucket").select(F.col("id").alias("doc_id"), "c").distinct(), "active")
    if not active.isEmpty():
        some = texts.join(picked(active), "doc_id").select("doc_id", "text", "c")
        shingle_hashes = lambda batch: (wh.shingles(wh.hash_words(batch.column(1).slice(a, b - a)), size)[0] for a, b in wh.blocks(batch.column(1)))
        ranks = setjoin.rarity_ranks(setjoin.bucket_counts(some, shingle_hashes))
        tokens = materialize(prefixes(some, size, percent, ranks), "prefixes")
        spanning = lambda rows: rows.groupBy("token").agg(F.min("id").alias("b"), F.min_by("c", "id").alias("cb"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
        led = tokens.join(spanning(tokens).select("token", "b", "cb"), "token").where("c <> cb").select(F.col("id").alias("a"), "b").distinct()
        led = materialize(led.join(tried, ["a", "b"], "left_anti"), "pairs")
        more = materialize(confirmed(led, texts, size, percent), "confirmed")
        of = components(of.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))

        rest = named(tokens.drop("c"), of)
        rest = materialize(rest.join(spanning(rest).select("token"), "token"), "prefixes")
        x, y = rest.alias("x"), rest.alias("y")
        near = setjoin.may_match(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"), percent)
        pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.id") > F.col("y.id")) & (F.col("x.c") != F.col("y.c")) & near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
        pairs = materialize(pairs.join(tried.unionAll(led), ["a", "b"], "left_anti"), "pairs")
        last = materialize(confirmed(pairs, texts, size, percent), "confirmed")
        if not last.isEmpty():
            of = components(of.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(last))
        drop(spark, tokens, rest, pairs, led)
    drop(spark, texts, members)

    named = sketches.select("doc_id", "n_shingles", "key_1", "key_2").join(classes.select("key_1", "key_2", "id"), ["key_1", "key_2"], "left")
    named = named.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id"))).join(of, "node", "left")
    component = F.coalesce("component", "node")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
