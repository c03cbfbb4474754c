"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its distinct words; lines without words take no part and stay. A line
is removed if an earlier line has a similarity of percent/100 or more. Order: doc_id
(nulls first), then a hash of the text, then the line's number.

Lines with equal sets (by 128 bits) form a class, kept by its earliest line, so a very common line is
one row from then on. Between classes the join works with prefixes of rarity-ordered words: a
longer set's probing prefix and a shorter set's indexing prefix share a word, or the sets
don't match; words that are common in the corpus meet only together with the next shared word. Candidates pass the length and positional filters and a bitmap filter (words
toggle one of 128 bits, then of 256; bits that differ count differing words at least); then
full sets decide. Beforehand, classes meet the earliest class of their MinHash buckets, which settles
large groups of variants of one line: once a line is known to go, it isn't looked up as the
later line of a pair any more, so that such groups' pairs aren't listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm import near_dup, setjoin
from rasterloom.llm import wordhash as wh
from rasterloom.llm.shared import bounded, bounded_batches, drop, free_names, materialize

BANDS, ROWS = 4, 3
BITS = tuple(f"bits_{i}" for i in range(4))
SCHEMA = "doc_id long, row long, line_no int, n int, key_1 long, key_2 long, bits_0 long, bits_1 long, bits_2 long, bits_3 long, prefix array<long>, " + ", ".join(f"band_{i} long" for i in range(BANDS))
OWN = ("doc_id", "row", "line_no")
NAMES = [x.strip().split()[0] for x in SCHEMA.split(",")]


def word_lines(texts: pa.Array) -> tuple[wh.Words, np.ndarray, np.ndarray]:
    """Words of a block, each word's text and its line number in that text."""
    words = wh.hash_words(texts)
    offsets, data = wh.text_buffers(texts)
    breaks = np.flatnonzero(data == 10)
    text = np.repeat(np.arange(len(texts)), np.diff(words.rows))
    number = np.searchsorted(breaks, words.starts) - np.searchsorted(breaks, offsets[:-1])[text]
    return words, text, number


def cut_lines(texts: pa.Array, owner: np.ndarray, line_no: np.ndarray) -> pa.Array:
    """Line ``line_no[i]`` of text ``owner[i]``, for each i; the rest of the texts isn't touched."""
    offsets, data = wh.text_buffers(texts)
    breaks = np.flatnonzero(data == 10)
    own = np.searchsorted(breaks, offsets)
    before, last = own[owner] + line_no - 1, own[owner + 1]
    padded = np.concatenate([breaks, [len(data)]])
    start = np.where(line_no == 0, offsets[owner], padded[np.maximum(before, 0)] + 1)
    end = np.where(before + 1 < last, padded[np.minimum(before + 1, len(breaks))], offsets[owner + 1])
    plain = data.tobytes()
    return pa.array([plain[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)], pa.binary()).cast(pa.string())


def line_sets(texts: pa.Array, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, line number, n, offsets, ordered keys) of the lines with words, in chunks."""
    words, text, number = word_lines(texts)
    if not len(words.hashes):
        return
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (number[1:] != number[:-1])])
    index, first = np.cumsum(new) - 1, np.flatnonzero(new)
    most = 1 << 20  # lines at a time: a line's index has 20 bits beside the 44 of a key
    for lo in range(0, len(first), most):
        a, b = first[lo], first[lo + most] if lo + most < len(first) else len(index)
        keys = np.sort((index[a:b] - lo).astype(np.uint64) << np.uint64(44) | setjoin.ordered_keys(words.hashes[a:b], ranks))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        line = (keys >> np.uint64(44)).astype(np.int64)
        lines = first[lo : lo + most]
        n = np.bincount(line, minlength=len(lines))
        yield text[lines], number[lines], n, np.concatenate([[0], np.cumsum(n)]), keys & np.uint64((1 << 44) - 1)


def sketch(docs: DataFrame, percent: int, counts: np.ndarray, common_words: int) -> DataFrame:
    """One row per line with words of ``docs`` (doc_id, row, text), as SCHEMA."""
    least, ranks, common = setjoin.least_size(percent), setjoin.rarity_ranks(counts), setjoin.first_common(counts, common_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, texts = batch.column(0), batch.column(1), batch.column(2)
            for a, b in wh.blocks(texts):
                for text, number, n, offsets, keys in line_sets(texts.slice(a, b - a), ranks):
                    at = offsets[:-1]
                    with np.errstate(over="ignore"):
                        key_1 = wh.mix(np.add.reduceat(wh.mix(keys + np.uint64(0x9E3779B97F4A7C15)), at))
                        key_2 = wh.mix(np.add.reduceat(wh.mix(keys ^ np.uint64(0xC2B2AE3D27D4EB4F)), at))
                    mixed = wh.mix(keys)
                    bit, word = np.uint64(1) << (mixed >> np.uint64(58)), mixed >> np.uint64(56) & np.uint64(3)
                    bits = [np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bit, np.uint64(0)), at) for k in range(4)]
                    chosen, ends = setjoin.prefix_keys(keys, offsets, n >= least, percent, common)  # shorter sets match equal ones only
                    prefix = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(chosen.view(np.int64)))
                    bands = near_dup.band_hashes(near_dup.row_signatures(keys, offsets, BANDS * ROWS), BANDS, ROWS)
                    take = pa.array(text + a)
                    columns = [ids.take(take).cast(pa.int64()), rows.take(take), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (key_1, key_2, *bits)), prefix]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(bands[:, i])) for i in range(BANDS))], NAMES)

    return docs.select("doc_id", "row", "text").mapInArrow(run, SCHEMA)


def words_of(places: DataFrame, docs: DataFrame, broadcast_bytes: int) -> DataFrame:
    """(id, words): the word hashes of the lines at ``places`` (id, at), taken from the documents again."""
    lines = places.select("id", "at.doc_id", "at.row", "at.line_no").groupBy("doc_id", "row").agg(F.collect_list(F.struct("line_no", "id")).alias("lines"))
    lines = materialize(lines, "lines")
    size = lines.agg(F.sum(F.size("lines") * 16 + 64)).first()[0] or 0
    with_text = docs.alias("d").join((F.broadcast(lines) if size <= broadcast_bytes else lines).alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.row") == F.col("l.row"))).select("d.text", "l.lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(0), batch.column(1)
            for a, b in wh.blocks(texts):
                asked = lists.slice(a, b - a)
                flat = asked.flatten()
                ids, line_no = flat.field("id"), flat.field("line_no").to_numpy()
                owner = np.repeat(np.arange(b - a), asked.value_lengths().to_numpy())
                lines = cut_lines(texts.slice(a, b - a), owner, line_no)
                words = wh.hash_words(lines)
                sets = [np.unique(words.hashes[p:q].view(np.int64)) for p, q in zip(words.rows[:-1], words.rows[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.list_(pa.int64()))], ["id", "words"])

    found = materialize(with_text.mapInArrow(run, "id long, words array<long>"), "words")
    drop(docs.sparkSession, lines)
    return found


def matched(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, broadcast_bytes: int) -> DataFrame:
    """The ids that an earlier class matches by full sets, of candidate ``pairs`` (a, b).

    Words are fetched once. Each later class is compared with its closest candidate first (by
    the bitmaps); only where that isn't a match do its other candidates follow, so that sets
    travel about once per line and not once per pair.
    """
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    places = materialize(classes.select("id", "at", "n", *BITS).join(bounded(ids, broadcast_bytes), "id"), "places")
    at = lambda c: places.select(F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("at", "n", *BITS)))
    swap = F.col("at_a") > F.col("at_b")
    apart = sum((F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in BITS), F.lit(0))
    both = pairs.join(at("a"), "a").join(at("b"), "b").where("at_a <> at_b").withColumn("far", apart)
    both = both.where(F.col("far") * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))
    ordered = materialize(both.select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("later"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("earlier"), "far"), "pairs")
    asked = ordered.select(F.col("later").alias("id")).unionAll(ordered.select("earlier")).distinct()
    words = words_of(places.select("id", "at").join(asked, "id"), docs, broadcast_bytes)
    one, two = words.select(F.col("id").alias("later"), F.col("words").alias("w")), words.select(F.col("id").alias("earlier"), F.col("words").alias("v"))
    common = F.size(F.array_intersect("w", "v"))

    def confirmed(some: DataFrame) -> DataFrame:
        same = some.join(one, "later").join(two, "earlier").where(common * 100 >= (F.size("w") + F.size("v") - common) * percent)
        return materialize(same.select(F.col("later").alias("id")).distinct(), "gone")

    closest = materialize(ordered.groupBy("later").agg(F.min_by("earlier", "far").alias("earlier")), "pairs")
    first = confirmed(closest)
    rest = ordered.select("later", "earlier").join(first.select(F.col("id").alias("later")), "later", "left_anti").join(closest, ["later", "earlier"], "left_anti").distinct()
    found = materialize(first.unionAll(confirmed(rest)).distinct(), "gone")
    drop(docs.sparkSession, words, ordered, closest, places)
    return found


def line_classes(docs: DataFrame, percent: int, common_words: int) -> DataFrame:
    """One row per distinct set of words: a number ``id``, the earliest line ``at`` and its sketch."""
    hashes = lambda batch: (wh.hash_words(batch.column(0).slice(a, b - a)).hashes for a, b in wh.blocks(batch.column(0)))
    counts = setjoin.bucket_counts(docs.select("text"), hashes)
    lines = materialize(sketch(docs, percent, counts, common_words), "lines")
    rest = [x for x in NAMES if x not in (*OWN, "key_1", "key_2")]
    first = lines.groupBy("key_1", "key_2").agg(F.min(F.struct(*OWN, *rest)).alias("c"))
    classes = materialize(first.select(F.monotonically_increasing_id().alias("id"), F.struct(*(F.col(f"c.{x}") for x in OWN)).alias("at"), *(F.col(f"c.{x}").alias(x) for x in rest)), "classes")
    drop(docs.sparkSession, lines)
    return classes


def halved() -> list[Column]:
    """A bitmap of 128 bits from that of 256: columns b1 and b2."""
    return [reduce(lambda x, y: x.bitwiseXOR(y), map(F.col, two)).alias(n) for n, two in (("b1", BITS[:2]), ("b2", BITS[2:]))]


def close(x: str, y: str, n: Column, m: Column, percent: int) -> Column:
    """The bitmaps of sets of n and m words, in columns with these prefixes, leave a match open."""
    far = F.bit_count(F.col(f"{x}b1").bitwiseXOR(F.col(f"{y}b1"))) + F.bit_count(F.col(f"{x}b2").bitwiseXOR(F.col(f"{y}b2")))
    return far * (100 + percent) <= (n + m) * (100 - percent)


def bucket_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class with the earliest class of its MinHash buckets."""
    bands = F.explode(F.array(*(f"band_{i}" for i in range(BANDS)))).alias("bucket")
    banded = classes.select("id", F.col("at.doc_id").alias("doc"), "n", *halved(), bands)
    first = lambda c: F.min_by(c, F.coalesce("doc", F.lit(-(2**63))))
    leaders = banded.groupBy("bucket").agg(first("id").alias("b"), first("n").alias("ln"), first("b1").alias("lb1"), first("b2").alias("lb2"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").drop("lo", "hi")
    led = banded.join(leaders, "bucket").where((F.col("id") != F.col("b")) & (F.least("n", "ln") * 100 >= F.greatest("n", "ln") * percent) & close("", "l", F.col("n"), F.col("ln"), percent))
    return materialize(led.select(F.col("id").alias("a"), "b").distinct(), "pairs")


def prefix_pairs(classes: DataFrame, gone: DataFrame, percent: int, broadcast_bytes: int) -> DataFrame:
    """(a, b): classes that share a prefix key and pass the filters, but those whose later line is ``gone``.

    The longer set takes part with its probing prefix, the shorter one with its indexing
    prefix. A row has two bitmaps and one long: size (23 bits), place (13), document order (26)
    and whether it is gone (1). Each errs to the safe side: sizes above the bound pass the
    filters, places stop there, and equal orders decide nothing.
    """
    ends = classes.agg(F.min("at.doc_id").cast("double"), F.max("at.doc_id").cast("double")).first()
    low, span = ends[0] or 0.0, max(1.0, (ends[1] or 0.0) - (ends[0] or 0.0))
    order = F.coalesce(F.floor((F.col("at.doc_id").cast("double") - low) / span * (2**26 - 1)), F.lit(0)).cast("long")
    most = 2**23 - 1
    marked = classes.join(bounded(gone.select("id", F.lit(1).alias("gone")), broadcast_bytes), "id", "left")
    packed = F.shiftleft(F.least("n", F.lit(most)).cast("long"), 40) + F.shiftleft(order, 1) + F.coalesce("gone", F.lit(0))
    rows = marked.select("id", *halved(), packed.alias("set"), F.explode("prefix").alias("key"))
    rows = rows.select(F.col("key").bitwiseAND((1 << 44) - 1).alias("token"), "id", "b1", "b2", (F.col("set") + F.shiftleft(F.shiftright("key", 44), 27)).alias("meta"))
    part = lambda s, shift, bits: F.shiftright(F.col(f"{s}.meta"), shift).bitwiseAND((1 << bits) - 1)
    size, place, doc, flag = (lambda s, a=a: part(s, *a) for a in ((40, 23), (27, 13), (1, 26), (0, 1)))
    # the later of two lines isn't removed yet (of lines of one document, either)
    live = F.when(doc("x") > doc("y"), flag("x")).when(doc("x") < doc("y"), flag("y")).otherwise(flag("x") * flag("y")) == 0
    longer = (size("x") > size("y")) | ((size("x") == size("y")) & (F.col("x.id") > F.col("y.id")))
    huge = size("x") == most
    # the shorter set's indexing prefix; tested in the join, so that both sides are one exchange
    indexed = size("y") * (2 * percent) <= (size("y") - place("y")) * (100 + percent)
    near = huge | (indexed & close("x.", "y.", size("x"), size("y"), percent) & setjoin.may_match(size("x"), place("x"), size("y"), place("y"), percent))
    pairs = rows.alias("x").join(rows.alias("y"), (F.col("x.token") == F.col("y.token")) & near & longer & live)
    return materialize(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "pairs")


def kept_lines(docs: DataFrame, percent: int = 80, broadcast_bytes: int = 32 << 20, common_words: int = 100_000) -> DataFrame:
    """(doc_id, row, lines): the numbers of the lines with words that stay, for documents that keep any.

    docs: doc_id, row, text, with ``row`` telling texts of one doc_id apart. Tables of up to
    ``broadcast_bytes`` of ids or line numbers are broadcast; larger ones are joined by a
    shuffle. Words whose bucket occurs more than ``common_words`` times join in pairs.
    """
    bounded_batches(docs.sparkSession)
    classes = line_classes(docs, percent, common_words)
    joined = classes.where(F.col("n") >= setjoin.least_size(percent))
    near = matched(bucket_pairs(joined, percent), classes, docs, percent, broadcast_bytes)
    gone = near.unionAll(matched(prefix_pairs(joined, near, percent, broadcast_bytes), classes, docs, percent, broadcast_bytes)).distinct()
    kept = classes.select("id", "at").join(bounded(materialize(gone, "gone"), broadcast_bytes), "id", "left_anti")
    out = materialize(kept.groupBy("at.doc_id", "at.row").agg(F.collect_list("at.line_no").alias("lines")), "kept")
    drop(docs.sparkSession, classes)
    return out


#: What separates words; a line of nothing else has none and stays.
BLANK = " \t\n\v\f\r"


def drop_lines(docs: DataFrame, percent: int = 80, counted: str | None = "n_removed") -> DataFrame:
    """``docs`` without the lines that an earlier line matches.

    docs: doc_id, text and any further columns, which stay; ``n_chars``, if there, is
    counted anew. The number of removed lines is a last column named ``counted``, with an
    underline more as long as ``docs`` has a column of that name in any case; None: no such
    column. A null text stays null. Rows equal in doc_id and text count as one
    document, which keeps the same lines in each row. A document may end up with an empty
    text; no row is dropped. An empty table gives an empty result.
    """
    row, own_id, own_row, lines = free_names(docs, "row", "own_id", "own_row", "kept")
    marked = docs.withColumn(row, F.xxhash64("text"))
    kept = kept_lines(marked.select("doc_id", F.col(row).alias("row"), "text"), percent).select(F.col("doc_id").alias(own_id), F.col("row").alias(own_row), F.col("lines").alias(lines))
    joined = marked.join(kept, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(row) == F.col(own_row)), "left").select(*docs.columns, lines)
    names = [*docs.columns, *(free_names(docs, counted) if counted else ())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.IntegerType()) for x in names[len(docs.columns) :])])
    where, n_chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, lists = batch.columns
            texts, counts = columns[where].to_pylist(), np.zeros(len(batch), np.int32)
            for i, numbers in enumerate(lists.to_pylist()):
                if texts[i]:
                    stay, parts = set(numbers or ()), texts[i].split("\n")
                    left = [x for k, x in enumerate(parts) if k in stay or not x.strip(BLANK)]
                    if len(left) < len(parts):
                        texts[i], counts[i] = "\n".join(left), len(parts) - len(left)
            columns[where] = pa.array(texts, columns[where].type)
            if n_chars is not None and counts.any():
                sizes = columns[n_chars].to_pylist()
                for i in np.flatnonzero(counts):
                    sizes[i] = len(texts[i])
                columns[n_chars] = pa.array(sizes, columns[n_chars].type)
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(counts)] if counted else [])], names)

    return joined.mapInArrow(run, schema)
