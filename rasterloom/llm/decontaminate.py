"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words: the words at its marked positions are
hashed together, the others are ignored, so a substituted word at an ignored position
doesn't hide a match. Seeds of benchmark items are looked up in the seeds of every text;
around each hit, text and item are laid side by side without gaps. A document holds an item's
passage if some segment there of at least ``min_words`` words, from an equal word to an equal
word, or the whole item, has three equal words of four at least: a matching word counts 1, a
substituted one -3, and the sum is 0 or more. The segment of largest sum is reported.

Where a hit lies is up to the seeds: passages of 13 words or more with up to two substitutions,
and whole items of 8 words or more with one, always have one; with more substitutions most do.
Items of fewer words must be equal. Words are runs of ASCII letters, digits and non-ASCII
characters, without regard to case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import wordhash as wh
from rasterloom.llm.shared import bounded_batches

#: Marked positions are 1: six, seven and six of them.
MASKS = ("11101011", "1101100111", "111001011")
MISMATCH = 3
#: Text of a block of items: its seeds, some 80 bytes a word, go to every worker.
BLOCK_BYTES = 4 << 20

SCHEMA = "doc_id long, item_id long, doc_start long, item_start long, length long, matches long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


@dataclass
class Seeds:
    """Sorted seed hashes of a block of items, with the item and word index of each."""

    hashes: np.ndarray
    items: np.ndarray
    at: np.ndarray
    filter: np.ndarray
    words: np.ndarray
    bounds: np.ndarray  # item i has words[bounds[i]:bounds[i + 1]]
    ids: list[int | None]
    short: list[int]


def masked(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Seed hashes at every start; only starts with a whole span are given."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, salt + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j, p in enumerate(wh.powers(0xC2B2AE3D27D4EB4F, len(mask))):
            if mask[j] == "1":
                acc += hashes[j : j + n] * p
    return wh.mix(acc)


_FILTER_BITS = 22


def make_seeds(ids: list[int | None], texts: list[str]) -> Seeds:
    words = [wh.hash_words(pa.array([t]), wh.MARKS).hashes for t in texts]
    h, items, at = [], [], []
    short: dict[int, list[tuple[int, int]]] = {}
    spans = sorted(map(len, MASKS))
    for i, w in enumerate(words):
        if 0 < len(w) < spans[0]:  # too short for a mask: looked up by its whole sequence
            short.setdefault(len(w), []).append((i, 0))
        elif 0 < len(w) < spans[-1]:  # one word may break all of its masks: looked up by its halves, too
            half = len(w) // 2
            short.setdefault(half, []).extend([(i, 0), (i, len(w) - half)])
        for salt, mask in enumerate(MASKS):
            s = masked(w, mask, salt)
            h.append(s)
            items.append(np.full(len(s), i))
            at.append(np.arange(len(s)))
    for length, which in short.items():
        for i, begin in which:
            h.append(masked(words[i][begin : begin + length], "1" * length, 100 + length))
            items.append(np.array([i]))
            at.append(np.array([begin]))
    h, items, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, items, at))
    order = np.argsort(h, kind="stable")
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return Seeds(h[order], items[order], at[order], seen, np.concatenate([np.zeros(0, np.uint64), *words]), bounds, ids, sorted(short))


def best_segment(same: np.ndarray, least: int, whole: bool) -> tuple[int, int, int] | None:
    """Start, length and matches of the passage of largest score on a diagonal, None for none.

    A passage has at least ``least`` words, begins and ends with equal ones and has a score of 0
    or more; if ``same`` is the ``whole`` item, all of it is one at such a score, too.
    """
    n = len(same)
    if n < least:
        return None
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
    far = MISMATCH * n + n + 1
    low = np.minimum.accumulate(np.where(same, total[:-1], far))[: n - least + 1]
    gain = np.where(same[least - 1 :], total[least:] - low, -far)
    at = int(np.argmax(gain))
    if gain[at] >= 0:
        begin, end = int(np.argmax(same[: at + 1] & (total[: at + 1] == low[at]))), at + least
    elif whole and total[-1] >= 0:
        begin, end = 0, n
    else:
        return None
    return begin, end - begin, int(same[begin:end].sum())


#: Diagonals, or words on diagonals, that are held at once.
CHUNK = 1 << 20


def _slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices of about ``most`` by sum of ``sizes``, one entry at least."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        before = ends[begin] - sizes[begin]
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(begin, end)
        begin = end


def _ramp(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``sizes[i]`` consecutive numbers from ``starts[i]`` on, for each i."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _diagonals(hashes: np.ndarray, rows: np.ndarray, seeds: Seeds) -> Iterator[np.ndarray]:
    """Columns (row, item, shift) of where an item's first word lies if a seed hit is real.

    Distinct within each array, and nearly always there is one array only.
    """
    longest, held, n = int(np.diff(seeds.bounds).max(initial=0)), [], 0
    span = longest + len(hashes) + 1

    def distinct() -> np.ndarray:
        codes = np.unique(np.concatenate(held))
        pair, shift = np.divmod(codes, span)
        return np.stack([*np.divmod(pair, len(seeds.ids)), shift - longest])

    for mask, salt in [(mask, salt) for salt, mask in enumerate(MASKS)] + [("1" * k, 100 + k) for k in seeds.short]:
        h = masked(hashes, mask, salt)
        hits = np.flatnonzero(seeds.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        low = np.searchsorted(seeds.hashes, h[hits], "left")
        number = np.searchsorted(seeds.hashes, h[hits], "right") - low
        hits, low, number = hits[number > 0], low[number > 0], number[number > 0]
        for some in _slices(number, CHUNK):
            k = _ramp(low[some], number[some])
            place = np.repeat(hits[some], number[some])
            row = np.searchsorted(rows, place, "right") - 1
            held.append((row * len(seeds.ids) + seeds.items[k]) * span + (place - seeds.at[k] + longest))
            n += len(k)
            if n >= CHUNK:
                yield distinct()
                held, n = [], 0
    if held:
        yield distinct()


def overlaps(hashes: np.ndarray, rows: np.ndarray, seeds: Seeds, min_words: int) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, doc word, item word, length, matches): each row's best segment per item.

    Diagonals are compared as arrays. A passage has three equal words of four and ``min_words`` words or
    all of its item's, so only diagonals with as many equal words are looked at one by one.
    """
    found: dict[tuple[int, int], tuple] = {}
    for row, item, shift in _diagonals(hashes, rows, seeds):
        size = seeds.bounds[item + 1] - seeds.bounds[item]
        begin, end = np.maximum(shift, rows[row]), np.minimum(shift + size, rows[row + 1])
        least = np.minimum(min_words, size)
        long = end - begin >= least
        row, item, shift, size, begin, end, least = (x[long] for x in (row, item, shift, size, begin, end, least))
        for some in _slices(end - begin, CHUNK):
            length = (end - begin)[some]
            own = (seeds.bounds[item] + begin - shift)[some]
            same = hashes[_ramp(begin[some], length)] == seeds.words[_ramp(own, length)]
            first = np.cumsum(length) - length
            equal = np.add.reduceat(same, first, dtype=np.int64)
            for i in np.flatnonzero(4 * equal >= 3 * least[some]).tolist():
                k = some.start + i
                passage = best_segment(same[first[i] : first[i] + length[i]], int(least[k]), length[i] == size[k])
                if passage is not None:
                    start, n, matches = passage
                    at = int(begin[k]) + start
                    new, pair = (matches, n, int(rows[row[k]]) - at, at - int(shift[k])), (int(row[k]), int(item[k]))
                    if pair not in found or new > found[pair]:
                        found[pair] = new
    return [(row, item, -at, item_at, length, matches) for (row, item), (matches, length, at, item_at) in sorted(found.items())]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, block_items: int = 20_000) -> DataFrame:
    """One row per document row and benchmark item that it holds a passage of.

    docs: doc_id, text; benchmark: item_id, text. Null, empty and white-space texts match
    nothing on either side; repeated rows give repeated results (equal items once each);
    further columns are ignored; empty tables give an empty result. Ties of segments go to
    the earliest in the text.

    The benchmark is a stated query set: blocks of about ``block_items`` items or BLOCK_BYTES
    bytes, whichever is less, go to the tasks, one after another, and each block meets all documents.
    """
    bounded_batches(docs.sparkSession)
    whole: DataFrame | None = None
    for seeds in _seed_blocks(benchmark, block_items):
        part = _search(docs, seeds, min_words)
        whole = part if whole is None else whole.unionAll(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if whole is None else whole


def _seed_blocks(benchmark: DataFrame, block_items: int) -> Iterator[Seeds]:
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // block_items), -(-size // BLOCK_BYTES), min(n, 1))
    for k in range(parts):
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        taken = sorted(some.collect(), key=lambda x: (x.item_id is not None, x.item_id or 0, x.text))
        yield make_seeds([x.item_id for x in taken], [x.text for x in taken])


def _search(docs: DataFrame, seeds: Seeds, min_words: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in wh.blocks(texts):
                words = wh.hash_words(texts.slice(a, b - a), wh.MARKS)
                rows = [(ids[a + r].as_py(), known.ids[i], *rest) for r, i, *rest in overlaps(words.hashes, words.rows, known, min_words)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def clean_documents(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, block_items: int = 20_000, keep_without_id: bool = True) -> DataFrame:
    """The rows of ``docs`` that hold no passage of ``benchmark``, with all their columns.

    Each row is decided by its own text, whatever other rows share its doc_id. A row without
    doc_id stays, unless ``keep_without_id`` is off: then it is decided like any other.
    """
    bounded_batches(docs.sparkSession)
    left = docs
    for seeds in _seed_blocks(benchmark, block_items):
        left = _without(left, seeds, min_words, keep_without_id)
    return left


def _without(docs: DataFrame, seeds: Seeds, min_words: int, keep_without_id: bool) -> DataFrame:
    """The rows of ``docs`` that hold no passage of a block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(seeds)
    at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts, keep = batch.column(text_at), np.ones(len(batch), bool)
            for a, b in wh.blocks(texts):
                words = wh.hash_words(texts.slice(a, b - a), wh.MARKS)
                keep[[a + r for r, *_ in overlaps(words.hashes, words.rows, known, min_words)]] = False
            if keep_without_id:
                keep |= batch.column(at).is_null().to_numpy(zero_copy_only=False)
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
