"""Parts of exact set-similarity joins: rarity order, prefixes and filters.

Two sets of sizes m and n have Jaccard similarity of percent/100 or more only if they share
a token among the first ``n - ceil(percent * n / 100) + 1`` of each, in any common order
(prefix filter), if ``100 * m >= percent * n`` for m <= n (length filter), and if what can
still be shared from a common token on is enough (positional filter). Rare tokens come
first in the order, so few sets share a prefix token.

Rarity is counted for every token of the input in a table of fixed size, by hash: tokens of
one bucket count together. That bounds the table whatever the vocabulary; the order stays
one common order, so no pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import wordhash as wh

BITS = 17
#: Places beyond this count as this one; as places only tighten filters, that loses nothing.
LAST_PLACE = 2**13 - 1


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def bucket_counts(rows: DataFrame, tokens: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """How many tokens of all ``rows`` fall into each bucket; ``tokens`` yields hashes of a batch.

    Each task adds up one table of 2**BITS counts; the driver gets 2**BITS rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for hashes in tokens(batch):
                count += np.bincount(bucket(hashes), minlength=1 << BITS)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["bucket", "n"])

    counts = rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << BITS, np.int64)
    total[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return total


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of every bucket, rarest first."""
    ranks = np.empty(1 << BITS, np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(1 << BITS, dtype=np.uint64)
    return ranks


def first_common(counts: np.ndarray, most: int) -> np.uint64:
    """The least ordered key whose bucket holds more than ``most`` tokens."""
    return np.uint64(int((counts <= most).sum())) << np.uint64(44 - BITS)


def ordered_keys(hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """44-bit token keys whose order is the rarity order."""
    return ranks[bucket(hashes)] << np.uint64(44 - BITS) | (hashes & np.uint64((1 << (44 - BITS)) - 1))


def least_size(percent: int) -> int:
    """The least size of a set that can match a larger one: n of n + 1 tokens are percent/100 or more."""
    return -(-percent // (100 - percent)) if percent < 100 else 2**31 - 1


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def prefix_keys(keys: np.ndarray, offsets: np.ndarray, joined: np.ndarray, percent: int, common: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The join keys of the ``joined`` sets between offsets, each with its place above 44 bits, and their offsets.

    ``keys``: ordered keys of each set. A prefix token below ``common`` is a key. From there on,
    a token meets only with a second one: sets with a link and two shared tokens share their
    first two among the prefix of one token more, so a common token's rows are split by the token
    that comes next in the order. Sets whose match may share one token alone keep that key, too.
    """
    n = np.diff(offsets)
    line = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(keys)) - np.repeat(offsets[:-1], n)
    length = np.where(joined, prefix_length(n, percent), 0)
    at = np.flatnonzero(place < length[line])
    single = (n + -(-percent * n // 100)) * percent <= 100 + percent
    plain = at[(keys[at] < common) | single[line[at]]]
    pairs = at[keys[at] >= common]
    left = np.minimum(length + 1, n)[line[pairs]] - 1 - place[pairs]
    first = np.repeat(pairs, left)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(left) - left, left)
    both = wh.mix(wh.mix(keys[second]) + keys[first]) >> np.uint64(20)
    found, owner = np.concatenate([keys[plain], both]), np.concatenate([plain, first])
    found = np.minimum(place[owner], LAST_PLACE).astype(np.uint64) << np.uint64(44) | found
    if len(first):
        order = np.argsort(line[owner], kind="stable")
        found, owner = found[order], owner[order]
    return found, np.concatenate([[0], np.cumsum(np.bincount(line[owner], minlength=len(n)))])


def may_match(a_size: Column, a_at: Column, b_size: Column, b_at: Column, percent: int) -> Column:
    """Length and positional filters for two sets with a common token at a_at and b_at."""
    small, large = F.least(a_size, b_size), F.greatest(a_size, b_size)
    most = F.least(a_size - a_at, b_size - b_at)
    return (small * 100 >= large * percent) & (most * (100 + percent) >= (a_size + b_size) * percent)
