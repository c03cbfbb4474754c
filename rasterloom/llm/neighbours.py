"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: vectors, scaled to unit length, are turned by learned rotations (principal axes of a
bounded sample, refined by iterative quantisation; further random rotations are refined
the same way for longer codes) and each coordinate's sign is a bit.

Index: a code is split into substrings of 16 bits, and every substring has its own table from
value to rows. By the pigeonhole principle a code within Hamming distance R of a query lies within
R // m of it in one of m substrings at least (with the sharper bound of the first
R % m + 1 substrings), so probing all values in those small radii retrieves every code within R.
All rows that the probes retrieve are ranked by the exact cosine.

The radius is measured: a bounded sample of vectors is searched exhaustively once, and R is the least
radius whose probes retrieve the stated share of their nearest neighbours.

Every task indexes the rows of its own partition, block by block. Queries are a stated set:
blocks of ``block_queries`` of them go to the tasks, one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.samples import thinned
from rasterloom.llm.shared import bounded_batches, materialize

SUB = 16  # bits of a substring: its table has 65536 values
_POP = np.array([bin(i).count("1") for i in range(1 << SUB)], np.uint8)


@cache
def masks(radius: int) -> np.ndarray:
    """All substring values of up to ``radius`` bits."""
    return np.flatnonzero(_POP <= radius).astype(np.uint16)


@dataclass
class Index:
    rotations: list[np.ndarray]
    radius: int

    @property
    def bits(self) -> int:
        return sum(r.shape[1] for r in self.rotations)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Codes as an array (rows, bits / SUB) of substrings."""
        return np.packbits(np.concatenate([unit @ r for r in self.rotations], axis=1) > 0, axis=1).view(">u2").astype(np.uint16)


def needed_radius(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The least radius whose probes of ``code`` retrieve each row of ``codes``."""
    return (_POP[codes ^ code].astype(np.int64) * len(code) + np.arange(len(code))).min(axis=1)


def usable(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a finite, non-zero vector of ``width`` parts (else the most common number), and their vectors."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if width is None:
        width = int(np.bincount(lengths[lengths > 0]).argmax()) if (lengths > 0).any() else 0
    good = np.flatnonzero(lengths == width) if width else np.zeros(0, np.int64)
    if not len(good):
        return good, np.zeros((0, width))
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null parts become NaN
    starts = np.cumsum(lengths) - lengths
    x = flat[starts[good][:, None] + np.arange(width)]
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return good[ok], x[ok]


def _fit(column: str) -> Column:
    """The vector is finite and not zero, as in ``usable``."""
    finite = F.forall(column, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(column, lambda v: v != 0), F.lit(False))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def learn(x: np.ndarray, code_bits: int = 256, rounds: int = 20, seed: int = 5) -> Index:
    """Rotations by iterative quantisation; the radius is that of a whole code."""
    rng = np.random.default_rng(seed)
    unit = x / norms(x)[:, None]
    width = unit.shape[1]
    step = -(-width // SUB) * SUB
    axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1]
    rotations = []
    for _ in range(max(1, code_bits // step)):
        turn = np.linalg.qr(rng.normal(size=(step, step)))[0][:width]
        v = unit @ axes
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v, full_matrices=False)
            turn = (u @ w).T
        rotations.append(axes @ turn)
    index = Index(rotations, 0)
    index.radius = index.bits
    return index


def measured_radius(vectors: DataFrame, index: Index, ids: np.ndarray, x: np.ndarray, k: int, reach: float) -> int:
    """The least radius whose probes retrieve the share ``reach`` of the k nearest rows of each of some vectors.

    Every row is compared with every one of them; a task hands on its k nearest of each.
    """
    width, length = x.shape[1], norms(x)
    shared = vectors.sparkSession.sparkContext.broadcast((index, ids, x, length, index.codes(x / length[:, None])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, q_ids, q, q_length, q_codes = shared.value
        kept: list[list[tuple]] = [[] for _ in q_ids]
        for batch in batches:
            ids, x = _taken(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), width)
            if not len(ids):
                continue
            own = norms(x)
            codes, scores = index.codes(x / own[:, None]), (x @ q.T) / (own[:, None] * q_length)
            scores[ids[:, None] == q_ids] = -2
            for i in range(len(q_ids)):
                near = np.argpartition(-scores[:, i], min(k, len(ids)) - 1)[:k]
                need = needed_radius(codes[near], q_codes[i])
                kept[i] = sorted(kept[i] + [(s, -v, n) for s, v, n in zip(scores[near, i].tolist(), ids[near].tolist(), need.tolist(), strict=True) if s > -2], reverse=True)[:k]
        rows = [(i, -v, s, n) for i, near in enumerate(kept) for s, v, n in near]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["probe", "vec_id", "score", "need"])

    near = vectors.where("vec_id is not null").select("vec_id", "embedding").mapInArrow(run, "probe long, vec_id long, score double, need long")
    best = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id")
    needs = near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).select("need").toArrow().column(0).to_numpy()
    return int(np.quantile(needs, reach, method="higher")) if len(needs) else index.bits


class Block:
    """The tables of one block of codes, for substrings of SUB bits."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(c, minlength=1 << SUB))]) for c in codes.T]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows that pigeonhole probing retrieves: all within Hamming distance ``radius``, and others."""
        m, n = self.codes.shape[1], len(self.codes)
        if radius >= m * SUB:
            return np.arange(n)
        small, extra = divmod(radius, m)
        found = np.zeros(n, bool)
        for s in range(m):
            r = small if s <= extra else small - 1
            if r < 0:
                continue
            values = masks(r) ^ code[s]
            first = self.starts[s][values]
            count = self.starts[s][values.astype(np.int64) + 1] - first
            some = np.flatnonzero(count)
            first, count = first[some], count[some]
            at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            found[self.order[s][at]] = True
        return np.flatnonzero(found)


def best(block: Block, ids: np.ndarray, x: np.ndarray, length: np.ndarray, queries: tuple, k: int, radius: int) -> Iterator[tuple]:
    """(query_id, vec_id, score, None) of each query's k best rows of a block, and how many its probes retrieved."""
    q_ids, q, q_length, q_codes = queries
    for i, query in enumerate(q_ids):
        rows = block.within(q_codes[i], radius)
        yield query, None, None, len(rows)
        rows = rows[ids[rows] != query]
        if not len(rows):
            continue
        score = (x[rows] * q[i]).sum(axis=1) / (length[rows] * q_length[i])
        if len(rows) > 4 * k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= least], score[score >= least]
        for j in np.lexsort((ids[rows], -score))[:k]:
            yield query, ids[rows[j]], score[j], None


FOUND = "query_id long, vec_id long, score double, touched long"


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, sample: int = 4096, code_bits: int = 256, reach: float = 0.95, probes: int = 200, block_queries: int = 20_000, block_rows: int = 1 << 16) -> DataFrame:
    """query_id, rank, vec_id, score, rows_touched: the k best rows found for each query.

    vectors, queries: vec_id long, embedding array<float>; a row isn't a candidate of a query
    with its own vec_id. Rows whose vector is null, empty, zero, of another length than most
    or has null or non-finite parts take no part, nor do rows without vec_id. Of candidates with
    one vec_id the best counts; of queries with one vec_id the least vector asks. Score: the cosine
    in double precision; ties go to the smaller vec_id. The rotations come from about ``sample`` rows
    and the radius from ``probes`` of them, of whose nearest rows it retrieves the share ``reach``;
    every row is indexed. ``rows_touched``: how many rows the query's probes retrieved, itself
    included. A query that finds fewer than k rows within the radius is searched again among
    all rows. An empty table gives an empty result.
    """
    bounded_batches(vectors.sparkSession)
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double, rows_touched long"
    fit = vectors.where("vec_id is not null").where(_fit("embedding")).select("vec_id", "embedding")
    some = thinned(fit, ["vec_id"], sample).toArrow()
    if not len(some):  # no row, or few vec_ids, none of which the hash chose
        some = fit.limit(sample).toArrow()
    if not len(some):
        return spark.createDataFrame([], schema)
    some = some.sort_by("vec_id")
    at, x = usable(some.column("embedding").combine_chunks())
    index, width = learn(x, code_bits), x.shape[1]
    chosen = np.unique(np.linspace(0, len(x) - 1, min(probes, len(x))).astype(np.int64))
    index.radius = measured_radius(vectors, index, some.column("vec_id").to_numpy()[at][chosen], x[chosen], k, reach)
    asked = queries.where("vec_id is not null").where(_fit("embedding")).where(F.size("embedding") == width).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    parts = max(1, -(-asked.count() // block_queries))
    best_of = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("touched").alias("touched"))
        once = once.withColumn("rows_touched", F.sum("touched").over(Window.partitionBy("query_id"))).where("vec_id is not null")
        return once.withColumn("rank", F.row_number().over(best_of)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "rows_touched")

    results = []
    for part in range(parts):
        rows = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)).toArrow()
        ids, q = _taken(rows.column("vec_id").to_numpy(), rows.column("embedding"), width)
        near = materialize(ranked(_scan(vectors, index, ids, q, k, index.radius, block_rows)), "neighbours")
        full = near.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
        done = set(full.toArrow().column(0).to_pylist())
        left = np.array([x not in done for x in ids.tolist()], bool)
        if left.any():
            again = materialize(ranked(_scan(vectors, index, ids[left], q[left], k, index.bits, block_rows)), "neighbours")
            near = near.join(again.select("query_id").distinct(), "query_id", "left_anti").select(*near.columns).unionAll(again)
        results.append(near)
    out = results[0]
    for more in results[1:]:
        out = out.unionAll(more)
    return out


def _taken(ids: np.ndarray, column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of rows with a usable vector of ``width`` parts."""
    good, x = usable(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, width)
    return np.asarray(ids)[good].astype(np.int64), x


def _scan(vectors: DataFrame, index: Index, q_ids: np.ndarray, q: np.ndarray, k: int, radius: int, block_rows: int) -> DataFrame:
    """Each task's k best rows for each query of a block."""
    if not len(q_ids):
        return vectors.sparkSession.createDataFrame([], FOUND)
    length = norms(q)
    width = q.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast((q_ids, q, length, index.codes(q / length[:, None])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value

        def answers(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            # equal vectors rank by id alone: the k + 1 smallest ids of each are enough
            order = np.lexsort((ids, *x.T[::-1]))
            ids, x = ids[order], x[order]
            new = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])
            first = np.flatnonzero(new)
            place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
            ids, x = ids[place <= k], x[place <= k]
            own = norms(x)
            block = Block(index.codes(x / own[:, None]))
            rows = list(best(block, ids, x, own, queries, k, radius))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["query_id", "vec_id", "score", "touched"])

        held_ids, held, n = [], [], 0
        for batch in batches:
            ids, x = _taken(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), width)
            held_ids.append(ids)
            held.append(x)
            n += len(ids)
            if n >= block_rows:
                yield answers(np.concatenate(held_ids), np.concatenate(held))
                held_ids, held, n = [], [], 0
        if n:
            yield answers(np.concatenate(held_ids), np.concatenate(held))

    return vectors.where("vec_id is not null and embedding is not null").select("vec_id", "embedding").mapInArrow(run, FOUND)
