"""Text quality by a factorisation machine.

Features of a text: its words hashed to buckets (values: log counts, scaled to unit
length), structure statistics (shares of byte classes, word and line lengths, repetition)
and metadata (its size), standardised and clipped. The machine adds a bias, a linear term
and all pairwise interactions, whose weights are inner products of low-rank factors:

    sum over pairs <v_i, v_j> x_i x_j  =  1/2 sum over f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so a score takes time linear in the number of features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import wordhash as wh
from rasterloom.llm.samples import folded, thinned
from rasterloom.llm.shared import bounded_batches

_CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "comma", "symbol", "quote", "high")
_CLASS = np.full(256, 7, np.int64)
for _name, _chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", b" \t\r\v\f"), ("line", b"\n"), ("stop", b".!?"), ("comma", b",;:"), ("quote", b"'\"()-"), ("high", range(128, 256))):
    _CLASS[list(_chars)] = _CLASSES.index(_name)

#: Structure statistics and metadata, in the order of ``structure``'s columns.
STRUCTURE = (*_CLASSES, "log_bytes", "log_words", "word_bytes", "long_words", "distinct_words", "top_word", "line_words", "empty")


def word_features(words: wh.Words, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each text with their values, and the texts' offsets."""
    rows = np.repeat(np.arange(len(words.rows) - 1, dtype=np.uint64), np.diff(words.rows))
    keys = np.sort(rows << np.uint64(32) | words.hashes >> np.uint64(64 - bits))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    offsets = np.searchsorted(keys >> np.uint64(32), np.arange(len(words.rows), dtype=np.uint64))
    value = np.log1p(count)
    return (keys & np.uint64((1 << 32) - 1)).astype(np.int64), _unit(value, offsets), offsets


def _unit(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return value / np.sqrt(np.maximum(sums(value * value, offsets), 1e-12)).repeat(np.diff(offsets))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows between offsets (0 for none)."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(values, offsets[:-1][some], axis=0)
    return out


def structure(texts: pa.Array, words: wh.Words, values: np.ndarray, offsets: np.ndarray, keys_per_text: np.ndarray) -> np.ndarray:
    """The STRUCTURE columns of each text, raw."""
    at, data = wh.text_buffers(texts)
    n, size = len(texts), np.diff(at)
    classes = np.bincount(np.repeat(np.arange(n) * len(_CLASSES), size) + _CLASS[data], minlength=n * len(_CLASSES)).reshape(n, -1)
    number = np.diff(words.rows)
    length = (words.ends - words.starts).astype(float)
    per, each = np.maximum(size, 1), np.maximum(number, 1)
    top = np.zeros(n)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        top[some] = np.maximum.reduceat(values, offsets[:-1][some])
    stats = [np.log1p(size), np.log1p(number), sums(length, words.rows) / each, sums((length > 12).astype(float), words.rows) / each, keys_per_text / each, top, np.log1p(number / (classes[:, 4] + 1)), (number == 0).astype(float)]
    return np.concatenate([classes / per[:, None], np.stack(stats, axis=1)], axis=1)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bits: int

    def dense(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.mean) / self.scale, -4, 4) / len(STRUCTURE) ** 0.5

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probabilities of quality 1, for a block of texts."""
        words = wh.hash_words(texts)
        keys, values, offsets = word_features(words, self.bits)
        x = self.dense(structure(texts, words, values, offsets, np.diff(offsets)))
        nw = 1 << self.bits
        w, v = self.linear, self.factors
        linear = sums(w[keys] * values, offsets) + x @ w[nw:]
        part = v[keys] * values[:, None]
        total = sums(part, offsets) + x @ v[nw:]
        squares = sums((part * part).sum(axis=1), offsets) + (x * x) @ (v[nw:] ** 2).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares), -30, 30)))


def train(texts: list[str], labels: list[int], bits: int = 15, rank: int = 8, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, seed: int = 11) -> Machine:
    """Fit by AdaGrad on single texts, in a random order that ``seed`` fixes."""
    rng = np.random.default_rng(seed)
    rows, raws = [], []
    for text in texts:
        one = pa.array([text])
        words = wh.hash_words(one)
        keys, values, offsets = word_features(words, bits)
        rows.append((keys, values))
        raws.append(structure(one, words, values, offsets, np.diff(offsets))[0])
    raw, y = np.stack(raws), np.array(labels, float)
    nw = 1 << bits
    size = nw + len(STRUCTURE)
    share = np.clip(y.mean(), 0.01, 0.99)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, rank)), raw.mean(axis=0), np.maximum(raw.std(axis=0), 1e-6), bits)
    dense, last = m.dense(raw), np.arange(nw, size)
    gw, gv, gb = np.full(size, 1e-2), np.full((size, rank), 1e-2), 1e-2
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = np.concatenate([rows[i][0], last]), np.concatenate([rows[i][1], dense[i]])
            w, v = m.linear[at], m.factors[at]
            total = x @ v
            s = m.bias + x @ w + 0.5 * (total @ total - (x * x) @ (v * v).sum(axis=1))
            g = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[i]
            dw = g * x + decay * w
            dv = g * x[:, None] * (total - v * x[:, None]) + decay * v
            gw[at] += dw * dw
            gv[at] += dv * dv
            gb += g * g
            m.linear[at] = w - rate * dw / np.sqrt(gw[at])
            m.factors[at] = v - rate * dv / np.sqrt(gv[at])
            m.bias -= rate * g / gb**0.5
    return m


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, sample_bytes: int = 64 << 20) -> Machine | None:
    """Train on about ``sample`` labelled rows: docs (doc_id, text), labels (doc_id, quality).

    The sample of labels is bounded, so its join with the documents broadcasts it; if their texts are
    longer than about ``sample_bytes`` together, fewer are taken. None
    where there is no labelled text. A null text is empty; rows without label are left out.
    However often a doc_id is repeated, only its first text in byte order is learned from, once for
    each of its labels.
    """
    some = thinned(labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality"), ["doc_id"], sample).distinct()
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = thinned(found, [F.col("doc_id"), F.lit("again")], sample, "text", sample_bytes).collect()
    rows.sort(key=lambda x: (x.doc_id, x.quality, x.text or ""))
    return train([x.text or "" for x in rows], [x.quality for x in rows]) if rows else None


def score(docs: DataFrame, machine: Machine | None, limit: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for each row of ``docs`` (doc_id, text).

    A null text is empty and gets a score as well; without a machine scores are 0.5.
    Repeated rows stay; further columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(1)
            for a, b in wh.blocks(texts):
                s = machine.scores(texts.slice(a, b - a)) if machine else np.full(b - a, 0.5)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(s), pa.array((s >= limit).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def learn_and_score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample: int = 6000) -> DataFrame:
    """``score`` with a machine from labelled rows outside the fold ``held_out``."""
    machine = fit(docs, labels.where(folded("doc_id", folds) != held_out), sample)
    return score(docs, machine).withColumn("held_out", folded("doc_id", folds) == held_out)
