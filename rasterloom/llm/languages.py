"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the byte n-grams of lower-cased text, white space counting as one space. A
text's vector is the mean of its subwords' embeddings; a softmax over a linear layer
gives the languages. Both layers are trained by stochastic gradient descent. A part of the
sample is kept from training and sets the softmax temperature; it and made-up texts of no
language set the rejection limit.
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

_CLEAN = wh._LOWER.copy()
_CLEAN[wh._SPACE] = 32


def lettered(texts: pa.Array) -> np.ndarray:
    """Which texts hold a letter; null ones don't."""
    return np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)


@dataclass
class Model:
    """``table[bucket]``: what one subword adds to each language's mean score.

    Texts that score below ``limit`` are rejected; of the calibration texts that was the share
    ``wrongly_rejected``, and of shuffled characters, digits and markup all but ``wrongly_accepted``.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    limit: float
    sizes: tuple[int, ...]
    wrongly_rejected: float = 0.0
    wrongly_accepted: float = 1.0


def buckets(offsets: np.ndarray, data: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the ``size``-byte n-grams within each text, and each text's offsets.

    Texts shorter than an n-gram have none.
    """
    number = np.maximum(np.diff(offsets) - size + 1, 0)
    rows = np.concatenate([[0], np.cumsum(number)])
    padded = np.concatenate([_CLEAN[data], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    if number.min(initial=1) > 0 and len(number) == 1:
        at = slice(0, int(number[0]))
    else:
        inside = np.ones(len(data) + 1, bool)
        inside[len(data) :] = False
        for j in range(1, size):  # n-grams that would run over a text's end
            inside[np.maximum(offsets[1:] - j, offsets[:-1])[np.diff(offsets) > 0]] = False
        short = np.flatnonzero((number == 0) & (np.diff(offsets) > 0))
        for i in short:
            inside[offsets[i] : offsets[i + 1]] = False
        at = inside
    grams = eight[at] & wh._MASK[size]
    with np.errstate(over="ignore"):
        return ((grams + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32), rows


def text_scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Mean scores of each text of a block, before the softmax."""
    offsets, data = wh.text_buffers(texts)
    total = np.zeros((len(texts), len(model.languages)))
    count = np.zeros(len(texts))
    bits = int(np.log2(len(model.table)))
    for size in model.sizes:
        b, rows = buckets(offsets, data, size, bits)
        some = np.flatnonzero(np.diff(rows))
        if len(some):
            total[some] += np.add.reduceat(model.table[b], rows[some], axis=0)
        count += np.diff(rows)
    return total / np.maximum(count, 1)[:, None] + model.bias


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], languages: list[str], sizes=(2, 3, 4), bits: int = 16, width: int = 16, epochs: int = 12, rate: float = 0.5, reject: float = 0.001, seed: int = 7) -> Model:
    """Fit by stochastic gradient descent; every fifth text calibrates instead.

    ``reject``: the share of calibration texts that may score below the limit. The limit lies
    no higher than that allows, nor than nearly all texts of no language need, nor than 0.5: texts
    of two languages stay.
    """
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (1 << bits, width)).astype(np.float32)
    seen = np.zeros(1 << bits, bool)
    linear, bias = np.zeros((width, len(names)), np.float32), np.zeros(len(names), np.float32)
    bags = []
    for text in texts:
        offsets, data = wh.text_buffers(pa.array([text]))
        b = np.concatenate([buckets(offsets, data, n, bits)[0] for n in sizes])
        which, n = np.unique(b, return_counts=True)
        bags.append((which, (n / max(1, n.sum())).astype(np.float32)))
    usable = [i for i in range(len(bags)) if len(bags[i][0])]
    held = set(usable[::5]) if len(usable) >= 50 else set()
    fit = [i for i in usable if i not in held]
    weight = len(y) / np.maximum(1, np.bincount(y, minlength=len(names))) / len(names)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            which, share = bags[i]
            mean = share @ embed[which]
            p = softmax((mean @ linear + bias)[None])[0]
            p[y[i]] -= 1
            p *= min(weight[y[i]], 4)
            back = linear @ p
            linear -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            # a bag's shares are small: embeddings take a step scaled by their share of the most frequent
            embed[which] -= (step * 20) * share[:, None] * back
            if epoch == 0:
                seen[which] = True
    embed[~seen] = 0  # subwords never met say nothing
    table = (embed @ linear).astype(np.float32)
    model = Model(names, table, bias.astype(np.float64), 1.0, 0.0, tuple(sizes))
    if held:
        held = sorted(held)
        scores = np.concatenate([text_scores(model, pa.array([texts[i]])) for i in held])
        target = y[held]
        losses = [(-np.log(softmax(scores / t)[np.arange(len(held)), target] + 1e-12).mean(), t) for t in (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0)]
        model.temperature = min(losses)[1]
        sure = softmax(scores / model.temperature).max(axis=1)
        noise = softmax(text_scores(model, pa.array(no_language([texts[i] for i in held], rng))) / model.temperature).max(axis=1)
        model.limit = float(min(0.5, np.quantile(sure, reject), np.quantile(noise, 0.99)))
        model.wrongly_rejected, model.wrongly_accepted = float((sure < model.limit).mean()), float((noise >= model.limit).mean())
    return model


def no_language(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Texts of no language, as long as the given ones up to 2000 characters: in turn shuffled letters, digits, markup."""
    out = []
    for i, text in enumerate(texts):
        part = text[:2000]
        if i % 3 == 0:
            out.append("".join(rng.permutation(list(part)).tolist()))
        elif i % 3 == 1:
            out.append("".join(rng.choice(list("0123456789 .,-"), len(part)).tolist()))
        else:
            out.append("".join(rng.choice(["<td>", "</td>", "{", "}", ";", "&nbsp;", " = ", "0", "x", "()", "<br/>"], len(part) // 4 + 1).tolist()))
    return out


def fit(rows: DataFrame, sample: int = 3000) -> Model | None:
    """Train on about ``sample`` rows (text, lang, doc_id) of 64 MB at most; None where there is none.

    However often a doc_id is repeated, only its first text in byte order is learned from.
    """
    given = thinned(rows.where("text is not null and lang is not null").select("doc_id", "text", "lang"), ["doc_id"], sample, "text")
    some = given.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("first")).select("doc_id", "first.*").collect()
    some = sorted((x for x in some if x.text), key=lambda x: (x.doc_id is not None, x.doc_id or 0, x.text))
    return train([x.text for x in some], [x.lang for x in some]) if some else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of ``docs`` (doc_id, text).

    ``lang_pred`` is a learned language, or ``und`` with score 0 where the text is null or
    has no letter (or nothing was learned); such rows and those whose score is below the
    model's limit are ``rejected``. The whole text counts. Repeated rows stay; further
    columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(1)
            for a, b in wh.blocks(texts):
                lang, score, rejected = judge(model, texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def judge(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    has = lettered(texts)
    if model is None or not len(texts):
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    p = softmax(text_scores(model, texts) / model.temperature)
    best = p.argmax(axis=1)
    score = np.where(has, p.max(axis=1), 0.0)
    return [model.languages[k] if ok else "und" for k, ok in zip(best, has, strict=True)], score, ~has | (score < model.limit)


def learn_and_identify(docs: DataFrame, folds: int = 4, held_out: int = 2, sample: int = 3000) -> DataFrame:
    """``identify`` with a model from the rows outside the fold ``held_out``."""
    model = fit(docs.where(folded("doc_id", folds) != held_out), sample)
    return identify(docs, model).withColumn("held_out", F.coalesce(folded("doc_id", folds) == held_out, F.lit(False)))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose text isn't rejected, with all their columns.

    Without a model (nothing to learn from) only texts without letters are rejected.
    """
    bounded_batches(docs.sparkSession)
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where)
            keep = []
            for a, b in wh.blocks(texts):
                part = texts.slice(a, b - a)
                if model is None:
                    keep += lettered(part).tolist()
                else:
                    keep += (~judge(model, part)[2]).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
