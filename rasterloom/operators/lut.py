"""3D lookup tables: .cube text, trilinear and tetrahedral interpolation."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions.numeric import non_negative
from rasterloom.shipping import ship


@dataclass(frozen=True)
class Lut:
    """``data[((b * size + g) * size + r) * 3 + channel]``; red varies fastest."""

    size: int
    data: tuple[float, ...]
    low: tuple[float, float, float] = (0.0, 0.0, 0.0)
    high: tuple[float, float, float] = (1.0, 1.0, 1.0)
    title: str = ""

    def __post_init__(self):
        if not 2 <= self.size <= 256 or len(self.data) != 3 * self.size**3:
            raise ValueError("Corrupt: a table of size**3 triples, size 2 to 256, is needed")


def from_function(size: int, f) -> Lut:
    """The table of ``f(r, g, b) -> (r, g, b)`` on a regular grid."""
    step = 1 / (size - 1)
    return Lut(size, tuple(v for b in range(size) for g in range(size) for r in range(size) for v in f(r * step, g * step, b * step)))


def parse_cube(text: str) -> Lut:
    """A 3D .cube file; a 1D table is unsupported, anything else malformed is corrupt."""
    size, title, low, high, data = 0, "", (0.0,) * 3, (1.0,) * 3, []
    for line in text.splitlines():
        words = line.partition("#")[0].split()
        if not words:
            continue
        try:
            match words[0]:
                case "TITLE":
                    title = line.partition("#")[0].strip()[5:].strip().strip('"')
                case "LUT_1D_SIZE":
                    raise NotImplementedError("Unsupported: a 1D table")
                case "LUT_3D_SIZE":
                    (size,) = map(int, words[1:])
                case "DOMAIN_MIN":
                    low = tuple(map(float, words[1:]))
                case "DOMAIN_MAX":
                    high = tuple(map(float, words[1:]))
                case _:
                    if len(words) != 3:
                        raise ValueError
                    data += map(float, words)
        except ValueError as e:
            raise ValueError(f"Corrupt: {line!r}") from e
    if len(low) != 3 or len(high) != 3:
        raise ValueError("Corrupt: a domain has three values")
    return Lut(size, tuple(data), low, high, title)


def _grid(v: Column, low: float, high: float, size: int) -> tuple[Column, Column]:
    """Cell index and fraction; the last cell takes the upper end with fraction 1."""
    span = high - low
    at = F.least(non_negative((v - low) / span * (size - 1) if span else F.lit(0.0)), F.lit(float(size - 1)))
    cell = F.least(F.floor(at), F.lit(size - 2)).cast("int")
    return cell, at - cell


#: Tables up to this size are literals of a plan; larger ones go to tasks as one broadcast array.
LITERAL_SIZE = 33


def apply(pixels: DataFrame, lut: Lut, channels: tuple[str, str, str] = ("r", "g", "b"), out: tuple[str, str, str] | None = None, tetrahedral: bool = False) -> DataFrame:
    """``pixels`` with red, green and blue through the table, in ``out`` (default: in place).

    A pixel's cell and fractions are one projection, its corners (eight, or four tetrahedral ones) the
    next, each fetched once as a triple; the plan doesn't grow with the table's use. Tables above
    LITERAL_SIZE (at most 256**3 triples) are interpolated in Arrow batches.
    """
    out = out or channels
    if lut.size > LITERAL_SIZE:
        return _in_batches(pixels, lut, channels, out, tetrahedral)
    n, data = lut.size, lut.data
    triples = [list(data[i : i + 3]) for i in range(0, len(data), 3)]
    table = F.from_json(F.lit(json.dumps(triples)), "array<array<double>>")
    names = [x for x in pixels.columns if x not in out]
    cell, fraction, corner = "_cell", "_fraction", "_corner"
    grids = [_grid(F.col(c), lo, hi, n) for c, lo, hi in zip(channels, lut.low, lut.high, strict=True)]
    step = (1, n, n * n)
    base = sum((g[0] * s for g, s in zip(grids, step, strict=True)), F.lit(0))
    at = pixels.select(*names, base.alias(cell), *(g[1].alias(f"{fraction}{k}") for k, g in enumerate(grids)))
    f = [F.col(f"{fraction}{k}") for k in range(3)]
    if tetrahedral:
        # from corner 000 to 111, one axis at a time, the largest fraction first
        first = F.when((f[0] >= f[1]) & (f[0] >= f[2]), step[0]).when(f[1] >= f[2], step[1]).otherwise(step[2])
        last = F.when((f[2] <= f[1]) & (f[2] <= f[0]), step[2]).when(f[1] <= f[0], step[1]).otherwise(step[0])
        most, least = F.greatest(*f), F.least(*f)
        middle = f[0] + f[1] + f[2] - most - least
        offsets = [F.lit(0), first, F.lit(sum(step)) - last, F.lit(sum(step))]
        weights = [1 - most, most - middle, middle - least, least]
    else:
        offsets = [F.lit(i * step[0] + j * step[1] + k * step[2]) for k in (0, 1) for j in (0, 1) for i in (0, 1)]
        weights = [(f[0] if i else 1 - f[0]) * (f[1] if j else 1 - f[1]) * (f[2] if k else 1 - f[2]) for k in (0, 1) for j in (0, 1) for i in (0, 1)]
    some = range(len(offsets))
    fetched = at.select(*names, *(F.get(table, (F.col(cell) + o).cast("int")).alias(f"{corner}{i}") for i, o in enumerate(offsets)), *(w.alias(f"_weight{i}") for i, w in enumerate(weights)))
    mixed = [sum((F.col(f"{corner}{i}")[c] * F.col(f"_weight{i}") for i in some), F.lit(0.0)).alias(o) for c, o in enumerate(out)]
    return fetched.select(*names, *mixed)


def interpolate(lut: Lut, rgb: np.ndarray, tetrahedral: bool) -> np.ndarray:
    """(rows, 3) through the table, by numpy."""
    n = lut.size
    table = np.asarray(lut.data).reshape(-1, 3)
    low, span = np.array(lut.low), np.array(lut.high) - np.array(lut.low)
    at = np.where(span != 0, (rgb - low) / np.where(span != 0, span, 1) * (n - 1), 0.0)
    at = np.clip(np.nan_to_num(at, nan=0.0), 0, n - 1)
    cell = np.minimum(at.astype(np.int64), n - 2)
    f, step = at - cell, np.array([1, n, n * n])
    base = cell @ step
    if tetrahedral:
        order = np.argsort(-f, axis=1, kind="stable")
        walked, weight = np.cumsum(step[order], axis=1), np.take_along_axis(f, order, 1)
        out = table[base] * (1 - weight[:, :1])
        for k in range(3):
            out += table[base + walked[:, k]] * (weight[:, k] - (weight[:, k + 1] if k < 2 else 0))[:, None]
        return out
    out = np.zeros_like(f)
    for corner in np.ndindex(2, 2, 2):
        out += table[base + np.array(corner) @ step] * np.where(corner, f, 1 - f).prod(axis=1)[:, None]
    return out


def _in_batches(pixels: DataFrame, lut: Lut, channels: tuple[str, ...], out: tuple[str, ...], tetrahedral: bool) -> DataFrame:
    spark = pixels.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(lut)
    names = [x for x in pixels.columns if x not in out]
    schema = T.StructType([*(pixels.schema[x] for x in names), *(T.StructField(x, T.DoubleType()) for x in out)])
    at = [pixels.columns.index(x) for x in (*names, *channels)]

    def run(batches):
        for batch in batches:
            kept, rgb = at[: len(names)], np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in at[len(names) :]], axis=1)
            mixed = interpolate(shared.value, rgb, tetrahedral)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array(np.ascontiguousarray(mixed[:, k])) for k in range(3))], [*names, *out])

    return pixels.mapInArrow(run, schema)
