"""Stateful streaming: row-wise resampling, assembly of byte ranges that arrive in any order, windows on event time."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rasterloom.operators.resample import axis_weights
from rasterloom.shipping import ship

RESIZED = "image long, y int, values array<double>, status string"
ASSEMBLED = "source string, start long, end long, status string"


def _matrix(source: int, target: int, name: str, mode: str) -> np.ndarray:
    m = np.zeros((target, source))
    for d, s, w in axis_weights(source, target, name, mode):
        m[d, s] += w
    return m


#: The largest UINT sample.
_UINT_TOP = 4294967295.0


def narrowed(values: np.ndarray, pixel_type: str) -> np.ndarray:
    """Values as samples of a pixel type hold them: UINT rounds half to even within 0..2**32 - 1 (NaN: 0)."""
    if pixel_type == "UINT":
        return np.where(values > 0, np.minimum(np.rint(values), _UINT_TOP), 0.0)
    with np.errstate(over="ignore"):
        return values.astype({"HALF": np.float16, "FLOAT": np.float32}[pixel_type]).astype(float)


def resize_rows(rows: DataFrame, size: tuple[int, int], target: tuple[int, int], name: str = "mitchell", mode: str = "clamp", pixel_type: str | None = None) -> DataFrame:
    """Target rows of each image as soon as their source rows have arrived.

    rows: a stream of (image long, y int, values array<double>). State per image: the resampled
    source rows that a later target row still needs (as many as the filter reaches over, plus
    rows that came ahead of others) and the next target row. ``pixel_type`` (HALF, FLOAT, UINT)
    narrows target values; without one they are doubles. Target rows have the status 'Success';
    a source row that lies outside the image, comes again while it is held or comes when no target
    row needs it any more changes nothing and gives a row 'Rejected' with its y, without values.
    """
    across, down = _matrix(size[0], target[0], name, mode), _matrix(size[1], target[1], name, mode)
    first = [int(np.flatnonzero(w)[0]) for w in down]
    last = [int(np.flatnonzero(w)[-1]) for w in down]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, held = pickle.loads(state.get[0]) if state.exists else (0, {})
        least, out = min(first[following:], default=size[1]), []
        for batch in batches:
            for y, values in zip(batch["y"], batch["values"], strict=True):
                if least <= y < size[1] and y not in held:
                    held[int(y)] = across @ np.asarray(values, float)
                else:
                    out.append((key[0], int(y), None, "Rejected"))
        while following < target[1] and all(y in held for y in range(first[following], last[following] + 1) if down[following, y]):
            made = sum(down[following, y] * held[int(y)] for y in np.flatnonzero(down[following]))
            out.append((key[0], following, (narrowed(made, pixel_type) if pixel_type else made).tolist(), "Success"))
            following += 1
        least = min(first[following:], default=size[1])
        state.update((pickle.dumps((following, {y: v for y, v in held.items() if y >= least})),))
        yield pd.DataFrame(out, columns=["image", "y", "values", "status"])

    ship(rows.sparkSession)
    return rows.groupBy("image").applyInPandasWithState(step, RESIZED, "held binary", "append", GroupStateTimeout.NoTimeout)


class Ranges:
    """Bytes of a source, supplied as ranges: repeated bytes must agree, touching ranges merge."""

    def __init__(self, parts: dict[int, bytes] | None = None, budget: int = 1 << 30):
        self.parts, self.budget = parts or {}, budget

    def supply(self, start: int, data: bytes) -> str:
        """'Success', 'Conflict' (nothing changes) or 'OutOfMemory' (nothing changes)."""
        end = start + len(data)
        near = sorted((a, d) for a, d in self.parts.items() if a <= end and a + len(d) >= start)
        low = min([start, *(a for a, _ in near)])
        merged = bytearray(max([end, *(a + len(d) for a, d in near)]) - low)
        merged[start - low : end - low] = data
        for a, d in near:
            x, y = max(a, start), min(a + len(d), end)
            if x < y and d[x - a : y - a] != data[x - start : y - start]:
                return "Conflict"
            merged[a - low : a - low + len(d)] = d
        if sum(map(len, self.parts.values())) - sum(len(d) for _, d in near) + len(merged) > self.budget:
            return "OutOfMemory"
        for a, _ in near:
            del self.parts[a]
        self.parts[low] = bytes(merged)
        return "Success"

    def missing(self, start: int, end: int) -> tuple[int, int] | None:
        """The first gap in a requested range as (offset, length); None if all is there."""
        at = start
        for a, d in sorted(self.parts.items()):
            if a + len(d) <= at:
                continue
            if a > at:
                break
            at = a + len(d)
        if at >= end:
            return None
        after = min([a for a in self.parts if a > at] + [end])
        return at, min(after, end) - at


def assemble_ranges(events: DataFrame, budget: int = 1 << 30) -> DataFrame:
    """Merged ranges after each micro-batch, and a row per rejected event.

    events: a stream of (source string, seq long, offset long, data binary), taken in the order of
    ``seq`` within a micro-batch. A conflict leaves the state unchanged and gives a row with its
    status.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = Ranges(pickle.loads(state.get[0]) if state.exists else {}, budget), []
        for batch in sorted(batches, key=lambda b: b["seq"].min()):
            for e in batch.sort_values("seq").itertuples():
                status = held.supply(int(e.offset), bytes(e.data))
                if status != "Success":
                    out.append((key[0], int(e.offset), int(e.offset) + len(e.data), status))
        out += [(key[0], a, a + len(d), "Success") for a, d in sorted(held.parts.items())]
        state.update((pickle.dumps(held.parts),))
        yield pd.DataFrame(out, columns=["source", "start", "end", "status"])

    ship(events.sparkSession)
    return events.groupBy("source").applyInPandasWithState(step, ASSEMBLED, "held binary", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all available input into Parquet files, and read them."""
    spark = stream.sparkSession
    started = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def count_windows(events: DataFrame, width: str, delay: str) -> DataFrame:
    """hour, event_type, n, total: tumbling windows of a stream of (ts, event_type, value).

    Events more than ``delay`` behind the latest one of earlier micro-batches may be late; those
    of a window that the watermark has passed are dropped with its state.
    """
    windows = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def last_updates(stream: DataFrame, folder: str, key: list[str]) -> DataFrame:
    """Run a stream in update mode over all available input, and read each key's last row."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    started = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    updates = spark.read.schema(f"{_ddl(stream)}, batch long").option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    last = Window.partitionBy(*key).orderBy(F.desc("batch"))
    return updates.withColumn("nth", F.row_number().over(last)).where("nth = 1").select(*stream.columns)


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
