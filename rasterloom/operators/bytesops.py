"""Byte-level operators as windows: predictors, runs, and segments of a byte stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _in_row(keys: tuple[str, ...]):
    return Window.partitionBy(*keys, "y").orderBy("x")


def delta(rows: DataFrame, value: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Difference to the byte before, biased by 128, modulo 256; the first of a row stays. ``keys`` tell images apart."""
    before = F.lag(value).over(_in_row(keys))
    return rows.withColumn(out, F.when(before.isNull(), F.col(value)).otherwise(F.pmod(F.col(value) - before + 128, F.lit(256))))


def undo_delta(rows: DataFrame, value: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The running sum that ``delta`` came from."""
    w = _in_row(keys)
    total = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.pmod(total - (F.row_number().over(w) - 1) * 128, F.lit(256)))


def deinterleave(rows: DataFrame, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Even positions of a row first, then the odd ones (keys, y, x, v)."""
    half, x = (width + 1) // 2, F.col("x")
    return rows.select(*keys, "y", F.when(x % 2 == 0, F.expr("x div 2")).otherwise(F.expr("x div 2") + half).cast("long").alias("x"), "v")


def runs(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs of equal neighbours in a row (keys, y, x, v -> keys, y, v, first_x, length)."""
    island = F.row_number().over(_in_row(keys)) - F.row_number().over(Window.partitionBy(*keys, "y", "v").orderBy("x"))
    return rows.withColumn("island", island).groupBy(*keys, "y", "v", "island").agg(F.min("x").alias("first_x"), F.count("*").alias("length")).drop("island")


def merge_segments(segments: DataFrame, most_length: int | None = None) -> DataFrame:
    """Segments (source, start, end) that touch exactly, merged per source.

    With ``most_length`` a merged segment ends before the piece that would make it longer; a piece
    longer than that stays alone.
    """
    w = Window.partitionBy("source").orderBy("start")
    touches = F.lag("end").over(w) == F.col("start")
    island = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = segments.withColumn("new", F.when(touches, 0).otherwise(1)).withColumn("island", island)
    if most_length is not None:
        # within an island, greedily: where a piece would pass the limit, the next segment starts with it
        pieces = F.array_sort(F.collect_list(F.struct("start", "end")))
        step = lambda acc, p: F.when((F.size(acc) > 0) & (p["end"] - F.element_at(acc, -1)["first"] <= most_length), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), p["end"].alias("last"), (F.element_at(acc, -1)["n"] + 1).alias("n"))))).otherwise(F.concat(acc, F.array(F.struct(p["start"].alias("first"), p["end"].alias("last"), F.lit(1).cast("long").alias("n")))))
        none = F.array().cast("array<struct<first:bigint,last:bigint,n:bigint>>")
        merged = marked.groupBy("source", "island").agg(F.aggregate(pieces, none, step).alias("merged"))
        return merged.select("source", F.inline("merged").alias("segment_start", "segment_end", "pieces"))
    return marked.groupBy("source", "island").agg(F.min("start").alias("segment_start"), F.max("end").alias("segment_end"), F.count("*").alias("pieces")).drop("island")


def first_gap(segments: DataFrame) -> DataFrame:
    """The first range between segments that none covers, per source."""
    w = Window.partitionBy("source").orderBy("start")
    gaps = segments.withColumn("next", F.lead("start").over(w)).where("next > end")
    return gaps.groupBy("source").agg(F.min("end").alias("gap_start"), F.min_by("next", "end").alias("gap_end"))


def overlaps(left: DataFrame, right: DataFrame, cell: int) -> DataFrame:
    """Pairs (a, b) of ranges (id, start, end) that overlap.

    Ranges are dealt to cells of a fixed width and meet by an equi-join on the cell; a pair
    counts in the cell where its overlap begins only, so none is repeated.
    """

    def cells(df: DataFrame, name: str) -> DataFrame:
        first, last = F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell)
        return df.select(F.col("id").alias(name), F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"), F.explode(F.sequence(first, last)).alias("cell"))

    both = cells(left, "a").join(cells(right, "b"), "cell")
    begin = F.greatest("a_start", "b_start")
    return both.where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.floor(begin / cell) == F.col("cell"))).select("a", "b")
