"""Connected components of a link table, by alternating large and small stars.

Every round replaces links by links to the smallest known neighbour; components are
stars around their smallest node when nothing changes any more, after a number of rounds
logarithmic in practice. Work and memory follow the links; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.shared import drop, materialize


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("v").cast("decimal(38,0)"))).first()
    return tuple(r)


def _round(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a long, b long) but the smallest ones.

    ``component`` is the smallest node that can be reached. Nodes absent from the result
    are their own component. Self-links and repeated links don't matter.
    """
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _state(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        nxt = materialize(_round(now), "links")
        state = _state(nxt)
        drop(now.sparkSession, now)
        now = nxt
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
