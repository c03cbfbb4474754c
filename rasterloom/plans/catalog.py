"""The registered queries: every operator over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL whose rows it equals."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and SQL; importing the modules registers them."""
    from rasterloom.plans import channel_queries, color_queries, deep_queries, file_queries, geometry_queries, header_queries, sampling_queries, spectral_queries, stream_queries  # noqa: F401

    return QUERIES, SQL
