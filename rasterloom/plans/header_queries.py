"""Header attributes, names and part summaries."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from rasterloom.functions import names
from rasterloom.plans.catalog import query
from rasterloom.plans.views import EVENT_CHANNEL, literal, table, with_rows, with_rows_sql

_FLOATS = [0.0, 1.0, -2.5, 0.1, 1e-40, 3.4e38]
_DOUBLES = [0.0, 1.0, -2.5, 0.1, 5e-324, 1.7e308, 2.2250738585072014e-308]


@query("attribute_floats", "SELECT i::BIGINT AS i, v::FLOAT::DOUBLE AS value FROM (VALUES " + ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(_FLOATS)) + ") t(i, v)")
def _floats(spark, sf_dir):
    rows = [(i, bytearray(struct.pack("<f", v))) for i, v in enumerate(_FLOATS)]
    return literal(spark, rows, "i long, data binary").select("i", names.little_endian_float(F.col("data")).alias("value"))


@query("attribute_doubles", "SELECT i::BIGINT AS i, v AS value FROM (VALUES " + ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(_DOUBLES)) + ") t(i, v)")
def _doubles(spark, sf_dir):
    rows = [(i, bytearray(struct.pack("<d", v))) for i, v in enumerate(_DOUBLES)]
    return literal(spark, rows, "i long, data binary").select("i", names.little_endian_double(F.col("data")).alias("value"))


@query("name_validation", "SELECT p_partkey AS id, octet_length(encode(p_name || repeat('é', (p_partkey % 20)::INT)))  <= 31 AS short_ok, octet_length(encode(p_name || repeat('é', (p_partkey % 20)::INT))) <= 255 AS long_ok FROM part")
def _names(spark, sf_dir):
    n = F.concat("p_name", F.repeat(F.lit("é"), (F.col("p_partkey") % 20).cast("int")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names.valid_name(n, F.lit(False)).alias("short_ok"), names.valid_name(n, F.lit(True)).alias("long_ok"))


_KINDS = [(0, "scanlineimage", True), (0, "deepscanline", True), (0, "tiledimage", False), (1, "deeptile", False), (1, "scanlineimage", True)]
#: Five orders are a file's parts.
_ORDER_KINDS = {"file_id": "CAST(floor(o_orderkey / 5.0) AS BIGINT) + 10", "part_type": "CASE o_custkey % 4 WHEN 0 THEN 'scanlineimage' WHEN 1 THEN 'tiledimage' WHEN 2 THEN 'deepscanline' ELSE 'deeptile' END", "decoded": "o_orderkey % 3 = 0"}


@query("part_kind_counts", f"WITH {with_rows_sql('p', _KINDS, 'orders', _ORDER_KINDS)} SELECT file_id::BIGINT AS file_id, count(*)::BIGINT AS parts, count(*) FILTER (decoded)::BIGINT AS decoded, count(*) FILTER (part_type LIKE 'deep%')::BIGINT AS deep, count(*) FILTER (part_type NOT LIKE 'deep%')::BIGINT AS flat FROM p GROUP BY 1")
def _kinds(spark, sf_dir):
    deep = F.startswith("part_type", F.lit("deep"))
    return with_rows(spark, sf_dir, _KINDS, "file_id long, part_type string, decoded boolean", "orders", _ORDER_KINDS).groupBy("file_id").agg(F.count("*").alias("parts"), F.count_if("decoded").alias("decoded"), F.count_if(deep).alias("deep"), F.count_if(~deep).alias("flat"))


_WINDOWS = [(0, 0, 0, 9, 9, None, None, None, None), (1, 0, 0, 9, 9, -2, -2, 20, 20), (2, 5, 5, 6, 6, 5, None, None, None)]
_ORDER_WINDOWS = {"id": "o_orderkey + 10", "a": "o_custkey % 5", "b": "o_orderkey % 7 - 3", "c": "9 + o_custkey % 5", "d": "9", "e": "CASE WHEN o_orderkey % 3 > 0 THEN 0 - o_custkey % 6 END", "f": "CASE WHEN o_orderkey % 4 > 0 THEN -2 END", "g": "20", "h": "21 + o_custkey % 3"}


@query("display_window_default", f"WITH {with_rows_sql('w', _WINDOWS, 'orders', _ORDER_WINDOWS)} SELECT id::BIGINT AS id, '(' || CASE WHEN e IS NULL OR f IS NULL OR g IS NULL OR h IS NULL THEN a || ', ' || b || ')-(' || c || ', ' || d ELSE e || ', ' || f || ')-(' || g || ', ' || h END || ')' AS display FROM w")
def _windows(spark, sf_dir):
    """The display window, or the data window where it isn't given whole."""
    df = with_rows(spark, sf_dir, _WINDOWS, "id long, a int, b int, c int, d int, e int, f int, g int, h int", "orders", _ORDER_WINDOWS)
    given = F.format_string("(%d, %d)-(%d, %d)", *"efgh")
    whole = F.col("e").isNotNull() & F.col("f").isNotNull() & F.col("g").isNotNull() & F.col("h").isNotNull()
    return df.select("id", F.when(whole, given).otherwise(F.format_string("(%d, %d)-(%d, %d)", *"abcd")).alias("display"))


#: part, attribute names, channel name
_MARKED = [(0, True, "S0.400nm"), (0, True, "S0.500nm"), (1, True, "T.400nm"), (2, False, "T.400nm"), (3, True, "R"), (4, True, "S2.400nm"), (4, True, "S0.400nm")]
#: Six events are a part's channels.
_EVENTS = {"part": "CAST(floor(event_id / 6.0) AS BIGINT) + 10", "marked": "CAST(floor(event_id / 6.0) AS BIGINT) % 3 > 0", "name": EVENT_CHANNEL}


@query(
    "spectral_type_marked",
    f"WITH {with_rows_sql('c', _MARKED, 'events', _EVENTS)} SELECT part::BIGINT AS part, bool_or(marked) AS is_spectral, CASE WHEN NOT bool_or(marked) THEN NULL WHEN bool_or(name LIKE 'T.%nm') THEN 0 WHEN bool_or(name SIMILAR TO 'S[1-3][.].*nm') THEN 2 WHEN bool_or(name LIKE 'S0.%nm') THEN 1 END::BIGINT AS code FROM c GROUP BY 1",
)
def _marked(spark, sf_dir):
    """The facade's codes (reflective 0, emissive 1, polarised 2): null without the layout marker or spectral channels."""
    kind, c = names.spectral_kind(F.col("name")), with_rows(spark, sf_dir, _MARKED, "part long, marked boolean, name string", "events", _EVENTS)
    has = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    code = F.when(~F.bool_or("marked"), F.lit(None)).when(has(kind == "T"), 0).when(has(kind.isin("S1", "S2", "S3")), 2).when(has(kind == "S0"), 1)
    return c.groupBy("part").agg(F.bool_or("marked").alias("is_spectral"), code.cast("long").alias("code"))

