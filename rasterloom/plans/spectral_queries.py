"""Spectral names, types, wavelengths and cubes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import names, numeric
from rasterloom.operators import spectral
from rasterloom.plans.catalog import query
from rasterloom.plans.views import EVENT_CHANNEL, SPECTRAL_SQL, literal, table, values_sql, with_rows, with_rows_sql
from rasterloom.plans.views import spectral as spectral_view

#: part, channel index, name
_CHANNELS = [
    (0, 0, "S0.550,000000nm"), (0, 1, "S0.480,250000nm"), (0, 2, "S0.480,255000nm"), (0, 3, "S0.700,000000nm"), (0, 4, "R"), (0, 5, "S0.480,265000nm"),
    (1, 0, "T.700,000000nm"), (1, 1, "T.400,500000nm"), (1, 2, "S0.500,000000nm"),
    (2, 0, "S0.400,000000nm"), (2, 1, "S3.400,500000nm"), (2, 2, "S2.480,250000nm"), (2, 3, "S1.400,000000nm"),
    (3, 0, "R"), (3, 1, "S0.550,0nm.trailing"), (3, 2, "S4.500,000000nm"), (3, 3, "T.nm"), (3, 4, "S0.-5nm"), (3, 5, "S0.0,0nm"),
]
#: Eight events are a part's channels.
_EVENTS = {"part": "CAST(floor(event_id / 8.0) AS BIGINT) + 10", "channel_idx": "event_id % 8", "name": EVENT_CHANNEL}
_SQL = with_rows_sql("c", _CHANNELS, "events", _EVENTS)
_RE = r"'^(S[0-3]|T)\.([+-]?[0-9]*[.,]?[0-9]*)nm$'"
_W = f"CASE WHEN regexp_matches(name, {_RE}) AND regexp_matches(regexp_extract(name, {_RE}, 2), '[0-9]') AND replace(regexp_extract(name, {_RE}, 2), ',', '.')::DOUBLE >= 0 THEN replace(regexp_extract(name, {_RE}, 2), ',', '.')::DOUBLE END"
# DuckDB may evaluate the cast for other rows: try_cast keeps it from failing
_W = _W.replace("replace(regexp_extract", "try_cast(replace(regexp_extract").replace("',', '.')::DOUBLE", "',', '.') AS DOUBLE)")
_PARSED = f"{_SQL}, p AS (SELECT part::BIGINT AS part, channel_idx::BIGINT AS channel_idx, name, {_W} AS w, regexp_extract(name, {_RE}, 1) AS kind FROM c)"


def _channels(spark, sf_dir):
    return with_rows(spark, sf_dir, _CHANNELS, "part long, channel_idx long, name string", "events", _EVENTS)


@query("spectral_parse_names", f"WITH {_PARSED} SELECT part, channel_idx, w AS wavelength, CASE WHEN w IS NOT NULL AND kind <> 'T' THEN right(kind, 1)::BIGINT END AS stokes, w IS NOT NULL AS is_spectral, coalesce(w > 0, false) AS is_spectral_strict FROM p")
def _parse(spark, sf_dir):
    n = F.col("name")
    w = names.wavelength(n)
    return _channels(spark, sf_dir).select("part", "channel_idx", w.alias("wavelength"), names.stokes(n).cast("long").alias("stokes"), w.isNotNull().alias("is_spectral"), F.coalesce(w > 0, F.lit(False)).alias("is_spectral_strict"))


@query(
    "spectral_format_names",
    "WITH w AS (SELECT vec_id, 400 + vec_id * 0.12345678::DOUBLE AS w FROM embeddings), m AS (SELECT vec_id, w, floor(w)::BIGINT AS whole, floor((w - floor(w)) * 1000000 + 0.5)::BIGINT AS micros FROM w), "
    "t AS (SELECT vec_id, CASE WHEN micros >= 1000000 THEN whole + 1 ELSE whole END || ',' || lpad(CASE WHEN micros >= 1000000 THEN 0 ELSE micros END::VARCHAR, 6, '0') AS t FROM m) "
    "SELECT vec_id, 'S0.' || t || 'nm' AS emissive, 'T.' || t || 'nm' AS reflective, 'S' || least(3, vec_id % 5) || '.' || t || 'nm' AS polarised FROM t",
)
def _format(spark, sf_dir):
    w = F.col("vec_id") * 0.12345678 + 400
    return table(spark, sf_dir, "embeddings").select("vec_id", names.spectral_name("emissive", w).alias("emissive"), names.spectral_name("reflective", w).alias("reflective"), names.spectral_name("polarised", w, F.col("vec_id") % 5).alias("polarised"))


@query("spectral_type", f"WITH {_PARSED}, k AS (SELECT part, CASE WHEN w IS NOT NULL THEN kind END AS kind FROM p) SELECT part, CASE WHEN bool_or(kind = 'T') THEN 'Reflective' WHEN bool_or(kind IN ('S1', 'S2', 'S3')) THEN 'Polarised' WHEN bool_or(kind = 'S0') THEN 'Emissive' ELSE 'None' END AS spectrum_type FROM k GROUP BY 1")
def _type(spark, sf_dir):
    return spectral.spectrum_type(_channels(spark, sf_dir))


# the folds compare with what was kept last (or at all), so SQL needs a recursion over the sorted list
_SORTED = f"{_PARSED}, s AS (SELECT part, w, row_number() OVER (PARTITION BY part ORDER BY w, channel_idx) AS k FROM p WHERE w IS NOT NULL)"


@query(
    "wavelengths_v3",
    f"WITH RECURSIVE {_SORTED}, f AS (SELECT part, k, [w] AS kept FROM s WHERE k = 1 UNION ALL SELECT s.part, s.k, CASE WHEN s.w > f.kept[-1] + 0.01 THEN list_append(f.kept, s.w) ELSE f.kept END FROM f JOIN s ON s.part = f.part AND s.k = f.k + 1) SELECT part, kept AS wavelengths FROM f WHERE (part, k) IN (SELECT part, max(k) FROM s GROUP BY 1)",
)
def _wavelengths(spark, sf_dir):
    return spectral.wavelengths(_channels(spark, sf_dir))


@query(
    "wavelengths_v1",
    f"WITH RECURSIVE {_PARSED}, s AS (SELECT part, w, row_number() OVER (PARTITION BY part ORDER BY channel_idx) AS k FROM p WHERE w > 0), f AS (SELECT part, k, [w] AS kept FROM s WHERE k = 1 UNION ALL SELECT s.part, s.k, CASE WHEN len(list_filter(f.kept, lambda x: abs(x - s.w) < 0.01)) = 0 THEN list_append(f.kept, s.w) ELSE f.kept END FROM f JOIN s ON s.part = f.part AND s.k = f.k + 1) SELECT part, list_sort(kept) AS wavelengths FROM f WHERE (part, k) IN (SELECT part, max(k) FROM s GROUP BY 1)",
)
def _wavelengths_any(spark, sf_dir):
    return spectral.wavelengths_any(_channels(spark, sf_dir))


@query("spectral_cube_long", f"WITH {SPECTRAL_SQL} SELECT y, x, wavelength_idx, wavelength, round(value, 6) AS value FROM sp")
def _cube(spark, sf_dir):
    return spectral_view(spark, sf_dir).withColumn("value", F.round("value", 6))


@query("pixel_spectrum", "SELECT vec_id // 25 AS y, vec_id % 25 AS x, list_transform(embedding, lambda v: round(v::DOUBLE, 6)) AS spectrum FROM embeddings")
def _spectrum(spark, sf_dir):
    """A spectrum for each row: rows of one vec_id stay apart, and null and empty vectors give null and empty spectra."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.monotonically_increasing_id().alias("row"), F.col("embedding").isNotNull().alias("known"))
    long = vectors.select("row", "known", "vec_id", F.posexplode_outer("embedding").alias("wavelength_idx", "v"))
    cube = long.select("row", "known", F.expr("vec_id div 25").alias("y"), (F.col("vec_id") % 25).alias("x"), "wavelength_idx", numeric.round_away(F.col("v"), 6).alias("value"))
    return spectral.pixel_spectra(cube, ("row", "known")).select("y", "x", F.when(F.col("known"), F.col("spectrum")).alias("spectrum"))


@query("spectral_sample", "SELECT vec_id, round(coalesce(embedding[(vec_id % 80 + 1)::INT]::DOUBLE, 0.0), 6) AS value FROM embeddings")
def _sample(spark, sf_dir):
    """The value at index vec_id % 80 of 64: 0 beyond the axis."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(spectral.sample(F.col("embedding").cast("array<double>"), F.col("vec_id") % 80), 6).alias("value"))


@query(
    "spectral_part_to_cube",
    f"WITH {SPECTRAL_SQL} SELECT 0::BIGINT AS stokes, wavelength_idx // 2 AS wavelength_idx, y, x, round(value, 6) AS value FROM sp WHERE wavelength_idx % 2 = 0 AND wavelength_idx % 7 <> 6",
)
def _to_cube(spark, sf_dir):
    """Channels onto an axis of every second wavelength; every seventh channel isn't spectral."""
    s = spectral_view(spark, sf_dir)
    name = F.when(F.col("wavelength_idx") % 7 == 6, F.concat(F.lit("R"), F.col("wavelength_idx").cast("string"))).otherwise(names.spectral_name("emissive", F.col("wavelength")))
    samples = s.select(name.alias("name"), "y", "x", F.round("value", 6).alias("value"))
    header = spark.range(64).select(F.col("id").alias("wavelength_idx"), (F.col("id") * 5 + 400.0).alias("wavelength")).select(F.col("wavelength_idx").alias("channel_idx"), name.alias("name"))
    axis = spark.range(32).select(F.col("id").alias("wavelength_idx"), (F.col("id") * 10 + 400.0).alias("wavelength"))
    return spectral.cube(samples, axis, F.broadcast(header)).select(F.col("stokes").cast("long").alias("stokes"), "wavelength_idx", "y", "x", "value")


@query("spectral_cube_to_part", f"WITH {SPECTRAL_SQL} SELECT 'S0.' || wavelength::BIGINT || ',000000nm' AS name, y, x, round(value, 6) AS value FROM sp")
def _from_cube(spark, sf_dir):
    return spectral.cube_channels(spectral_view(spark, sf_dir), "emissive").withColumn("value", F.round("value", 6))


_CLOSE = "400 + o_orderkey % 1000 + CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 7 * 5e-8 ELSE 0 END"


@query(
    "spectral_clashing_names",
    f"WITH w AS (SELECT DISTINCT o_orderkey // 3000 AS part, ({_CLOSE})::DOUBLE AS w FROM orders), n AS (SELECT part, 'T.' || round(w)::BIGINT || ',000000nm' AS name FROM w) SELECT part, name, count(*)::BIGINT AS n FROM n GROUP BY 1, 2 HAVING count(*) > 1",
)
def _clashing(spark, sf_dir):
    """Wavelengths that no longer differ once they are formatted with six decimals."""
    axis = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 3000").alias("part"), F.expr(f"cast({_CLOSE.replace('5e-8', '5e-8D')} as double)").alias("wavelength")).distinct()
    return spectral.clashing_names(axis, "reflective", ("part",))


@query(
    "wavelengths_capped",
    "WITH w AS (SELECT event_id // 1000 AS part, (30000 + 2 * (event_id % 1000 * 5 + j)) / 100.0::DOUBLE AS w FROM events, range(5) t(j)), r AS (SELECT part, w, row_number() OVER (PARTITION BY part ORDER BY w) AS k FROM w) SELECT part, count(*)::BIGINT AS n, min(w) AS low, max(w) AS high FROM r WHERE k <= 4096 GROUP BY 1",
)
def _capped(spark, sf_dir):
    """Parts of 5000 wavelengths: the 4096 lowest count."""
    w = (F.lit(30000) + (F.col("event_id") % 1000 * 5 + F.col("j")) * 2) / 100.0
    named = table(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).select(F.expr("event_id div 1000").alias("part"), names.spectral_name("emissive", w).alias("name"))
    return spectral.wavelengths(named).select("part", F.size("wavelengths").cast("long").alias("n"), F.array_min("wavelengths").alias("low"), F.array_max("wavelengths").alias("high"))


@query("stokes_planes", f"WITH {_PARSED} SELECT part, right(kind, 1)::BIGINT AS stokes, count(*)::BIGINT AS channels FROM p WHERE w IS NOT NULL AND kind <> 'T' GROUP BY 1, 2")
def _stokes(spark, sf_dir):
    s = names.stokes(F.col("name"))
    return _channels(spark, sf_dir).where(s.isNotNull()).groupBy("part", s.cast("long").alias("stokes")).agg(F.count("*").alias("channels"))


_ATTRIBUTES = [(0, "owner", "me"), (0, "emissiveUnits", "W"), (1, "ROOT/units", "m"), (1, "emissiveUnits", "W"), (2, "owner", "you")]


@query("spectral_units", f"WITH {values_sql('a', ['part', 'name', 'value'], _ATTRIBUTES)} SELECT part::BIGINT AS part, coalesce(max(value) FILTER (name = 'ROOT/units'), max(value) FILTER (name = 'emissiveUnits')) AS units FROM a GROUP BY 1")
def _units(spark, sf_dir):
    a = literal(spark, _ATTRIBUTES, "part long, name string, value string").groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    return a.select("part", spectral.units(F.col("m")).alias("units"))


@query(
    "spectral_set_attributes",
    f"WITH {values_sql('a', ['part', 'name', 'value'], _ATTRIBUTES)} SELECT part::BIGINT AS part, name, value FROM a WHERE name NOT IN ('spectralLayoutVersion', 'ROOT/units', 'emissiveUnits', 'polarisationHandedness') UNION ALL SELECT DISTINCT part::BIGINT, 'spectralLayoutVersion', '1.0' FROM a UNION ALL SELECT DISTINCT part::BIGINT, 'emissiveUnits', 'W.m^-2' FROM a",
)
def _set_attributes(spark, sf_dir):
    a = literal(spark, _ATTRIBUTES, "part long, name string, value string").groupBy("part").agg(F.collect_list(F.struct("name", "value")).alias("attributes"))
    return a.select("part", F.explode(spectral.with_spectral_attributes(F.col("attributes"), "1.0", "W.m^-2")).alias("a")).select("part", "a.name", "a.value")
