"""Raster views over the driver's tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100

#: pixels(y, x, value, r, g, b, a): one event is one pixel of an image 100 wide.
PIXELS_SQL = f"px AS (SELECT event_id // {WIDTH} AS y, event_id % {WIDTH} AS x, value, value / 100 AS r, (event_id % 97) / 97.0::DOUBLE AS g, (user_id % 31) / 31.0::DOUBLE AS b, 1.0::DOUBLE - (event_id % 5) / 10.0::DOUBLE AS a FROM events)"

#: deep_pixels(y, x, cnt): an order is a pixel, its line items are its samples.
DEEP_SQL = f"dp AS (SELECT o_orderkey // {WIDTH} AS y, o_orderkey % {WIDTH} AS x, coalesce(n, 0)::BIGINT AS cnt FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) t ON l_orderkey = o_orderkey)"

#: deep_images(image, y, x, cnt): the same as images of 10 lines.
DEEP_IMAGES_SQL = f"{DEEP_SQL}, di AS (SELECT y // 10 AS image, y % 10 AS y, x, cnt FROM dp)"

#: spectral(y, x, wavelength_idx, wavelength, value): a vector is a pixel's spectrum, 25 pixels wide.
SPECTRAL_SQL = "sp AS (SELECT vec_id // 25 AS y, vec_id % 25 AS x, (i - 1)::BIGINT AS wavelength_idx, 400.0::DOUBLE + 5 * (i - 1) AS wavelength, embedding[i]::DOUBLE AS value FROM embeddings, generate_series(1, 64) g(i))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    y, x = F.expr(f"event_id div {WIDTH}"), e % WIDTH
    return table(spark, sf_dir, "events").select(y.alias("y"), x.alias("x"), "value", (F.col("value") / 100).alias("r"), ((e % 97) / 97.0).alias("g"), ((F.col("user_id") % 31) / 31.0).alias("b"), (1.0 - (e % 5) / 10.0).alias("a"))


#: Lines of an image where a query needs images of one size.
LINES = 10
#: images(image, y, x, value, r, g, b, a): the pixels as images of 10 lines.
IMAGES_SQL = f"{PIXELS_SQL}, im AS (SELECT y // {LINES} AS image, y % {LINES} AS y, x, value, r, g, b, a FROM px)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return p.select(F.expr(f"y div {LINES}").alias("image"), (F.col("y") % LINES).alias("y"), "x", "value", *"rgba")


def deep_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    joined = orders.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(F.expr(f"o_orderkey div {WIDTH}").alias("y"), (F.col("o_orderkey") % WIDTH).alias("x"), F.coalesce("n", F.lit(0)).cast("long").alias("cnt"))


def deep_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deep pixels as images of 10 lines."""
    return deep_pixels(spark, sf_dir).select(F.expr(f"y div {LINES}").alias("image"), (F.col("y") % LINES).alias("y"), "x", "cnt")


def spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return long.select(F.expr("vec_id div 25").alias("y"), (F.col("vec_id") % 25).alias("x"), F.col("i").cast("long").alias("wavelength_idx"), (F.col("i") * 5 + 400.0).alias("wavelength"), F.col("v").cast("double").alias("value"))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def with_rows(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str, source: str, expressions: dict[str, str]) -> DataFrame:
    """Literal rows, and one for each row of a table."""
    given = literal(spark, rows, schema)
    return given.unionByName(table(spark, sf_dir, source).select(*(F.expr(e).cast(given.schema[n].dataType).alias(n) for n, e in expressions.items())))


def with_rows_sql(name: str, rows: list[tuple], source: str, expressions: dict[str, str]) -> str:
    """The same as common table expressions; the expressions mean the same to Spark and DuckDB."""
    return f"{values_sql(f'{name}_given', list(expressions), rows)}, {name} AS (SELECT * FROM {name}_given UNION ALL SELECT {', '.join(f'{e} AS {n}' for n, e in expressions.items())} FROM {source})"


def values_sql(name: str, columns: list[str], rows: list[tuple]) -> str:
    """A common table expression of literal rows."""

    def say(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)})"


#: A spectral channel's name (or another) for each event; wavelengths lie near each other.
EVENT_CHANNEL = (
    "concat(CASE user_id % 8 WHEN 0 THEN 'S0.' WHEN 1 THEN 'S1.' WHEN 2 THEN 'S2.' WHEN 3 THEN 'S3.' WHEN 4 THEN 'T.' WHEN 5 THEN 'R' WHEN 6 THEN 'S4.' ELSE 'S0.' END, "
    "400 + event_id * 37 % 11, CASE event_id % 4 WHEN 0 THEN ',000000nm' WHEN 1 THEN ',004000nm' WHEN 2 THEN ',008000nm' ELSE ',012000nm' END)"
)
