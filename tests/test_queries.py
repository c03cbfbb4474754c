"""Every registered query with SQL equals DuckDB's rows at the smallest scale."""

from __future__ import annotations

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

from rasterloom.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert table(df.columns, df.collect()) == table(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_training_data(tmp_path):
    """The entry module and the raster queries don't need the training-data subpackage."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(["cp", "-r", f"{root}/rasterloom", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/rasterloom/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'deep_statistics' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def on_table(spark, folder, query, name, schema, rows):
    """Rows of a query and of its SQL over one made-up table, as text: signs of zeros count."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    df, c = QUERIES[query](spark, str(folder)), duckdb.connect()
    c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    want = c.sql(SQL[query])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    return [sorted(repr(tuple(r[at.index(n)] for n in order)) for r in rows) for at, rows in ((df.columns, map(tuple, df.collect())), (want.columns, want.fetchall()))]


def test_half_rounding_of_odd_values(spark, tmp_path):
    """float_half_rounding at zeros, ties and beyond the range of halves (at zeros it gave 0 and the SQL NaN)."""
    values = [0.0, -0.0, -1.5, None, math.nan, math.inf, -math.inf, 65519.0, 65520.0, 70001.0, 2.0**-14, 1.2345e-5, 3e-8, 2.0**-25, 1e-300, 2.0**-1064, 2.0**-1065, 5e-324, 1e300, 1.7976931348623157e308]
    values += [2048.0 + 1, 2048.0 + 3, 1 + 2.0**-11, 1 + 3 * 2.0**-11] + [2.0**k * s for k in range(-30, 31) for s in (1, 1 - 2.0**-53, 1 + 2.0**-52)]
    rows = [(i, i * 7, v) for i, v in enumerate(values)]
    got, want = on_table(spark, tmp_path, "float_half_rounding", "events", "event_id long, user_id long, value double", rows)
    assert got == want


def test_pixel_spectrum_of_odd_vectors(spark, tmp_path):
    """pixel_spectrum row for row: small negative values (they lost their sign), equal ids (they were joined), null and empty vectors (they were left out)."""
    vectors = [[-1e-7, 1e-7, -0.0, 0.0, -4.9e-7, -5.1e-7], [1.0, 2.0], [4.0, 3.0], [1.0, 2.0], None, [], [None, 0.5, None], [None], [math.nan, math.inf, -math.inf, 3.4e38, -1.2345679e15, 4.5e9, 4503599627.0]]
    vectors += [[(2 * k + 1) * s / 128 for k in range(-70, 70)] + [k / 3 * s for k in range(40)] for s in (1.0, -1.0, 1e3, 1e-4)]
    ids = [3, 26, 26, 26, 27, 28, 29, 30, -7, -30, 0, None, None]
    rows = [(i, v) for i, v in zip(ids, vectors, strict=True)]
    got, want = on_table(spark, tmp_path, "pixel_spectrum", "embeddings", "vec_id long, embedding array<float>", rows)
    assert len(got) == len(rows) and got == want
