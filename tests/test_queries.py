"""Every query with SQL gives what DuckDB gives on the smallest tables; the others give rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from terrasieve.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return float(x) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x if isinstance(x, (bool, str)) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(cell(r[c]) for c in columns) for r in df.collect()]
    rel = con.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = [tuple(cell(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in rel.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_flagship_and_entry(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert __spark_entry__.entry(spark).count() == 5


def against_sql(spark, folder, name, **tables):
    """A query and its SQL over tables of the test's own."""
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t, rows in tables.items():
        c.execute(f"COPY ({rows}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = [tuple(cell(r[x]) for x in columns) for r in df.collect()]
    found = c.execute(catalogue.SQL[name])
    at = [[d[0] for d in found.description].index(x) for x in columns]
    want = [tuple(cell(r[i]) for i in at) for r in found.fetchall()]
    assert got and sorted(got, key=repr) == sorted(want, key=repr)


def test_polygons_beyond_the_raster(spark, tmp_path):
    against_sql(spark, tmp_path, "polygon_pixels", supplier="SELECT 400 + i AS s_suppkey FROM range(60) r(i)")


def test_days_of_zero_power_are_unknown(spark, tmp_path):
    against_sql(spark, tmp_path, "grid_complete", events="SELECT i % 3 AS user_id, TIMESTAMP '2024-01-01' + INTERVAL (i) DAY AS ts, CASE WHEN i % 4 = 0 THEN 0.001 ELSE i * 1.0 END AS value FROM range(30) r(i)")


@pytest.mark.parametrize("rows", [f"SELECT * FROM '{SF}/lineitem.parquet'", f"SELECT * FROM '{SF}/lineitem.parquet' LIMIT 0"])
def test_edges_of_hard_cases_are_selected_by_counts(spark, tmp_path, monkeypatch, rows):
    from pyspark.sql import functions as F

    monkeypatch.delattr(F, "percentile")  # it takes all values to one task
    duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    assert catalogue.QUERIES["hard_cases"](spark, str(tmp_path)).count() == (0 if "LIMIT" in rows else 80)
