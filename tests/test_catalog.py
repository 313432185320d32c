"""Every query of the catalogue against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from grantmill.plans import catalog
from grantmill.plans.dialect import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def _rows(rows, cols):
    at = [cols.index(c) for c in sorted(cols)]
    return sorted(repr(tuple(_plain(r[i]) for i in at)) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert len(QUERIES) > 120


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    r = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    assert _rows(df.collect(), df.columns) == _rows(r.fetchall(), r.columns)
