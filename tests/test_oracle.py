"""Every registered query with an oracle matches DuckDB on the smallest scale (the driver
runs the same comparison at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from notecover.sources.tables import TABLES
from conftest import SF_SMALL

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


def test_every_query_registered_with_a_callable():
    q = E.queries()
    assert len(q) >= 70 and set(ORACLE) <= set(q)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "f1" in df.columns
