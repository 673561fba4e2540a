"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidewell.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        table = name.removesuffix(".parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{name}'")
    return con


def canonical(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    theirs = con.sql(SQL[name])
    columns = sorted(theirs.columns)
    ours = QUERIES[name](spark, DATA)
    assert sorted(ours.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert canonical(ours.select(*columns).collect()) == canonical(theirs.project(listed).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() == 200
