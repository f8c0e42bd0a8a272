"""Every registered query that has SQL gives what DuckDB gives; the others run and keep a stable schema."""

import math

import duckdb
import pytest

from larder.plans import catalog
from larder.plans.fixtures import BASE


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for name in BASE:
        c.sql(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_duckdb(name, spark, sf_dir, duck):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(norm(v) for v in row) for row in df.select(*columns).collect())
    theirs = duck.sql(catalog.SQL[name])
    names = theirs.columns
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ours == sorted(tuple(norm(row[i]) for i in at) for row in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark, sf_dir):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:2] == ["guide", "rank"]
