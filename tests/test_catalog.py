"""Every registered query with SQL against DuckDB on the smallest tables; what is too slow for a test run is left to the driver."""

import os

import duckdb
import pytest

from tessera.plans import catalog, java, reports, syntax  # noqa: F401

DATA = "/root/testdata/sf0.001"
SLOW = {"scc_parts_distributed", "pagerank_distributed"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SLOW))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    found = db.execute(f"select {', '.join(columns)} from ({catalog.ORACLES[name]}) q")
    assert sorted(map(repr, found.fetchall())) == got


def test_all_have_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
