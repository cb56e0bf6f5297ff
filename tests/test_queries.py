"""Every registered query with SQL returns what DuckDB does, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tracewell import oracles, record_queries
from tracewell import queries as own

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = own.QUERIES | record_queries.QUERIES, oracles.ORACLES | record_queries.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(frame):
    def one(v):
        return None if pd.isna(v) else round(float(v), 6) if isinstance(v, float) else v

    return sorted((tuple(one(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = con.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
