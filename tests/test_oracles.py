"""Every registered query against its DuckDB oracle at sf0.001 (exact values after type normalisation)."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tools.oracle_check import TABLES, key, norm  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
    res = con.sql(ORACLES[name])
    assert sorted(sdf.columns) == sorted(res.columns)
    order = [res.columns.index(c) for c in sdf.columns]
    drows = [tuple(norm(r[i]) for i in order) for r in res.fetchall()]
    assert sorted(srows, key=key) == sorted(drows, key=key)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["Brand", "total", "rank"]
