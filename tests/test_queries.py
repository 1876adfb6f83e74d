"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from brightquay.plans.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def norm(v):
    """Values as comparable text."""
    return ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def db():
    """DuckDB with the tables as views."""
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    """Equal rows where there is SQL, and rows at all where there is none."""
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    r = db.sql(ORACLE_SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert got == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())


def test_inventory_names_queries():
    """Every query is listed, and nothing else."""
    from brightquay.plans.inventory import IDS, queries_of

    assert set(IDS) == set(QUERIES) and queries_of("M9") == ["render_features", "daily_measures"]
