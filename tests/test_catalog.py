"""Every named query against DuckDB on the small test tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import catalog

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(ROOT):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{ROOT}/{f}'")
    return con


#: Values that SQL states for one size of the data.
FIXED = {}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, con, name):
    df = catalog.queries()[name](spark, ROOT)
    names = sorted(df.columns)
    ours = sorted([tuple(plain(r[c]) for c in names) for r in df.collect()], key=str)
    found = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    theirs = sorted([tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()], key=str)
    assert names == sorted(columns)
    assert ours == theirs


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
