"""Every feed query against its SQL in DuckDB, and the driver's contract."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point
from emberdesk.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", [k for k, (_, s) in Q.REGISTRY.items() if s])
def test_query_equals_sql(spark, con, name):
    f, sql = Q.REGISTRY[name]
    df = f(spark, SF)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert Counter(tuple(plain(x) for x in r) for r in df.collect()) == want



def test_contract(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
