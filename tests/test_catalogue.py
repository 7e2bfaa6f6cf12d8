"""Every catalogue query against its SQL at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quern.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    rows, cols = df.collect(), sorted(df.columns)
    if name in catalogue.ORACLES:
        r = con.sql(catalogue.ORACLES[name])
        assert sorted(r.columns) == cols
        at = [r.columns.index(c) for c in cols]
        want = sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)
        assert sorted((tuple(norm(x[c]) for c in cols) for x in rows), key=repr) == want
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_text_filters_reach_the_scan(spark):
    plan = catalogue.QUERIES["recommend"](spark, SMALL)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "ReadSchema: struct<p_partkey" in plan
