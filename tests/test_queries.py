"""Every query with an SQL equivalent gives the same rows."""

import math
import os

import duckdb
import pytest

from paperloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in registry.ORACLE_SQL:
        want = con.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert ordered(want.fetchall()) == ordered([[r[c] for c in want.columns] for r in rows])
    assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
