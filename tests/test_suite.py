"""Every registered query of the engine against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from wayfinder.operators import suite

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(suite.queries()))
def test_query_equals_its_sql(spark, con, name):
    df = suite.queries()[name](spark, DIR)
    cur = con.execute(suite.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
