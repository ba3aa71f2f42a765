"""Every registered query against its SQL oracle on the smallest tables, and rules on their plans."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def text(v):
    if v is None:
        return "~"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_oracle(spark, oracle, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "ExistingRDD"):
        assert forbidden not in plan, forbidden
    columns = sorted(df.columns)
    got = sorted(tuple(map(text, r)) for r in df.select(*columns).collect())
    result = oracle.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in columns]
    want = sorted(tuple(text(r[i]) for i in order) for r in result.fetchall())
    assert sorted(names) == columns
    assert got == want


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
