"""Every core query that has SQL, run side by side with it on the smallest given tables; every other one for rows and schema."""

import glob
import math
import os

import pytest

from chartloom.plans import registry

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert len(at) == len(result.description)
    assert got == sorted(repr([plain(row[i]) for i in at]) for row in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, DATA)
    assert df.count() >= 0 and df.columns


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 0
