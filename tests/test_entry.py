"""The registered core queries run, and agree with their SQL twins on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from tideline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert len(got) or name in ("user_sessions",)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    want = con.execute(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)
