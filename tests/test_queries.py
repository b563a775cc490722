"""Every query against its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return int(v) if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - {"pipeline"}))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    rows = got.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.columns
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == sorted(got.columns)
    names = sorted(got.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted(repr([plain(r[c]) for c in names]) for r in rows) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
