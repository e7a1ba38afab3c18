"""Every query of the reference's operators runs on the smallest tables and agrees with its SQL there."""

import os

import duckdb
import pytest

from textloom.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("pages", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)
    if name not in ORACLE:
        assert got
        return
    found = duck.sql(ORACLE[name])
    assert sorted(found.columns) == columns
    assert got == sorted([tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall()], key=repr)
