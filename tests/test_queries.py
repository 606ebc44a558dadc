"""Every registered query with SQL gives DuckDB's rows; the others run and give rows."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from lorekeep.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(row):
    return tuple((x is None, str(round(x, 6) + 0.0) if isinstance(x, float) else str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*[f"`{c}`" for c in names]).collect())
    if name in ORACLE_SQL:
        assert sorted(duck.sql(ORACLE_SQL[name]).columns) == names
        want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in names)} from ({ORACLE_SQL[name]})").fetchall()
        assert got == sorted(map(plain, want))
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
