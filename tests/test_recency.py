"""W5 on messages beyond the one asked for: the rows are DuckDB's, to the last place and beyond the largest double."""

from __future__ import annotations

import datetime

import duckdb

import __spark_entry__

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_later_messages(spark, tmp_path):
    now = datetime.datetime(2024, 1, 1)
    rows = [(i * 331, now, i % 5, "signup", 1.0, f'{{"k": {i % 40}}}') for i in range(400)] + [(6_000_000, now, 1, "signup", 1.0, '{"k": 7}')]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = __spark_entry__.queries()["w5_minmax_recency"](spark, str(tmp_path)).select("conv_id", "slot", "version", "recency", "norm").collect()
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(f"select conv_id, slot, version, recency, norm from ({__spark_entry__.oracle_sql()['w5_minmax_recency']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and any(1 < x[3] < float("inf") for x in want) and any(x[3] == float("inf") for x in want)
