"""Periods of notices around the last day that is believed."""

import datetime

import duckdb

import oracle
from millrace.plans import calendar, catalog


def test_the_last_day_that_is_believed(spark, tmp_path):
    con, n = duckdb.connect(), len(calendar.NOTICES)
    days = [datetime.date(1997, 12, 10) + datetime.timedelta(k) for k in range(30)]  # in thirty years their ends are around the limit
    con.execute("CREATE TABLE orders(o_orderkey BIGINT, o_orderdate DATE)")
    con.executemany("INSERT INTO orders VALUES (?, ?)", [(i * n + k, d) for i, d in enumerate(days) for k in range(n)])
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
    oracle.check(spark, con, str(tmp_path), catalog.QUERIES["notice_deadlines"], catalog.ORACLES["notice_deadlines"])
