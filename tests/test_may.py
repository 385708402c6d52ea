"""Columns of dates that begin with a May, whose short name is its full one."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import dates
from tallyframe.operators import normalize
from tallyframe.plans.queries import DATE_FORMS, QUERIES
from tallyframe.plans.sql import SQL

from .conftest import SF

SHORT, FULL = ["8 May 1999", "9 Jan 2000", "1 Sep 2000"], ["8 May 1999", "9 January 2000", "1 September 2000"]
US_SHORT, US_FULL = ["MAY 8, 1999", "Jan 9, 2000", "Sep 1, 2000"], ["May 8, 1999", "January 9, 2000", "September 1, 2000"]
WANT = ["1999-05-08", "2000-01-09", "2000-09-01"]


def read(spark, first, texts):
    rows = spark.createDataFrame([(first, t) for t in texts], "first string, t string").coalesce(1)
    return [r[0] for r in rows.select(dates.iso_day(dates.parse_date(F.col("t"), dates.format_of(F.col("first"))))).collect()]


@pytest.mark.parametrize("column", [SHORT, FULL, US_SHORT, US_FULL])
def test_a_column_that_begins_with_may(spark, column):
    assert read(spark, column[0], column) == WANT


def test_what_else_stays_null(spark):
    assert read(spark, "8 May 1999", ["MayMay 8, 1999", "9 Janu 2000", "31 February 2000", "May 8, 1999", "1999-05-08", "09/01/2000", "", None, "40 May 1999"]) == [None] * 9
    assert read(spark, "40 May 1999", ["8 May 1999", "1999-05-08"]) == [None, "1999-05-08"]  # no date: ISO
    assert read(spark, "8 Jan 1999", ["9 May 1999", "9 June 1999"]) == ["1999-05-09", None]  # short names alone
    assert read(spark, "8 June 1999", ["9 May 1999", "9 Jan 1999"]) == ["1999-05-09", None]  # full names alone
    assert read(spark, "8-May-1999", ["9-May-1999", "9-Jan-2000"]) == ["1999-05-09", "2000-01-09"]


def test_a_file_that_begins_with_may(spark):
    lines = [("f", 0, ["date", "amount"])] + [("f", k + 1, [d, "1"]) for k, d in enumerate(FULL)]
    ledger = normalize.to_ledger(spark.createDataFrame(lines, "source_file string, pos long, cells array<string>"))
    assert [str(r.date)[:10] for r in ledger.orderBy("row_id").collect()] == WANT


def test_every_column_begins_with_may(spark, tmp_path):
    """Orders whose first one in each column is of May, one without a date, one without a key, and a column that has none but "soon"."""
    n = len(DATE_FORMS)
    orders = spark.read.parquet(f"{SF}/orders.parquet").where(f"o_orderkey < 300 AND (o_orderkey % {n} <> 3 OR o_orderkey % 13 = 0)")
    key = F.when(F.col("o_orderkey") != 57, F.col("o_orderkey"))
    day = F.when(key.isNull() | (key > 2 * n), F.when(F.col("o_orderkey") != 59, F.col("o_orderdate"))).otherwise(F.lit("1999-05-08").cast("timestamp_ntz"))
    orders.select(key.alias("o_orderkey"), day.alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = QUERIES["date_parse"](spark, f"file://{tmp_path}").select("o_orderkey", "day").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(duck.sql(f"SELECT o_orderkey, day FROM ({SQL['date_parse']})").fetchall(), key=repr) and len(got) == orders.count()
