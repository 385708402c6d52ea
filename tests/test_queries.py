"""Every ledger query against DuckDB over the smallest tables, and the streaming extension."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tallyframe.plans.queries import QUERIES
from tallyframe.plans.sql import SQL
from tallyframe.schema import LEDGER
from tallyframe.streaming import drop_folder

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    ours = sorted([tuple(map(plain, r)) for r in frame.select(*columns).collect()], key=repr)
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert ours == sorted([tuple(plain(r[k]) for k in at) for r in found.fetchall()], key=repr)


def test_driver_contract(spark):
    assert driver.entry(spark).count() > 0
    assert set(QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


def test_posting_stream(spark, tmp_path):
    rows = [(k, "2026-06-04", "Fee", "", float(k % 3)) for k in range(9)]
    ledger = spark.createDataFrame(rows, "row_id long, date string, description string, reference string, amount double").withColumn("date", F.col("date").cast("timestamp_ntz"))
    inbox, posted = f"file://{tmp_path}/in", f"file://{tmp_path}/posted"
    for _ in range(2):  # the second delivery brings nothing new
        ledger.select(*LEDGER.names).write.mode("append").parquet(inbox)
        drop_folder.post_batches(drop_folder.ledger_stream(spark, inbox), posted, f"file://{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(posted).count() == 3
    once = drop_folder.once_within(drop_folder.ledger_stream(spark, inbox)).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination(120)
    assert spark.table("once").count() == 3
