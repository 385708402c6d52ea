"""Digests of texts of many rows, against the text put together in one piece."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import digests
from tallyframe.plans.queries import QUERIES

from .conftest import SF


def rows(n):
    return [(k, None if k % 9 == 4 or 20 <= k < 30 else ["", "é;|", "x" * (k % 50)][k % 3] + str(k)) for k in range(n)]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_pieces_come_in_order(spark, size):
    given = rows(300)
    frame = spark.createDataFrame(given, "row_id long, t string").repartition(6)
    texts = [t for _, t in given if t is not None]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # many batches
    try:
        got = digests.text_digest(frame, F.col("t"), rows_a_piece=size).first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert tuple(got) == (len(texts), hashlib.sha256(";".join(texts).encode()).hexdigest())
    assert max(p.rows for p in digests.text_pieces(frame, F.col("t"), rows_a_piece=size).collect()) <= size


def test_digest_of_no_rows(spark):
    none = spark.createDataFrame([(0, None)], "row_id long, t string")
    assert tuple(digests.text_digest(none, F.col("t")).first()) == (0, None) == tuple(digests.text_digest(none.limit(0), F.col("t")).first())
    empty = spark.createDataFrame([(0, "")], "row_id long, t string")
    assert tuple(digests.text_digest(empty, F.col("t")).first()) == (1, hashlib.sha256(b"").hexdigest())


def test_no_row_holds_the_ledger(spark):
    """The preview's digest comes of pieces: nothing is collected without a group."""
    plan = QUERIES["preview_entries"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    collects = re.findall(r"Aggregate \[.*collect_list.*", plan)
    assert collects and not [x for x in collects if re.match(r"Aggregate \[(array_sort\()?collect_list", x)]


def test_preview_of_an_empty_ledger(spark, tmp_path):
    spark.read.parquet(f"{SF}/orders.parquet").limit(0).write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["preview_entries"](spark, f"file://{tmp_path}").first()
    assert (got.entry_count, got.entries, got.entries_sha256) == (0, 0, None)  # as in SQL
