"""The posting plan kept by key over micro-batches, against the plan of all rows at once."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import postings
from tallyframe.schema import LEDGER, POSTED
from tallyframe.sources.remote import OUTCOMES
from tallyframe.streaming import drop_folder, keyed_postings


@pytest.fixture(autouse=True)
def one_state_store(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Runs:
    """A stream over two folders that goes on from its checkpoint."""

    def __init__(self, spark, at, posted=None, keep_ms=None):
        self.spark, self.at, self.posted, self.keep_ms = spark, f"file://{at}", posted, keep_ms
        spark.createDataFrame([], LEDGER).write.parquet(f"{self.at}/rows")
        spark.createDataFrame([], OUTCOMES).write.parquet(f"{self.at}/run/outcomes")

    def started(self, **trigger):
        both = keyed_postings.events(drop_folder.ledger_stream(self.spark, f"{self.at}/rows", 1), keyed_postings.outcome_stream(self.spark, f"{self.at}/run"))
        told = keyed_postings.changes(both, self.posted, self.keep_ms)
        def keep(batch, number):
            batch.write.mode("overwrite").parquet(f"{self.at}/told/batch={number}")

        return told.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{self.at}/state").trigger(**trigger).start()

    def go(self):
        assert self.started(availableNow=True).awaitTermination(90)

    def bring(self, rows):
        rows.select(*LEDGER.names).coalesce(1).write.mode("append").parquet(f"{self.at}/rows")

    def report(self, tries):
        self.spark.createDataFrame(tries, OUTCOMES).coalesce(1).write.mode("append").parquet(f"{self.at}/run/outcomes")

    def standing(self):
        told = keyed_postings.standing(self.spark.read.parquet(f"{self.at}/told"))
        return {r.row_id: (r.status, r.detail, r.posted_id, r.turn) for r in told.collect()}


def ledger(spark, ids):
    rows = [(k, "2026-06-04", f"Payee {k % 4}", "", 10.0 + k % 4) for k in ids]
    return spark.createDataFrame(rows, "row_id long, date string, description string, reference string, amount double").withColumn("date", F.col("date").cast("timestamp_ntz"))


def batch(spark, ids, posted, tries):
    plan = postings.plan_postings(ledger(spark, ids), posted)
    frame = postings.with_outcomes(plan, spark.createDataFrame(tries, OUTCOMES)) if tries else plan
    return {r.row_id: (r.status, r.detail, r.posted_id, r.turn) for r in frame.collect()}


def test_batches_give_the_plan_of_all_rows(spark, tmp_path):
    keys = {r.row_id: (r.txn_type, r.doc_number) for r in postings.with_keys(ledger(spark, range(4))).collect()}
    posted = spark.createDataFrame([(*keys[3], "old")], POSTED)
    runs = Runs(spark, tmp_path, posted)
    ids: list[int] = []
    for some in (range(6), range(6, 7), range(7, 13)):
        ids += some
        runs.bring(ledger(spark, some))
        runs.go()
        assert runs.standing() == batch(spark, ids, posted, [])
    # a create fails between batches, one works, one is still under way
    tries = [(*keys[0], 1, None, "boom"), (*keys[1], 1, "A1", None)]
    runs.report(tries)
    runs.go()
    assert runs.standing() == batch(spark, ids, posted, tries)
    assert runs.standing()[0] == ("error", "Could not be created: boom", None, 1) and runs.standing()[4][0] == "created"
    ids += range(13, 18)
    runs.bring(ledger(spark, range(13, 18)))
    runs.go()
    assert runs.standing() == batch(spark, ids, posted, tries)
    # all tries of a key fail; the row that comes next is tried
    more = [(*keys[0], k, None, f"boom {k}") for k in (2, 3, 4, 5)] + [(*keys[2], 1, "C1", None)]
    runs.report(more)
    runs.report(tries)  # told again: nothing changes
    runs.go()
    assert runs.standing() == batch(spark, ids, posted, tries + more)
    ids += [20]
    runs.bring(ledger(spark, [20]))
    runs.go()
    last = (*keys[0], 6, "Z9", None)
    runs.report([last])
    runs.go()
    got = runs.standing()
    assert got == batch(spark, ids, posted, [*tries, *more, last]) and got[20][2] == "Z9"


def test_state_expires(spark, tmp_path):
    """A key that nothing has touched for a while is new again."""
    runs = Runs(spark, tmp_path, keep_ms=500)
    query = runs.started(processingTime="100 milliseconds")
    try:
        for row in (0, 4):
            runs.bring(ledger(spark, [row]))
            until = time.time() + 60
            while not seen(runs, row):
                assert time.time() < until and query.isActive
                time.sleep(0.3)
            time.sleep(2)  # state is older than it may be
    finally:
        query.stop()
    assert seen(runs, 0) == [("created", None)] and seen(runs, 4) == [("created", None)]


def seen(runs, row):
    try:
        told = runs.spark.read.schema(keyed_postings.CHANGES).parquet(f"{runs.at}/told")
        return [(r.status, r.posted_id) for r in told.where(F.col("row_id") == row).orderBy("change").collect()]
    except Exception as e:  # noqa: BLE001  no batch yet, or one that is being written
        if not any(x in str(e) for x in ("PATH_NOT_FOUND", "FILE_NOT_EXIST", "does not exist")):
            raise
        return []
