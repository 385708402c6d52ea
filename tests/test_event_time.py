"""Totals by event time, streamed and at once, and sketches kept by day against exact values."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import sketches
from tallyframe.schema import LEDGER
from tallyframe.streaming import drop_folder, windows

T0 = datetime(2026, 3, 1)


def rows_at(spark, hours, first=0):
    rows = [(first + k, None if h is None else T0 + timedelta(hours=h), f"p{k % 2}", "", float(k % 7 - 3)) for k, h in enumerate(hours)]
    return spark.createDataFrame(rows, "row_id long, date timestamp_ntz, description string, reference string, amount double")


@pytest.mark.parametrize("kind", ["sliding", "sessions"])
def test_stream_gives_what_the_table_gives(spark, tmp_path, kind):
    r = random.Random(4)
    make = lambda frame, delay=None: windows.sliding(frame, "6 hours", "2 hours", "description", delay=delay) if kind == "sliding" else windows.sessions(frame, "3 hours", "description", delay=delay)
    early = [r.uniform(0, 60) for _ in range(40)]
    late = [r.uniform(45, 60) for _ in range(15)] + [r.uniform(60, 90) for _ in range(20)]  # within the delay of what came before
    too_late = [r.uniform(0, 10) for _ in range(9)]
    steps = [rows_at(spark, early, 0), rows_at(spark, late, 100), rows_at(spark, [*too_late, None, 91.0], 200), rows_at(spark, [1000.0], 300), rows_at(spark, [2000.0], 400)]
    inbox, before = f"file://{tmp_path}/in", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for step in steps:
            step.select(*LEDGER.names).coalesce(1).write.mode("append").parquet(inbox)
            stream = make(drop_folder.ledger_stream(spark, inbox), "20 hours")
            query = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
            assert query.awaitTermination(120)
        got = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    whole = steps[0].unionAll(steps[1]).unionAll(rows_at(spark, [91.0], 300)).unionAll(steps[3])
    want = sorted(map(tuple, make(whole).collect()))
    counts = lambda rows: [(x[0], x[1], x[2], x[3]) for x in rows if x[1] < T0 + timedelta(hours=1500)]
    assert counts(got) == counts(want) and sum(x[3] for x in got) < sum(x[3] for x in sorted(map(tuple, make(whole.unionAll(rows_at(spark, too_late, 500))).collect())))


def test_windows_of_a_table(spark):
    frame = rows_at(spark, [0, 1, 5, None, 7.99, 30])
    got = {(r.description, r.begins, r.entry_count) for r in windows.sliding(frame, "4 hours", "4 hours", "description").collect()}
    assert got == {("p0", T0, 1), ("p1", T0, 1), ("p0", T0 + timedelta(hours=4), 2), ("p1", T0 + timedelta(hours=28), 1)}
    found = sorted((r.begins, r.ends, r.entry_count) for r in windows.sessions(frame, "4 hours").collect())
    assert found == [(T0, T0 + timedelta(hours=11.99), 4), (T0 + timedelta(hours=30), T0 + timedelta(hours=34), 1)]


def test_sketches_of_any_period(spark, tmp_path):
    r = np.random.default_rng(6)
    n = 40_000
    days, amounts, names = r.integers(0, 60, n), np.round(np.exp(r.normal(3, 2, n)) * r.choice([-1, 1], n), 2), r.integers(0, 9000, n)
    rows = [(k, T0 + timedelta(days=int(d)), f"payee {p}", "", float(a)) for k, (d, p, a) in enumerate(zip(days, names, amounts, strict=True))]
    ledger = spark.createDataFrame(rows, "row_id long, date timestamp_ntz, description string, reference string, amount double").repartition(7)
    sketches.daily(ledger).write.parquet(f"file://{tmp_path}/kept")  # stored, then merged for periods
    kept = spark.read.parquet(f"file://{tmp_path}/kept")
    assert kept.count() == 60
    wanted = (0.01, 0.25, 0.5, 0.9, 0.99)
    for low, high in ((0, 59), (10, 20), (33, 33)):
        first, last = (str((T0 + timedelta(days=d)).date()) for d in (low, high))
        got = sketches.period(kept, first, last, quantiles=wanted).first()
        inside = (days >= low) & (days <= high)
        assert got.entries == inside.sum() and got.total == pytest.approx(amounts[inside].sum())
        for q, v in zip(wanted, got.quantiles, strict=True):
            assert abs((amounts[inside] <= v).mean() - q) <= sketches.RANK_ERROR + 1 / inside.sum()
        assert abs(got.payees / len(set(names[inside].tolist())) - 1) <= sketches.DISTINCT_ERROR
    odd = spark.createDataFrame([(0, T0, "a", "", float("inf")), (1, None, "b", "", 1.0), (2, T0, "a", "", float("nan")), (3, T0, "c", "", 2.5)], ledger.schema)
    one = sketches.merged(sketches.daily(odd)).first()
    assert (one.entries, one.total, one.quantiles, one.payees) == (3, 2.5, [2.5] * 3, 2)
    assert sketches.merged(sketches.daily(odd.limit(0)), "day").count() == 0
