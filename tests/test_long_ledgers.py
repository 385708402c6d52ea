"""Joins by time, documents in pieces and previews in pages, against the plain way."""

from __future__ import annotations

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import numbering, ofx, summary, temporal
from tallyframe.sources import sinks

LEDGER = "row_id long, date string, description string, reference string, amount double"


@pytest.fixture(scope="module")
def ledger(spark):
    rows = [(k, None if k % 17 == 5 else f"2026-{k % 12 + 1:02d}-{k % 28 + 1:02d}", "Payé & <Co>" if k % 3 else "", f"R{k}", (-1) ** k * k / 4) for k in range(230)]
    return spark.createDataFrame(rows, LEDGER).withColumn("date", F.col("date").cast("timestamp_ntz")).repartition(5)


# joins by time


def moment(r):
    return datetime(2026, 1, 1) + timedelta(minutes=r.randint(0, 400_000))


@pytest.mark.parametrize("days", [1, 20, 10_000])
def test_as_of(spark, days):
    r = random.Random(days)
    accounts = ["hot"] * 6 + ["a", "b", None, "only left"]
    left = [(k, r.choice(accounts), None if k % 31 == 0 else moment(r)) for k in range(300)]
    right = [(r.choice(["hot", "hot", "a", "b", None, "only right"]), None if k % 29 == 0 else moment(r), float(k)) for k in range(120)]
    right += [(b, t, v + 1000) for b, t, v in right[:20]] + right[5:9]  # ties and repeated rows
    left += [(500 + k, b, t) for k, (b, t, _) in enumerate(right[:30])]  # at the very moment
    frame = spark.createDataFrame(left, "n long, account string, at timestamp_ntz").withColumn("_row", F.lit("x"))
    values = spark.createDataFrame(right, "account string, day timestamp_ntz, balance double")
    got = temporal.as_of(frame, values, "account", "at", {"balance": "balance", "day": "since"}, "day", days=days)
    assert got.columns == ["n", "account", "at", "_row", "balance", "since"]

    def want(b, t):
        return max(((d, v) for a, d, v in right if b is not None and t is not None and a == b and d is not None and d <= t), default=(None, None))

    assert {x.n: (x.since, x.balance) for x in got.collect()} == {n: want(b, t) for n, b, t in left}
    assert temporal.as_of(frame.limit(0), values, "account", "at", {"balance": "v"}, "day").count() == 0
    assert {x.v for x in temporal.as_of(frame, values.limit(0), "account", "at", {"balance": "v"}, "day").collect()} == {None}


@pytest.mark.parametrize(("days", "most"), [(3, 10), (3, 200_000), (365, 7)])
def test_moments_within_periods(spark, days, most):
    r = random.Random(days)
    moments = [(k, r.choice(["hot", "hot", "hot", "a", None]), None if k % 41 == 0 else moment(r)) for k in range(240)]
    periods = []
    for k in range(60):
        begin = moment(r)
        periods.append((1000 + k, r.choice(["hot", "a", None]), begin, begin + timedelta(minutes=r.choice([0, -5, 1, 9000, 90_000]))))
    moments += [(700 + 2 * k + j, a, t) for k, (_, a, b, e) in enumerate(periods[:20]) for j, t in enumerate((b, e))]  # on the edges
    m = spark.createDataFrame(moments, "n long, account string, at timestamp_ntz")
    p = spark.createDataFrame(periods, "p long, account string, begins timestamp_ntz, ends timestamp_ntz")
    got = temporal.within(m, p, "account", "at", "begins", "ends", days=days, most=most)
    assert got.columns == ["n", "account", "at", "p", "begins", "ends"]
    want = sorted((n, q) for n, a, t in moments for q, b, s, e in periods if a is not None and a == b and t is not None and s <= t < e)
    assert sorted((x.n, x.p) for x in got.collect()) == want and len(want) > 50


# documents in pieces


@pytest.mark.parametrize("bucket", [7, 500_000])
@pytest.mark.parametrize("kind", ["checking", "creditcard"])
def test_pieces_are_the_document(spark, ledger, kind, bucket):
    whole = ofx.document(ledger, "12&3", kind, "9", "20260101000000").first()[0] + "\r\n"
    parts = ofx.document_parts(ledger, "12&3", kind, "9", "20260101000000", rows_a_bucket=bucket).orderBy("part").collect()
    assert "".join(p.text + "\r\n" for p in parts) == whole and len(parts) > 200
    raw = whole.encode()
    assert all(raw[p.offset : p.offset + p.bytes] == (p.text + "\r\n").encode() for p in parts)
    assert ofx.document_parts(ledger.where("date IS NULL"), "1", kind).count() == 0


def test_joined_file(spark, ledger, tmp_path):
    sinks.write_ofx(ledger, f"file://{tmp_path}/out", "123", "savings", now="20260101000000", rows_a_bucket=20)
    names = [n for n in os.listdir(f"{tmp_path}/out") if not n.startswith(".")]
    assert names == ["part-00000.txt"]
    with open(f"{tmp_path}/out/{names[0]}", newline="") as f:
        assert f.read() == ofx.document(ledger, "123", "savings", now="20260101000000").first()[0] + "\r\n"


def test_running_sums(spark):
    rows = [(k, (k * 7) % 11) for k in range(100)]
    frame = spark.createDataFrame(rows, "row_id long, v long").repartition(6)
    got = {r.row_id: r.s for r in numbering.running(frame, F.col("v"), "s", rows_a_bucket=9).collect()}
    assert got == {k: sum(v for j, v in rows if j < k) for k, _ in rows}


def test_row_numbers_over_many_ranges(spark):
    r = random.Random(8)
    rows = [(None if k % 50 == 0 else r.choice([7, 7, r.randint(-5000, 5000)]), k) for k in range(3000)]
    frame = spark.createDataFrame(rows, "k long, t long").repartition(4)
    got = [(x.k, x.t) for x in numbering.number_rows(frame, "k", "t", rows_a_bucket=5).orderBy("row_id").collect()]  # 600 ranges
    assert got == sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


# previews in pages


def test_pages_are_the_preview(spark, ledger):
    whole = json.loads(summary.preview_json(ledger))["entries"]
    pages = summary.preview_pages(ledger, 50).orderBy("page").collect()
    assert [e for p in pages for e in json.loads(p.entries)] == whole
    assert [(p.first_row, p.last_row) for p in pages] == [(k, min(k + 49, 229)) for k in range(0, 230, 50)] and pages[-1].token is None
    token, seen = None, []
    for page in pages:
        one = summary.preview_page(ledger, token, 50).first()
        assert (one.entries, one.token) == (page.entries, page.token)
        seen += json.loads(one.entries)
        token = one.token
    assert seen == whole and token is None
    assert tuple(summary.preview_page(ledger.limit(0)).first()) == ("[]", None) and summary.preview_pages(ledger.limit(0)).count() == 0


def test_rows_that_come_in_meanwhile(spark, ledger):
    """A page is found by the number after which it comes, not by a count."""
    first = summary.preview_page(ledger.where("row_id >= 20"), None, 10).first()
    after = summary.preview_page(ledger, first.token, 10).first()
    assert [e["row_id"] for e in json.loads(after.entries)] == list(range(30, 40))
