"""The create sink, its outcomes, and scans of a remote system."""

from __future__ import annotations

import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import postings
from tallyframe.sources import remote

LEDGER = "row_id long, date string, description string, reference string, amount double"


@pytest.fixture(scope="module")
def ledger(spark):
    rows = [(k, f"2026-06-{k % 20 + 1:02d}", f"Payee {k % 20}", "", float(10 + k % 20) * (-1 if k % 2 else 1)) for k in range(60)]
    return spark.createDataFrame(rows, LEDGER).withColumn("date", F.col("date").cast("timestamp_ntz"))


class Counting(remote.FolderRemote):
    """Notes each call in a folder beside it."""

    def note(self, what: str) -> int:
        os.makedirs(f"{self.folder}-calls", exist_ok=True)
        with open(f"{self.folder}-calls/{what.replace('/', ' ')}", "ab") as f:
            f.write(b"x")
            return f.tell()

    def calls(self, what: str) -> int:
        return sum(os.path.getsize(f"{self.folder}-calls/{n}") for n in os.listdir(f"{self.folder}-calls") if n.startswith(what))

    def create(self, txn_type, doc_number, document, row_id):
        self.note(f"create {txn_type} {doc_number}")
        return super().create(txn_type, doc_number, document, row_id)

    def page(self, wanted, n, columns):
        self.note(f"page {n}")
        self.note(f"columns {' '.join(columns)}")
        return super().page(wanted, n, columns)


class Refusing(Counting):
    """Refuses rows by number; at others it is busy once."""

    def create(self, txn_type, doc_number, document, row_id):
        if row_id < 40 and row_id % 3 == 0:
            raise remote.Refused(f"no {row_id}")
        if row_id % 3 == 1 and self.note(f"busy {row_id}") == 1:
            raise remote.Busy("later")
        return super().create(txn_type, doc_number, document, row_id)


class Dying(Counting):
    """Takes its worker down in the middle of a task, once: after the document is posted, before anyone is told."""

    def create(self, txn_type, doc_number, document, row_id):
        ident = super().create(txn_type, doc_number, document, row_id)
        if row_id == 7 and self.note("death") == 1:
            os._exit(1)
        return ident


def made(spark, ledger, client, folder, posted=None, **more):
    posted = spark.createDataFrame([], "txn_type string, doc_number string, id string") if posted is None else posted
    plan = postings.plan_postings(ledger, posted)
    docs = postings.documents(ledger, "35", "90", "70")
    kept, found = remote.push(plan, docs, client, folder, pause=0.0, **more)
    return {r.row_id: r for r in postings.with_outcomes(kept, found).collect()}


def test_each_key_is_created_once(spark, ledger, tmp_path):
    client = Counting(f"{tmp_path}/remote")
    got = made(spark, ledger, client, f"file://{tmp_path}/run")
    assert Counter(r.status for r in got.values()) == {"created": 20, "skipped_duplicate": 40} and client.calls("create") == 20
    assert {r.posted_id for r in got.values()} == {f"{k}-1" for k in range(20)} and all(got[k].posted_id == f"{k % 20}-1" for k in got)
    # what was posted is known to the next run
    again = made(spark, ledger, client, f"file://{tmp_path}/again", remote.scan(spark, client))
    assert {r.status for r in again.values()} == {"skipped_duplicate"} and client.calls("create") == 20
    assert again[45].posted_id == "5-1"


def test_refusals_leave_it_to_the_next_row(spark, ledger, tmp_path):
    client = Refusing(f"{tmp_path}/remote")
    got = made(spark, ledger, client, f"file://{tmp_path}/run")
    for first in range(20):  # rows first, first + 20, first + 40 share a key
        rows, made_by = [first, first + 20, first + 40], None
        for k in rows:
            if made_by is None and k < 40 and k % 3 == 0:
                assert (got[k].status, got[k].detail) == ("error", f"Could not be created: no {k}")
            elif made_by is None:
                made_by = k
                assert (got[k].status, got[k].posted_id) == ("created", f"{k}-1")
            else:
                assert (got[k].status, got[k].posted_id) == ("skipped_duplicate", f"{made_by}-1")
    assert client.calls("create") == 20
    busy = made(spark, ledger.where("row_id % 3 = 1"), Refusing(f"{tmp_path}/other"), f"file://{tmp_path}/busy", attempts=1)
    assert all(r.detail == "Could not be created: later" for r in busy.values() if r.status == "error") and "error" in {r.status for r in busy.values()}


def test_a_run_that_was_killed_goes_on(spark, ledger, tmp_path):
    client, folder = Dying(f"{tmp_path}/remote"), f"file://{tmp_path}/run"
    with pytest.raises(Exception):  # noqa: B017, PT011
        made(spark, ledger, client, folder)
    assert 0 < client.calls("create") <= 20
    got = made(spark, ledger, client, folder)
    assert Counter(r.status for r in got.values()) == {"created": 20, "skipped_duplicate": 40}
    names = os.listdir(f"{client.folder}-calls")
    assert all(os.path.getsize(f"{client.folder}-calls/{n}") == 1 for n in names if n.startswith("create")) and len(os.listdir(client.folder)) == 20


def test_key_with_many_rows(spark, tmp_path):
    """Turns are sent 1, then 2 to 3, then 4 to 7 and so on, not all at once."""

    class Late(Counting):
        def create(self, txn_type, doc_number, document, row_id):
            if row_id < 9:
                raise remote.Refused("too early")
            return super().create(txn_type, doc_number, document, row_id)

    rows = [(k, "2026-06-04", "Same", "", 5.0) for k in range(100)]
    same = spark.createDataFrame(rows, LEDGER).withColumn("date", F.col("date").cast("timestamp_ntz"))
    got = made(spark, same, Late(f"{tmp_path}/remote"), f"file://{tmp_path}/run")
    assert [got[k].status for k in range(12)] == ["error"] * 9 + ["created"] + ["skipped_duplicate"] * 2
    tries = remote.outcomes(spark, f"file://{tmp_path}/run")
    assert tries.count() == 10 and len(os.listdir(f"{tmp_path}/run/outcomes")) >= 4
    nothing = made(spark, same.where("row_id < 0"), Late(f"{tmp_path}/none"), f"file://{tmp_path}/nothing")
    assert nothing == {}


@pytest.fixture(scope="module")
def posted(spark, ledger, tmp_path_factory):
    folder = tmp_path_factory.mktemp("posted")
    made(spark, ledger, remote.FolderRemote(f"{folder}/remote"), f"file://{folder}/run")
    return f"{folder}/remote"


def test_filters_and_columns_reach_the_remote_system(spark, posted, tmp_path):
    client = Counting(posted, rows_a_page=3)
    whole = remote.scan(spark, client)
    assert whole.count() == 20 and client.calls("page") == 7 and whole.rdd.getNumPartitions() == 7
    key = whole.where("txn_type = 'Deposit'").first()
    before = client.calls("page")
    one = whole.where((F.col("txn_type") == "Deposit") & (F.col("doc_number") == key.doc_number) & (F.col("position") >= 0))
    assert one.count() == 1 and client.calls("page") == before + 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "position" in plan and "doc_number#" not in "".join(x for x in plan.splitlines() if "Filter" in x and "Scan" not in x)  # Spark has only the position left to compare
    some = remote.scan(spark, client, "doc_number", "id").where(F.col("doc_number").isin(key.doc_number, "none"))
    before = client.calls("page")
    assert [tuple(r) for r in some.collect()] == [(key.doc_number, key.id)] and client.calls("page") == before + 1 and client.calls("columns doc_number id") == 1


def test_lookup_asks_for_many_keys_at_once(spark, ledger, posted):
    client = Counting(posted, rows_a_page=100)
    keys = postings.with_keys(ledger).select("txn_type", "doc_number").unionAll(spark.createDataFrame([("Deposit", "R-none")], "txn_type string, doc_number string")).coalesce(1)
    before = client.calls("page") if os.path.exists(f"{posted}-calls") else 0
    found = remote.lookup(keys.distinct().coalesce(1), client, at_once=8)
    assert found.where("error IS NULL").count() == 20
    assert client.calls("page") - before <= 20

    class Down(remote.FolderRemote):
        def page(self, wanted, n, columns):
            raise remote.Busy("down")

    errors = remote.lookup(keys, Down(posted)).collect()
    assert {r.error for r in errors} == {"down"}
    # lookups that failed are errors of their own rows
    failed = postings.with_keys(ledger).join(remote.lookup(keys, Down(posted)).select("txn_type", "doc_number", "error"), ["txn_type", "doc_number"]).select("row_id", "error")
    plan = postings.plan_postings(ledger, spark.createDataFrame([], "txn_type string, doc_number string, id string"), lookup_errors=failed)
    assert {r.status for r in plan.collect()} == {"error"} and time.time() > 0
