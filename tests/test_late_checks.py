"""Checks inside the query that returns the ledger: the same refusals, one job."""

from __future__ import annotations

import pytest

from tallyframe.operators import layout, normalize
from tallyframe.schema import WORDS, StatementParseError, refusal

RAW = "source_file string, pos long, cells array<string>"


def raw(spark, **files):
    return spark.createDataFrame([(name, k, cells) for name, rows in files.items() for k, cells in enumerate(rows)], RAW)


GOOD = [["date", "memo", "amount"], ["2026-01-01", "a", "1"], ["2026-01-02", "b", None]]


@pytest.mark.parametrize(
    ("rows", "reason"),
    [
        ([["date", "amount"]], "no_rows"), ([["date", "memo"], ["2026-01-01", "x"]], "no_amount_column"), ([["date", "amount"], ["2026-01-01", "1", "2"]], "unreadable"),
        ([["date", "amount"], ["2026-01-01", "x"], ["2026-01-01", None]], "no_usable_amount"),
    ],
)
def test_the_same_refusals(spark, rows, reason):
    frame = raw(spark, good=GOOD, bad=rows)
    with pytest.raises(StatementParseError) as early:
        normalize.to_ledger(frame)
    ledger = normalize.to_ledger(frame, check="late")  # nothing is looked at yet
    with pytest.raises(Exception) as late:  # noqa: PT011
        ledger.collect()
    told = refusal(late.value)
    assert told.reason == early.value.reason == reason and "'bad'" in str(told)
    if reason != "no_amount_column":
        assert str(told) == str(early.value)
    assert refusal(ValueError("of another kind")) is None


def test_one_job_and_the_same_ledger(spark):
    frame = raw(spark, one=GOOD, two=[["debit", "credit"], ["5", None], [None, "7"]])
    jobs = lambda tag: len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a job for each query, so that they can be counted
    try:
        spark.sparkContext.setJobGroup("early", "")
        early = normalize.to_ledger(frame).collect()
        spark.sparkContext.setJobGroup("late", "")
        late = normalize.to_ledger(frame, check="late").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, early)) == sorted(map(tuple, late)) and len(late) == 3
    assert jobs("late") < jobs("early")
    assert normalize.to_ledger(frame.limit(0), check="late").count() == 0


def page(name, rows, credit="5.00", top=10.0):
    out = [(name, 1, top, x, k, t) for k, (x, t) in enumerate([(63.0, "Date"), (117.0, "Number"), (150.0, "Description"), (413.0, "Credits"), (483.0, "Debits")])]
    for n, (day, words) in enumerate(rows, 1):
        out += [(name, 1, top + 10 * n, x, k, t) for k, (x, t) in enumerate([(61.5, day), *words])]
    return out + [(name, 1, top + 10 * (len(rows) + 1), x, k, t) for k, (x, t) in enumerate([(61.5, "Totals"), (400.0, credit), (470.0, "0.00")])]


@pytest.mark.parametrize(
    ("words", "text", "reason"),
    [
        (page("bad", [("6/4", [(150.0, "Pay"), (405.0, "5.00")])]), "no day here", "no_statement_date"), ([("bad", 1, 1.0, 1.0, 0, "word")], "June 30, 2026", "no_table"),
        (page("bad", [("2/31", [(150.0, "Pay"), (405.0, "5.00")])]), "June 30, 2026", "no_such_day"), (page("bad", [("6/4", [(150.0, "Pay"), (405.0, "5.00")])], "6.00"), "June 30, 2026", "totals_differ"),
        (None, None, None),
    ],
)
def test_statements(spark, words, text, reason):
    good = page("good", [("6/3", [(150.0, "Fee"), (405.0, "5.00")])])
    frame = spark.createDataFrame(good + (words or []), WORDS)
    pages = spark.createDataFrame([("good", 1, "June 30, 2026")] + ([("bad", 1, text)] if words else []), "source_file string, page int, text string")
    late = layout.read_statements(frame, pages, check="late")
    if reason is None:
        assert [tuple(r) for r in late.collect()] == [tuple(r) for r in layout.read_statements(frame, pages).collect()] and late.count() == 1
        return
    with pytest.raises(StatementParseError) as early:
        layout.read_statements(frame, pages)
    with pytest.raises(Exception) as error:  # noqa: PT011
        late.collect()
    assert refusal(error.value).reason == early.value.reason == reason and str(refusal(error.value)) == str(early.value)
