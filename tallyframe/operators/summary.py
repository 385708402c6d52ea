"""Entries, summaries and counts of a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_day
from ..functions.money import is_credit, round2, total


def dated(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("date").isNotNull())


def entries(ledger: DataFrame) -> DataFrame:
    """row_id, date as text or null, description, reference, amount of two decimals."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return ledger.select("row_id", iso_day(F.col("date")).alias("date"), text("description"), text("reference"), round2(F.col("amount")).alias("amount"))


def summary(ledger: DataFrame, *by: str) -> DataFrame:
    """entry_count and total over all rows, start_date and end_date over dated ones; a row for all or for each ``by``."""
    return ledger.groupBy(*by).agg(
        F.count("*").alias("entry_count"), total(F.col("amount")).alias("total"),
        iso_day(F.min("date")).alias("start_date"), iso_day(F.max("date")).alias("end_date"),
    )


def balance(ledger: DataFrame) -> DataFrame:
    """The sum of movements of dated rows and their range of days."""
    return dated(ledger).agg(
        total(F.col("amount")).alias("balance"), F.date_format(F.min("date"), "yyyyMMdd").alias("dtstart"), F.date_format(F.max("date"), "yyyyMMdd").alias("dtend")
    )


def sign_totals(ledger: DataFrame, *by: str) -> DataFrame:
    """Sums and counts of credits and of debits, these as positive numbers."""
    a = F.col("amount")
    return ledger.groupBy(*by).agg(
        total(F.when(a > 0, a)).alias("credits"), total(F.when(a < 0, -a)).alias("debits"),
        F.count_if(is_credit(a)).alias("credit_rows"), F.count_if(~is_credit(a)).alias("debit_rows"),
    )


def preview(ledger: DataFrame) -> DataFrame:
    """One row: the summary as a struct and the entries as an array in row order. For one statement."""
    rows = entries(ledger).agg(F.array_sort(F.collect_list(F.struct("row_id", "date", "description", "reference", "amount"))).alias("entries"))
    return summary(ledger).select(F.struct("*").alias("summary")).crossJoin(rows)


def preview_json(ledger: DataFrame) -> str:
    return preview(ledger).select(F.to_json(F.struct("summary", "entries"), {"ignoreNullFields": "false"})).first()[0]


_ENTRY = ("row_id", "date", "description", "reference", "amount")


def _token(last: Column) -> Column:
    return F.concat(F.lit("after-"), last.cast("string"))


def preview_pages(ledger: DataFrame, size: int = 1000) -> DataFrame:
    """The preview in pages of so many row numbers: page, first_row, last_row, token, entries (JSON).

    A page has the entries of its rows in order; ``token``, which ``preview_page`` takes, leads to what comes after
    it and is null at the last. No row holds more than a page, whatever the length of the ledger.
    """
    page = F.floor(F.col("row_id") / size).cast("long")
    whole = entries(ledger).groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(F.struct(*_ENTRY))).alias("e"))
    last = whole.agg(F.max("page").alias("_last"))
    rows = whole.crossJoin(F.broadcast(last))  # one row
    ends = F.element_at("e", -1)["row_id"]
    return rows.select(
        "page", F.col("e")[0]["row_id"].alias("first_row"), ends.alias("last_row"), F.when(F.col("page") < F.col("_last"), _token(ends)).alias("token"),
        F.to_json("e", {"ignoreNullFields": "false"}).alias("entries"),
    )


def preview_page(ledger: DataFrame, token: str | None = None, size: int = 1000) -> DataFrame:
    """One row: entries (JSON) and token of the ``size`` rows after a token, or of the first ones. Found
    by row number, so rows that come in meanwhile neither repeat nor hide others."""
    after = -1 if token is None else int(token.removeprefix("after-"))
    some = entries(ledger.where(F.col("row_id") > after)).orderBy("row_id").limit(size + 1)
    rows = some.agg(F.array_sort(F.collect_list(F.struct(*_ENTRY))).alias("e"))
    shown = F.slice("e", 1, size)
    return rows.select(F.to_json(shown, {"ignoreNullFields": "false"}).alias("entries"), F.when(F.size("e") > size, _token(F.element_at(shown, -1)["row_id"])).alias("token"))
