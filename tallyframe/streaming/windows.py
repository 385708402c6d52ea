"""An extension: ledger totals by event time, of a table or of rows that keep arriving.

The same code serves both. A stream needs ``delay``: rows that come later than that after
the newest one are left out, and a window or session is told once no row of it can come any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import total


def _totals(ledger: DataFrame, over: Column, by: tuple[str, ...], delay: str | None) -> DataFrame:
    timed = ledger.where(F.col("date").isNotNull()).withColumn("event_time", F.col("date").cast("timestamp"))
    if delay is not None:
        timed = timed.withWatermark("event_time", delay)
    found = timed.groupBy(over.alias("_w"), *by).agg(F.count("*").alias("entry_count"), total(F.col("amount")).alias("total"))
    return found.select(*by, F.col("_w.start").alias("begins"), F.col("_w.end").alias("ends"), "entry_count", "total")


def sliding(ledger: DataFrame, size: str, slide: str | None = None, *by: str, delay: str | None = None) -> DataFrame:
    """Totals of windows of ``size`` that begin every ``slide``: by, begins, ends, entry_count, total. Undated rows are in none."""
    return _totals(ledger, F.window("event_time", size, slide), by, delay)


def sessions(ledger: DataFrame, gap: str, *by: str, delay: str | None = None) -> DataFrame:
    """Totals of sessions, which end where nothing follows for longer than ``gap``; ``ends`` is the last entry and the gap."""
    return _totals(ledger, F.session_window("event_time", gap), by, delay)
