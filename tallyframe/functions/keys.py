"""Keys by which transactions are recognised."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .dates import compact_day, iso_day
from .money import fixed2
from .text import or_default, strip

KEY_LENGTH = 21


def content_key(day: Column, description: Column, amount: Column) -> Column:
    """R- and 16 hex digits of a SHA-256 over day, description and amount. Day is text, empty if
    there is none; the description counts stripped and in lower case."""
    content = F.concat_ws("|", F.coalesce(day, F.lit("")), F.lower(strip(F.coalesce(description, F.lit("")))), fixed2(amount))
    return F.substring(F.concat(F.lit("R-"), F.substring(F.sha2(content, 256), 1, 16)), 1, KEY_LENGTH)


def push_key(date: Column, description: Column, amount: Column) -> Column:
    """The key of a posting: days as 2026-01-31."""
    return content_key(iso_day(date), description, amount)


def export_key(date: Column, description: Column, amount: Column) -> Column:
    """The key of an exported transaction: days as 20260131, and a default description, so
    it differs from ``push_key`` for the same row."""
    return content_key(compact_day(date), or_default(description, "Transaction"), amount)


def numbered(key: Column, *order: Column | str, within: tuple = ()) -> Column:
    """The key for the first row that has it, key-2, key-3 and so on for those that follow."""
    n = F.row_number().over(Window.partitionBy(*within, key).orderBy(*order))
    return F.when(n == 1, key).otherwise(F.concat(key, F.lit("-"), n.cast("string")))
