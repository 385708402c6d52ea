"""Money as doubles, summed as decimals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: From here on doubles have no room for cents that could be trusted.
LARGE = 1e15
# What a number and a money token look like.
_MONEY_TOKEN = r"^-?\$?[\d,]+\.\d{2}$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"


def parse_number(text: Column) -> Column:
    """A double, or null for what isn't a plain number (no type letters, no underscores)."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_amount(text: Column) -> Column:
    """Commas and dollar signs go, ``(x)`` becomes ``-x`` if the parentheses are outermost,
    then blanks at the ends go, in this order: ``"(15.00) "`` is null."""
    bare = F.regexp_replace(text, "[,$]", "")
    return parse_number(strip(F.regexp_replace(bare, r"^\((.*)\)$", "-$1")))


def net_amount(debit: Column, credit: Column) -> Column:
    """Credit less the debit's absolute value; null if both are."""
    return F.when(debit.isNotNull() | credit.isNotNull(), F.coalesce(credit, F.lit(0.0)) - F.abs(F.coalesce(debit, F.lit(0.0))))


def round2(amount: Column) -> Column:
    """To two decimals; exact for amounts that have no more than that to begin with."""
    return F.round(amount, 2)


def exact_round2(amount: Column) -> Column:
    """To two decimals as Python rounds a double, for amounts with more decimals. Arrow batches."""

    def exact(values: pd.Series) -> pd.Series:
        return values.map(lambda x: round(x, 2), na_action="ignore")

    return F.pandas_udf(exact, "double")(amount)


def fixed2(amount: Column) -> Column:
    """Two decimals without grouping; what is below zero and rounds to zero keeps its sign."""
    rounded = round2(amount)
    below = (amount < 0) | (amount.cast("string") == "-0.0")
    endless = F.when(amount == float("inf"), "inf").when(amount == float("-inf"), "-inf")
    return F.coalesce(endless, F.when((rounded == 0) & below, "-0.00").otherwise(F.format_string("%.2f", rounded)))


def grouped(amount: Column) -> Column:
    return F.format_number(amount, 2)


def short_number(amount: Column) -> Column:
    """As JavaScript writes a number of two decimals: 100, 3998.82, 0.5. Amounts of 1e15 or more go
    without decimals, infinite ones by name."""
    endless = F.when(amount == float("inf"), "Infinity").when(amount == float("-inf"), "-Infinity")
    large = F.when(F.abs(amount) >= LARGE, F.format_string("%.0f", amount))
    return F.coalesce(endless, large, F.regexp_replace(F.when(F.abs(amount) < LARGE, amount).cast("decimal(20,2)").cast("string"), r"\.?0+$", ""))


def total(amount: Column) -> Column:
    """Sum of amounts of two decimals, the same in whatever order they come.

    Amounts of 1e15 or more have no cents in a double; they, and infinite ones, are summed as
    doubles, so a total can be infinite, or NaN if both infinities come together.
    """
    exact = F.sum(F.when(F.abs(amount) < LARGE, amount).cast("decimal(18,2)")).cast("double")
    rest = F.sum(F.when(~(F.abs(amount) < LARGE), amount))
    return F.when(rest.isNotNull(), F.coalesce(exact, F.lit(0.0)) + rest).otherwise(F.coalesce(exact, F.lit(0.0)))


def is_credit(amount: Column) -> Column:
    """By the rounded amount; zero is a credit."""
    return round2(amount) >= 0


def is_money_token(text: Column) -> Column:
    return text.rlike(_MONEY_TOKEN)


def money_token(text: Column) -> Column:
    return F.regexp_replace(text, "[$,]", "").try_cast("double")


def inside(x: Column, span: tuple[float, float]) -> Column:
    """Half-open range."""
    return (x >= span[0]) & (x < span[1])
