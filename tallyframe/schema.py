"""Relations, fixed names and errors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

#: The canonical ledger. ``row_id`` is dense from 0 in file order; text is never null.
LEDGER = StructType(
    [
        StructField("row_id", LongType(), False),
        StructField("date", TimestampNTZType()),
        StructField("description", StringType(), False),
        StructField("reference", StringType(), False),
        StructField("amount", DoubleType(), False),
    ]
)
#: A word on a statement page; ``seq`` is its place in the extractor's order.
WORDS = StructType(
    [
        StructField("source_file", StringType()),
        StructField("page", IntegerType()),
        StructField("top", DoubleType()),
        StructField("x0", DoubleType()),
        StructField("seq", LongType()),
        StructField("text", StringType()),
    ]
)
#: What has been posted before; stands for the remote accounting system.
POSTED = StructType([StructField("txn_type", StringType()), StructField("doc_number", StringType()), StructField("id", StringType())])
ACCOUNTS = StructType(
    [StructField("id", StringType()), StructField("name", StringType()), StructField("account_type", StringType()), StructField("account_sub_type", StringType()), StructField("active", BooleanType())]
)

# Header names by column, in order of preference.
DATE_NAMES = ("date", "transaction_date", "posted_date", "trans_date", "post_date")
DESCRIPTION_NAMES = ("description", "desc", "memo", "payee", "details", "narrative")
AMOUNT_NAMES = ("amount", "amt", "net_amount", "value")
DEBIT_NAMES = ("debit", "debt", "withdrawal", "out", "money_out", "debit_amount")
CREDIT_NAMES = ("credit", "deposit", "in", "money_in", "credit_amount")
REFERENCE_NAMES = ("reference", "ref", "check_number", "check_no", "checkno", "transaction_id", "trans_id", "id")

# Columns of the statement table by horizontal position, half-open.
CHECK_X, CREDIT_X, DEBIT_X = (110.0, 149.0), (390.0, 460.0), (460.0, 525.0)
#: Declared and parsed totals may differ by so much.
TOTALS_TOLERANCE = 0.01

# Kinds of account in an export.
ACCOUNT_TYPES = ("CHECKING", "SAVINGS", "CREDITCARD")


class StatementParseError(ValueError):
    """A statement can't be turned into a ledger; ``reason`` says why in one word."""

    def __init__(self, reason: str, message: str) -> None:
        super().__init__(message)
        self.reason = reason


def refuse(reason: str, *message: Column | str) -> Column:
    """An expression that ends the query and says why."""
    return F.raise_error(F.concat(F.lit(f"statement refused ({reason}): "), *[F.lit(m) if isinstance(m, str) else m for m in message]))


def refusal(error: Exception) -> StatementParseError | None:
    """What a late check says in an error of Spark's; null if it is an error of another kind."""
    found = re.search(r"statement refused \((\w+)\): (.*?)(?: SQLSTATE: \w+)?$", str(error), re.MULTILINE)
    return StatementParseError(found[1], found[2]) if found else None


class ExportError(ValueError):
    """A ledger can't be exported with these parameters."""
