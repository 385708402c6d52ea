"""Postings: what a ledger adds to an accounting system, and what it has already.

One plan in place of a lookup and a create for each row: keys are joined with those posted
before, and of rows in one batch that share a key the first is created and the others
are skipped. If a create fails, the next row of its key is tried, and so on: ``turn`` is a
row's place among those of its key, and the k-th try of a key is that of turn k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import iso_day
from ..functions.keys import push_key
from ..functions.money import is_credit, round2

CREATED, SKIPPED, ERROR = "created", "skipped_duplicate", "error"
SKIPPED_DETAIL = "Posted already: same date, description and amount."
LOOKUP_FAILED, CREATE_FAILED = "Could not be looked up: ", "Could not be created: "


def with_keys(ledger: DataFrame) -> DataFrame:
    """The ledger with txn_type and doc_number."""
    text = F.coalesce(F.col("description"), F.lit(""))
    return ledger.select(
        "*", F.when(is_credit(F.col("amount")), "Deposit").otherwise("Purchase").alias("txn_type"), push_key(F.col("date"), text, F.col("amount")).alias("doc_number")
    )


def posted_once(posted: DataFrame) -> DataFrame:
    """One row for each type and key: the first by ``position``, if the table has such a column for the
    order in which the remote system lists its transactions, else by id, shorter ids first."""
    order = F.struct("position", "id") if "position" in posted.columns else F.struct(F.length("id"), "id")
    return posted.groupBy("txn_type", "doc_number").agg(F.min_by("id", order).alias("id"))


def _plain(ledger: DataFrame) -> DataFrame:
    """The columns of a ledger that a posting needs, whatever others there are, with txn_type and doc_number."""
    return with_keys(ledger.select("row_id", "date", "description", "amount"))


def plan_postings(ledger: DataFrame, posted: DataFrame, order: str = "row_id", lookup_errors: DataFrame | None = None) -> DataFrame:
    """A row for each ledger row: row_id, date, description, amount, status, detail, posted_id,
    txn_type, doc_number, turn. Assumes that creates succeed; see ``with_outcomes``.

    ``lookup_errors`` (row_id, error): rows whose key couldn't be looked up. They are errors, have
    no turn, and leave the other rows of their key as they are.
    """
    keyed = _plain(ledger if order == "row_id" else ledger.withColumn("row_id", F.col(order)))
    keyed = keyed.withColumn("_error", F.lit(None).cast("string"))
    if lookup_errors is not None:
        found = lookup_errors.groupBy("row_id").agg(F.min("error").alias("_error"))
        keyed = keyed.drop("_error").join(found, "row_id", "left")
    tried = F.col("_error").isNull()
    turn = F.when(tried, F.row_number().over(Window.partitionBy("txn_type", "doc_number", tried).orderBy("row_id")))
    joined = keyed.withColumn("turn", turn).join(posted_once(posted), ["txn_type", "doc_number"], "left")
    skipped = F.col("id").isNotNull() | (F.col("turn") > 1)
    return joined.select(
        "row_id", iso_day(F.col("date")).alias("date"), F.coalesce("description", F.lit("")).alias("description"), round2(F.col("amount")).alias("amount"),
        F.when(~tried, ERROR).when(skipped, SKIPPED).otherwise(CREATED).alias("status"),
        F.when(~tried, F.concat(F.lit(LOOKUP_FAILED), F.col("_error"))).when(skipped, SKIPPED_DETAIL).otherwise("").alias("detail"),
        F.when(tried, F.col("id")).alias("posted_id"), "txn_type", "doc_number", "turn",
    )


def to_create(ledger: DataFrame, posted: DataFrame) -> DataFrame:
    """Rows whose key isn't posted, all of them: row_id, date, description, amount, txn_type, doc_number."""
    return _plain(ledger).join(posted, ["txn_type", "doc_number"], "left_anti")


def with_outcomes(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The plan after a sink has tried its creates. ``outcomes``: txn_type, doc_number, id or error,
    and, where a key was tried more than once, ``attempt`` from 1.

    The first try that succeeded makes its row created and the later rows of its key skipped, with the new
    id; a try that failed makes its row an error with the sink's words. If all tries of a key
    failed, the row whose turn is next is planned as created, for the sink to try.
    """
    attempt = F.col("attempt") if "attempt" in outcomes.columns else F.lit(1)
    tries = outcomes.select("txn_type", "doc_number", attempt.cast("int").alias("turn"), F.col("id").alias("_id"), F.col("error").alias("_error"))
    good = F.col("_id").isNotNull() & F.col("_error").isNull()
    by_key = tries.groupBy("txn_type", "doc_number").agg(
        F.min(F.when(good, F.col("turn"))).alias("_good"), F.min_by("_id", F.when(good, F.col("turn"))).alias("_new"), F.max("turn").alias("_last"),
    )
    failed = tries.where(F.col("_error").isNotNull()).groupBy("txn_type", "doc_number", "turn").agg(F.min("_error").alias("_error"))
    joined = plan.join(by_key, ["txn_type", "doc_number"], "left").join(failed, ["txn_type", "doc_number", "turn"], "left")
    open_ = F.col("posted_id").isNull() & F.col("turn").isNotNull() & F.col("_last").isNotNull()  # rows that the tries bear on
    turn, made = F.col("turn"), F.col("_good")
    wrong = open_ & F.col("_error").isNotNull() & (made.isNull() | (turn < made))
    new = open_ & ((turn == made) | made.isNull() & (turn == F.col("_last") + 1))
    again = open_ & ~wrong & ~new
    return joined.select(
        "row_id", "date", "description", "amount",
        F.when(wrong, ERROR).when(new, CREATED).when(again, SKIPPED).otherwise(F.col("status")).alias("status"),
        F.when(wrong, F.concat(F.lit(CREATE_FAILED), F.col("_error"))).when(new, "").when(again, SKIPPED_DETAIL).otherwise(F.col("detail")).alias("detail"),
        F.when(open_ & ~wrong, F.when(turn >= made, F.col("_new"))).otherwise(F.col("posted_id")).alias("posted_id"), "txn_type", "doc_number", "turn",
    )


def failed_lookups(ledger: DataFrame, error: str) -> DataFrame:
    """What a plan is when the posted ledger can't be read: every row an error."""
    keyed = _plain(ledger)
    return keyed.select(
        "row_id", iso_day(F.col("date")).alias("date"), F.coalesce("description", F.lit("")).alias("description"), round2(F.col("amount")).alias("amount"), F.lit(ERROR).alias("status"),
        F.lit(f"{LOOKUP_FAILED}{error}").alias("detail"), F.lit(None).cast("string").alias("posted_id"), "txn_type", "doc_number", F.lit(None).cast("int").alias("turn"),
    )


def status_counts(plan: DataFrame, *by: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return plan.groupBy(*by).agg(count(CREATED).alias("created"), count(SKIPPED).alias("skipped_duplicate"), count(ERROR).alias("errors"))


def account_ref(account: str | Column) -> Column:
    return F.struct((F.lit(account) if isinstance(account, str) else account).alias("value"), F.lit("Account").alias("type"))


def deposits(ledger: DataFrame, bank: str, income: str) -> DataFrame:
    """row_id and a deposit document for each row of amount zero or more."""
    detail = F.struct(account_ref(income).alias("AccountRef"))
    line = F.struct(round2(F.col("amount")).alias("Amount"), F.col("description").alias("Description"), F.lit("DepositLineDetail").alias("DetailType"), detail.alias("DepositLineDetail"))
    document = F.struct(
        iso_day(F.col("date")).alias("TxnDate"), F.col("doc_number").alias("DocNumber"), F.col("description").alias("PrivateNote"),
        account_ref(bank).alias("DepositToAccountRef"), F.array(line).alias("Line"),
    )
    return with_keys(ledger).where("txn_type = 'Deposit'").select("row_id", document.alias("document"))


def purchases(ledger: DataFrame, bank: str, expense: str) -> DataFrame:
    """row_id and a purchase document for each row of an amount under zero."""
    detail = F.struct(account_ref(expense).alias("AccountRef"))
    line = F.struct(F.abs(round2(F.col("amount"))).alias("Amount"), F.col("description").alias("Description"), detail.alias("AccountBasedExpenseLineDetail"))
    document = F.struct(
        iso_day(F.col("date")).alias("TxnDate"), F.col("doc_number").alias("DocNumber"), F.col("description").alias("PrivateNote"),
        F.lit("Cash").alias("PaymentType"), account_ref(bank).alias("AccountRef"), F.array(line).alias("Line"),
    )
    return with_keys(ledger).where("txn_type = 'Purchase'").select("row_id", document.alias("document"))


def documents(ledger: DataFrame, bank: str, income: str, expense: str) -> DataFrame:
    """row_id, txn_type and the document as JSON, for every row."""
    parts = [(deposits(ledger, bank, income), "Deposit"), (purchases(ledger, bank, expense), "Purchase")]
    both = [d.select("row_id", F.lit(kind).alias("txn_type"), F.to_json("document").alias("document")) for d, kind in parts]
    return both[0].unionByName(both[1])


def active_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.where("active").select("id", "name", "account_type", "account_sub_type")


def append_created(plan: DataFrame, path: str) -> None:
    """Add the created rows to a posted table, their key standing for the id. One writer at a
    time: a second run over the same ledger then creates nothing."""
    made = plan.where(F.col("status") == CREATED).select("txn_type", "doc_number", F.col("doc_number").alias("id"))
    made.write.mode("append").parquet(path)
