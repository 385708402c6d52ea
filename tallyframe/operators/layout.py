"""Transaction tables from the words of statement pages.

Words become lines, lines become rows, all by grouping and running counts within a page. The
flags are taken in stages: the header first, then on what follows it the totals line, then
on what is before that the lines that open a row. Works on many statements at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.dates import make_day, resolve_year, statement_day
from ..functions.money import inside, is_money_token, money_token, round2, total
from ..functions.text import join_parts

# Fixed value: the day that opens a row.
_DATE = r"^(\d{1,2})/(\d{1,2})$"
_PAGE = ("source_file", "page")


def lines(words: DataFrame) -> DataFrame:
    """source_file, page, line, words (in order of x0), first word and joined text. A line is what
    has the same height, rounded half to even."""
    grouped = words.groupBy(*_PAGE, F.rint("top").cast("int").alias("line")).agg(F.array_sort(F.collect_list(F.struct("x0", "seq", "text"))).alias("words"))
    return grouped.select("*", F.col("words")[0]["text"].alias("first"), F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("line_text"))


def _before(flag: Column) -> Column:
    upto = Window.partitionBy(*_PAGE).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(flag.cast("int")).over(upto), F.lit(0)) == 1


def segments(lined: DataFrame) -> DataFrame:
    """The lines of the table with ordinal (the row on the page that a line belongs to) and is_totals.

    The table begins after the first line that starts with Date and has Description in it, and
    ends with the first that starts with Totals. A line that starts with month/day opens a
    row and the others continue it; those before the first belong to none.
    """
    header = (F.col("first") == "Date") & F.col("line_text").contains("Description")
    body = lined.withColumn("_in", _before(header)).where("_in").drop("_in")
    totals = F.col("first") == "Totals"
    body = body.withColumn("_over", _before(totals)).where(~F.col("_over")).drop("_over")
    upto = Window.partitionBy(*_PAGE).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.col("first").rlike(_DATE)
    body = body.select("*", totals.alias("is_totals"), opens.alias("opens"), F.sum(opens.cast("int")).over(upto).cast("long").alias("ordinal"))
    return body.where("ordinal > 0 OR is_totals")


def token_class(text: Column, x0: Column) -> Column:
    """reference, credit, debit, description or dropped. Money counts by its column and is
    dropped outside of both, also where descriptions stand."""
    return (
        F.when(inside(x0, S.CHECK_X) & text.rlike(r"^\d+$"), "reference")
        .when(is_money_token(text), F.when(inside(x0, S.CREDIT_X), "credit").when(inside(x0, S.DEBIT_X), "debit").otherwise("dropped"))
        .when(x0 >= S.CREDIT_X[0], "dropped")
        .otherwise("description")
    )


def tokens(segmented: DataFrame) -> DataFrame:
    """One row for each word of the table, without the date or Totals that opens a line; a line
    of nothing else has a row without a word."""
    rest = F.when(F.col("opens") | F.col("is_totals"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(1)))).otherwise(F.col("words"))
    each = segmented.select(*_PAGE, "line", "ordinal", "is_totals", "opens", "first", F.explode_outer(rest).alias("w"))
    return each.select("*", F.col("w.x0").alias("x0"), F.col("w.seq").alias("seq"), F.col("w.text").alias("text"), token_class(F.col("w.text"), F.col("w.x0")).alias("class")).drop("w")


def table_rows(classified: DataFrame) -> DataFrame:
    """One row for each table row and totals line of a page; of several references or amounts the last counts."""
    at = F.struct("line", "x0", "seq")
    last = lambda kind: F.max_by(F.when(F.col("class") == kind, F.col("text")), F.when(F.col("class") == kind, at))
    parts = F.array_sort(F.collect_list(F.when(F.col("class") == "description", F.struct("line", "x0", "seq", "text"))))
    rows = classified.groupBy(*_PAGE, "ordinal", "is_totals").agg(
        F.min_by("first", F.when(F.col("opens"), F.col("line"))).alias("day"), last("reference").alias("reference"),
        money_token(last("credit")).alias("credit"), money_token(last("debit")).alias("debit"), parts.alias("parts"),
    )
    return rows.select(*_PAGE, "ordinal", "is_totals", "day", F.coalesce("reference", F.lit("")).alias("reference"), "credit", "debit", join_parts(F.transform("parts", lambda p: p["text"])).alias("description"))


def read_tables(words: DataFrame) -> DataFrame:
    """The table rows of statements. Words are dealt by statement once; all later grouping, by page, line
    or row, stays where they are."""
    return table_rows(tokens(segments(lines(words.repartition("source_file")))))


def statement_ends(pages: DataFrame) -> DataFrame:
    """source_file and end, from (source_file, page, text): of the first two pages the first with a date."""
    seen = pages.withColumn("_n", F.row_number().over(Window.partitionBy("source_file").orderBy("page"))).where("_n <= 2")
    return seen.select("source_file", "page", statement_day(F.col("text")).alias("end")).groupBy("source_file").agg(F.min_by("end", F.when(F.col("end").isNotNull(), F.col("page"))).alias("end"))


def _amount() -> Column:
    return round2(F.coalesce(F.col("credit"), F.lit(0.0)) - F.coalesce(F.col("debit"), F.lit(0.0)))


def to_ledger(tables: DataFrame, ends: DataFrame) -> DataFrame:
    """source_file, row_id, date, description, reference, amount. A row without money stays, at 0."""
    part = lambda k: F.regexp_extract("day", _DATE, k).try_cast("int")
    rows = tables.where("NOT is_totals").join(ends, "source_file")
    place = F.row_number().over(Window.partitionBy("source_file").orderBy("page", "ordinal")) - 1
    return rows.select(
        "source_file", place.cast("long").alias("row_id"), make_day(resolve_year(part(1), F.col("end")), part(1), part(2)).alias("date"),
        "description", "reference", _amount().alias("amount"),
    )


def reconcile(tables: DataFrame) -> DataFrame:
    """For each statement that prints totals: declared and parsed sums and whether they agree.
    Sums are over all pages; a missing amount on a totals line is 0. One pass over the table rows."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    printed, a = F.col("is_totals"), _amount()
    both = tables.groupBy("source_file").agg(
        total(F.when(printed, zero("credit"))).alias("declared_credit"), total(F.when(printed, zero("debit"))).alias("declared_debit"),
        total(F.when(~printed & (a > 0), a)).alias("parsed_credit"), total(F.when(~printed & (a < 0), -a)).alias("parsed_debit"), F.count_if(printed).alias("_lines"),
    ).where("_lines > 0").drop("_lines")
    near = lambda k: F.abs(F.round(F.col(f"declared_{k}") - F.col(f"parsed_{k}"), 4)) <= S.TOTALS_TOLERANCE
    return both.withColumn("agrees", near("credit") & near("debit"))


def _late(state: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger as far as nothing is wrong with its statements, told by the query itself."""
    quoted = F.concat(F.lit("'"), F.col("source_file"), F.lit("'"))
    fine = (
        F.when(F.col("wrong") == 1, S.refuse("no_statement_date", quoted, " has no statement date on its first pages."))
        .when(F.col("wrong") == 2, S.refuse("no_table", quoted, " has no transaction table."))
        .when(F.col("wrong") == 3, S.refuse("no_such_day", quoted, " has an impossible date in row ", F.col("bad_row").cast("string"), "."))
        .when(F.col("wrong") == 4, S.refuse("totals_differ", quoted, " says credits $", F.col("declared_credit"), " and debits $", F.col("declared_debit"), ", but its rows come to $", F.col("parsed_credit"), " and $", F.col("parsed_debit"), "; nothing is returned."))
        .otherwise(F.lit(None))
    )
    return state.where(fine.cast("string").isNull()).select("source_file").join(ledger, "source_file")


def read_statements(words: DataFrame, pages: DataFrame, check: bool | str = True) -> DataFrame:
    """The ledger of statements given as words and page texts; an error if a statement has no date,
    no table, an impossible day, or totals that disagree. All statements are checked in one pass, before
    there is a result, or, with ``check`` "late", by the query that is returned (see ``schema.refusal``)."""
    tables, ends = read_tables(words), statement_ends(pages)
    ledger = to_ledger(tables, ends)
    rows = ledger.groupBy("source_file").agg(F.count("*").alias("rows"), F.min(F.when(F.col("date").isNull(), F.col("row_id"))).alias("bad_row"))
    state = words.select("source_file").distinct().join(ends, "source_file", "left").join(rows, "source_file", "left").join(reconcile(tables), "source_file", "left")
    wrong = F.when(F.col("end").isNull(), 1).when(F.col("rows").isNull(), 2).when(F.col("bad_row").isNotNull(), 3).when(~F.col("agrees"), 4)
    sums = [F.format_number(c, 2).alias(c) for c in ("declared_credit", "declared_debit", "parsed_credit", "parsed_debit")]
    state = state.select("source_file", wrong.alias("wrong"), "bad_row", *sums)
    if check == "late":
        return _late(state, ledger)
    if not check:
        return ledger
    first = state.where("wrong IS NOT NULL").agg(F.min(F.struct("wrong", "source_file", "bad_row", *[F.col(c) for c in ("declared_credit", "declared_debit", "parsed_credit", "parsed_debit")]))).first()[0]
    if first:
        reason, text = {
            1: ("no_statement_date", "{0!r} has no statement date on its first pages."),
            2: ("no_table", "{0!r} has no transaction table."),
            3: ("no_such_day", "{0!r} has an impossible date in row {1}."),
            4: ("totals_differ", "{0!r} says credits ${2} and debits ${3}, but its rows come to ${4} and ${5}; nothing is returned."),
        }[first.wrong]
        raise S.StatementParseError(reason, text.format(first.source_file, *first[2:]))
    return ledger
