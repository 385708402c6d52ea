"""Raw statement rows to the canonical ledger.

A raw relation has one row for each record of a file: source_file, pos (the record's place in
its file) and cells, an array of text. The first record of a file is its header. Files
with different headers may come together: each finds its columns by its own header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.dates import format_of, parse_date
from ..functions.money import net_amount, parse_amount
from ..functions.text import clean_text, no_value_to_null, strip


def normal_header(cell: Column) -> Column:
    """Stripped, in lower case, blanks as underscores; of names that repeat the first counts."""
    return F.replace(F.lower(strip(cell)), F.lit(" "), F.lit("_"))


def _index(names: Column, wanted: tuple[str, ...]) -> Column:
    """The 1-based place of the first wanted name that is there; null if none is."""
    return F.coalesce(*[F.nullif(F.array_position(names, w), F.lit(0)) for w in wanted]).cast("int")


def headers(raw: DataFrame) -> DataFrame:
    """For each file the places of its columns, and the width and names of its header."""
    first = raw.groupBy("source_file").agg(F.min_by("cells", "pos").alias("header"), F.min("pos").alias("header_pos"), F.count("*").alias("records"))
    names = F.transform(F.coalesce("header", F.array()), lambda c: normal_header(F.coalesce(c, F.lit(""))))
    first = first.withColumn("names", names)
    # up to the last cell that has a name: those between may have none
    width = F.coalesce(F.array_max(F.transform("header", lambda c, k: F.when(c.isNotNull(), k + 1))), F.lit(0))
    found = {
        "date_at": S.DATE_NAMES, "description_at": S.DESCRIPTION_NAMES, "reference_at": S.REFERENCE_NAMES,
        "amount_at": S.AMOUNT_NAMES, "debit_at": S.DEBIT_NAMES, "credit_at": S.CREDIT_NAMES,
    }
    return first.select("source_file", "header_pos", "records", "header", width.alias("width"), *[_index(F.col("names"), v).alias(k) for k, v in found.items()])


def _check(found: DataFrame, typed: DataFrame) -> None:
    """The first thing that is wrong with any file, by one pass over all: no rows at all, a file
    without rows or without a column that can be an amount, a record longer than its header, no
    amount that can be used."""
    usable = F.count_if(F.col("amount").isNotNull() & ~F.isnan("amount"))
    state = found.join(typed.groupBy("source_file").agg(F.max("_extra").alias("extra"), usable.alias("usable")), "source_file", "left")
    wrong = (
        F.when(F.col("records") < 2, 1).when(F.coalesce("amount_at", "debit_at", "credit_at").isNull(), 2).when(F.col("extra") > 0, 3).when(F.coalesce("usable", F.lit(0)) == 0, 4)
    )
    files, first = state.select("*", wrong.alias("wrong")).agg(F.count("*"), F.min(F.when(F.col("wrong").isNotNull(), F.struct("wrong", "source_file", "header")))).first()
    if not files:
        raise S.StatementParseError("no_rows", "There are no rows.")
    if first:
        reason, text = {
            1: ("no_rows", "{!r} has no rows."),
            2: ("no_amount_column", "{!r} has neither an amount column nor debit or credit columns; it has {}."),
            3: ("unreadable", "{!r} has a record that is longer than its header."),
            4: ("no_usable_amount", "{!r} has no rows with a usable amount."),
        }[first.wrong]
        raise S.StatementParseError(reason, text.format(first.source_file, first.header))


def _late(found: DataFrame, typed: DataFrame) -> DataFrame:
    """``typed`` as far as nothing is wrong with its files, told by the query itself: a file is known by its
    header, so it is looked at even if it has no rows, and what its rows come to is a window over them."""
    file = Window.partitionBy("source_file")
    quoted = F.concat(F.lit("'"), F.col("source_file"), F.lit("'"))
    state = found.select("source_file", "records", F.coalesce("amount_at", "debit_at", "credit_at").alias("_money"), F.array_join("header", ", ").alias("_names"))
    rows = state.join(typed, "source_file", "left").withColumn("_wide", F.max("_extra").over(file))
    rows = rows.withColumn("_usable", F.count_if(F.col("amount").isNotNull() & ~F.isnan("amount")).over(file))
    fine = (
        F.when(F.col("records") < 2, S.refuse("no_rows", quoted, " has no rows."))
        .when(F.col("_money").isNull(), S.refuse("no_amount_column", quoted, " has neither an amount column nor debit or credit columns; it has ", F.coalesce("_names", F.lit("none")), "."))
        .when(F.col("_wide") > 0, S.refuse("unreadable", quoted, " has a record that is longer than its header."))
        .when(F.col("_usable") == 0, S.refuse("no_usable_amount", quoted, " has no rows with a usable amount."))
        .otherwise(F.lit(None))
    )
    return rows.where(fine.cast("string").isNull()).select(*typed.columns)


def to_ledger(raw: DataFrame, check: bool | str = True) -> DataFrame:
    """source_file, row_id, date, description, reference, amount.

    A file's dates are read by one format, that of its first date; others become null and
    their rows stay. An amount column wins over debit and credit even where it is blank.
    Rows without an amount go; row numbers are dense from 0 in each file. Text keeps its
    source form ("0012" stays), absent columns are empty text.

    ``check``: True looks for what is wrong with the files by a job of its own, before there is a
    result; "late" leaves it to the query that is returned, which ends with an error that
    ``schema.refusal`` reads, so there is one job, and no rows at all are no error; False doesn't look.
    """
    found = headers(raw)
    rows = raw.join(found.drop("records", "header"), "source_file").where("pos > header_pos")
    long = F.size(F.array_compact(F.slice("cells", F.col("width") + 1, F.greatest(F.size("cells"), F.lit(1)))))
    cell = lambda at: F.when(F.col(at).isNotNull(), F.try_element_at("cells", F.col(at)))
    typed = rows.select(
        "source_file", "pos", long.alias("_extra"), no_value_to_null(cell("date_at")).alias("_date"),
        clean_text(cell("description_at")).alias("description"), clean_text(cell("reference_at")).alias("reference"),
        F.when(F.col("amount_at").isNotNull(), parse_amount(cell("amount_at")))
        .otherwise(net_amount(parse_amount(cell("debit_at")), parse_amount(cell("credit_at")))).alias("amount"),
    )
    if check == "late":
        typed = _late(found, typed)
    elif check:
        _check(found, typed)
    file = Window.partitionBy("source_file")
    first = F.min_by("_date", F.when(F.col("_date").isNotNull(), F.col("pos"))).over(file)
    # a column for each step, so that the window and the format are worked out once
    dated = typed.withColumn("_first", first).withColumn("_form", format_of(F.col("_first"))).withColumn("date", parse_date(F.col("_date"), F.col("_form")))
    kept = dated.where(F.col("amount").isNotNull() & ~F.isnan("amount"))
    place = (F.row_number().over(file.orderBy("pos")) - 1).cast("long")
    return kept.select("source_file", place.alias("row_id"), "date", "description", "reference", "amount")
