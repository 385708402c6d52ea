"""Dates without zones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (pattern that a first value must match, format), in order of preference.
FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,9}$", "yyyy-MM-dd HH:mm:ss.SSSSSSSSS"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,9}$", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "M.d.yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", "d-MMM-yy"),
)
#: "May" is a short name as well as a full one. What a first value with it matches, and the formats that it leaves open.
MAY = (
    (r"^[Mm][Aa][Yy] \d{1,2}, \d{4}$", ("MMM d, yyyy", "MMMM d, yyyy")),
    (r"^\d{1,2} [Mm][Aa][Yy] \d{4}$", ("d MMM yyyy", "d MMMM yyyy")),
)
# Fixed values.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _read(text: Column, k: int) -> Column:
    pattern, form = FORMATS[k]
    day = F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz")
    if not form.endswith("yyyy") and form.endswith("yy"):  # years of two digits: 69 to 99 are of the last century
        day = F.when(F.year(day) > 2068, (day - F.expr("INTERVAL 100 YEARS")).cast("timestamp_ntz")).otherwise(day)
    return F.when(text.rlike(pattern), day)


def _read_open(text: Column, j: int) -> Column:
    """By any of the formats that a May leaves open."""
    return F.coalesce(*[_read(text, k) for k, (_, form) in enumerate(FORMATS) if form in MAY[j][1]])


def format_of(first: Column) -> Column:
    """The number of the first format that reads a column's first value; ISO if none does. Beyond ``FORMATS``
    come those of ``MAY``: a column that begins with a May is read with short and full names of months."""
    may = [F.when(first.rlike(pattern) & _read_open(first, j).isNotNull(), len(FORMATS) + j) for j, (pattern, _) in enumerate(MAY)]
    return F.coalesce(*may, *[F.when(_read(first, k).isNotNull(), k) for k in range(len(FORMATS))], F.lit(0))


def parse_date(text: Column, form: Column) -> Column:
    """By the column's one format; other values are null."""
    reads = [_read(text, k) for k in range(len(FORMATS))] + [_read_open(text, j) for j in range(len(MAY))]
    return reduce(lambda rest, k: F.when(form == k, reads[k]).otherwise(rest), range(len(reads)), F.lit(None).cast("timestamp_ntz"))


def iso_day(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def compact_day(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd")


def resolve_year(month: Column, end: Column) -> Column:
    """A month after the statement's last belongs to the year before."""
    return F.when(month > F.month(end), F.year(end) - 1).otherwise(F.year(end))


def make_day(year: Column, month: Column, day: Column) -> Column:
    """Null if there is no such day."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")


def statement_day(text: Column) -> Column:
    """The first "Month d, yyyy" of a page, if its month is a full English name; else null."""
    found = r"([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4})"  # fixed value
    part = lambda k: F.regexp_extract(text, found, k)
    months = F.create_map(*[F.lit(x) for k, name in enumerate(MONTHS, 1) for x in (name, k)])
    month = F.try_element_at(months, part(1))
    return F.when(month.isNotNull(), make_day(part(3).try_cast("int"), month, part(2).try_cast("int")))
