"""Text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a CSV field may say for "no value", compared before trimming.
NO_VALUE = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# White space as Python sees it: Unicode's, and four separators that Unicode leaves out.
_SPACE = r"[\s\x1c-\x1f]"


# The same, spelled out.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends. In linear time, also where there are long runs of it."""
    return F.btrim(text, F.lit(_SPACES))


def no_value_to_null(text: Column) -> Column:
    return F.when(~text.isin(*NO_VALUE), text)


def clean_text(text: Column) -> Column:
    """Never null: what says "no value" becomes empty, the rest is stripped."""
    return strip(F.coalesce(no_value_to_null(text), F.lit("")))


def or_default(text: Column, default: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", default).otherwise(text)


def sanitize(text: Column, most: int | None = None) -> Column:
    """For SGML values: markup and control characters become blanks, runs of blanks one; cut
    after trimming, so a blank may stand at the end."""
    plain = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"[<>&\r\n\t]", " "))
    plain = F.regexp_replace(plain, rf"(?U){_SPACE}+", " ")
    return F.substring(plain, 1, most) if most else plain


def join_parts(parts: Column) -> Column:
    """Parts that aren't empty, one blank between them."""
    return strip(F.array_join(F.filter(parts, lambda x: x != ""), " "))
