"""Fill-in-the-middle documents from relational units.

A text is cut at unit ordinals; a unit is what a pattern matches, by default one code point.
Matches are posexploded, in runs of ``RUN`` units so that a row stands for many of them;
window sums over the runs' lengths say at which character each run begins; the cuts that
documents ask for are joined with the runs by the ordinal of their unit, and the offsets are
aggregated to one row a document, which meets its text again for substring. Texts are dealt
once, by a key of id and text; runs, cuts, offsets and the final join all stay where that put
them, and read the same exchange.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Units of a run.
RUN = 256
# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of 100 documents so many are rearranged, and so many of these begin with their suffix.
REARRANGED, SUFFIX_FIRST = 90, 20


def _draws(ident: Column, seed: int) -> Column:
    """Four whole numbers under 2^32 from the hash of seed and id; a null id is as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident, F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def _key(ident: Column, text: Column) -> Column:
    """What tells rows apart whose output may differ: the text's digest and the id, which can be read from it."""
    return F.concat(F.sha2(text, 256), F.coalesce(F.concat(F.lit("="), ident.cast("string")), F.lit("")))


def _ident(key: Column) -> Column:
    return F.when(F.char_length(key) > 64, F.substring(key, 66, 1 << 30))


def _count(text: Column, unit: str | None) -> Column:
    return F.char_length(text).cast("long") if unit is None else F.regexp_count(text, F.lit(f"(?s)(?:{unit})|.")).cast("long")


def _form(text: Column, draws: Column) -> Column:
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    return F.when((text == "") | marked | (draws[2] % 100 >= REARRANGED), PLAIN).when(draws[3] % 100 < SUFFIX_FIRST, SPM).otherwise(PSM)


def _inside(text: Column, run: Column, unit: str | None, size: int) -> Column:
    """Characters before a cut inside the run in which it lies."""
    ahead = run["ordinal"] % size
    if unit is None:
        return ahead
    units = F.regexp_extract_all(F.substring(text, (run["start"] + 1).cast("int"), run["chars"].cast("int")), F.lit(f"(?s)(?:{unit})|."), F.lit(0))
    return F.aggregate(F.slice(units, F.lit(1), ahead.cast("int")), F.lit(0).cast("long"), lambda n, u: n + F.char_length(u))


def offsets(texts: DataFrame, unit: str | None = None, run: int = RUN, seed: int = 1) -> DataFrame:
    """key, n (units), first and second (for each cut the run that it lies in: start, chars, ordinal; null past the last unit), from (key, text)."""
    pattern = f"(?s).{{1,{run}}}" if unit is None else f"(?s)(?:(?:{unit})|.){{1,{run}}}"
    runs = texts.select("key", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "_run"))
    runs = runs.select("key", "pos", F.char_length("_run").cast("long").alias("chars")).dropDuplicates(["key", "pos"])
    before = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0)))

    draws, n = _draws(_ident(F.col("key")), seed), F.col("n")
    cuts = texts.select("key", _count(F.col("text"), unit).alias("n")).dropDuplicates(["key"]).select("key", "n", draws.alias("_d"))
    places = [F.col("_d")[k] % (n + 1) for k in range(2)]
    cuts = cuts.select("key", "n", F.posexplode(F.array(F.least(*places), F.greatest(*places))).alias("cut", "ordinal"))
    # by the key alone, so that nothing is dealt anew; a key has two cuts
    within = (F.col("ordinal") >= F.col("pos") * run) & (F.col("ordinal") < F.col("pos") * run + run)
    found = cuts.join(runs.withColumnRenamed("key", "_of"), (F.col("key") == F.col("_of")) & within, "left")
    at = lambda k: F.max(F.when((F.col("cut") == k) & F.col("start").isNotNull(), F.struct("start", "chars", "ordinal")))
    return found.groupBy("key").agg(F.max("n").alias("n"), at(0).alias("first"), at(1).alias("second"))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str | None = None, run: int = RUN, seed: int = 1) -> DataFrame:
    """id, text, n, form, prefix_chars, middle_chars, output for each row.

    ``unit`` is a pattern that matches no empty text; what it leaves out are units of one code
    point. Null text is empty; empty texts, and those that hold a mark of the form, stay plain,
    with null lengths. Ids decide where a text is cut, so rows that share id and text have equal
    output, and null ids are as one id. Ties: a cut may have no units on a side. Texts of any length are cut
    whole; a very long one is one row of one task, as it is in the table. An empty table gives
    no rows; other columns, whatever their names, are not read.
    """
    if unit is not None and re.match(unit, ""):
        raise ValueError(f"A unit can't be empty: {unit!r}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(_key(F.col(id_col), text).alias("key"), text.alias("text")).repartition("key")
    both = texts.join(offsets(texts, unit, run, seed), "key")
    ends = [F.coalesce(F.col(c)["start"] + _inside(F.col("text"), F.col(c), unit, run), F.char_length("text").cast("long")) for c in ("first", "second")]
    cut = both.select("key", "text", "n", _form(F.col("text"), _draws(_ident(F.col("key")), seed)).alias("form"), *[e.cast("int").alias(c) for e, c in zip(ends, ("_a", "_b"), strict=True)])
    a, b, form = F.col("_a"), F.col("_b"), F.col("form")
    part = lambda low, high: F.substring(F.col("text"), low + 1, high - low)
    prefix, middle, suffix = part(F.lit(0), a), part(a, b), part(b, F.char_length("text"))
    marks = {c: F.lit(c) for c in (PREFIX, SUFFIX, MIDDLE)}
    output = (
        F.when(form == PSM, F.concat(marks[PREFIX], prefix, marks[SUFFIX], suffix, marks[MIDDLE], middle))
        .when(form == SPM, F.concat(marks[SUFFIX], suffix, marks[PREFIX], prefix, marks[MIDDLE], middle))
        .otherwise(F.col("text"))
    )
    of = F.when(form != PLAIN, F.lit(True))
    return cut.select(
        _ident(F.col("key")).cast(docs.schema[id_col].dataType).alias(id_col), "text", "n", "form",
        F.when(of, a.cast("long")).alias("prefix_chars"), F.when(of, (b - a).cast("long")).alias("middle_chars"), output.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text from what ``transform`` made of it. Parts hold no marks, and no mark can arise where
    parts and marks meet, so the first of each kind is the mark itself."""
    size, end = len(MIDDLE), F.locate(MIDDLE, output)
    turn = F.when(form == PSM, F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output))  # where the second mark stands
    left, right, middle = F.substring(output, size + 1, turn - size - 1), F.substring(output, turn + size, end - turn - size), F.substring(output, end + size, F.char_length(output))
    return F.when(form == PSM, F.concat(left, middle, right)).when(form == SPM, F.concat(right, middle, left)).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, lengths and digests of every document, as ``transform`` and ``restore`` say."""
    found = transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), h AS (
  SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), f AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
