"""Mixing sources to target weights by Efraimidis-Spirakis sampling, DataFrame operations only.

Every document gets the key -ln(u) / quality, u uniform from a hash of its id: in ascending
key order the documents of a source form a weighted sample without replacement. A source's
target is met by complete epochs first; what is left of it is filled in key order by prefix
sums. The prefix sums are taken in two steps: sizes are summed by key bucket, a window over
the bucket sums finds the one bucket in which a source's budget ends, and only that bucket
is sorted row by row. So no task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, staged, table

#: A target stops at so many times its source's size.
MOST_TIMES = 3
#: Rows that a key bucket is meant to hold, and quantiles of a source's keys between which buckets are of equal width.
BUCKET_ROWS, QUANTILES = 4096, 64
#: Weights by the sources' order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS)).cast("long")


def default_quality(text: Column, size: Column) -> Column:
    """1 at six characters a word, less the further the mean is from that; 0.01 at least."""
    mean = F.char_length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.01), 1.0 / (1.0 + F.abs(mean - 6.0) / 6.0))


def _uniform(ident: Column, text: Column, seed: int) -> Column:
    """52 bits of an MD5 as a number inside (0, 1); a row without an id goes by its text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.concat(F.lit("t"), F.sha2(F.coalesce(text, F.lit("")), 256))))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """From (source, source_size): the target of each source.

    Weights go by the sources' order (code points, null last). A target stops at
    ``most_times`` its size and the excess goes to the others by weight until none is above:
    in order of size / weight the stopped sources come first, so one pass of running sums
    finds the level at which the rest stand.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    rows = sources.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")).alias("_w"))
    rows = rows.withColumn("_most", F.col("source_size") * float(most_times)).withColumn("_ratio", F.col("_most") / F.col("_w"))
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    rows = rows.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))).alias("_rest"),
        (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))).alias("_weights"),
    ).withColumn("_level", F.col("_rest") / F.col("_weights"))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(whole)["_level"]
    return rows.select("source", "source_size", F.round(F.least(F.col("_most"), F.coalesce(F.col("_w") * level, F.col("_most"))), 6).alias("target"))


def _bucket(key: Column, steps: Column, buckets: Column) -> Column:
    """A number that grows with the key: the key's place among the quantiles, and between two of them by distance."""
    above = F.least(F.size(F.filter(steps, lambda c: c < key)), F.lit(QUANTILES)).cast("int")
    low, high = F.get(steps, F.greatest(above - 1, F.lit(0))), F.get(steps, above)
    inside = F.when(high > low, F.least(F.greatest((key - low) / (high - low), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    share = F.when(above > 0, (above - 1 + inside) / QUANTILES).otherwise(0.0)
    return F.least(F.floor(share * buckets), buckets - 1).cast("long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    most_times: int = MOST_TIMES,
    seed: int = 42,
) -> DataFrame:
    """Every row with id, size, source, source_size, target, times, taken (times * size), text_md5.

    Empty or null texts have size 0 and are taken 0 times. A null source is a source, last
    in order. Rows that repeat an id share its key; ties go by text, and equal rows are
    alike. The document at which a budget ends is taken if at least half of it is inside, so
    a source is off its target by half a document at most. An empty table gives no rows;
    further columns of ``docs`` are not read.
    """
    text, ident, source = F.col(text_col), F.col(id_col), F.col(source_col)
    rank = quality if quality is not None else default_quality(text, n_words(text))
    slim = docs.select(
        ident.alias("_id"), source.alias("source"), n_words(text).alias("size"),
        (-F.ln(_uniform(ident, text, seed)) / rank).alias("_key"), F.md5(F.coalesce(text, F.lit(""))).alias("text_md5"),
    )
    slim = staged(slim, "mix-keys")
    steps = [k / QUANTILES for k in range(QUANTILES + 1)]
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"), F.percentile_approx("_key", steps, 50 * QUANTILES).alias("_steps"))
    sums = staged(sums, "mix-sources")
    counts = sums.select(F.col("source").alias("_s"), F.ceil(F.col("_rows") / float(BUCKET_ROWS)).cast("long").alias("_buckets"), "_steps")
    plan = targets(sums, weights, most_times).join(counts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("_epochs", epochs).withColumn("_budget", F.col("target") - F.col("_epochs") * F.col("source_size"))
    plan = staged(plan, "mix-plan")

    bucket = _bucket(F.col("_key"), F.col("_steps"), F.col("_buckets"))
    of_source = F.col("source").eqNullSafe(F.col("_s"))
    keyed = slim.join(plan.withColumnRenamed("source", "_s"), of_source).drop("_s").withColumn("_bucket", bucket).drop("_steps")
    heaps = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"), F.first("_budget").alias("_budget"))
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heaps = heaps.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0)))
    inside = F.col("_before") + F.col("_sum") <= F.col("_budget")
    edge = F.when(~inside & (F.col("_before") < F.col("_budget")), F.struct("_bucket", "_before"))
    cut = heaps.groupBy(F.col("source").alias("_s")).agg(F.max(F.when(inside, F.col("_bucket"))).alias("_full"), F.max(edge).alias("_edge"))
    cut = staged(cut, "mix-cuts")

    placed = keyed.join(cut, of_source).drop("_s")
    at_edge = F.coalesce(F.col("_bucket") == F.col("_edge._bucket"), F.lit(False))
    run = Window.partitionBy("source").orderBy("_key", "_id", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.where(at_edge).withColumn("_here", F.col("_edge._before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    ends = ends.withColumn("_once", F.col("_here") + F.col("size") / 2.0 <= F.col("_budget")).drop("_here")
    rest = placed.where(~at_edge).withColumn("_once", (F.col("_bucket") <= F.coalesce(F.col("_full"), F.lit(-1))) & (F.col("_budget") > 0))
    times = F.when(F.col("size") > 0, F.col("_epochs") + F.when(F.col("_once"), 1).otherwise(0)).otherwise(0).cast("long")
    return ends.unionByName(rest).select(
        F.col("_id").alias(id_col), "size", "source", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"), "text_md5"
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **more) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, with all their columns: a document taken twice stands twice.

    Nulls, empty and long texts, ties and empty tables are as in ``mix``; rows that repeat
    id, source and text are each taken as often as the one of them that is taken most.
    Other columns may have any names.
    """
    plan = mix(docs, id_col, text_col, source_col, **more).where("times > 0")
    times = plan.groupBy(F.col(id_col).alias("_id"), F.col("source").alias("_src"), "text_md5").agg(F.max("times").alias("_times"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_md5"))
    same = F.col(f"_row.{id_col}").eqNullSafe(F.col("_id")) & F.col(f"_row.{source_col}").eqNullSafe(F.col("_src"))
    found = rows.join(times, same & (F.col("_md5") == F.col("text_md5")))
    return found.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. Texts without words have size 0, a null source is a source, ties go by text,
    rows that repeat are taken alike, an empty table gives no rows: see ``mix``."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), k AS (
  SELECT doc_id, source, size, md5(t) AS tie,
    -ln((CAST('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
      / greatest(0.01, 1.0 / (1.0 + abs(CAST(length(t) AS DOUBLE) / greatest(size, 1) - 6.0) / 6.0)) AS key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS DOUBLE) AS w FROM k GROUP BY source
), r AS (
  SELECT *, 3.0 * source_size AS most, 3.0 * source_size / w AS ratio,
    sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weights
  FROM s WINDOW before AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, round(CAST(least(most, w * (SELECT arg_min(rest / weights, ratio) FROM r WHERE rest / weights <= ratio)) AS DOUBLE), 6) AS target FROM r
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), p AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS budget,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS here
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source
), q AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE epochs + CASE WHEN here + size / 2.0 <= budget THEN 1 ELSE 0 END END AS times FROM p
)
SELECT doc_id, size, source_size, target, CAST(times * size AS BIGINT) AS taken, CAST(times AS BIGINT) AS times FROM q
"""
