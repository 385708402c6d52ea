"""Dense row numbers without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range is meant to hold, and ranges at most.
ROWS_A_BUCKET, MOST_RANGES = 500_000, 4096


def _range(key: Column, bounds: list) -> Column:
    """How many of the ascending bounds are under the key, by halving."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    held = F.array(*[F.lit(b) for b in bounds])
    further = lambda at, step: F.when(F.get(held, at + step - 1) < key, at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


def number_rows(df: DataFrame, key: str, *ties: str, name: str = "row_id", rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """``df`` with row numbers from 0 in the order of a whole-number column, then ``ties``.

    Rows are numbered inside ranges of the key; a running count over the ranges, of which
    there are few, says where each begins. The ranges lie between quantiles of the key, so
    that one far-off key doesn't put all others into one range; a pass over the key alone counts the rows
    and finds them. What fits into one range is numbered as it is. Null keys come first. Columns
    of ``df`` may have any names but ``name``.
    """
    some = [k / 256 for k in range(1, 256)]
    rows, found = df.agg(F.count("*"), F.percentile_approx(key, some, 10_000)).first()
    order = lambda *first: (*first, *[F.col(f"_tie{k}") for k in range(len(ties))])
    whole = df.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), *[F.col(t).alias(f"_tie{k}") for k, t in enumerate(ties)])
    in_order = order(F.col("_key").asc_nulls_first())
    if rows <= rows_a_bucket:
        return whole.select("_row.*", (F.row_number().over(Window.orderBy(*in_order)) - 1).cast("long").alias(name))
    ranges = min(MOST_RANGES, -(-rows // rows_a_bucket))
    if ranges > 256:
        found = df.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0]
    bounds = sorted(set(found or ()))
    ranged = whole.withColumn("_range", F.when(F.col("_key").isNull(), -1).otherwise(_range(F.col("_key"), bounds) if bounds else F.lit(0)))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*in_order)) - 1
    numbered = ranged.withColumn("_place", place).join(starts, "_range")
    return numbered.select("_row.*", (F.col("_start") + F.col("_place")).cast("long").alias(name))


def running(df: DataFrame, value: Column, name: str, row: str = "row_id", rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before, by dense row numbers: summed by bucket of rows
    first, so that no task sees more than a bucket's rows or all buckets' sums."""
    valued = df.withColumn("_value", value).withColumn("_bucket", F.floor(F.col(row) / rows_a_bucket))
    before = lambda *by: Window.partitionBy(*by).orderBy(row if by else "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = valued.groupBy("_bucket").agg(F.sum("_value").alias("_sum"))
    starts = starts.select("_bucket", F.coalesce(F.sum("_sum").over(before()), F.lit(0)).alias("_start"))
    inside = valued.withColumn("_inside", F.coalesce(F.sum("_value").over(before("_bucket")), F.lit(0)))
    return inside.join(starts, "_bucket").withColumn(name, F.col("_start") + F.col("_inside")).drop("_bucket", "_value", "_sum", "_start", "_inside")
