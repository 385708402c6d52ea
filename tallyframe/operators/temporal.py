"""Joins by time: the last value as of a moment, and moments within periods.

Both deal rows by account and stretch of time, so that one account with most of the rows is
many tasks' work, and neither forms more pairs than it returns within a stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a stretch.
DAYS = 64
#: Moments that a stretch of an account may have before it is split, and splits that are looked after;
#: with more of them there is work for all without.
MOST_MOMENTS, MOST_SPLITS = 200_000, 10_000


def _stretch(at: Column, days: int) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / (days * 86_400_000_000)).cast("long")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, take: dict[str, str], right_at: str | None = None, days: int = DAYS) -> DataFrame:
    """``left`` with the columns ``take`` (name in ``right`` to new name) of the last row of ``right`` that has
    the same ``by`` and isn't later; null if there is none.

    Of rows of the same moment the largest values count, and a row of the moment itself counts. One
    scan of both sides together, no pairs: what is last within a stretch of time goes on to the
    next ones as one row. A null account or moment finds nothing and is found by nothing.
    """
    moment = right_at or at
    zone = F.col(at).cast("timestamp"), F.col(moment).cast("timestamp")
    kind = right.select(F.struct(*[F.col(c).alias(n) for c, n in take.items()]).alias("_t")).schema["_t"].dataType
    mine = left.select(F.col(by).alias("_by"), zone[0].alias("_at"), F.lit(1).alias("_side"), F.struct("*").alias("_row"), F.lit(None).cast(kind).alias("_taken"))
    theirs = right.where(F.col(by).isNotNull() & F.col(moment).isNotNull()).select(
        F.col(by).alias("_by"), zone[1].alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct("*").alias("_r")).schema["_r"].dataType).alias("_row"),
        F.struct(*[F.col(c).alias(n) for c, n in take.items()]).alias("_taken"),
    )
    both = mine.unionByName(theirs).withColumn("_in", _stretch(F.col("_at"), days))
    last = F.max_by("_taken", F.when(F.col("_side") == 0, F.struct("_at", "_taken")))
    before = Window.partitionBy("_by").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.where("_by IS NOT NULL AND _in IS NOT NULL").groupBy("_by", "_in").agg(last.alias("_last"))
    carried = carried.select("_by", "_in", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    upto = Window.partitionBy("_by", "_in").orderBy("_at", "_side", "_taken").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_here", F.last("_taken", ignorenulls=True).over(upto)).where("_side = 1")
    found = own.join(carried, ["_by", "_in"], "left")
    sure = F.when(F.col("_by").isNotNull() & F.col("_in").isNotNull(), F.coalesce("_here", "_carried"))
    return found.select("_row.*", *[sure[n].alias(n) for n in take.values()])


def within(moments: DataFrame, periods: DataFrame, by: str, at: str, start: str, end: str, days: int = DAYS, most: int = MOST_MOMENTS) -> DataFrame:
    """Every pair of a moment and a period of its account that holds it, from ``start`` until before ``end``: the columns of both, ``by`` once.

    Periods are repeated for each stretch of time that they touch, and met there. A stretch with
    more than ``most`` moments of one account is split, each split with the periods of the whole.
    Rows with a null account or time, and periods that end before they begin, pair with nothing.
    """
    m = moments.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select("*", F.col(by).alias("_by"), _stretch(F.col(at), days).alias("_in"))
    low, high = _stretch(F.col(start), days), F.floor((F.unix_micros(F.col(end).cast("timestamp")) - 1) / (days * 86_400_000_000)).cast("long")
    p = periods.where(F.col(by).isNotNull() & (F.col(start) < F.col(end))).withColumnRenamed(by, "_by").select("*", F.explode(F.sequence(low, high)).alias("_in"))
    full = m.groupBy("_by", "_in").count().where(F.col("count") > most).select("_by", "_in", F.ceil(F.col("count") / most).cast("int").alias("_n"))
    crowded = full.limit(MOST_SPLITS + 1).collect()
    if crowded and len(crowded) <= MOST_SPLITS:
        few = F.broadcast(m.sparkSession.createDataFrame(crowded, full.schema))
        m = m.join(few, ["_by", "_in"], "left").withColumn("_split", F.pmod(F.xxhash64(*moments.columns), F.coalesce("_n", F.lit(1)))).drop("_n")
        p = p.join(few, ["_by", "_in"], "left").withColumn("_split", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_n", F.lit(1)).cast("long") - 1))).drop("_n")
    else:
        m, p = m.withColumn("_split", F.lit(0).cast("long")), p.withColumn("_split", F.lit(0).cast("long"))
    holds = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return m.join(p, ["_by", "_in", "_split"]).where(holds).drop("_by", "_in", "_split")
