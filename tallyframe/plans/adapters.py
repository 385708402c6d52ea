"""Ledgers and word relations made from the star-schema tables, which hold no bank statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import number_rows


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_ledger(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Orders as a ledger in the order of their keys; finished ones are money out. ``more``: further columns."""
    rows = read(spark, sf_dir, "orders").select(
        "o_orderkey", *more, F.col("o_orderdate").cast("timestamp_ntz").alias("date"), F.col("o_orderpriority").alias("description"),
        F.col("o_orderkey").cast("string").alias("reference"), F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("amount"),
    )
    return number_rows(rows, "o_orderkey").select(*more, "row_id", "date", "description", "reference", "amount")


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger with a time of day; every third is money out. The event's id numbers its row."""
    value = F.when(F.col("event_id") % 3 == 0, -F.col("value")).otherwise(F.col("value"))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp_ntz").alias("date"), F.col("event_type").alias("description"), F.col("user_id").cast("string").alias("reference"), value.alias("amount")
    )


def lineitem_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as the words of a statement page: a header, rows of which every third
    continues the one before, and totals, which are off by one for every seventh order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    rows = read(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order)).withColumn("is_in", F.col("l_returnflag") == "N")
    opens = (F.col("n") % 3 != 0) & ~F.col("l_linenumber").isNull()
    word = lambda x0, text: F.struct(F.lit(float(x0)).alias("x0"), text.alias("text"))
    money = F.format_string("%.2f", "l_extendedprice")
    day = F.concat_ws("/", F.month("l_shipdate").cast("string"), F.dayofmonth("l_shipdate").cast("string"))
    row = F.array(
        word(61.5, day), F.when(F.col("l_linenumber") % 2 == 0, word(120, F.col("l_suppkey").cast("string"))), word(150, F.lit("Part")), word(190, F.col("l_partkey").cast("string")),
        F.when(F.col("is_in"), word(405, money)).otherwise(word(470, money)), word(533, F.lit("9.00")),
    )
    more = F.array(word(150, F.lit("Supplier")), word(200, F.col("l_suppkey").cast("string")), word(395, F.lit("x")))
    lines = rows.select("l_orderkey", (F.lit(100.25) + 10 * F.col("n")).alias("top"), F.array_compact(F.when(opens, row).otherwise(more)).alias("words"))
    amount = F.when(opens, F.col("l_extendedprice").cast("decimal(18,2)")).otherwise(0)
    ends = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("is_in"), amount).otherwise(0)).alias("credit"), F.sum(F.when(~F.col("is_in"), amount).otherwise(0)).alias("debit"))
    head = F.array(*[word(x, F.lit(t)) for x, t in ((63, "Date"), (117, "Number"), (150, "Description"), (413, "Credits"), (483, "Debits"))])
    wrong = F.when(F.col("l_orderkey") % 7 == 0, 1).otherwise(0)
    shown = lambda c: F.concat(F.lit("$"), F.format_string("%.2f", c.cast("double")))
    last = F.array(word(61.5, F.lit("Totals")), word(400, shown(F.col("credit") + wrong)), word(465, shown(F.col("debit"))))
    frame = ends.select("l_orderkey", F.explode(F.array(F.struct(F.lit(50.0).alias("top"), head.alias("words")), F.struct((F.lit(100.0) + 10 * (F.col("n") + 1)).alias("top"), last.alias("words")))).alias("l"))
    every = lines.unionByName(frame.select("l_orderkey", "l.top", "l.words"))
    each = every.select("l_orderkey", "top", F.posexplode("words").alias("seq", "w"))
    return each.select(F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("source_file"), F.lit(1).alias("page"), "top", "w.x0", F.col("seq").cast("long").alias("seq"), "w.text")


def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pages of statements, one for each order, that end with June 1995."""
    orders = read(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return orders.select(F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("source_file"), F.lit(1).alias("page"), F.lit("Account of June 30, 1995 Page 1 of 1").alias("text"))
