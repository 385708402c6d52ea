"""An extension: ledger rows that arrive as a stream are posted once each.

Each micro-batch is planned against the posted table and its created rows are appended to a folder
of that batch's own, so a batch that is run again after a failure replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import push_key
from ..operators.postings import CREATED, plan_postings
from ..schema import LEDGER, POSTED


def ledger_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Ledger rows of Parquet files as they are put into a folder."""
    return spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def once_within(ledger: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream's rows without those whose key came within ``delay`` before; state is kept no longer."""
    keyed = ledger.withColumn("doc_number", push_key(F.col("date"), F.col("description"), F.col("amount")))
    return keyed.withColumn("event_time", F.col("date").cast("timestamp")).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["doc_number"])


def post_batches(stream: DataFrame, posted_path: str, checkpoint: str):
    """Start posting; the query has run out when all files of the folder are done."""

    def post(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        posted = spark.createDataFrame([], POSTED)
        try:
            earlier = spark.read.option("basePath", posted_path).parquet(posted_path)
            posted = earlier.where(F.col("batch") < number).select(*POSTED.names)
        except Exception as e:  # no batch has written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        made = plan_postings(batch, posted).where(F.col("status") == CREATED)
        made.select("txn_type", "doc_number", F.col("doc_number").alias("id")).write.mode("overwrite").parquet(f"{posted_path}/batch={number}")

    return stream.writeStream.foreachBatch(post).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
