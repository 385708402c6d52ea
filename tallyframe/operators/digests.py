"""Digests of texts that are too long for one row."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship

#: Row numbers whose texts one piece holds.
ROWS_A_PIECE = 200


def text_pieces(df: DataFrame, text: Column, row: str = "row_id", between: str = ";", rows_a_piece: int = ROWS_A_PIECE) -> DataFrame:
    """piece, rows, text: the texts of so many row numbers, in order. Rows whose text is null have no part in it."""
    some = df.select(F.floor(F.col(row) / rows_a_piece).alias("piece"), F.col(row).alias("_row"), text.alias("_text")).where("_text IS NOT NULL")
    found = some.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("_row", "_text"))).alias("_t"))
    return found.select("piece", F.size("_t").cast("long").alias("rows"), F.array_join(F.col("_t._text"), between).alias("text"))


def text_digest(df: DataFrame, text: Column, row: str = "row_id", between: str = ";", rows_a_piece: int = ROWS_A_PIECE) -> DataFrame:
    """One row: ``rows`` and ``sha256`` of their texts joined in the order of row numbers; null if there are none.

    Each byte of a SHA-256 depends on all before it, so one task reads the whole text, but it holds a batch of pieces at
    a time and does nothing else: the pieces are made by many tasks, and Spark sorts them, on disk if need be.
    """
    ship(df.sparkSession)
    joint = between.encode()

    def chained(batches):
        found, rows = hashlib.sha256(), 0
        for batch in batches:
            for n, piece in zip(batch["rows"].to_pylist(), batch["text"].cast(pa.large_binary()), strict=True):
                if rows:
                    found.update(joint)
                found.update(piece.as_buffer())
                rows += n
        if rows:
            yield pa.RecordBatch.from_pydict({"rows": [rows], "sha256": [found.hexdigest()]})

    in_order = text_pieces(df, text, row, between, rows_a_piece).repartition(1).sortWithinPartitions("piece").select("rows", "text")
    whole = in_order.mapInArrow(chained, "rows long, sha256 string")
    return whole.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.max("sha256").alias("sha256"))  # a row even of no pieces
