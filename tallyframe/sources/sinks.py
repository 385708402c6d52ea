"""Writers."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import short_number
from ..operators.ofx import CRLF, document_parts
from ..operators.summary import entries


def csv_entries(ledger: DataFrame) -> DataFrame:
    """date, description, reference, amount as text, with numbers in their short form."""
    rows = entries(ledger)
    return rows.select("row_id", F.coalesce("date", F.lit("")).alias("date"), "description", "reference", short_number(F.col("amount")).alias("amount"))


def csv_lines(ledger: DataFrame) -> DataFrame:
    """row_id and a CSV record, every field quoted; quotes doubled."""
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in ("date", "description", "reference", "amount")]
    return csv_entries(ledger).select("row_id", F.concat_ws(",", *quoted).alias("line"))


def write_csv(ledger: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, rows in order over the files."""
    rows = csv_entries(ledger).repartitionByRange("row_id").sortWithinPartitions("row_id").drop("row_id")
    kept = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    rows.write.options(**kept).csv(path)


def _joined(spark: SparkSession, parts: str, target: str) -> None:
    """The files of a folder, by name, as one file. Bytes pass through the driver in a buffer of a few KB."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(parts)
    store = at.getFileSystem(conf)
    names = sorted(f.getPath().toString() for f in store.listStatus(at) if f.getPath().getName().startswith("part-"))
    out = store.create(jvm.org.apache.hadoop.fs.Path(target), True)
    try:
        for name in names:
            into = store.open(jvm.org.apache.hadoop.fs.Path(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(into, out, conf, False)
            finally:
                into.close()
    finally:
        out.close()
    store.delete(at, True)


def write_ofx(ledger: DataFrame, path: str, account_id: str, account_type: str, bank_id: str = "0", now: str | None = None, **more) -> None:
    """A folder with the one text file that an OFX document is, of any length: its pieces are
    written in order by many tasks, and their files joined."""
    parts = document_parts(ledger, account_id, account_type, bank_id, now, **more).select("offset", "text")
    dealt = parts.repartitionByRange("offset").sortWithinPartitions("offset").select("text")
    dealt.write.option("lineSep", CRLF).text(f"{path}/_pieces")
    _joined(ledger.sparkSession, f"{path}/_pieces", f"{path}/part-00000.txt")


def download_name(upload: str) -> str:
    """The name under which an export of an uploaded file is offered."""
    return f"{PurePosixPath(upload).stem or 'transactions'}.qbo"
