"""Statement files to raw relations: CSV by Spark's reader, spreadsheets and PDFs by optional libraries."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators import layout, normalize
from ..schema import WORDS, StatementParseError
from . import records

RAW = "source_file string, pos long, cells array<string>"


_LIBRARIES = {"excel": ("openpyxl", "spreadsheets"), "pdf": ("pdfplumber", "PDF statements")}


def _need(module: str, what: str) -> None:
    if importlib.util.find_spec(module) is None:
        raise StatementParseError("missing_library", f"Reading {what} needs the library {module}, which is not installed.")


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_file, pos, cells of CSV files or folders of them; every record, the header too. One
    large file is read by as many tasks as it has splits; see ``records.read``."""
    return records.read(spark, path)


def read_excel(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``read_csv``, of the first sheet of each workbook."""
    _need(*_LIBRARIES["excel"])

    def sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for files in batches:
            for at, content in zip(files["path"], files["content"], strict=True):
                sheet = pd.read_excel(io.BytesIO(content), header=None, dtype=object)
                cells = [[None if pd.isna(v) else str(v) for v in r] for r in sheet.itertuples(index=False)]
                yield pd.DataFrame({"source_file": at, "pos": range(len(cells)), "cells": cells})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(sheets, RAW)


def read_pdf(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Words and page texts of PDF files, for ``layout.read_statements``."""
    _need(*_LIBRARIES["pdf"])

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pdfplumber

        for files in batches:
            for at, content in zip(files["path"], files["content"], strict=True):
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    for n, page in enumerate(pdf.pages):
                        found = page.extract_words(use_text_flow=False, keep_blank_chars=False)
                        yield pd.DataFrame([(at, n, w["top"], w["x0"], k, w["text"]) for k, w in enumerate(found)], columns=WORDS.names)

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pdfplumber

        for files in batches:
            for at, content in zip(files["path"], files["content"], strict=True):
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    yield pd.DataFrame([(at, n, page.extract_text() or "") for n, page in enumerate(pdf.pages[:2])], columns=["source_file", "page", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(words, WORDS), files.mapInPandas(texts, "source_file string, page int, text string")


def kind_of(name: str) -> str:
    """pdf, excel or csv by the name's ending; csv for all others."""
    low = name.lower()
    return "pdf" if low.endswith(".pdf") else "excel" if low.endswith((".xlsx", ".xls")) else "csv"


def files_by_kind(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of a path, or of all folders below it, by kind. Names that begin with a dot or an underscore aren't statements."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), {}
    while found.hasNext():
        file = found.next().getPath()
        inside = file.toString().removeprefix(at.toString()).split("/")
        if not any(x.startswith((".", "_")) for x in inside):
            out.setdefault(kind_of(file.getName()), []).append(file.toString())
    return out


def read_statement(spark: SparkSession, path: str, check: bool | str = True) -> DataFrame:
    """The ledger of a statement file, or of all files of a folder, each by its kind; all that can go wrong
    is a StatementParseError, but for what ``check`` "late" leaves to the query."""
    if (kind := kind_of(path)) != "csv":
        _need(*_LIBRARIES[kind])
    try:
        kinds = files_by_kind(spark, path)
        ledgers = []
        if kinds.get("pdf"):
            ledgers.append(layout.read_statements(*read_pdf(spark, kinds["pdf"]), check))
        for kind, reader in (("excel", read_excel), ("csv", read_csv)):
            if kinds.get(kind):
                ledgers.append(normalize.to_ledger(reader(spark, kinds[kind]), check))
        if not ledgers:
            raise StatementParseError("no_rows", "There are no rows.")
        return reduce(DataFrame.unionByName, ledgers)
    except StatementParseError:
        raise
    except Exception as e:
        raise StatementParseError("unreadable", f"Could not read {path!r}: {str(e).splitlines()[0]}") from e
