"""The query text_clean over whole texts, against Python."""

from __future__ import annotations

from tallyframe.functions import text
from tallyframe.plans.queries import text_clean


def test_whole_texts_of_every_document(spark, tmp_path):
    texts = ["x" * 150 + " y" * 5000, "plain", " \t\r\n\x0b\x0c inner  blanks \x0c", "", " \n", None, "é" * 1000]
    rows = [(10 * k + digit, t) for k, t in enumerate(texts) for digit in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(map(tuple, text_clean(spark, f"file://{tmp_path}").collect()))
    assert got == sorted((i, (t or "").strip(" \t\n\x0b\x0c\r")) for i, t in rows)


def test_no_value_texts(spark):
    rows = [("N/A", ""), (None, ""), ("nan", ""), ("a N/A", "a N/A")]
    frame = spark.createDataFrame(rows, "written string, want string")
    assert all(r.got == r.want for r in frame.select("want", text.clean_text(frame["written"]).alias("got")).collect())
