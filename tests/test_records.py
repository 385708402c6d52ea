"""CSV files that Spark splits, against one pass over the whole text by Python's own reader."""

from __future__ import annotations

import csv
import io
import random
import time
from itertools import product

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import normalize
from tallyframe.sources import readers, records


def plain(content: str) -> list[list[str]]:
    return [r for r in csv.reader(io.StringIO(content, newline="")) if len(r) > 1 or (r and r[0].strip())]


def written(rows: int, seed: int) -> str:
    r = random.Random(seed)
    parts = ["a", "", "two\nlines", 'say ""so""', "x,y", "\n\n", "end\r\nin", 'tail""', "é" * 9, ","]
    out = ["date,description,amount"]
    for k in range(rows):
        cell = "".join(r.choice(parts) for _ in range(r.randint(0, 6)))
        field = r.choice([f'"{cell}"', f'"{cell}"after', 'in"side', 'b "q" b', "plain", ""])
        out.append(f"2026-01-{k % 28 + 1:02d},{field},{k}" + r.choice(["", "\r"]))
    return "\n".join(out) + "\n"


def places(spark, at, size, **more):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        frame = records.read(spark, at, **more)
        return frame.rdd.getNumPartitions(), [[c or "" for c in r.cells] for r in frame.orderBy("source_file", "pos").collect()], frame
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ('a,b\n1,"x"\n', [["a", "b"], ["1", "x"]]), ('"', [[""]]), ('a,"open\nto the end', [["a", "open\nto the end"]]), ('x\r"y\rz",1\n', [["x"], ["y\rz", "1"]]),
        ('""\n \n\t\n"a"\n', [[""], ["a"]]), ('"a""b",\n,"c"d"e",f\n', [["a""\"b", None], [None, 'cd"e"', "f"]]), ("\n\n", []), ('a"b,"c\n"\n', [['a"b', "c\n"]]), ("a,\r\n,b\r\n", [["a", None], [None, "b"]]),
    ],
)
def test_records_of_a_text(content, want):
    assert records.split_records(content) == want


def test_ends_of_lines_by_characters():
    """The scan by quotes against one by characters, over all short lines of four characters."""

    def by_characters(line, inside):
        state = "quoted" if inside else "begin"
        for c in line:
            if state == "quoted":
                state = "closing" if c == '"' else "quoted"
            elif state == "closing" and c == '"':
                state = "quoted"
            elif c in ",\r":
                state = "begin"
            elif state == "begin" and c == '"':
                state = "quoted"
            else:
                state = "plain"
        return state == "quoted"

    for n in range(7):
        for line in map("".join, product('",a\r', repeat=n)):
            for inside in (False, True):
                assert records.ends_inside(line, inside) == by_characters(line, inside), (line, inside)


@pytest.mark.parametrize(("seed", "size", "named"), [(1, 97, 10_000), (2, 211, 10_000), (3, 1009, 10_000), (4, 211, 0), (5, 64, 3)])
def test_splits_anywhere(spark, tmp_path, seed, size, named):
    content = written(300, seed)
    (tmp_path / "x.csv").write_bytes(content.encode())
    tasks, got, _ = places(spark, f"file://{tmp_path}/x.csv", size, most_named=named)
    assert got == plain(content) and (tasks > 8 or named < 10)


def test_one_record_over_many_splits(spark, tmp_path):
    long = "\n".join(f"line {k}, still quoted" for k in range(400))
    content = f'date,memo,amount\n2026-01-01,a,1\n2026-01-02,"{long}",2\n2026-01-03,c,3\n2026-01-04,"open\nto the end'
    (tmp_path / "x.csv").write_text(content)
    (tmp_path / "y.csv").write_text('date,memo,amount\n2026-01-05,"z\nz",5\n')
    _, got, frame = places(spark, f"file://{tmp_path}", 500)
    assert got == plain(content) + [["date", "memo", "amount"], ["2026-01-05", "z\nz", "5"]]
    assert all(len(set(p)) == len(p) for p in [[r.pos for r in frame.collect() if r.source_file.endswith(n)] for n in "xy"])


def test_states_need_no_whole_file(spark, tmp_path):
    """Each split's function is found alone, and the window gives what one pass over the file gives."""
    content = written(500, 9)
    (tmp_path / "x.csv").write_bytes(content.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        states = {r.start: (r.inside, r.ends_inside) for r in records.begins(spark, f"file://{tmp_path}/x.csv").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    raw, inside, at, want, starts = content.encode(), False, 0, {}, sorted(states)
    for line in raw.split(b"\n")[:-1]:
        of = max(s for s in starts if s == 0 or s < at)  # a line belongs to the split in which it begins, or to the one before at its edge
        want.setdefault(of, [int(inside), 0])
        inside = records.ends_inside(line.decode(), inside)
        want[of][1] = int(inside)
        at += len(line) + 1
    assert {k: tuple(v) for k, v in want.items()} == states and {v[0] for v in states.values()} == {0, 1}


def test_many_commas_and_broken_text(spark, tmp_path):
    commas = "," * 100_000
    (tmp_path / "x.csv").write_bytes(f'date,memo,amount\n2026-01-01,"{commas}",1\n'.encode() + b"2026-01-02,\xff\xfe,2\n")
    began = time.time()
    got = [(len(r.description), r.amount) for r in normalize.to_ledger(readers.read_csv(spark, f"file://{tmp_path}/x.csv")).orderBy("row_id").collect()]
    assert got == [(100_000, 1.0), (2, 2.0)] and time.time() - began < 60


def test_strip_takes_linear_time(spark):
    n = 1_000_000
    frame = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), n), F.lit("b"), F.repeat(F.lit("\t"), n)).alias("t"))
    text.strip(F.col("t"))
    frame.select(F.length(text.strip(F.col("t")))).first()
    began = time.time()
    assert frame.select(F.length(text.strip(F.col("t")))).first()[0] == n + 2
    assert time.time() - began < 1.5
    every = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    kept = [chr(c) for c in range(0x3001) if not chr(c).isspace() and not 0xD800 <= c < 0xE000]
    frame = spark.createDataFrame([(every + "x" + every,), ("".join(kept),)], "t string")
    assert [r[0] for r in frame.select(text.strip(F.col("t"))).collect()] == ["x", "".join(kept)]


def test_folders_of_several_kinds(spark, tmp_path, monkeypatch):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text("date,memo,amount\n2026-01-01,a,1\n")
    (tmp_path / "deep" / "b.txt").write_text('date,memo,amount\n2026-01-02,"b\nb",2\n')
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / ".hidden.csv").write_text("x")
    where = f"file://{tmp_path}"
    assert sorted((r.description, r.amount) for r in readers.read_statement(spark, where).collect()) == [("a", 1.0), ("b\nb", 2.0)]
    (tmp_path / "c.PDF").write_text("")
    assert sorted((k, len(v)) for k, v in readers.files_by_kind(spark, where).items()) == [("csv", 2), ("pdf", 1)]
    words = [("c", 1, 10.0, x, k, t) for k, (x, t) in enumerate([(63.0, "Date"), (150.0, "Description")])] + [("c", 1, 20.0, x, k, t) for k, (x, t) in enumerate([(61.5, "6/4"), (150.0, "Pay"), (405.0, "5.00")])]
    pages = spark.createDataFrame([("c", 1, "June 30, 2026")], "source_file string, page int, text string")
    monkeypatch.setattr(readers, "read_pdf", lambda s, paths: (s.createDataFrame(words, readers.WORDS), pages))
    assert sorted((r.description, r.amount) for r in readers.read_statement(spark, where).collect()) == [("Pay", 5.0), ("a", 1.0), ("b\nb", 2.0)]
    (tmp_path / "none").mkdir()
    for bad, reason in (("none", "no_rows"), ("absent", "unreadable")):
        with pytest.raises(readers.StatementParseError) as e:
            readers.read_statement(spark, f"{where}/{bad}")
        assert e.value.reason == reason
