"""CSV records of files that Spark splits, wherever the splits fall.

Spark's text reader hands out lines by byte split. Whether a split begins inside a quoted field
depends on all before it, but each split is a function of that one bit: it hands it on, turns
it, or leaves it at a value of its own once a quote can only be read in one way. A pass over
the lines finds each split's function, window sums over the splits (the last value that was
set, and the parity of the turns since) say how each begins, and a second pass reads its
records. What a split has of a record that began before it, or goes on after it, is put
together by file and place. No task reads more than a split, whatever the size of a file.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import ship

RECORDS = "source_file string, pos long, cells array<string>"
#: So many splits that begin inside quotes are named to the tasks; if there are more, lines are joined with their splits.
MOST_NAMED = 10_000
_OPENS, _FIELD_ENDS, _ENDS = re.compile('[,\r]"'), re.compile("[,\r]"), re.compile("[,\r\n]")
_BLANK = " \t\r"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line, begun inside a quoted field or at the beginning of a record, ends inside one.

    A quote opens a field only where the field begins, two inside a quoted field are one
    character, and after the closing quote the field goes on unquoted.
    """
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                found = _OPENS.search(line, at)
                if not found:
                    return False
                at = found.end() - 1
            at += 1
        inside = True
        close = line.find('"', at)
        if close < 0:
            return True
        at = close + 1
        if not line.startswith('"', at):
            found = _FIELD_ENDS.search(line, at)
            if not found:
                return False
            at, inside = found.end(), False
        else:
            at += 1


def split_records(text: str) -> list[list[str | None]]:
    """The records of a text that begins and ends between records. An empty field without quotes is
    null, with quotes it is empty; records without fields but blanks are left out."""
    if '"' not in text:
        parts = text.split("\n") if "\r" not in text else re.split("\r\n|\r|\n", text)
        return [[f or None for f in p.split(",")] for p in parts if p.strip(_BLANK)]
    out, row, at, size = [], [], 0, len(text)
    while at <= size:
        value, quoted = None, text.startswith('"', at)
        if quoted:
            value, at = "", at + 1
            while True:
                close = text.find('"', at)
                if close < 0:
                    value, at = value + text[at:], size
                    break
                value, at = value + text[at:close], close + 1
                if not text.startswith('"', at):
                    break
                value, at = value + '"', at + 1
        found = _ENDS.search(text, at)
        stop = found.start() if found else size
        if stop > at:
            value = (value or "") + text[at:stop]
        row.append(value)
        if stop >= size or text[stop] != ",":
            if len(row) > 1 or quoted or (value or "").strip(_BLANK):
                out.append(row)
            row = []
            if stop >= size:
                break
        at = stop + 1
    return out


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, start (of the split) and line, in order within a split. A file ends its lines by line feeds."""
    at = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(at["file_path"].alias("file"), at["file_block_start"].alias("start"), F.make_valid_utf8("value").alias("line"))


def _by_split(batches):
    """(file, start, lines) of Arrow batches, a split in parts that follow each other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column(0), batch.column(1).to_numpy()
        codes = file.dictionary_encode().indices.to_numpy()
        new = [0, *(k for k in range(1, len(start)) if start[k] != start[k - 1] or codes[k] != codes[k - 1]), len(start)] if (start != start[0]).any() or (codes != codes[0]).any() else [0, len(start)]
        for a, b in zip(new, new[1:], strict=False):
            yield file[a].as_py(), int(start[a]), batch.column(2).slice(a, b - a)


def _functions(batches):
    """What each split does to the bit: ``last`` is the value that it sets, or null; ``turns`` the parity since."""
    mark, last, turns = None, None, 0
    for file, start, lines in _by_split(batches):
        if (file, start) != mark:
            if mark:
                yield _row(mark, last, turns)
            mark, last, turns = (file, start), None, 0
        for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
            out = ends_inside(line, False), ends_inside(line, True)
            if out[0] == out[1]:
                last, turns = int(out[0]), 0
            elif out[0]:
                turns ^= 1
    if mark:
        yield _row(mark, last, turns)


def _row(mark, last, turns):
    return pa.RecordBatch.from_arrays([pa.array([mark[0]]), pa.array([mark[1]], pa.int64()), pa.array([last], pa.int32()), pa.array([turns], pa.int32())], names=["file", "start", "last", "turns"])


def begins(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, start, inside and ends_inside (0 or 1) of each split that has lines. As many rows as the scan has splits."""
    ship(spark)
    each = _lines(spark, path).mapInArrow(_functions, "file string, start long, last int, turns int")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_turned", F.sum("turns").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    # a split that sets a value counts its own turns after that
    given = F.last(F.when(F.col("last").isNotNull(), F.struct((F.col("last") + F.col("turns")).alias("value"), "_turned")), ignorenulls=True).over(before)
    turned = F.coalesce(F.col("_turned") - F.col("turns"), F.lit(0))
    inside = F.when(given.isNotNull(), given["value"] + turned - given["_turned"]).otherwise(turned)
    ends = F.coalesce("last", inside) + F.col("turns")
    return each.select("file", "start", *[F.pmod(x, F.lit(2)).cast("int").alias(c) for x, c in ((inside, "inside"), (ends, "ends_inside"))])


def _out(rows, kind) -> pa.RecordBatch:
    fields = [pa.field("source_file", pa.string()), pa.field("pos", pa.int64()), pa.field("cells", pa.list_(pa.string())) if kind == "cells" else pa.field("text", pa.string()), pa.field("opens", pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields[: len(rows[0])], strict=True)], schema=pa.schema(fields[: len(rows[0])]))


def _read(inside_of, pieces: bool):
    """Lines to the records that lie in one split, or to the pieces of those that don't.

    A piece is what a split has of such a record: ``opens`` says whether it begins there. A place is
    the beginning of the split and the characters from its first line, so places grow along a file.
    """

    def run(batches):
        mark, inside, rest = None, False, False  # rest: of a record that began before the split
        held, at, opened, rows = [], 0, 0, []
        for file, start, lines in _by_split(batches):
            if (file, start) != mark:
                if held and pieces:
                    rows.append((mark[0], mark[1] + opened, "\n".join(held), not rest))
                mark, held, at = (file, start), [], 0
                inside = rest = inside_of(file, start)
            for line in lines.to_pylist():
                if not held:
                    opened = at
                at += len(line) + 1
                held.append(line)
                inside = ends_inside(line, inside) if '"' in line else inside
                if inside:
                    continue
                if rest and pieces:
                    rows.append((file, start + opened, "\n".join(held), False))
                elif not rest and not pieces:
                    rows += [(file, start + opened + k, cells) for k, cells in enumerate(split_records("\n".join(held)))]
                held, rest = [], False
            if len(rows) >= 4096:
                yield _out(rows, "text" if pieces else "cells")
                rows = []
        if held and pieces:
            rows.append((mark[0], mark[1] + opened, "\n".join(held), not rest))
        if rows:
            yield _out(rows, "text" if pieces else "cells")

    return run


def _joined(batches):
    """Whole texts of records that were in pieces to records."""
    for batch in batches:
        rows = [(f, p + k, cells) for f, p, text in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True) for k, cells in enumerate(split_records(text))]
        if rows:
            yield _out(rows, "cells")


def read(spark: SparkSession, path: str | list[str], most_named: int = MOST_NAMED) -> DataFrame:
    """source_file, pos and cells of every record of CSV files or folders of them, headers too.

    ``pos`` grows along a file. Quoted fields may hold line feeds, two quotes stand for one, blank
    lines are skipped; a field that is open at the end of its file ends there. A record has as
    many cells as it has. A file whose lines end by carriage returns alone is one line, so one task reads it.
    """
    ship(spark)
    states = begins(spark, path)
    found = states.where("inside = 1 OR ends_inside = 1").limit(most_named + 1).collect()
    named = [(r.file, r.start) for r in found if r.inside]
    lines = _lines(spark, path)
    if len(found) <= most_named:
        quoted = frozenset(named)
        look = lambda file, start: (file, start) in quoted
    else:
        lines = _marked(lines, states.where("inside = 1").select("file", "start"))
        look = None
    kind = "source_file string, pos long, text string, opens boolean"
    whole = lines.mapInArrow(_reading(look, False), RECORDS)
    if not found:
        return whole
    parts = lines.mapInArrow(_reading(look, True), kind)
    upto = Window.partitionBy("source_file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_of", F.sum(F.col("opens").cast("int")).over(upto))
    texts = parts.groupBy("source_file", "_of").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(texts.select("source_file", "pos", "text").mapInArrow(_joined, RECORDS))


def _marked(lines: DataFrame, states: DataFrame) -> DataFrame:
    """Lines with a fourth column, whether their split begins inside quotes, each split whole and in order."""
    numbered = lines.withColumn("_n", F.monotonically_increasing_id())
    found = numbered.join(states.withColumn("_inside", F.lit(True)), ["file", "start"], "left")
    dealt = found.repartition("file", "start").sortWithinPartitions("file", "start", "_n")
    return dealt.select("file", "start", "line", F.coalesce("_inside", F.lit(False)).alias("inside"))


def _reading(look, pieces: bool):
    if look:
        return _read(look, pieces)

    def run(batches):
        now = {}

        def watched():
            for batch in batches:
                if batch.num_rows:
                    for f, s, i in {*zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)}:
                        now[f, s] = i
                yield batch

        yield from _read(lambda file, start: now.pop((file, start), False), pieces)(watched())

    return run
