"""Fixity audit of WARC archives by Merkle trees over ordered offset ranges.

A leaf is the SHA-256 of a record's bytes at its offset. Leaves are gathered by ranges of
offsets, RANGE_BYTES long, and ranges by FANOUT into longer ones, up to one root for each
archive; a node hashes its children's offsets and hashes in order. Two replicas are compared
root by root, and only the children of nodes that differ are looked at, down to the
records that are changed, missing or extra. Trees are DataFrames, a table for each level.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, staged, table

RANGE_BYTES, FANOUT = 1 << 16, 16
RECORDS_AN_ARCHIVE = 10_000
_NEXT = 10**15  # more than there are ranges of ids
_CRLF = "\r\n"


# records


def page_record(url: Column, html: Column, ident: Column) -> Column:
    """A page as a WARC resource record, the same bytes each time it is made. Nulls count as empty."""
    body, name = F.coalesce(html, F.lit("")), F.md5(F.coalesce(ident.cast("string"), F.lit("")))
    urn = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: resource{_CRLF}WARC-Record-ID: <urn:uuid:"), urn, F.lit(f">{_CRLF}WARC-Date: 2026-01-01T00:00:00Z{_CRLF}WARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit(f"{_CRLF}Content-Type: text/html{_CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(_CRLF * 2),
    )
    return F.concat(head, body, F.lit(_CRLF * 2))


def parse_warc(raw: bytes):
    """(offset, length, record bytes) of the records of an uncompressed WARC file. What is between
    records, or after the last that can be read, is a record of its own, so no byte goes unhashed."""
    at = 0
    while at < len(raw):
        head = raw.find(b"\r\n\r\n", at)
        size = re.search(rb"(?im)^content-length:[ \t]*(\d+)", raw[at:head]) if raw.startswith(b"WARC/", at) and head >= 0 else None
        end = head + 4 + int(size[1]) + 4 if size else -1
        if not size or end > len(raw):
            following = raw.find(b"WARC/1.", at + 1)
            end = following if following >= 0 else len(raw)
        yield at, end - at, raw[at:end]
        at = end


def _leaves(batches):
    for batch in batches:
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = [(name, at, n, hashlib.sha256(x).hexdigest()) for at, n, x in parse_warc(raw)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["archive", "offset", "length", "hash"])


def file_leaves(spark: SparkSession, path: str) -> DataFrame:
    """archive (file name), offset, length and hash of each record of a replica's WARC files."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    return files.transform(mapped, _leaves, "archive string, offset long, length long, hash string")


# trees


def depth_of(*replicas: DataFrame) -> int:
    """Levels above the records, so that every archive has one root."""
    end = max((x.agg(F.max(F.col("offset"))).first()[0] or 0 for x in replicas), default=0)
    levels, span = 1, RANGE_BYTES
    while end >= span:
        levels, span = levels + 1, span * FANOUT
    return levels


def _digest(children: Column) -> Column:
    text = F.transform(F.array_sort(children), lambda c: F.concat_ws(":", c["at"].cast("string"), c["length"].cast("string"), c["hash"]))
    return F.sha2(F.concat(F.lit("range;"), F.array_join(text, ";")), 256)


def tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Tables of (archive, node, length, hash) by level; the first are the shortest ranges, the last the roots."""
    out, below = [], leaves.select("archive", F.floor(F.col("offset") / RANGE_BYTES).alias("node"), F.col("offset").alias("at"), "length", "hash")
    for _ in range(levels):
        grouped = below.groupBy("archive", "node").agg(F.collect_list(F.struct("at", "length", "hash")).alias("c"), F.sum("length").alias("length"))
        level = staged(grouped.select("archive", "node", "length", _digest(F.col("c")).alias("hash")), "merkle")
        out.append(level)
        below = level.select("archive", F.floor(F.col("node") / FANOUT).alias("node"), F.col("node").alias("at"), "length", "hash")
    return out


def _differing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    x = a.select("archive", key, F.col("hash").alias("hash_a"), F.col("length").alias("length_a"))
    y = b.select("archive", key, F.col("hash").alias("hash_b"), F.col("length").alias("length_b"))
    return x.join(y, ["archive", key], "full_outer").where(~(F.col("hash_a").eqNullSafe(F.col("hash_b")) & F.col("length_a").eqNullSafe(F.col("length_b"))))


def audit(a: DataFrame, b: DataFrame) -> tuple[DataFrame, list[int]]:
    """The records in which replica ``b`` differs from ``a``, and how many nodes differed at each level
    from the roots down: archive, offset, hash_a, hash_b, length_a, length_b, state.

    State is changed, missing (not in ``b``) or extra (not in ``a``). Replicas of no records agree.
    Records of one archive must differ in their offsets.
    """
    levels = depth_of(a, b)
    one, two = tree(a, levels), tree(b, levels)
    bad = staged(_differing(one[-1], two[-1], "node"), "differing")
    seen = [bad.count()]
    for x, y in zip(one[-2::-1], two[-2::-1], strict=True):
        up = bad.select("archive", F.col("node").alias("parent"))
        below = lambda t: t.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(up, ["archive", "parent"], "left_semi")  # noqa: E731, B023
        bad = staged(_differing(below(x), below(y), "node"), "differing")
        seen.append(bad.count())
    up = bad.select("archive", F.col("node").alias("parent"))
    below = lambda t: t.withColumn("parent", F.floor(F.col("offset") / RANGE_BYTES)).join(up, ["archive", "parent"], "left_semi")
    state = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return staged(_differing(below(a), below(b), "offset").withColumn("state", state), "differing"), seen


# the query: pages as archives, and a replica with known damage


def page_leaves(pages: DataFrame, record: Column, damaged: Column | None = None, lost: Column | None = None) -> DataFrame:
    """page_id, archive, offset, length, hash and replica_hash (null if lost) of pages in archives of
    RECORDS_AN_ARCHIVE consecutive ids. Records follow one another by id, url and hash; null ids
    count as a range of their own, -1. The replica holds records in the same places.

    Ids of a range that repeat, or null ids, may be more than an archive takes: such a range is
    dealt by a hash to as many archives as it fills, the further ones numbered _NEXT apart.
    Null and empty html make records with an empty body. An empty table gives no rows;
    columns beside page_id, url and html are not read.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("_url"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("hash"),
        F.when(~(lost if lost is not None else F.lit(False)), F.sha2(damaged if damaged is not None else record, 256)).alias("replica_hash"), F.spark_partition_id().alias("_part"),
    )
    block = F.coalesce(F.floor(F.col("page_id") / RECORDS_AN_ARCHIVE), F.lit(-1))
    counts = pages.select(F.coalesce(F.floor(F.col("page_id").cast("long") / RECORDS_AN_ARCHIVE), F.lit(-1)).alias("_range")).groupBy("_range").agg(F.count("*").alias("_n"))
    full = counts.where(F.col("_n") > RECORDS_AN_ARCHIVE).withColumn("_archives", F.ceil(F.col("_n") / RECORDS_AN_ARCHIVE).cast("long"))
    # written, so that the planner knows how few they are and needn't deal the records by range
    rows = rows.withColumn("_range", block).join(staged(full.select("_range", "_archives"), "full-ranges"), "_range", "left")
    further = F.coalesce(F.pmod(F.xxhash64("_url", "hash", "page_id", "_part"), F.col("_archives")), F.lit(0))
    rows = rows.withColumn("archive", F.col("_range") + further * _NEXT)
    before = Window.partitionBy("archive").orderBy(F.col("page_id"), "_url", "hash").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select("page_id", "archive", "offset", "length", "hash", "replica_hash")


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archive records, audited against a replica in which every record whose
    id's CRC-32 is 1 modulo 97 has a byte changed and every one where it is 2 is lost.

    A row for each page, repeated ones too; nulls, long pages and empty tables are as in
    ``page_leaves``. A null id's record is whole in the replica.
    """
    mark = F.coalesce(F.crc32(F.col("page_id").cast("string")) % 97, F.lit(0))
    record = page_record(F.col("url"), F.col("html"), F.col("page_id"))
    # the first byte becomes another
    damaged = F.when(mark == 1, F.concat(F.lit("X"), F.substring(record, 2, 1 << 30))).otherwise(record)
    leaves = staged(page_leaves(table(spark, sf_dir, "pages"), record, damaged, mark == 2), "leaves")
    first = leaves.select("archive", "offset", "length", "hash")
    second = leaves.where("replica_hash IS NOT NULL").select("archive", "offset", "length", F.col("replica_hash").alias("hash"))
    found, _ = audit(first, second)
    bad = found.select("archive", "offset", "hash_b", "state")
    rows = leaves.drop("replica_hash").join(bad, ["archive", "offset"], "left")
    return rows.select(
        "page_id", "archive", F.col("offset").alias("record_offset"), F.col("length").alias("record_bytes"), F.col("hash").alias("record_sha256"),
        F.when(F.col("state").isNull(), F.col("hash")).otherwise(F.col("hash_b")).alias("replica_sha256"), F.coalesce("state", F.lit("same")).alias("state"),
    )


def crc32_sql(text: str) -> str:
    """CRC-32 of a text of digits in plain SQL: the bytes are folded in bit by bit."""
    step = lambda c: f"CASE WHEN ({c}) % 2 = 1 THEN xor(({c}) >> 1, 3988292384) ELSE ({c}) >> 1 END"
    byte = reduce(lambda c, _: f"list_transform([{c}], lambda c: {step('c')})[1]", range(8), "xor(s, b)")
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda s, b: {byte}), 4294967295)"


_HEAD = "'WARC/1.1' || n || 'WARC-Type: resource' || n || 'WARC-Record-ID: <urn:uuid:' || concat_ws('-', substr(m, 1, 8), substr(m, 9, 4), substr(m, 13, 4), substr(m, 17, 4), substr(m, 21, 12)) || '>'"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, md5(CAST(page_id AS VARCHAR)) AS m, chr(13) || chr(10) AS n,
    {crc32_sql("CAST(page_id AS VARCHAR)")} % 97 AS mark FROM pages),
r AS (SELECT page_id, url, mark, {_HEAD} || n || 'WARC-Date: 2026-01-01T00:00:00Z' || n || 'WARC-Target-URI: ' || url || n || 'Content-Type: text/html' || n
    || 'Content-Length: ' || strlen(html) || n || n || html || n || n AS rec FROM p),
h AS (SELECT page_id, url, mark, CAST(floor(page_id / {RECORDS_AN_ARCHIVE}) AS BIGINT) AS archive, CAST(strlen(rec) AS BIGINT) AS record_bytes, sha256(rec) AS record_sha256,
    CASE WHEN mark = 1 THEN sha256('X' || substr(rec, 2)) WHEN mark = 2 THEN NULL ELSE sha256(rec) END AS replica_sha256 FROM r)
SELECT page_id, archive, CAST(coalesce(sum(record_bytes) OVER (PARTITION BY archive ORDER BY page_id, url, record_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset,
  record_bytes, record_sha256, replica_sha256, CASE mark WHEN 1 THEN 'changed' WHEN 2 THEN 'missing' ELSE 'same' END AS state FROM h
"""
