"""Line dedup that can be taken back: exact reference counts and sharded cuckoo filters.

An index is two tables. ``refs`` has for each line key the number of documents that hold it,
exactly. ``filters`` has for each shard of keys a cuckoo filter of those whose count reaches
the threshold. Inserting documents adds to the counts and deleting documents subtracts;
keys that cross the threshold enter or leave their shard's filter, and keys at zero go. When
there are too many keys for the shards, the filters are built anew with more of them.
Stripping deals each text's line keys to their shards' filters. A key that its filter doesn't
have is not over the threshold; only the few that a filter has by mistake are looked for in
the exact table, by their difference from it.

A key is a line without white space at its ends and with A-Z in lower case; tables hold its
128-bit BLAKE2 digest. A document is a row: rows that repeat are documents of their own.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, mapped, staged, table
from .cuckoo import CuckooFilter

#: Keys of a shard's filter.
SHARD_KEYS = 1 << 18
_HELD = 200_000  # keys that a task counts before it passes them on
_SEEN = 20_000  # texts whose copies a task passes over
KEY_BYTES = 16

_COUNTS = "key binary, docs long"
_STRIPPED = "n_lines long, n_dropped long, kept_text string"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key's digest; None if the key is too short to be dropped."""
    key = line.strip().lower()  # of bytes: only the six white-space bytes, only A-Z
    if len(key) < min_chars or min_chars > 1 and len(key.decode(errors="replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=KEY_BYTES).digest()


def shard_of(key: bytes, shards: int) -> int:
    return int.from_bytes(key[:4], "little") % shards


def _shard_column(shards: int):
    """As ``shard_of``."""
    little = F.conv(F.concat(*[F.substring(F.hex("key"), k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    return (little % shards).cast("int").alias("shard")


def _counting(min_chars: int, sign: int):
    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["key", "docs"])

    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            for raw in binary(batch.column(0)):
                for key in {line_key(x, min_chars) for x in (raw or b"").split(b"\n")}:
                    if key is not None:
                        held[key] = held.get(key, 0) + sign
                if len(held) > _HELD:
                    yield out(held)
                    held = {}
        if held:
            yield out(held)

    return run


def references(docs: DataFrame, text_col: str = "text", min_chars: int = 1, sign: int = 1) -> DataFrame:
    """(key, docs): in how many documents each line key is found, times ``sign``."""
    parts = docs.select(F.col(text_col).alias("text")).transform(mapped, _counting(min_chars, sign), _COUNTS)
    return parts.groupBy("key").agg(F.sum("docs").alias("docs"))


def _build(batches):
    """Filters of shards whose keys come one shard after the other."""
    shard, keys = None, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([CuckooFilter.of(keys).to_bytes()], pa.binary())], names=["shard", "filter"])

    for batch in batches:
        for s, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if s != shard:
                if shard is not None:
                    yield out()
                shard, keys = s, []
            keys.append(key)
    if shard is not None:
        yield out()


def _update(key, filters: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """Apply to a shard's filter the keys that crossed the threshold. ``enters`` is 1, -1, or 0
    for keys that stay over it, which only a filter that must grow needs."""
    f = CuckooFilter.from_bytes(filters["filter"].iloc[0]) if len(filters) else CuckooFilter.sized(0)
    for k, way in zip(changes["key"], changes["enters"], strict=True):
        if way < 0:
            f.delete(bytes(k))
    for k, way in zip(changes["key"], changes["enters"], strict=True):
        if way > 0 and not f.insert(bytes(k)):
            f = CuckooFilter.of([bytes(k) for k, w in zip(changes["key"], changes["enters"], strict=True) if w >= 0])
            break
    return pd.DataFrame({"shard": [key[0]], "filter": [f.to_bytes()]})


def shards_for(keys: int) -> int:
    """A power of two that leaves at most SHARD_KEYS keys to a shard on average."""
    return 1 << max(0, (keys // SHARD_KEYS).bit_length())


def _filters(refs: DataFrame, threshold: int) -> tuple[DataFrame, int]:
    """A filter for each shard that has keys over the threshold, and the number of shards."""
    over = refs.where(F.col("docs") >= threshold)
    shards = shards_for(over.count())
    dealt = over.select(_shard_column(shards), "key").repartition("shard").sortWithinPartitions("shard")
    return staged(dealt.transform(mapped, _build, "shard int, filter binary"), "line-filters"), shards


@dataclass
class LineIndex:
    """Reference counts and filters of a corpus; insert and delete return a new index."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    threshold: int
    min_chars: int

    @classmethod
    def build(cls, docs: DataFrame, threshold: int = 10, min_chars: int = 1, text_col: str = "text") -> LineIndex:
        """The index of all rows; null and empty texts are one empty line, whose key counts only if ``min_chars`` is 0."""
        refs = staged(references(docs, text_col, min_chars), "line-refs")
        return cls(refs, *_filters(refs, threshold), threshold, min_chars)

    def _changed(self, docs: DataFrame, sign: int, text_col: str) -> LineIndex:
        before = self.refs.select("key", F.col("docs").alias("was"), F.col("docs").alias("docs"))
        delta = references(docs, text_col, self.min_chars, sign).select("key", F.lit(0).cast("long").alias("was"), "docs")
        both = staged(before.unionAll(delta).groupBy("key").agg(F.sum("was").alias("was"), F.sum("docs").alias("docs")), "line-changes")
        refs, now, was = both.where("docs > 0").select("key", "docs"), F.col("docs") >= self.threshold, F.col("was") >= self.threshold
        if shards_for(both.where(now).count()) > self.shards:
            return LineIndex(refs, *_filters(refs, self.threshold), self.threshold, self.min_chars)
        moved = both.where(now | was).select(_shard_column(self.shards), "key", (now.cast("int") - was.cast("int")).alias("enters"))
        filters = self.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(_update, "shard int, filter binary")
        return LineIndex(refs, staged(filters, "line-filters"), self.shards, self.threshold, self.min_chars)

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Count the lines of further documents. Null text is one empty line, a line counts once a document however often it
        stands there, rows that repeat are documents of their own; an empty table changes nothing, other columns are not read."""
        return self._changed(docs, 1, text_col)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Take out documents that were inserted before; nulls, repeats and empty tables are as in ``insert``."""
        return self._changed(docs, -1, text_col)

    def over(self) -> DataFrame:
        return self.refs.where(F.col("docs") >= self.threshold).select("key")

    def maybe_over(self, found: DataFrame) -> DataFrame:
        """Of (name, key) the rows whose key is in its shard's filter: all that are over, few others.

        A shard's rows are cut into slices, each with a copy of the filter, so that there are
        about as many pieces as shuffle partitions, and rows of one key or one text are spread
        over all slices of their shard.
        """
        slices = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")) // self.shards)
        place = F.pmod(F.xxhash64("name", "key", F.spark_partition_id()), F.lit(slices)).cast("int")
        dealt = found.select(_shard_column(self.shards), place.alias("slice"), F.lit(None).cast("binary").alias("filter"), "name", "key")
        none = F.lit(None)
        filters = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "filter", none.cast("binary").alias("name"), none.cast("binary").alias("key"))
        rows = dealt.unionAll(filters).repartition("shard", "slice").sortWithinPartitions("shard", "slice", F.col("filter").isNull())
        return rows.transform(mapped, _passing, "name binary, key binary")

    def over_in(self, found: DataFrame) -> DataFrame:
        """Of (name, key) the rows whose key is over the threshold: those that pass their filter, less its mistakes."""
        passed = staged(self.maybe_over(found), "line-passed")
        # written, so that the planner knows how few they are and needn't deal ``passed`` by key
        mistaken = staged(passed.select("key").distinct().join(self.over(), "key", "left_anti"), "line-mistaken")
        return passed.join(mistaken, "key", "left_anti")

    def strip(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Each row's id, n_lines, n_dropped and kept_text.

        Null and empty texts are one empty line, which stays as it has no characters. Equal
        texts, whatever their number and ids, are looked up once a task. Rows that repeat, share
        an id or have none have a row each; long texts are read whole; other columns,
        whatever their names, are not read; an empty table gives no rows.
        """
        slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        found = self.over_in(slim.select("text").transform(mapped, _keys_of(self.min_chars), "name binary, key binary"))
        found = found.distinct().groupBy("name").agg(F.collect_list("key").alias("keys"))
        named = slim.withColumn("name", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
        return named.join(found, "name", "left").select("id", "text", "keys").transform(mapped, _strip(self.min_chars), f"id long, {_STRIPPED}").withColumnRenamed("id", id_col)


def _drop(raw: bytes, min_chars: int, is_over) -> tuple[int, int, str]:
    lines = raw.split(b"\n")
    kept = [x for x in lines if (key := line_key(x, min_chars)) is None or not is_over(key)]
    return len(lines), len(lines) - len(kept), b"\n".join(kept).decode()


def _keys_of(min_chars: int):
    """The different line keys of each text, under the text's name; copies in a task are passed over."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            names, keys = [], []
            for raw in binary(batch.column(0)):
                name = hashlib.md5(raw or b"").digest()
                if name in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(name)
                own = {line_key(x, min_chars) for x in (raw or b"").split(b"\n")} - {None}
                names += [name] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(keys, pa.binary())], names=["name", "key"])

    return run


def _passing(batches):
    """Rows (shard, slice, filter, name, key), each piece's filter before its keys, to those in the filter."""
    mark, f = None, None
    for batch in batches:
        names, keys = [], []
        for shard, piece, raw, name, key in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if raw is not None:
                mark, f = (shard, piece), CuckooFilter.from_bytes(raw)
            elif mark == (shard, piece) and key in f:
                names.append(name)
                keys.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(keys, pa.binary())], names=["name", "key"])


def _strip(min_chars: int):
    """(id, text, keys over the threshold or null) to what ``strip`` returns."""

    def run(batches):
        for batch in batches:
            rows = [_drop(raw or b"", min_chars, frozenset(keys or ()).__contains__) for raw, keys in zip(binary(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            arrays = [batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_lines", "n_dropped", "kept_text"])

    return run


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document, as ``LineIndex.strip`` says."""
    docs = table(spark, sf_dir, "documents")
    out = LineIndex.build(docs, threshold=10, min_chars=1).strip(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, TRUE AS is_over FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(is_over) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE is_over IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY r, doc_id
"""
