"""Exact dedup by Patricia-trie owners.

Map side: each task puts its normalised byte strings into a compressed radix trie, so a
text leaves a task once, as a part with the ids of all its copies there, however many these
are. A trie over its byte budget spills its heaviest subtree downstream. Owner side: parts
are dealt by (length, content hash) and sorted by their bytes, so an owner's trie fills from
left to right: over its budget it spills the subtrees that lie before the current key,
as these are complete. Terminal nodes hold the smallest id, the number of copies and the parts
they come from, and an owner tells each of those parts what it found. Texts are
equal if their bytes lead to the same node; hashes only deal them out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, LongType, StructField, StructType

from .common import binary, mapped, squeeze, staged, table

#: Bytes of text that one trie holds before it spills a subtree.
TRIE_BYTES = 32 << 20
#: Ids that a row of parts holds; a part with more has several rows.
PART_IDS = 4096
_EMIT_BYTES, _EMIT_ROWS = 4 << 20, 16_384

_PARTS = "tag long, chunk int, n_bytes long, content_hash long, body binary, keep_id long, copies long, ids array<long>"
_OWNED = "tag long, n_bytes long, text_sha256 string, keep_id long, keep_tag long, group_size long"


def least(a: int | None, b: int | None) -> int | None:
    """The smaller id; null counts as larger than any."""
    return b if a is None else a if b is None else min(a, b)


def _shared(label: bytes, key: bytes, at: int) -> int:
    """How many leading bytes of ``label`` stand in ``key`` from ``at`` on."""
    if key.startswith(label, at):
        return len(label)
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings. A node is [label, children by first byte, what
    the terminal node holds or None]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.bytes = 0
        self.weight: dict[int | None, int] = {}  # bytes below each child of the root

    def terminal(self, key: bytes) -> list:
        """The node of ``key``, made if it isn't there."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None]
                node[1][key[at]] = child
                self.grow(key, len(key) - at + 200)  # with a node's own objects
                return child
            n = _shared(child[0], key, at)
            if n < len(child[0]):
                upper = [child[0][:n], {child[0][n]: child}, None]
                child[0] = child[0][n:]
                node[1][key[at]] = child = upper
            node, at = child, at + n
        return node

    def grow(self, key: bytes, n: int) -> None:
        first = key[0] if key else None
        self.bytes += n
        self.weight[first] = self.weight.get(first, 0) + n

    def _below(self, node: list, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            whole = prefix + node[0]
            if node[2] is not None:
                yield whole, node[2]
            stack += [(x, whole) for x in node[1].values()]

    def terminals(self) -> Iterator[tuple[bytes, list]]:
        yield from self._below(self.root, b"")

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Take out the heaviest subtree below the root, or the empty string, and yield what it holds."""
        if self.weight:
            first = max(self.weight, key=self.weight.get)
            self.bytes -= self.weight.pop(first)
            if first is None:
                held, self.root[2] = self.root[2], None
                yield b"", held
            else:
                yield from self._below(self.root[1].pop(first), b"")

    def spill_before(self, key: bytes) -> Iterator[tuple[bytes, list]]:
        """For keys that arrive in order: yield and drop all that isn't ``key`` itself."""
        mine = None
        for found in self.terminals():
            if found[0] == key:
                mine = found[1]
            else:
                yield found
        self.__init__()
        if mine is not None:
            self.terminal(key)[2] = mine


def _batch(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def combine(trie_bytes: int, part_ids: int):
    """Map side: a task's texts through one trie, to parts. The smallest id of a part comes first."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches):
        task, made, trie = TaskContext.get().partitionId(), 0, PatriciaTrie()

        def parts(found):
            nonlocal made
            rows, size = [], 0
            for body, ids in found:
                tag, made = task << 33 | made, made + 1
                first = min(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
                ids[0], ids[first] = ids[first], ids[0]
                rows.append((tag, 0, len(body), xxhash.xxh64_intdigest(body) - (1 << 63), body, ids[0], len(ids), ids[:part_ids]))
                rows += [(tag, k // part_ids, None, None, None, None, None, ids[k : k + part_ids]) for k in range(part_ids, len(ids), part_ids)]
                size += len(body) + 8 * len(ids)
                if size > _EMIT_BYTES or len(rows) > _EMIT_ROWS:
                    yield _batch(rows, kinds, _PARTS)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, kinds, _PARTS)

        for batch in batches:
            for ident, raw in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                body = squeeze(raw or b"")
                node = trie.terminal(body)
                if node[2] is None:
                    node[2] = []
                node[2].append(ident)
                trie.grow(body, 40)
                while trie.bytes > trie_bytes:
                    yield from parts(trie.spill())
        yield from parts(trie.terminals())

    return run


def own(trie_bytes: int):
    """Owner side: parts sorted by their bytes, through one trie, to a row for each part."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        trie, rows = PatriciaTrie(), []

        def told(found):
            for body, (ident, first, copies, tags) in found:
                digest = hashlib.sha256(body).hexdigest()
                rows.extend((tag, len(body), digest, ident, first, copies) for tag in tags)

        for batch in batches:
            for tag, body, ident, copies in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                node = trie.terminal(body)
                if node[2] is None:
                    node[2] = [ident, tag, 0, []]
                held = node[2]
                if (ident is None, ident or 0, tag) < (held[0] is None, held[0] or 0, held[1]):
                    held[:2] = ident, tag
                held[2] += copies
                held[3].append(tag)
                trie.grow(body, 40)
                if trie.bytes > trie_bytes:
                    told(trie.spill_before(body))
                    for k in range(0, len(rows), _EMIT_ROWS):
                        yield _batch(rows[k : k + _EMIT_ROWS], kinds, _OWNED)
                    rows.clear()
        told(trie.terminals())
        for k in range(0, len(rows), _EMIT_ROWS):
            yield _batch(rows[k : k + _EMIT_ROWS], kinds, _OWNED)

    return run


def parts_and_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The parts as written (tag, chunk, ids), and for each tag n_bytes, text_sha256, keep_id, keep_tag (the
    part whose first id is kept) and group_size."""
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    parts = staged(slim.transform(mapped, combine(trie_bytes, PART_IDS), _PARTS), "parts")
    dealt = parts.where("chunk = 0").repartition("n_bytes", "content_hash").sortWithinPartitions("body")
    return parts.select("tag", "chunk", "ids"), dealt.select("tag", "body", "keep_id", "copies").transform(mapped, own(trie_bytes), _OWNED)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per different text: n_bytes, text_sha256, keep_id, group_size."""
    return parts_and_owners(docs, id_col, text_col, trie_bytes)[1].where("tag = keep_tag").select("n_bytes", "text_sha256", "keep_id", "group_size")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its group: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; long texts are compared whole. Null ids count as larger than
    any: keep_id is null only when all ids of a group are. Rows that repeat both id and text
    are copies like any other, so one of them is kept. An empty table gives no rows; further
    columns, whatever their names, are not read.
    """
    return _assigned(*parts_and_owners(docs, id_col, text_col), id_col)


def _assigned(parts: DataFrame, owned: DataFrame, id_col: str) -> DataFrame:
    each = parts.join(owned, "tag").select("*", F.posexplode("ids").alias("_at", "_id"))
    kept = (F.col("tag") == F.col("keep_tag")) & (F.col("chunk") == 0) & (F.col("_at") == 0)
    return each.select(F.col("_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _key(ident, tie) -> tuple:
    """Rows in the order in which they stay: null ids last, then a hash of the row."""
    return ident is None, ident or 0, tie


def firsts(text_at: int, trie_bytes: int):
    """Map side of ``dedupe``: of a task's rows (their columns, id, tie) with equal texts the first. A trie's worth of
    rows is held at a time and then handed on subtree by subtree; what had copies is remembered
    after that, within the same bound, so that a text with very many leaves a task about once."""

    def run(batches):
        held, size, trie, told, told_bytes = [], 0, PatriciaTrie(), {}, 0

        def flush():
            nonlocal told, told_bytes
            table = pa.Table.from_batches(held)
            while trie.weight:
                rows = []
                for body, (key, row, copies) in trie.spill():
                    rows.append((row, len(body), xxhash.xxh64_intdigest(body) - (1 << 63)))
                    if copies > 1 or body in told:
                        told_bytes += 0 if body in told else len(body) + 200
                        told[body] = key
                if rows:
                    out = table.take(pa.array([r[0] for r in rows], pa.int64()))
                    for k, name in ((1, "n_bytes"), (2, "content_hash")):
                        out = out.append_column(name, pa.array([r[k] for r in rows], pa.int64()))
                    yield from out.combine_chunks().to_batches()
            if told_bytes > trie_bytes:
                told, told_bytes = {}, 0

        at = 0
        for batch in batches:
            n = len(batch.schema)
            columns = binary(batch.column(text_at)), batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()
            for k, (raw, ident, tie) in enumerate(zip(*columns, strict=True)):
                body, key = squeeze(raw or b""), _key(ident, tie)
                if told and body in told and told[body] <= key:
                    continue
                node = trie.terminal(body)
                if node[2] is None:
                    node[2] = [key, at + k, 1]
                    trie.grow(body, 40)
                else:
                    node[2][2] += 1
                    if key < node[2][0]:
                        node[2][:2] = key, at + k
            held.append(batch)
            at, size = at + batch.num_rows, size + batch.nbytes
            if size > trie_bytes:
                yield from flush()
                held, at, size = [], 0, 0
        if held:
            yield from flush()

    return run


def stay(text_at: int, trie_bytes: int):
    """Owner side of ``dedupe``: rows sorted by (length, content hash) and then in the order in which they stay,
    through one trie: a row whose text isn't in it stays. Tries are let go between texts of
    different hashes once they are full, as none of what they hold comes again."""

    def run(batches):
        trie, mark = PatriciaTrie(), None
        for batch in batches:
            names = batch.schema.names
            dealt = zip(batch.column(len(names) - 2).to_pylist(), batch.column(len(names) - 1).to_pylist(), strict=True)
            keep = []
            for place, raw in zip(dealt, binary(batch.column(text_at)), strict=True):
                if place != mark and trie.bytes > trie_bytes:
                    trie = PatriciaTrie()
                mark = place
                node = trie.terminal(squeeze(raw or b""))
                keep.append(node[2] is None)
                node[2] = True
            yield batch.filter(pa.array(keep, pa.bool_())).select(names[:-4])

    return run


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int | None = None) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the smallest id.

    Nulls, repeats and empty tables are as in ``assign``; of rows that repeat id and text the one
    with the lowest hash stays. Other columns may have any names. Rows are shuffled once, whole, after each task has
    dropped the copies that it has seen; nothing is joined, and no table is written in between.
    """
    names, limit = docs.columns, trie_bytes or TRIE_BYTES
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # names may hold dots
    schema, text_at = plain.schema, names.index(text_col)
    tie = F.xxhash64(*[F.col(f.name) if isinstance(f.dataType, AtomicType) else F.to_json(F.struct(f.name)) for f in schema])
    rows = plain.select("*", plain[f"c{names.index(id_col)}"].cast("long").alias("_id"), tie.alias("_tie"))
    dealt = StructType([*rows.schema.fields, StructField("n_bytes", LongType()), StructField("content_hash", LongType())])
    own = rows.transform(mapped, firsts(text_at, limit), dealt).repartition("n_bytes", "content_hash")
    own = own.sortWithinPartitions("n_bytes", "content_hash", F.col("_id").asc_nulls_last(), "_tie")
    return own.transform(mapped, stay(text_at, limit), schema).toDF(*names)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group. Null and empty texts are one group, null ids come last, rows that repeat are copies,
    long texts are compared whole, an empty table gives no rows, other columns are not read: see ``assign``."""
    return assign(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
