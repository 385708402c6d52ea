"""SimHash near-dedup by anchor-point covering.

The 64 bits of a fingerprint are seen as three blocks of 21, 21 and 22 bits. Fingerprints
that differ in 4 bits at most differ in one bit at most in at least one block. A block's
first 15 bits are covered by the codewords of the Hamming code, which lie within one bit of
any word, and the rest by all words, so a block's anchors are a covering code of radius 1.
Each fingerprint has one home anchor in a block and is copied to all anchors within the
covering radius plus the threshold that holds in a block, 1 + 1; of these the ones that a
home one bit away can have are enough. At each anchor its homes are compared with all that
were copied there, and what is found leaves as the edges of a spanning forest. The homes of
a crowded anchor are dealt to tiles, each of which gets all that was copied there.
Different fingerprints are compared once, however many documents have them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, binary, mapped, staged, table
from .components import components

BITS = 64
BLOCKS = ((0, 21), (21, 21), (42, 22))  # first bit and width
_CODED = 15
_TILE = 2048
#: Homes of an anchor that one task compares; an anchor with more is cut into tiles.
MOST_HOMES = 16_384

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(raw: bytes, words: int = 4, seed: int = 42) -> int:
    """A bit is set if more than half of the shingles' hashes have it. No words: zero."""
    found = raw.translate(_LOWER).split()  # of bytes: at the six white-space bytes only
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    each = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(each), 4096):
        counts += np.unpackbits(each[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(each), bitorder="little").view("<u8")[0])


def _fingerprints(words: int, seed: int):
    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(x or b"", words, seed) for x in binary(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["id", "print"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(id, print) for each row; null text counts as empty."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.transform(mapped, _fingerprints(words, seed), "id long, print long")


def _hamming_home(words: np.ndarray) -> np.ndarray:
    """The codeword within one bit of each 15-bit word: the syndrome is the place to flip."""
    syndrome = np.zeros_like(words)
    for k in range(_CODED):
        syndrome ^= np.where(words >> np.uint64(k) & np.uint64(1), np.uint64(k + 1), np.uint64(0))
    flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    return words ^ flip


def anchors(prints: np.ndarray, start: int, width: int, spare: int = 1) -> list[np.ndarray]:
    """Home anchors of all words within ``spare`` bits in a block; the first is the own home.

    These are all anchors at which a home can lie that differs from the word in ``spare`` bits
    at most: each is within the covering radius 1 of such a word, so within 1 + spare of this one.
    """
    block = prints >> np.uint64(start) & np.uint64((1 << width) - 1)
    low = np.uint64((1 << _CODED) - 1)
    out = []
    for n in range(spare + 1):
        for bits in combinations(range(width), n):
            word = block ^ np.uint64(sum(1 << b for b in bits))
            out.append(_hamming_home(word & low) | word & ~low)
    return out


def _replicate(threshold: int):
    """Prints to (anchor, print, home): once as home and once for each other anchor in reach, for each block."""
    spare = threshold // len(BLOCKS)

    def run(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (start, width) in enumerate(BLOCKS):
                found = anchors(prints, start, width, spare)
                key = np.stack(found) << np.uint64(2) | np.uint64(k)
                ordered = np.sort(key, axis=0)
                fresh = np.vstack([np.ones((1, len(prints)), bool), ordered[1:] != ordered[:-1]])
                at, who = np.nonzero(fresh)
                near = ordered[at, who]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.view(np.int64)), pa.array(prints[who].view(np.int64)), pa.array(near == key[0][who])], names=["anchor", "print", "home"]
                )

    return run


def _homes(batches):
    """The home anchors of prints."""
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k, (start, width) in enumerate(BLOCKS):
            yield pa.RecordBatch.from_arrays([pa.array((anchors(prints, start, width, 0)[0] << np.uint64(2) | np.uint64(k)).view(np.int64))], names=["anchor"])


def spanning_edges(homes: np.ndarray, others: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ``homes`` and ``others`` (which has the homes too)."""
    nodes = np.unique(others)
    label = np.arange(len(nodes))  # of each node the smallest node that it is known to reach
    left, right = [], []
    for i in range(0, len(homes), _TILE):
        for j in range(0, len(nodes), _TILE):
            near = np.bitwise_count(homes[i : i + _TILE, None] ^ nodes[None, j : j + _TILE]) <= threshold
            for row in np.flatnonzero(near.any(axis=1)).tolist():
                me = int(np.searchsorted(nodes, homes[i + row]))
                with_ = np.flatnonzero(near[row]) + j
                roots, first = np.unique(label[with_], return_index=True)
                apart = roots != label[me]
                if apart.any():
                    left += [me] * int(apart.sum())
                    right += with_[first[apart]].tolist()
                    merged = np.append(roots, label[me])
                    label[np.isin(label, merged)] = merged.min()
    return nodes[left], nodes[right]


def _compare(threshold: int):
    """Rows (anchor, tile, print, home) sorted by anchor and tile to edges between prints."""

    def run(batches):
        def edges():
            prints, home = (held[0], flags[0]) if len(held) == 1 else (np.concatenate(held), np.concatenate(flags))
            if len(prints) > 1 and home.any():
                a, b = spanning_edges(prints[home], prints, threshold)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        mark, held, flags = None, [], []
        for batch in batches:
            key, tile, prints, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1).tolist(), len(key)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if (key[low], tile[low]) != mark:
                    if held:
                        yield from edges()
                    mark, held, flags = (key[low], tile[low]), [], []
                held.append(prints[low:high].view(np.uint64))
                flags.append(home[low:high].astype(bool))
        if held:
            yield from edges()

    return run


def links(prints: DataFrame, threshold: int = 4, most_homes: int | None = None) -> DataFrame:
    """Edges (a, b) of a spanning forest for each anchor's tile, from the different fingerprints (print)."""
    copies = prints.transform(mapped, _replicate(threshold), "anchor long, print long, home boolean")
    most = most_homes or MOST_HOMES
    counts = prints.transform(mapped, _homes, "anchor long").groupBy(F.col("anchor").alias("_crowded")).agg(F.count("*").alias("_n"))
    crowded = staged(counts.where(F.col("_n") > most).select("_crowded", F.ceil(F.col("_n") / most).cast("int").alias("_tiles")), "crowded")
    placed = copies.join(crowded, F.col("anchor") == F.col("_crowded"), "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    dealt = placed.select("anchor", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("tile"), "print", "home", F.pmod(F.xxhash64("print"), F.col("_tiles")).alias("_own"))
    dealt = dealt.select("anchor", "tile", "print", (F.col("home") & (F.col("tile") == F.col("_own"))).alias("home"))
    return dealt.repartition("anchor", "tile").sortWithinPartitions("anchor", "tile").transform(mapped, _compare(threshold), "a long, b long")


def groups(prints: DataFrame, threshold: int = 4) -> DataFrame:
    """(print, component_id) for each different fingerprint of (id, print): the smallest id in reach.

    Null ids count as larger than any; a component of null ids alone has a null id.
    """
    return least_ids(rooted_prints(prints, threshold))


def rooted_prints(prints: DataFrame, threshold: int = 4) -> DataFrame:
    """(print, first, root): each fingerprint's smallest id and the smallest fingerprint of its component."""
    nodes = staged(prints.groupBy("print").agg(F.min("id").alias("first")), "prints")
    joined = components(links(nodes.select("print"), threshold))
    rooted = nodes.join(joined, nodes["print"] == joined["node"], "left").select("print", "first", F.coalesce("component", "print").alias("root"))
    return staged(rooted, "rooted")


def least_ids(rooted: DataFrame) -> DataFrame:
    least = staged(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    return rooted.join(least, "root").select("print", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, threshold: int = 4, seed: int = 42) -> DataFrame:
    """Each row's id, fingerprint (16 hex digits) and component_id.

    Texts that are null, empty or of white space alone have fingerprint zero and are linked
    like any other; texts of any length are fingerprinted whole. Rows that repeat, or share an id,
    have a row each; a bit that half of the shingles have, no more, is 0. An empty table gives
    no rows; other columns, whatever their names, are not read.
    """
    prints = staged(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    found = prints.join(groups(prints, threshold), "print")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, threshold: int = 4, seed: int = 42) -> DataFrame:
    """One row of each component with all its columns: that of the smallest id.

    Rows that share this id are told apart by their fingerprints and then by their texts.
    """
    prints = staged(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    return kept_rows(docs, id_col, text_col, prints, rooted_prints(prints, threshold), _fingerprints(words, seed))


def kept_rows(docs: DataFrame, id_col: str, text_col: str, prints: DataFrame, rooted: DataFrame, printer) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each root; ``printer`` makes (key, text) to (key, print).
    Columns of ``docs`` may have any names."""
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    found = staged(prints.join(least_ids(rooted), "print"), "components")
    first = staged(found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("id").agg(F.count("*").alias("n")), "kept")
    single = first.where("n = 1 AND id IS NOT NULL").select(F.col("id").alias("_kept_id"))
    plain = whole.join(single, F.col("_id") == F.col("_kept_id"), "left_semi").select("_row.*")
    shared = first.where("n > 1 OR id IS NULL").select("id")
    if shared.isEmpty():
        return plain
    # several rows with a kept id: fingerprint them anew, beside their other columns
    rows = whole.join(shared, F.col("_id").eqNullSafe(F.col("id")), "left_semi")
    rows = rows.withColumn("_json", F.to_json("_row")).withColumn("_key", F.sha2(F.concat_ws("|", F.coalesce(F.col("_text"), F.lit("")), "_json"), 256))
    rows = staged(rows, "shared-ids")
    keyed = rows.select("_key", "_text").distinct().transform(mapped, printer, "_key string, print long")
    where = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select("print", "component_id", "id").distinct()
    best = rows.join(keyed, "_key").join(where, (rows["_id"].eqNullSafe(where["id"])) & (keyed["print"] == where["print"]))
    roots = best.select("_row", "_key", "component_id", keyed["print"])
    if not shared.where("id IS NULL").isEmpty():
        # components without any id: one row of each root
        roots = roots.join(rooted.select("print", "root"), "print")
    else:
        roots = roots.withColumn("root", F.lit(None).cast("long"))
    one = roots.groupBy("component_id", "root").agg(F.min_by("_row", "_key").alias("_row"))
    return plain.unionAll(one.select("_row.*"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Texts without words have fingerprint zero and are linked like any other,
    null ids come last, rows that repeat have a row each, an empty table gives no rows: see ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
