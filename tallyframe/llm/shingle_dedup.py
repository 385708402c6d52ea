"""Near-dedup at a Jaccard similarity of word shingles: SimHash by anchor-point covering, then exact sets.

At similarity 0.8 two sets of shingles lie 27 degrees apart, so a bit of SimHash differs with
probability 0.15: some 10 bits of 64 and up to 18, a radius at which no blocks of 64 bits
tell documents apart. The fingerprint here has 320 bits, and 15 blocks of 19 of them. A block's
anchors are those of ``simhash``: its first 15 bits are covered by the codewords of the
Hamming code, the rest by all words. Each fingerprint has one home anchor in a block and is
copied to anchors at which homes one bit away can lie: of two such anchors one sends its
fingerprints to the other, so that a pair meets once. All that differ in one bit of a
block meet there, and some that differ in more; a pair at similarity 0.8 meets in a block with
probability 0.265, in one of them with 1 - (1 - 0.265) ** 15, about 0.99, and closer pairs more
surely. At each anchor its homes are compared with all that came there; the homes of a crowded
anchor are dealt to tiles. Those that differ in ``REACH`` of the first 128 bits at most are
candidates; inside each connected group of candidates the sets themselves are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, binary, mapped, staged
from .components import FOREST_EDGES, components, forest
from .simhash import MOST_HOMES, anchors, kept_rows

WORDS = 5
SIMILARITY = 0.8
LANES = 5  # 64 bits each
STARTS, BLOCK = (0, 19, 38), 19  # blocks of a lane: first bits, width
SPARE = 1  # bits of a block in which those that meet for certain may differ
REACH = 34  # of 128 bits: at similarity 0.8 the mean is 19.5, the standard deviation 4.1
_SMALL = 128  # in larger buckets links are followed instead of listed

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_STEPS = np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_LOWER).split()  # of bytes: at the six white-space bytes only


def node_of(found: list[bytes]) -> int:
    """Texts of the same words are one node."""
    return xxhash.xxh64_intdigest(b" ".join(found), 7)


def shingles(found: list[bytes], words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles. A shorter text is one shingle; no words, none."""
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)] if found else [], "<u8")
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], "<u8"))


def wide_print(each: np.ndarray) -> np.ndarray:
    """``LANES`` words; a bit is set if more than half of the shingles' hashes have it."""
    counts = np.zeros(LANES * 64, np.int64)
    for k in range(0, len(each), 255):  # counts of a part fit a byte
        x = each[k : k + 255, None] + _STEPS
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(each), bitorder="little").view("<u8")


def _nodes(batches):
    """(key, text) to (key, print): the node alone."""
    for batch in batches:
        found = np.array([node_of(words_of(x or b"")) for x in binary(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["_key", "print"])


def _prints(words: int):
    def run(batches):
        for batch in batches:
            nodes, wide = [], []
            for raw in binary(batch.column(1)):
                found = words_of(raw or b"")
                nodes.append(node_of(found))
                wide.append(wide_print(shingles(found, words)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(wide, pa.binary())], names=["id", "print", "wide"])

    return run


def _sends(home: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the fingerprints of anchor ``home`` are copied to ``other``: of two anchors one sends to the other."""
    return (other > home) ^ (np.bitwise_count(other + home) & 1 == 1)


def homes_and_copies(lane: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, whether it is the row's home) in one block of a lane's words."""
    found = np.stack(anchors(lane, start, BLOCK, SPARE))
    home, ordered = found[0], np.sort(found, axis=0)
    goes = (ordered == home) | _sends(home, ordered)
    goes[1:] &= ordered[1:] != ordered[:-1]
    at, row = np.nonzero(goes)
    near = ordered[at, row]
    return near, row, near == home[row]


def _blocks(batches):
    """(nodes, lanes, number of the block, the block's words, its first bit) of rows (print, wide)."""
    for batch in batches:
        wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, LANES)
        node = batch.column(0).to_numpy(zero_copy_only=False)
        for n in range(LANES * len(STARTS)):
            lane, k = divmod(n, len(STARTS))
            yield node, wide, n, np.ascontiguousarray(wide[:, lane]), STARTS[k]


def _keys(near: np.ndarray, block: int) -> np.ndarray:
    return (near * np.uint64(LANES * len(STARTS)) + np.uint64(block)).view(np.int64)


def _deal(batches):
    """Each print to its home anchor and to those that it is copied to, for each block, with its node and its first 128 bits."""
    for node, wide, n, lane, start in _blocks(batches):
        near, row, home = homes_and_copies(lane, start)
        out = [_keys(near, n), node[row], wide[row, 0].view(np.int64), wide[row, 1].view(np.int64), home]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["anchor", "print", "w0", "w1", "home"])


def _homes(batches):
    """The home anchors of prints."""
    for _, _, n, lane, start in _blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(_keys(anchors(lane, start, BLOCK, 0)[0], n))], names=["anchor"])


def _followed(nodes, w0, w1, home, reach: int):
    """A forest of stars that connects what is linked in one bucket: each home reached looks only for
    those not yet reached, each copy for homes alone, and all of a tree hang on its smallest node, so that
    the buckets of a large group give much the same edges."""
    nodes, first = np.unique(nodes, return_index=True)
    w0, w1, home = w0[first], w1[first], home[first]
    rest, copies = np.flatnonzero(home), np.flatnonzero(~home)
    left, right = [], []

    def near(me: int, of):
        return np.bitwise_count(w0[of] ^ w0[me]) + np.bitwise_count(w1[of] ^ w1[me]) <= reach

    while len(rest):
        tree, rest = [int(rest[0])], rest[1:]
        front = list(tree)
        while front:
            me = front.pop()
            found = near(me, rest)
            fresh, rest = rest[found].tolist(), rest[~found]
            if home[me]:
                found = near(me, copies)
                fresh += copies[found].tolist()
                copies = copies[~found]
            tree += fresh
            front += fresh
        root = min(tree)
        left += [root] * (len(tree) - 1)
        right += [k for k in tree if k != root]
    return nodes[left], nodes[right]


def bucket_edges(key, nodes, w0, w1, reach: int = REACH, home=None):
    """Candidate links (a, b) between homes and others among rows that are sorted by ``key``, homes first (None: all are)."""
    home = np.ones(len(key), bool) if home is None else home
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    large = sizes > _SMALL
    out = [_followed(*(x[s : s + n] for x in (nodes, w0, w1, home)), reach) for s, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True)]
    last = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(np.repeat(~large, sizes) & home)
    for d in range(1, _SMALL):
        at = at[at + d < last[at]]
        if not len(at):
            break
        near = np.bitwise_count(w0[at] ^ w0[at + d]) + np.bitwise_count(w1[at] ^ w1[at + d]) <= reach
        out.append((nodes[at[near]], nodes[at[near] + d]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (nodes[:0], nodes[:0])


def _meet(batches):
    """Rows sorted by anchor and tile, homes first, to a forest of the task's candidate links: nodes that
    meet at many anchors leave it with few links all the same."""
    found: list = []

    def meet(rows) -> None:
        if len(rows[0]) > 1:
            found.append(forest(*bucket_edges(rows[0], rows[1], rows[2].view(np.uint64), rows[3].view(np.uint64), home=rows[4])))

    def links():
        a, b = forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held: list = []
    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last bucket may go on
        if cut == 0 and held and held[-1][0][-1] == rows[0][0]:
            held.append(rows)
            continue
        meet([np.concatenate(x) for x in zip(*held, [x[:cut] for x in rows], strict=True)])
        held = [[x[cut:] for x in rows]]
        if sum(len(a) for a, _ in found) > FOREST_EDGES:
            yield links()
            found.clear()
    if held:
        meet([np.concatenate(x) for x in zip(*held, strict=True)])
    if found:
        yield links()


def _sets(words: int):
    def run(batches):
        for batch in batches:
            nodes, sets = [], []
            for raw in binary(batch.column(0)):
                found = words_of(raw or b"")
                nodes.append(node_of(found))
                sets.append(shingles(found, words).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sets, pa.binary())], names=["print", "shingles"])

    return run


def set_components(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[int]:
    """For each set the first one that a chain of pairs at ``similarity`` or more leads to."""
    label, sizes = [-1] * len(sets), np.array([len(x) for x in sets])
    rest = np.arange(len(sets))
    while len(rest):
        root, front, rest = int(rest[0]), [int(rest[0])], rest[1:]
        label[root] = root
        while front and len(rest):
            mine = sets[front.pop()]
            fits = np.minimum(sizes[rest], len(mine)) >= similarity * np.maximum(sizes[rest], len(mine))
            near = np.zeros(len(rest), bool)
            tried = np.flatnonzero(fits)
            if len(tried) and len(mine):
                each = np.concatenate([sets[k] for k in rest[tried]])
                spot = np.minimum(np.searchsorted(mine, each), len(mine) - 1)
                shared = np.add.reduceat(mine[spot] == each, np.r_[0, np.cumsum(sizes[rest[tried]])[:-1]], dtype=np.int64)
                near[tried] = shared >= similarity * (sizes[rest[tried]] + len(mine) - shared)
            for k in rest[near].tolist():
                label[k] = root
                front.append(k)
            rest = rest[~near]
    return label


def _verify(similarity: float):
    """Rows (group, print, shingles) sorted by group to (print, root)."""

    def run(batches):
        def out():
            label = set_components([np.frombuffer(x, "<u8") for x in sets], similarity)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([nodes[k] for k in label], pa.int64())], names=["print", "root"])

        mark, nodes, sets = None, [], []
        for batch in batches:
            for group, node, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if group != mark:
                    if nodes:
                        yield out()
                    mark, nodes, sets = group, [], []
                nodes.append(node)
                sets.append(raw)
        if nodes:
            yield out()

    return run


def links(prints: DataFrame, most_homes: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the candidates among the different fingerprints (print, wide)."""
    most = most_homes or MOST_HOMES
    copies = prints.transform(mapped, _deal, "anchor long, print long, w0 long, w1 long, home boolean")
    counts = prints.transform(mapped, _homes, "anchor long").groupBy(F.col("anchor").alias("_crowded")).agg(F.count("*").alias("_n"))
    crowded = staged(counts.where(F.col("_n") > most).select("_crowded", F.ceil(F.col("_n") / most).alias("_tiles")), "crowded")
    placed = copies.join(crowded, F.col("anchor") == F.col("_crowded"), "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("print"), F.col("_tiles")).alias("_own")
    dealt = placed.select("anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)).alias("_tile"), "print", "w0", "w1", "home", own)
    spot = F.shiftleft("anchor", 32).bitwiseOR(F.col("_tile")).alias("spot")
    dealt = dealt.select(spot, "print", "w0", "w1", (F.col("home") & (F.col("_tile") == F.col("_own"))).alias("home"))
    return dealt.repartition("spot").sortWithinPartitions("spot", F.desc("home")).transform(mapped, _meet, "a long, b long")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group with all its columns: that of the smallest id.

    Documents are linked if the Jaccard similarity of their sets of word shingles is
    ``similarity`` or more; texts without words, null and empty ones among them, are equal.
    Texts of any length are compared whole. Null ids count as larger than any. Rows that share
    the id are told apart by their words and then by their texts. An empty table gives no
    rows; other columns may have any names.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = staged(slim.transform(mapped, _prints(words), "id long, print long, wide binary"), "wide-prints")
    nodes = staged(prints.select("print", "wide").distinct(), "nodes")
    groups = staged(components(links(nodes)).select(F.col("node").alias("print"), F.col("component").alias("group")), "candidates")
    wanted = prints.join(groups, "print", "left_semi").select(F.col("id").alias("_wanted")).distinct()
    texts = slim.join(wanted, F.col("id").eqNullSafe(F.col("_wanted")), "left_semi").select("text")
    sets = texts.transform(mapped, _sets(words), "print long, shingles binary").join(groups, "print")
    sets = sets.dropDuplicates(["print"]).select("group", "print", "shingles")
    linked = sets.repartition("group").sortWithinPartitions("group", "print").transform(mapped, _verify(similarity), "print long, root long")
    linked = staged(linked, "linked")
    rooted = prints.groupBy("print").agg(F.min("id").alias("first")).join(linked, "print", "left")
    rooted = staged(rooted.select("print", "first", F.coalesce("root", "print").alias("root")), "rooted")
    return kept_rows(docs, id_col, text_col, prints.select("id", "print"), rooted, _nodes)
