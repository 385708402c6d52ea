"""The pipeline's near-dedup stage against exact Jaccard of five-word shingles."""

from __future__ import annotations

import random
import re

import numpy as np

import corpus_pipeline
from tallyframe.llm import shingle_dedup
from tests.llm.test_operators import near, plain_print, roots

SCHEMA = "doc_id long, text string"


def plain_set(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def expected(rows):
    sets = [plain_set(t) for _, t in rows]
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if similar(sets[a], sets[b])])
    return sorted(min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root))


def test_copies_between_jaccard_and_four_bits(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefghij", k=5)) for _ in range(3000)]
    rows = []
    for k in range(60):
        words = r.choices(vocabulary, k=r.randint(60, 400))
        rows.append((10 * k, " ".join(words)))
        for j in range(1, 4):  # five shingles a changed word: similarities on both sides of 0.8
            changed = list(words)
            for at in r.sample(range(len(words)), max(1, len(words) * j // 100)):
                changed[at] = "other"
            rows.append((10 * k + j, " ".join(changed)))
    want = expected(rows)
    four_bits = roots(len(rows), near([plain_print(t) for _, t in rows]))
    assert len(want) < len(set(four_bits))  # what the stage of 4 words and 4 bits left in
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want


def test_awkward_rows(spark):
    long = " ".join(map(str, range(50)))
    rows = [(5, None), (3, ""), (4, " \n"), (9, "a b"), (8, "A  b"), (7, "a c"), (20, long), (21, long + " x"), (22, "y " + long + " x"), (30, "é" * 9)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'k' AS print", "doc_id + 1 AS id")
    out = shingle_dedup.keep_first(docs)
    assert out.columns == docs.columns and sorted(x.doc_id for x in out.collect()) == expected(rows) == [3, 7, 8, 20, 30]
    assert shingle_dedup.keep_first(docs.limit(0)).count() == 0
    shared = spark.createDataFrame([(1, long), (1, long + " x"), (1, "z"), (None, "q"), (None, "r"), (None, "Q")], SCHEMA)
    assert sorted(str(x.doc_id) for x in shingle_dedup.keep_first(shared).collect()) == ["1", "1", "None", "None"]


def test_buckets_give_the_links_of_all_pairs():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, (6, 2), dtype=np.uint64)
    w = base[r.integers(0, 6, 900)] ^ (np.uint64(1) << r.integers(0, 63, (900, 2)).astype(np.uint64))
    key = np.sort(np.r_[r.integers(0, 40, 600), np.full(300, 41)])  # small buckets and a large one
    nodes = r.permutation(900)
    a, b = shingle_dedup.bucket_edges(key, nodes, w[:, 0], w[:, 1])
    close = np.bitwise_count(w[:, None] ^ w[None]).sum(axis=2) <= shingle_dedup.REACH
    for k in np.unique(key):
        rows = np.flatnonzero(key == k)
        at = {int(nodes[x]): n for n, x in enumerate(rows)}
        got = roots(len(rows), [(at[x], at[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x in at])
        assert got == roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if close[rows[i], rows[j]]])


def test_sets_link_in_chains():
    x = np.arange(100, dtype="<u8")
    assert shingle_dedup.set_components([x, x[20:], x[36:], x[:79], x[:0], x[:0] + 1]) == [0, 0, 0, 3, 4, 5]


def words_frame(spark, wide):
    return spark.createDataFrame([(k, bytearray(w.tobytes())) for k, w in enumerate(wide)], "print long, wide binary").repartition(3)


def test_prints_that_differ_in_a_bit_of_every_block_meet(spark):
    """No block is the same in both prints; half of the pairs differ in some other blocks as they like."""
    r = np.random.default_rng(7)
    lanes = shingle_dedup.LANES
    base = r.integers(0, 1 << 63, (60, lanes), dtype=np.uint64)
    other = base.copy()
    for k in range(60):
        for lane in range(lanes):
            for start in (0, 19, 38):
                bits = r.choice(19, 1 if k < 30 or (lane, start) == (k % lanes, 19) else 3, replace=False)
                other[k, lane] ^= np.bitwise_or.reduce(np.uint64(1) << (bits + start).astype(np.uint64))
    found = shingle_dedup.links(words_frame(spark, [*base, *other])).collect()
    assert sorted((min(e.a, e.b), max(e.a, e.b)) for e in found if e.a != e.b) == [(k, k + 60) for k in range(60)]


def test_each_anchor_pair_sends_one_way():
    r = np.random.default_rng(8)
    x = r.integers(0, 1 << 19, 500, dtype=np.uint64)
    for bit in range(19):
        y = x ^ np.uint64(1 << bit)
        came = [{k: set() for k in range(500)} for _ in "xy"]
        homes = []
        for n, word in enumerate((x, y)):
            near, row, home = shingle_dedup.homes_and_copies(word, 0)
            homes.append(dict(zip(row[home].tolist(), near[home].tolist(), strict=True)))
            for a, k in zip(near.tolist(), row.tolist(), strict=True):
                came[n][k].add(a)
        assert all(homes[0][k] == homes[1][k] or (homes[0][k] in came[1][k]) != (homes[1][k] in came[0][k]) for k in range(500))


def test_tiles_of_crowded_anchors_link_the_same(spark):
    r = np.random.default_rng(9)
    base = r.integers(0, 1 << 63, (4, shingle_dedup.LANES), dtype=np.uint64)
    wide = base[np.arange(240) % 4]
    for _ in range(9):  # bits at random, groups stay apart
        wide[np.arange(240), r.integers(0, shingle_dedup.LANES, 240)] ^= np.uint64(1) << r.integers(0, 57, 240).astype(np.uint64)
    for most in (5, 10_000):
        edges = [(e.a, e.b) for e in shingle_dedup.links(words_frame(spark, wide), most_homes=most).collect()]
        assert roots(240, edges) == [k % 4 for k in range(240)]


def test_copies_look_for_homes_alone():
    r = np.random.default_rng(10)
    for size in (40, 300):  # followed in the larger bucket
        w = r.integers(0, 1 << 63, (size // 8, 2), dtype=np.uint64)[np.arange(size) % (size // 8)]
        for _ in range(20):
            w[np.arange(size), r.integers(0, 2, size)] ^= np.uint64(1) << r.integers(0, 63, size).astype(np.uint64)
        home = np.arange(size) < size // 3
        a, b = shingle_dedup.bucket_edges(np.zeros(size, int), np.arange(size), w[:, 0], w[:, 1], home=home)
        close = np.bitwise_count(w[:, None] ^ w[None]).sum(axis=2) <= shingle_dedup.REACH
        assert roots(size, list(zip(a.tolist(), b.tolist(), strict=True))) == roots(size, [(i, j) for i in range(size) for j in range(i) if close[i, j] and (home[i] or home[j])])
