"""Each operator against a brute-force version, on made-up rows with the awkward cases:
nulls, empty and long texts, ties, repeated rows, empty tables, columns with clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import cuckoo, embedding_dedup, exact_dedup, html_text, line_dedup, mixing, piece_codec, simhash, simple8b, subsequence, token_files, toxicity

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def roots(n: int, links) -> list[int]:
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def awkward() -> list[tuple]:
    r = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(40)]
    texts += [texts[0], texts[0] + " ", texts[0].replace(" ", "\t", 1), "  ", " ", "", None, "a", "É é  x", "shared line\nother\nShared Line \n\nend", "x" * 5000]
    texts += [f"shared line\n{r.choice(words)} {k}" for k in range(12)] + [" ".join(words * 3000)]
    rows = [(k, t, "en", f"s{k % 5}" if k % 9 else None, None) for k, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[1], "en", "s1", 3), (None, "only here without an id at all", None, None, None), (7, texts[9], "en", "s2", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS)


@pytest.fixture(scope="module")
def odd(docs):
    """Extra columns whose names an operator might use itself."""
    return docs.selectExpr("*", *(f"'x' AS `{c}`" for c in ("id", "_id", "_row", "size", "key", "keep_id", "component_id", "_sha", "a.b", "print", "text_md5", "_kept_id", "_kept", "_text", "_n", "tag")))


def empty(spark):
    return spark.createDataFrame([], DOCS)


# exact dedup


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_trie_spills_by_subtree():
    trie, r = exact_dedup.PatriciaTrie(), random.Random(1)
    keys = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(500)]
    found: dict[bytes, list] = {}
    for k, key in enumerate(keys):
        node = trie.terminal(key)
        node[2] = [*(node[2] or []), k]
        trie.grow(key, 40)
        if k % 50 == 49:
            spilled = list(trie.spill())
            assert len({x[:1] for x, _ in spilled}) == 1  # one subtree below the root
            for x, ids in spilled:
                found.setdefault(x, []).extend(ids)
    for x, ids in trie.terminals():
        found.setdefault(x, []).extend(ids)
    assert {x: sorted(ids) for x, ids in found.items()} == {x: [k for k, y in enumerate(keys) if y == x] for x in set(keys)}
    # nodes share what keys have in common
    trie = exact_dedup.PatriciaTrie()
    for key in (b"prefix-one", b"prefix-two", b"prefix"):
        trie.terminal(key)[2] = [0]
    assert list(trie.root[1]) == [ord("p")] and trie.root[1][ord("p")][0] == b"prefix" and {x for x, _ in trie.spill_before(b"prefix")} == {b"prefix-one", b"prefix-two"}
    assert [x for x, _ in trie.terminals()] == [b"prefix"]


@pytest.mark.parametrize("limit", [1, 400, 1 << 20])
def test_owners_decide_by_bytes(limit):
    """An owner sees no hash: parts that it is dealt are of one group if their bytes are the same."""
    bodies = sorted([b"", b"a", b"ab", b"ab", b"abc", b"b", b"b", b"b"])
    columns = [range(8), bodies, [5, 3, None, 9, 1, None, 4, 4], [1] * 8]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["tag", "body", "keep_id", "copies"])
    got = sorted(tuple(r.values()) for b in exact_dedup.own(limit)(iter([batch.slice(0, 5), batch.slice(5)])) for r in b.to_pylist())
    want = [(5, 0, 1), (3, 1, 1), (9, 3, 2), (9, 3, 2), (1, 4, 1), (4, 6, 3), (4, 6, 3), (4, 6, 3)]
    assert got == [(k, len(x), hashlib.sha256(x).hexdigest(), *w) for k, (x, w) in enumerate(zip(bodies, want, strict=True))]


def test_parts_with_many_ids(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PART_IDS", 3)
    rows = [(k if k % 5 else None, "same  text" if k % 2 else "same\ttext") for k in range(40, 0, -1)] + [(1, "same text")]
    got = exact_dedup.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 41 and {(r.keep_id, r.group_size) for r in got} == {(1, 41)} and [r.doc_id for r in got if r.kept] == [1]
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (i for i, _ in rows)))


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_exact_dedup(spark, docs, limit, monkeypatch):
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", limit)
    want = {}
    for i, t, *_ in awkward():
        want.setdefault(squeezed(t), []).append(i)
    own = exact_dedup.owners(docs, trie_bytes=limit).collect()
    assert sorted((r.text_sha256, -1 if r.keep_id is None else r.keep_id, r.group_size) for r in own) == sorted(
        (sha(t), min((i for i in ids if i is not None), default=-1), len(ids)) for t, ids in want.items()
    )
    out = exact_dedup.assign(docs).collect()
    assert len(out) == len(awkward()) and sum(r.kept for r in out) == len(want)
    assert all(r.keep_id == r.doc_id for r in out if r.kept)


def test_exact_dedup_keeps_rows_whole(spark, odd):
    out = exact_dedup.dedupe(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert sorted(squeezed(r.text) for r in rows) == sorted({squeezed(t) for _, t, *_ in awkward()})
    assert exact_dedup.dedupe(empty(spark)).count() == 0 and exact_dedup.assign(empty(spark)).count() == 0


# line dedup


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def stripped(rows, threshold):
    counts: dict[str, int] = {}
    for t in rows:
        for k in {key_of(x) for x in (t or "").split("\n")}:
            counts[k] = counts.get(k, 0) + 1
    out = []
    for t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key_of(x) or counts[key_of(x)] < threshold]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(odd):
    got = line_dedup.LineIndex.build(odd, threshold=3).strip(odd).collect()
    assert sorted((r.n_lines, r.n_dropped, r.kept_text) for r in got) == sorted(stripped([t for _, t, *_ in awkward()], 3))


def test_line_dedup_can_be_taken_back(spark, docs):
    first, second = docs.where("doc_id < 58"), docs.where("doc_id >= 58")
    known = lambda x: {bytes(r.key): r.docs for r in x.refs.collect()}
    index = line_dedup.LineIndex.build(first, threshold=3)
    grown = index.insert(second)
    both = line_dedup.LineIndex.build(docs.where("doc_id IS NOT NULL"), threshold=3)
    assert known(grown) == known(both)
    back = grown.delete(second)
    assert known(back) == known(index)
    for state in (index, grown, back):
        filters = {r.shard: cuckoo.CuckooFilter.from_bytes(bytes(r.filter)) for r in state.filters.collect()}
        over = [bytes(r.key) for r in state.over().collect()]
        assert all(k in filters[line_dedup.shard_of(k, state.shards)] for k in over)
        assert sum(f.count for f in filters.values()) == len(over)
    assert line_dedup.LineIndex.build(empty(spark)).strip(empty(spark)).count() == 0


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(k).encode(), digest_size=16).digest() for k in range(3000)]
    f = cuckoo.CuckooFilter.of(keys[:2000])
    assert all(k in f for k in keys[:2000]) and sum(k in f for k in keys[2000:]) < 10
    assert all(f.delete(k) for k in keys[:1000]) and all(k in f for k in keys[1000:2000])
    assert sum(k in f for k in keys[:1000]) < 10
    again = cuckoo.CuckooFilter.from_bytes(f.to_bytes())
    assert again.count == 1000 and all(k in again for k in keys[1000:2000])


# pieces


def test_pieces_as_the_library(docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    public = pytest.importorskip("public_tokenizers")
    sp = sentencepiece.SentencePieceProcessor(model_file=public.path(piece_codec.MODEL))
    codec, r = piece_codec.PieceCodec(piece_codec.model_bytes(), remembered=50), random.Random(3)
    parts = [" ", "  ", "\n", "\t", "▁", "a", "th", "the", "é", "日", "😀", "\x00", "<s>", "1", ".", "e", "́", "<0x41>", "ing", "!!", "-->"]
    for _ in range(2000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        ids = sp.encode(t)
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == ids
        assert codec.decode(np.array(ids, "<u4").tobytes()) == sp.decode(ids)
    for _ in range(500):
        ids = [r.randrange(32_000) if r.random() < 0.5 else r.randrange(3, 259) for _ in range(r.randint(0, 8))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == sp.decode(ids)
    out = piece_codec.encode(docs).collect()
    want = sorted((np.array(sp.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes()) for _, t, *_ in awkward())
    assert sorted(bytes(x.ids) for x in out) == want
    texts = piece_codec.decode(piece_codec.encode(docs)).collect()
    assert sorted(x.text for x in texts) == sorted(sp.decode(sp.encode(t or "")) for _, t, *_ in awkward())


def test_piece_digests(spark, odd):
    rows = piece_codec.round_trip(odd).collect()
    assert len(rows) == len(awkward()) and piece_codec.round_trip(empty(spark)).count() == 0
    blank = [x for x in rows if x.n_tokens == 2]
    assert {x.ids_sha256 for x in blank} == {hashlib.sha256(np.array([1, 2], "<u4").tobytes()).hexdigest()} and {x.decoded_sha256 for x in blank} == {sha("")}


# simhash


def plain_print(t):
    words = re.findall(WORD, key_of("x" + (t or "") + "x")[1:-1])
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    each = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in each) > len(each))


def near(prints, threshold=4):
    return [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= threshold]


def test_anchors_cover_all_pairs():
    r = random.Random(2)
    x = [r.getrandbits(64) for _ in range(300)]
    y = [v ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for v in x]
    for (start, width) in simhash.BLOCKS:
        homes = simhash.anchors(np.array(x, np.uint64), start, width)[0]
        others = np.stack(simhash.anchors(np.array(y, np.uint64), start, width))
        for k in range(len(x)):
            apart = ((x[k] ^ y[k]) >> start & ((1 << width) - 1)).bit_count()
            assert apart > 1 or homes[k] in others[:, k]
    blocks = [min(((a ^ b) >> s & ((1 << w) - 1)).bit_count() for s, w in simhash.BLOCKS) for a, b in zip(x, y, strict=True)]
    assert max(blocks) <= 1


def test_simhash(spark, odd):
    rows = awkward()
    prints = [plain_print(t) for _, t, *_ in rows]
    root = roots(len(rows), near(prints))
    least = {c: min((rows[k][0] for k in range(len(rows)) if root[k] == c and rows[k][0] is not None), default=None) for c in set(root)}
    got = simhash.near_duplicates(odd).collect()
    low = lambda v: -1 if v is None else v
    assert sorted((low(x.doc_id), x.fingerprint, low(x.component_id)) for x in got) == sorted((low(rows[k][0]), f"{prints[k]:016x}", low(least[root[k]])) for k in range(len(rows)))
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_first(empty(spark)).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    kept = kept.collect()
    ours = [(x.doc_id, plain_print(x.text)) for x in kept]
    # one row for each component, of its smallest id
    assert sorted(low(least[root[prints.index(p)]]) for _, p in ours) == sorted(low(v) for v in least.values())
    assert all(i == least[root[prints.index(p)]] for i, p in ours)


def test_crowded_anchors_are_cut_into_tiles(spark):
    r = random.Random(4)
    base = r.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in r.sample(range(22), r.randint(0, 5))) for _ in range(400)} | {r.getrandbits(64) for _ in range(50)})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    for most in (3, 10_000):
        edges = [(prints.index(e.a % (1 << 64)), prints.index(e.b % (1 << 64))) for e in simhash.links(frame, most_homes=most).collect()]
        assert roots(len(prints), edges) == roots(len(prints), near(prints))


def test_chains_of_prints_are_one_component(spark):
    r, prints = random.Random(9), []
    for k in range(30):
        x = r.getrandbits(64)
        for _ in range(20):
            prints.append(x)
            x ^= sum(1 << b for b in r.sample(range(64), 4))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(k, p) for k, p in enumerate(signed)], "id long, print long")
    got = {x.print: x.component_id for x in simhash.groups(frame).collect()}
    root = roots(len(prints), near(prints))
    assert [got[p] for p in signed] == root


# embeddings


def test_embeddings(spark):
    g = np.random.default_rng(4)
    base = g.normal(size=(40, 16))
    x = np.vstack([base, base[:20] + g.normal(size=(20, 16)) * 0.04, base[:10] * 3, base[:3]])
    rows = [(k, v.tolist(), k % 3 if k % 11 else None) for k, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [], 1), (n + 4, [1.0, 2.0], 1), (n + 5, [2.0, 4.0], 1), (n + 6, [1e200, 1e200], 1)]
    rows += [(n + 7, [1.0, None], 1), rows[0], rows[0], (n + 8, [float("inf"), 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS id", "1 AS grp", "2 AS node")
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / max(map(abs, rows[k][1])) for k in good}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    links = [(a, b) for a in good for b in good if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    root = roots(len(rows), links)
    least = {c: min(rows[k][0] for k in range(len(rows)) if root[k] == c) for c in set(root)}
    want = sorted((rows[k][0], sum(a == k for a, _ in links), least[root[k]]) for k in range(len(rows)))
    for tile in (7, 2048):
        got = embedding_dedup.near_duplicates(frame, tile=tile).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0
    # single precision: the numbers are the rounded ones
    small = [(k, np.float32(v).tolist(), 1) for k, v in enumerate(x)]
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in small]
    links = [(a, b) for a in range(len(x)) for b in range(len(x)) if a != b and unit[a] @ unit[b] >= 0.98]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(small, "vec_id long, embedding array<float>, label int"), tile=9).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(k, sum(a == k for a, _ in links), c) for k, c in enumerate(roots(len(x), links))]


# token files


def test_simple8b():
    g = np.random.default_rng(0)
    for n in (0, 1, 2, 59, 60, 61, 5000):
        for most in (1, 2, 300, 50_257, 2**32, 2**33, 2**61, 2**63):
            v = g.integers(0, most, n, dtype=np.uint64)
            v[g.random(n) < 0.3] = 0
            raw = simple8b.pack(v, 1000)
            assert (simple8b.unpack(raw) == v).all()
            if n > 2000:
                assert (simple8b.unpack_block(raw, 1) == v[1000:2000]).all()


def test_token_files(spark, odd, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path(token_files.TOKENIZER))
    e, r = token_files.TextEncoder(token_files.tokenizer_json(), remembered=100), random.Random(2)
    narrow = token_files.TextEncoder(token_files.tokenizer_json(), remembered=100, window_bytes=8)  # texts over many windows
    parts = ["×", "Ж", "҂", "'", "-", " world", "\r\n", " ", "·", "ſ", " ", "  ", "\n", "\t", "a", "the", "'s", "'re", "é", "ß", "日", "😀", "\x00", "<|endoftext|>", "1", ".", " ", "́", "x!", "\x1c", "\x85", "²", "÷", "ł", "ª"]
    for _ in range(2000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        want = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(x), "<u4").tolist() == want == np.frombuffer(narrow.encode(x), "<u4").tolist()
    many = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) if k % 9 else None for k in range(200)]
    for got, x in zip(narrow.encode_all(pa.array(many, pa.string()).slice(3)), many[3:], strict=True):
        assert got.tolist() == t.encode(x or "", add_special_tokens=False).ids
    path = f"file://{tmp_path}/tokens"
    token_files.write(odd, path, segment_ids=50)
    rows = sorted(awkward(), key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode()))
    want, start = [], 0
    for i, x, *_ in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.append((i, start, len(ids) // 4, zlib.crc32(ids), ids))
        start += len(ids) // 4
    got = token_files.index(spark, path).orderBy("start").collect()
    assert [tuple(x) for x in got] == [w[:4] for w in want]
    assert [bytes(x.ids) for x in token_files.read(spark, path).orderBy("start").collect()] == [w[4] for w in want]
    token_files.write(empty(spark), f"{path}-none")
    assert token_files.index(spark, f"{path}-none").count() == 0


# mixing


def water(sizes: dict, weights: dict) -> dict:
    out, open_, rest = {}, set(sizes), sum(sizes.values())
    while open_:
        level = rest / sum(weights[s] for s in open_)
        above = {s for s in open_ if weights[s] * level > 3 * sizes[s]}
        if not above:
            return out | {s: weights[s] * level for s in open_}
        for s in above:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
        open_ -= above
    return out


def test_mix(spark, odd):
    rows = awkward()
    sizes: dict = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(WORD, t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    goal = water(sizes, {s: 1.0 + k % 3 for k, s in enumerate(order)})
    got = mixing.mix(odd).collect()
    assert len(got) == len(rows)
    for s in sizes:
        own = [x for x in got if x.source == s]
        assert {x.source_size for x in own} == {sizes[s]}
        assert all(abs(x.target - goal[s]) < 1e-3 for x in own)
        assert abs(sum(x.taken for x in own) - goal[s]) <= max(x.size for x in own) / 2 + 1e-3
        assert all(x.taken <= 3 * x.size for x in own)
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.text_md5, x.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(odd.repartition(3)).collect()))
    assert mixing.mix(empty(spark)).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and mixing.mixed(empty(spark)).count() == 0


def test_mix_prefers_quality(spark):
    rows = [(k, "w " * 10, "en", "a" if k % 2 else "b", 1 if k % 4 < 2 else 0) for k in range(4000)]
    frame = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(frame, quality=F.when(F.col("n_chars") == 1, 4.0).otherwise(1.0), weights=(1.0, 3.0)).join(frame.drop("source"), "doc_id")
    share = {r[0]: r[1] for r in got.where("target < source_size").groupBy("n_chars").agg(F.avg("times")).collect()}
    assert share[1] > share[0] + 0.2


def test_mix_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = [(k, "w " * (k % 17 + 1), "en", f"s{k % 3}", None) for k in range(1500)]
    frame = spark.createDataFrame(rows, DOCS)
    many = {r.doc_id: r.taken for r in mixing.mix(frame).collect()}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1 << 20)
    assert many == {r.doc_id: r.taken for r in mixing.mix(frame).collect()}


@pytest.mark.parametrize("quality", [0.01, 1.0, 100.0, None])
def test_buckets_are_small_whatever_the_quality(spark, quality):
    mixed = F.when(F.col("id") % 2 == 0, 100.0).otherwise(0.01) if quality is None else F.lit(quality)
    keys = spark.range(40_000).select((-F.ln(mixing._uniform(F.col("id"), F.lit(""), 42)) / mixed).alias("key"))
    steps = keys.agg(F.percentile_approx("key", [k / mixing.QUANTILES for k in range(mixing.QUANTILES + 1)], 50 * mixing.QUANTILES).alias("steps"))
    rows = keys.crossJoin(F.broadcast(steps)).withColumn("bucket", mixing._bucket(F.col("key"), F.col("steps"), F.lit(40)))
    found = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("bucket").collect()
    assert max(r.n for r in found) < 4_000 and all(a.high <= b.low for a, b in zip(found, found[1:], strict=False))


# pages


def test_main_text():
    tree = html_text.trained()
    get = lambda h: html_text.main_text(h, tree)
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header><p>Site name</p></header>"
        "<nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- <p>no</p> --><div class='ad'>Buy now.</div><article><h1>A  title &amp; more</h1><p><b>First\n part.<br>Next"
        "<p>Second &lt;b&gt; &eacute;&#233; part.</p><div id='cookie-banner'>We use cookies.</div><ul><li>one</li><li>two</li></ul></article>"
        "<section class='comments'><p>I disagree with all of this, says a reader.</p></section><aside>More</aside><form><p>Your mail</p><input></form><footer>&copy; x</footer></body></html>"
    )
    assert get(page) == "A title & more\nFirst part. Next\nSecond <b> éé part.\none\ntwo"
    assert get("") == "" and get("<nav>x</nav>") == "" and get("<article>a < b</article>") == "a < b"
    assert get("<article><p>x</p><div class='comments'><article><p>reply here</p></article></div>") in ("x", "x\nreply here")
    long = "<p>" + "word " * 200_000 + "</p>"
    assert len(get(f"<article>{long * 3}</article>")) == 3 * (200_000 * 5 - 1) + 2


def test_main_text_of_awkward_pages():
    tree = html_text.trained()
    get = lambda h: html_text.main_text(h, tree)
    text = "This is a paragraph of the article, long enough to look like one of its own accord."
    p, nav = f"<p>{text}</p>", '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
    one, two = text, f"{text}\n{text}"
    assert get(f'{nav}<article class="post has-sidebar">{p}</article>') == one
    assert get(f'{nav}<main class="content with-sidebar">{p}</main>') == one
    assert get(f'<div class="layout sidebar-left"><article class="sidebar">{p}</article></div>') == one
    assert get(f"<form>{nav}<h1>The title</h1>{p}{p}</form>") == get(f"<form>{nav}<article><h1>The title</h1>{p}{p}</article></form>") == f"The title\n{two}"
    assert get(f"<article>{p}{p}<form><p>Your mail address, please</p></form></article>") == two
    assert get(f"<article>{p}<button>Menu{p}{p}</article><footer><p>foot</p></footer>") == f"{text}\n{two}"
    assert get(f"<article>{p}<button><div>Menu</div></button>{p}</article>") == two
    assert get(f"<article>{p}<object>a<object>b</object>leak</object>{p}</article>") == two
    assert get(f'<article>{p}<div class="post-comments"><article><p>I disagree, says a reader at length.</p></article></div></article>') == one
    assert get(f'<article class="post no-comments">{p}</article>') == get(f"<main>{p}</main><aside><article>{p}</article></aside>") == one
    assert get(f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header>{p}</article>") == f"Title\n{one}"
    assert get("<button>" * 20_000 + f"<article>{p}</article>") == one


def test_main_text_against_what_pages_were_made_of():
    """Pages put together from known parts, with and without an element that says where the article is."""
    tree, r = html_text.trained(), random.Random(8)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    links = lambda n: "<ul>" + "".join(f'<li><a href="/{k}">{say(r.randint(1, 3))}</a></li>' for k in range(n)) + "</ul>"
    around = [
        lambda: f"<nav>{links(r.randint(3, 9))}</nav>", lambda: f'<div class="ad">{say(r.randint(3, 40))}.</div>', lambda: f"<aside><h2>{say(2)}</h2><p>{say(r.randint(5, 60))}.</p></aside>",
        lambda: f'<div id="cookie-notice"><p>{say(20)}.</p></div>', lambda: f"<form><p>{say(9)}</p><input></form>", lambda: f"<script>var x = '<p>{say(5)}</p>';</script>",
        lambda: f'<section class="comments"><p>{say(30)}.</p><p>{say(4)}!</p></section>', lambda: f"<!-- {say(4)} -->",
    ]
    for k in range(300):
        marked = k % 3 > 0
        own = [say(r.randint(1, 90) if marked else r.randint(20, 90)) + "." for _ in range(r.randint(1, 8))]
        body = "".join(f"<p>{t.replace(' ', r.choice([' ', chr(10), '  ']), 1)}" + r.choice(["</p>", "</p>\n", ""]) for t in own)
        body = f"<article>{body}</article>" if marked else body
        page = "<html><head><title>T</title></head><body>" + "".join(f() for f in r.sample(around, 3)) + body + "".join(f() for f in r.sample(around, 3)) + f"<footer><p>{say(25)}.</p></footer></body></html>"
        assert html_text.main_text(page, tree) == "\n".join(own), page


def test_extract(spark):
    frame = spark.createDataFrame([(1, "u", "<article><p>x y</p></article>"), (2, None, None), (1, "u", "<article><p>x y</p></article>")], "page_id long, url string, html string")
    rows = html_text.extract(frame.selectExpr("*", "'x' AS text", "1 AS n_chars")).orderBy("page_id", "url").collect()
    assert [tuple(r) for r in rows] == [(1, "u", "x y", 3), (1, "u", "x y", 3), (2, None, "", 0)]
    assert html_text.extract(frame.limit(0)).count() == 0


# toxicity


def test_kernel_tolerates_gaps():
    k = subsequence.kernel
    assert k("idiot", "idiot") == pytest.approx(1.0)
    assert k("idiot", "idxiot") > 0.5 > k("idiot", "indigo") and k("clown", "cloown") > 0.8 and k("abc", "xyz") == 0
    assert k(subsequence.bordered("clown"), subsequence.bordered("clowns")) > k(subsequence.bordered("clown"), subsequence.bordered("xclownsy"))
    marks = subsequence.Landmarks(["idiot", "clown", "worthless"], 0.3)
    words = ["idiot", "idxiot", "cloown", "table", "worrthless", "in", "x" * 24, "worthlessness"]
    found = marks.against(words)
    for w in words:
        for m, mark in enumerate(marks.words):
            exact = k(w, mark)
            assert (found[w][m] if w in found else 0.0) == pytest.approx(exact if exact >= 0.3 else 0.0)


def sentences(n: int, seed: int):
    r = random.Random(seed)
    plain = ["".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(300)]
    out = []
    for k in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 60))]
        if k % 3 == 0:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "worthless", "moronic"]))
        out.append((" ".join(words) + ".", int(k % 3 == 0)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = sentences(600, 1)
    return toxicity.fit([t for t, _ in rows], [x for _, x in rows])


def scores(model, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    return [x for b in toxicity.scoring(model)(iter([batch])) for x in b.column(1).to_pylist()]


def test_toxicity_learns(model):
    rows = sentences(300, 1)[-150:] + sentences(150, 1)
    right = sum((s >= 0.5) == bool(y) for s, (_, y) in zip(scores(model, [t for t, _ in rows]), rows, strict=True))
    assert right / len(rows) > 0.97
    toxic = scores(model, ["you IDIOT!", "i.d.i.o.t", "an i d i o t", "a i d i o t", "a worthhless one", "an id iot", "i\u200bd\u200biot", "idiot " + "fine " * 100_000])
    clean = scores(model, ["", None, "a table", "good day to you", "fine " * 100_000])
    assert min(toxic) >= 0.5 > max(clean)


def test_toxicity_tolerates_letters_put_in_left_out_and_doubled(model):
    put_in, left_out, doubled = [], [], []
    for w in ("idiot", "worthless", "moronic"):
        put_in += [w[:k] + c + w[k:] for k in range(1, len(w)) for c in "abfknqxz"]
        left_out += [w[:k] + w[k + 1 :] for k in range(1, len(w) - 1)]
        doubled += [w[:k] + w[k] + w[k:] for k in range(len(w))]
    for words, least in ((put_in, 0.9), (left_out, 0.9), (doubled, 1.0)):
        assert np.mean([s >= 0.5 for s in scores(model, [f"you are {w} today" for w in words])]) >= least


def test_toxicity_score_by_brute_force(model):
    def kernel(unit, landmark):
        pieces = subsequence.windows(unit)
        cosine = max(subsequence.kernel(subsequence.bordered(p), landmark) for p in pieces)
        return max(0.0, (cosine - toxicity.KNEE) / (1 - toxicity.KNEE)) ** 2

    texts = [t for t, _ in sentences(12, 7)] + ["", "idxiot", "x" * 60 + "idiot", "a worthless-idiot mor onic", "é moron"]
    for text, got in zip(texts, scores(model, texts), strict=True):
        units = [u.decode() for u in toxicity.units(text, model.joins)]
        values = [sum(w * kernel(u, m) for w, m in zip(model.weights, model.landmarks.words, strict=True)) for u in units]
        z = model.slope * (max([0.0, *values]) + model.bias) + model.offset
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
    assert {"moronic"} <= {u.decode() for u in toxicity.units("mor onic", model.joins)}


def test_toxicity_query_parts(spark, model, odd):
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.not_toxic(odd, model).columns == odd.columns
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.fit(["a b c"], [1]) is None and toxicity.fit([], []) is None
    labels = spark.createDataFrame([(k, None, k % 2) for k in range(60)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    used = toxicity.training_rows(odd, labels)
    allowed = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    texts = {i: t or "" for i, t, *_ in awkward()}
    assert {t for t, _ in used} <= {t or "" for i, t, *_ in awkward() if i in allowed} and len(texts) > 0
    assert toxicity.training_rows(empty(spark), labels) == []
    assert toxicity.score(empty(spark), model).count() == 0 and toxicity.not_toxic(empty(spark), model).count() == 0
    by_text = dict(zip([t for _, t, *_ in awkward()], scores(model, [t for _, t, *_ in awkward()]), strict=True))
    assert sorted(r.score for r in rows) == sorted(by_text[t] for _, t, *_ in awkward())
    with_insults = odd.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" idxiot"))).otherwise(F.col("text")))
    kept = toxicity.not_toxic(with_insults, model).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == sorted((i is None, i or 0, t or "") for i, t, *_ in awkward() if i is None or i % 7)
