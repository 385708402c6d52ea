"""The pipeline's stages against plain Python, each on what its predecessor kept, and the WARC audit."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import components, exact_dedup, mixing, toxicity, warc_fixity
from tallyframe.llm.common import staged, table
from tests.conftest import SF
from tests.llm.test_operators import DOCS, awkward, roots, squeezed
from tests.llm.test_shingle_dedup import expected, plain_set, similar


@pytest.fixture(scope="module")
def kept(spark):
    docs = table(spark, SF, "documents")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        out.append((name, docs))
    return {name: (frame.columns, frame.collect(), frame) for name, frame in out}


def test_stages(spark, kept):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mix", "sentencepiece"]
    assert all(kept[n][0] == kept["documents"][0] for n in names[:-1])
    # toxicity
    model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(kept["documents"][2], model).collect()}
    assert sorted(r.doc_id for r in kept["toxicity"][1]) == sorted(i for i, s in scores.items() if s < 0.5)
    # exact copies
    least: dict = {}
    for r in kept["toxicity"][1]:
        least[squeezed(r.text)] = min(least.get(squeezed(r.text), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in kept["exact_dedup"][1]) == sorted(least.values())
    # near copies
    assert sorted(r.doc_id for r in kept["simhash_near_dedup"][1]) == expected([(r.doc_id, r.text) for r in kept["exact_dedup"][1]])
    # mix
    times = {r.doc_id: r.times for r in mixing.mix(kept["simhash_near_dedup"][2]).collect()}
    mixed = [r.doc_id for r in kept["source_mix"][1]]
    assert all(mixed.count(i) == n for i, n in times.items()) and len(mixed) == sum(times.values())
    # pieces
    sentencepiece, public = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    want = []
    for r in kept["source_mix"][1]:
        ids = sp.encode(r.text, add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, kept["sentencepiece"][1])) == sorted(want)


def test_run(spark, kept):
    out = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, kept["sentencepiece"][1]))


@pytest.mark.parametrize("number", range(5))
def test_stages_on_awkward_rows(spark, number):
    """Nulls, repeated rows, ties, an empty table, and extra columns with names that stages use themselves."""
    name, stage = corpus_pipeline.STAGES[number]
    clashing = ("id", "_id", "_row", "_kept_id", "_kept", "_n", "_text", "_md5", "_times", "print", "size", "key", "tag", "a.b")
    odd = spark.createDataFrame(awkward(), DOCS).selectExpr("*", *(f"'x' AS `{c}`" for c in clashing))
    out = stage(spark, odd, SF)
    assert stage(spark, odd.limit(0), SF).count() == 0
    if number == 4:
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted((i is None, i or 0) for i, *_ in awkward())
        return
    assert out.columns == odd.columns
    got, texts = out.collect(), [(i, t) for i, t, *_ in awkward()]
    assert all(r["a.b"] == "x" for r in got)
    low = lambda i, t: (i is None, i or 0, t is None, t or "")
    found = sorted(low(r.doc_id, r.text) for r in got)
    if number == 0:
        assert found == sorted(low(*x) for x in texts)  # none of them is toxic
    elif number == 1:
        assert sorted(squeezed(r.text) for r in got) == sorted({squeezed(t) for _, t in texts})
        least = {s: min((i for i, t in texts if squeezed(t) == s and i is not None), default=None) for s in {squeezed(t) for _, t in texts}}
        assert all(r.doc_id == least[squeezed(r.text)] for r in got)
    elif number == 2:
        sets = [plain_set(t) for _, t in texts]
        root = roots(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if similar(sets[a], sets[b])])
        ids = [min((texts[k][0] for k in range(len(texts)) if root[k] == c and texts[k][0] is not None), default=None) for c in sorted(set(root))]
        assert sorted(x[:2] for x in found) == sorted((i is None, i or 0) for i in ids)
    else:
        times = {}
        for r in mixing.mix(odd).collect():
            key = (r.doc_id, r.source, r.text_md5)
            times[key] = max(times.get(key, 0), r.times)
        md5 = lambda t: hashlib.md5((t or "").encode()).hexdigest()
        assert len(got) == sum(times[i, s, md5(t)] for i, t, _, s, _ in awkward()) and all(squeezed(r.text).strip() for r in got)


# WARC


def records(n: int) -> list[bytes]:
    bodies = [f"page {k} ".encode() * (k * 37 % 400) for k in range(n)]
    return [b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in bodies]


def test_records_cover_every_byte():
    raw = b"".join(records(20)) + b"tail without a record"
    for damaged in (raw, raw[:1000] + b"\0" + raw[1001:], b"junk" + raw, raw[:-40], b""):
        found = list(warc_fixity.parse_warc(damaged))
        assert b"".join(x for _, _, x in found) == damaged and [at for at, _, _ in found] == np.cumsum([0, *(n for _, n, _ in found)])[:-1].tolist()
    assert len(list(warc_fixity.parse_warc(b"".join(records(20))))) == 20


def test_audit_of_files(spark, tmp_path):
    for side in "ab":
        (tmp_path / side).mkdir()
    good = records(300)
    starts = np.cumsum([0, *map(len, good)])
    for name in ("x.warc", "y.warc"):
        (tmp_path / "a" / name).write_bytes(b"".join(good))
    broken = bytearray(b"".join(good))
    broken[starts[200] - 10] ^= 1  # in record 199
    (tmp_path / "b" / "x.warc").write_bytes(bytes(broken))
    (tmp_path / "b" / "y.warc").write_bytes(b"".join(good[:299]))
    a, b = (warc_fixity.file_leaves(spark, f"file://{tmp_path}/{s}") for s in "ab")
    found, seen = warc_fixity.audit(a, b)
    assert sorted((r.archive, r.offset, r.state) for r in found.collect()) == [("x.warc", starts[199], "changed"), ("y.warc", starts[299], "missing")]
    assert seen[0] == 2 and all(n == 2 for n in seen) and re.fullmatch("[0-9a-f]{64}", found.first().hash_a)
    same, seen = warc_fixity.audit(a, a)
    assert same.count() == 0 and set(seen) == {0}
    assert warc_fixity.audit(a.limit(0), a.limit(0))[0].count() == 0
    assert {r.state for r in warc_fixity.audit(a.limit(0), a.limit(2))[0].collect()} == {"extra"}


def test_pages_with_nulls_and_repeated_rows(spark, tmp_path):
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, None, None), (None, "v", "é" * 70_000), (20_001, "u", ""), (-5, "u", None)]
    for sub, data in (("full", rows), ("none", [])):
        spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "'z' AS archive", "1 AS offset", "2 AS state").write.parquet(f"file://{tmp_path}/{sub}/pages.parquet")
    out = warc_fixity.op2_warc_fixity(spark, f"file://{tmp_path}/full").collect()
    assert len(out) == 6 and len({(r.archive, r.record_offset) for r in out}) == 6
    assert warc_fixity.op2_warc_fixity(spark, f"file://{tmp_path}/none").count() == 0


def test_many_records_of_one_range_fill_several_archives(spark):
    pages = spark.range(100_000, numPartitions=8).select(F.lit(None).cast("long").alias("page_id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit("<p>x</p>").alias("html"))
    same = spark.range(30_000, numPartitions=8).select(F.lit(7).cast("long").alias("page_id"), F.lit("u").alias("url"), F.lit("").alias("html"))
    record = warc_fixity.page_record(F.col("url"), F.col("html"), F.col("page_id"))
    leaves = warc_fixity.page_leaves(pages.unionAll(same), record).groupBy("archive").agg(F.count("*").alias("n"), F.count_distinct("offset").alias("places")).collect()
    assert len(leaves) >= 11 and sum(r.n for r in leaves) == 130_000 and max(r.n for r in leaves) < 16_000 and all(r.n == r.places for r in leaves)


@pytest.mark.parametrize("limit", [1, 3000, 1 << 20])
def test_exact_dedup_keeps_first_rows(spark, limit):
    """Small tries: what a task has handed on is remembered, and owners' tries are let go."""
    r = random.Random(limit)
    texts = [f"text {k}  of some length {'x' * (k % 90)}" for k in range(40)] + ["", None, " \t", "hot text"]
    rows = [(r.choice([None, r.randint(0, 99)]), r.choice([t, t and t.replace(" ", "\n")]), k % 3, [k % 2]) for k, t in enumerate(texts * 3)] + [(k, "hot text", 0, [0]) for k in range(300, 0, -1)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long, _id array<int>").repartition(3)
    got = exact_dedup.dedupe(frame, trie_bytes=limit)
    assert got.columns == frame.columns
    squeezed = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    best: dict = {}
    for i, t, *_ in rows:
        best[squeezed(t)] = min(best.get(squeezed(t), (True, 0)), (i is None, i or 0))
    found = [tuple(x) for x in got.collect()]
    assert sorted((squeezed(t), (i is None, i or 0)) for i, t, *_ in found) == sorted(best.items()) and all(x in rows for x in found)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1


def test_forest_connects_what_edges_connect():
    r = np.random.default_rng(2)
    for n, m in ((1, 1), (50, 30), (50, 400), (3000, 2900)):
        a, b = r.integers(0, n, m) * 7 - 9, r.integers(0, n, m) * 7 - 9
        x, y = components.forest(a, b)
        at = {int(v): k for k, v in enumerate(np.unique(np.concatenate([a, b])))}
        want, got = (roots(len(at), [(at[int(p)], at[int(q)]) for p, q in zip(*e, strict=True)]) for e in ((a, b), (x, y)))
        assert want == got and len(x) < len(at) and len(set(x.tolist())) == len(x) and not set(x.tolist()) & set(y.tolist())
