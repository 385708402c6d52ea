"""Filter audit, fill-in-the-middle and quality against brute force and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import filter_audit, fill_middle, quality
from tests.conftest import SF

from .test_operators import DOCS, WORD, awkward, empty, sha

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(audited(), DOCS)


def audited() -> list[tuple]:
    r = random.Random(3)
    few = ["tick", "tock"]
    more = [" ".join(f"w{r.randint(0, 400)}" for _ in range(r.randint(45, 80))) for _ in range(30)]
    more += [x.upper() for x in more[:6]] + [x + " 100%" for x in more[3:9]] + [" ".join(few * 40), " ".join(few * 40), "AB" * 30, "5% " * 60, "É" * 3]
    return awkward() + [(1000 + k, t, "en", ("web", "", None)[k % 3], None) for k, t in enumerate(more + more[:9])] + [(999, more[2], "en", "web", None)]


def labels() -> list[tuple]:
    return [(k, k % 2, int(k % 7 == 0)) for k in range(1000, 1030)] + [(3, 1, None), (3, 0, 1), (3, None, None), (None, 1, 1), (77777, 1, 1)]


# filter audit


def failing(rows):
    out = []
    for i, t, _, source, _ in rows:
        t = t or ""
        w = re.findall(WORD, t)
        fails = {"A"} if len(w) < 50 else set()
        fails |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        same = [j for j, u, *_ in rows if (u or "") == t and j is not None]
        fails |= {"E"} if same and (i is None or min(same) < i) else set()
        out.append((i, source or "", fails))
    return out


def simulated(rows, marks):
    """Every order, step by step."""
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    out, whole = {}, failing(rows)
    for part in {p for _, p, _ in whole}:
        own = [(i, f) for i, p, f in whole if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                stay = [x for x in left if c not in x[1]]
                total[c] += len(gone)
                fail = [x for x in own if c in x[1]]
                out[part, "".join(order), step] = [
                    len(stay), len(gone), len(fail) - len(gone), sum(x[1] == {c} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), c,
                ]
                left = stay
        for (p, _, _), v in out.items():
            if p == part:
                v[-1] = total[v[-1]]
    return out


@pytest.mark.parametrize("held", [1, 512])
def test_audit_against_every_order(spark, docs, held, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS_HELD", held)
    marks = spark.createDataFrame(labels(), LABELS)
    odd = docs.selectExpr("*", "'x' AS part", "'y' AS failed", "'z' AS _id", "1 AS `a.b`").repartition(3)
    got = filter_audit.audit(filter_audit.judged(odd, marks)).collect()
    want = simulated(audited(), labels())
    assert len(got) == len(want) and len(got) % 600 == 0
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want


def test_audit_of_nothing(spark, docs):
    marks = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(filter_audit.judged(empty(spark), marks)).count() == 0
    got = filter_audit.audit(filter_audit.judged(docs, marks)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(got) == (0, 0)


def test_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120)
    for k, order in enumerate(filter_audit.ORDERS):
        for s in range(32):
            assert table[s, k] == next((step for step, c in enumerate(order) if s >> "ABCDE".index(c) & 1), 5)


# fill in the middle


def middled(i, t):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


MARKED = ["has <S> inside", "<P>", "no <M", "<S<S", "M><P", "\x00 nul", "á \U0001f600" * 90, "<" * 300]


@pytest.mark.parametrize("run", [1, 3, 256])
def test_fill_middle(spark, run):
    rows = awkward() + [(500 + 40 * k + j, t, None, None, None) for k, t in enumerate(MARKED) for j in range(12)]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS key", "'y' AS form", "0 AS n", "1 AS `a.b`").repartition(3)
    got = fill_middle.transform(frame, run=run).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(map(repr, ((i, *middled(i, t)) for i, t, *_ in rows)))
    assert all(r.back == r.text for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("run", [1, 4, 256])
def test_units_of_a_pattern(spark, run):
    """Cuts fall between units: words with the blanks before them, and single characters at the end."""
    rows = [(k, t, None, None, None) for k, t in enumerate([" ".join(f"w{j}" for j in range(k)) + " " * (k % 3) for k in range(1, 60)])]
    frame = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in fill_middle.transform(frame, unit=r"\s*\S+", run=run).collect()}
    for i, t, *_ in rows:
        pieces = re.findall(r"(?s)\s*\S+|.", t)
        h = hashlib.sha256(f"1:{i}".encode()).hexdigest()
        a, b = sorted(int(h[8 * k : 8 * k + 8], 16) % (len(pieces) + 1) for k in range(2))
        r = got[i]
        assert r.n == len(pieces)
        if r.form != "plain":
            assert (r.prefix_chars, r.middle_chars) == (len("".join(pieces[:a])), len("".join(pieces[a:b])))
    with pytest.raises(ValueError, match="empty"):
        fill_middle.transform(frame, unit=r"\s*")


def test_fill_middle_reads_one_exchange(spark):
    frame = fill_middle.transform(spark.createDataFrame(awkward(), DOCS))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().partition("== Initial")[0]
    assert len(re.findall(r"\+- Exchange hashpartitioning", plan)) == 1 and plan.count("ReusedExchange") == 2
    assert fill_middle.transform(empty(spark)).count() == 0


# quality


def test_statistics_by_their_definitions():
    text = "One two, two THREE.\nOne two, two THREE.\n#4 é!"
    got = dict(zip(quality.STATISTICS, quality.statistics(text.encode()), strict=True))
    words = text.split()
    want = {
        "log_words": np.log1p(len(words)), "log_chars": np.log1p(len(text)), "word_length": np.mean([len(w.encode()) for w in words]), "different_words": len(set(words)) / len(words),
        "commonest_word": 2 / 10, "different_pairs": len(set(zip(words, words[1:], strict=False))) / 9, "lines_a_word": 3 / 10, "different_lines": 2 / 3, "capitals": 12 / len(text), "digits": 1 / len(text),
        "exclaims": 1 / len(text), "marks": 1 / len(text), "not_ascii": 1 / len(text), "begins_large": 4 / 10, "all_large": 2 / 10, "ends_marked": 1 / 10,
    }
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: got[k] for k in want}
    for raw in (b"", b" \n ", b"x", "é".encode() * 70_000, b"\n" * 5):
        assert np.isfinite(quality.statistics(raw)).all()


def test_features_approximate_the_kernel():
    r = np.random.default_rng(1)
    x = r.standard_normal((60, len(quality.STATISTICS)))
    z = quality.features(x, np.zeros(x.shape[1]), np.ones(x.shape[1]))[:, :-1]
    gauss = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * quality.BANDWIDTH**2))
    assert np.abs(z @ z.T - gauss).mean() < 0.06


def test_isotonic_against_min_max():
    r = np.random.default_rng(4)
    for _ in range(30):
        n = int(r.integers(1, 25))
        x, rows = np.sort(r.random(n)), r.integers(1, 5, n).astype(float)
        good = np.array([r.integers(0, int(k) + 1) for k in rows], float)
        at, level = quality.isotonic(x, good, rows)
        assert (np.diff(level) >= 0).all() and (np.diff(at) > 0).all()
        mean = lambda a, b: good[a : b + 1].sum() / rows[a : b + 1].sum()  # noqa: B023, E731
        best = [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
        assert len(at) == len({round(v, 12) for v in best})


def test_summed_equations_are_those_of_all_rows(spark):
    r = np.random.default_rng(2)
    stats = r.standard_normal((80, len(quality.STATISTICS)))
    rows = [(k % 4, int(k % 3 == 0), stats[k].tolist()) for k in range(80)]
    frame = spark.createDataFrame(rows, "fold int, good int, stats array<double>").repartition(5)
    mean, spread = np.zeros(stats.shape[1]), np.ones(stats.shape[1])
    got = np.zeros((4, quality.FEATURES + 2, quality.FEATURES + 2))
    for x in frame.transform(quality.mapped, quality._equations(mean, spread), "fold int, line int, sums array<double>").collect():
        got[x.fold, x.line] += x.sums
    z = np.column_stack([quality.features(stats, mean, spread), [g for _, g, _ in rows]])
    for k in range(4):
        assert np.allclose(got[k], z[k::4].T @ z[k::4])


def test_quality_of_held_out_documents(spark):
    got = quality.op11_quality(spark, SF.replace("0.001", "0.01")).collect()
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").collect()}
    held = [(r.predicted, known[r.doc_id]) for r in got if r.held_out and r.doc_id in known]
    assert len(held) > 60 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_quality_of_awkward_tables(spark, tmp_path):
    rows = awkward()
    spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS id", "'y' AS stats", "0 AS score", "1 AS `a.b`").write.parquet(f"file://{tmp_path}/documents.parquet")
    for name, marks, constant in (
        ("none", [], 0.5), ("null", [(1, None, 0), (None, 1, 0)], 0.5), ("one", [(k, 1, 0) for k in range(30)], None), ("both", [(k, k % 2, 0) for k in range(40)] + [(3, 0, 0)], None),
    ):
        (tmp_path / name).mkdir()
        (tmp_path / name / "documents.parquet").symlink_to(tmp_path / "documents.parquet")
        spark.createDataFrame(marks, LABELS).write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
        got = quality.op11_quality(spark, f"file://{tmp_path}/{name}").collect()
        assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (i for i, *_ in rows)))
        assert all(0 <= r.score <= 1 for r in got) and (constant is None or {r.score for r in got} == {constant})
    stats = quality.described(empty(spark))
    assert quality.score(stats, quality.train(stats, spark.createDataFrame([(1, 1, 0)], LABELS))).count() == 0
    assert sha("") == hashlib.sha256(b"").hexdigest()
