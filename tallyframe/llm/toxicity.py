"""Toxicity by a support vector machine on a subsequence string kernel, with Nystroem landmarks.

A sentence is a bag of units: its words without the punctuation inside them, words spelled
letter by letter, and insults cut in two by a blank. A unit's kernel value with a landmark
is the cosine of their gap-weighted subsequences, word borders included, taken up from
``KNEE`` on and squared. Landmarks are words that go with toxic documents and the clean words
most like them, each chosen for not being like one chosen before. The values are mapped through the
inverse root of the landmarks' own kernel matrix (Nystroem), and a linear machine with
squared hinge loss is trained. A sentence has the value of its highest unit. Labels are of
documents, so all sentences of a clean one are clean, while the highest sentence of a toxic
one stands for it, provided that it lies on the toxic side: some labels are wrong. That choice,
the clean sentences that come nearest and the machine are found in turns. For each toxic word that the
labels bear out, versions with a letter put in, left out or doubled at every place are added,
weighing more the more the labels say. A document's score is that of its
highest sentence, through a logistic curve fitted on the training documents.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, mapped, resident, table
from .subsequence import Landmarks, bordered, features, windows

#: The machine is fitted on so many labelled documents at most, clean and toxic, those of the lowest hash.
TRAIN_ROWS = (4000, 2000)
MOST_TOXIC_LANDMARKS, MOST_CLEAN_LANDMARKS = 120, 80
#: Landmarks of a side have no larger cosine with one another.
TOXIC_SPREAD, CLEAN_SPREAD = 0.8, 0.9
#: Cosines up to this count as zero; from here on the value grows as a square, to 1.
KNEE = 0.3
#: Units remembered by a worker, for each of two generations.
REMEMBERED = 400_000
_TURNS, _RIDGE, _ALTERED_COST, _NEAREST, _COMMON = 6, 1e-3, 1.0, 3, 0.05
_TOGETHER = 256  # documents whose words are looked up together
_AT_ONCE = 8_000  # units whose kernel values are held together when a machine is fitted

_DELETED = b".-_*'`~^#@$%\\"
_SPACED = bytes.maketrans(b",;:!?()\"/|<>=&+[]{}", b" " * 19)
_SPELLED = re.compile(rb"(?<!\S)(?:[a-z0-9]|[\xc3-\xdf][\x80-\xbf])(?: (?:[a-z0-9]|[\xc3-\xdf][\x80-\xbf])){2,}(?!\S)")
_UNSEEN = re.compile("[\u00ad\u0300-\u036f\u200b-\u200f\u2060\ufeff]")  # soft hyphens, marks, characters without width
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")


def units(text: str, joins: dict[str, set[str]] | None = None) -> set[bytes]:
    """The words of a text in lower case without punctuation, words spelled letter by letter, and
    neighbours (first, second) that ``joins`` has, put together."""
    if not text.isascii() and _UNSEEN.search(text):
        text = _UNSEEN.sub("", text)
    low = text.lower()
    raw = low.encode("utf-8", "replace").translate(_SPACED, _DELETED)
    out = set(raw.split())
    if spelled := _SPELLED.findall(raw):
        out |= {x.replace(b" ", b"") for x in spelled}
    if joins:
        some = {first for first in joins if first.encode() in out}
        if some and any(second.encode() in out for first in some for second in joins[first]):
            words = low.split()
            out |= {(a + b).encode() for a, b in zip(words, words[1:], strict=False) if a in some and b in joins[a]}
    return out


def shape(cosines: np.ndarray) -> np.ndarray:
    """Kernel values from cosines of subsequences."""
    return np.maximum(0.0, (cosines - KNEE) / (1.0 - KNEE)) ** 2


def described(words: list[bytes], landmarks: Landmarks) -> dict[bytes, np.ndarray]:
    """Kernel values of units with all landmarks; units without any value are left out. Of a
    unit in pieces each landmark sees the nearest piece."""
    parts = {w: [bordered(p) for p in windows(w.decode())] for w in words}
    found = landmarks.against(list({p for ps in parts.values() for p in ps}))
    near = {w: [found[p] for p in ps if p in found] for w, ps in parts.items()}
    return {w: shape(np.maximum.reduce(rows)) for w, rows in near.items() if rows}


@dataclass
class ToxicityModel:
    landmarks: Landmarks
    weights: np.ndarray  # of the kernel values: Nystroem map and machine in one
    bias: float
    slope: float
    offset: float
    joins: dict[str, set[str]] = field(default_factory=dict)

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * worst + self.offset, -60, 60)))


class UnitValues:
    """The machine's value of each unit above its bias, computed in batches and remembered."""

    def __init__(self, model: ToxicityModel, remembered: int = REMEMBERED) -> None:
        self.model, self.most = model, remembered
        self.new: dict[bytes, float] = {}
        self.old: dict[bytes, float] = {}

    def learn(self, words: set[bytes]) -> dict[bytes, float]:
        """A dictionary that has each of the words."""
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        missing = [w for w in words if w not in new]
        if old:
            new.update((w, old[w]) for w in missing if w in old)
            missing = [w for w in missing if w not in new]
        found = described(missing, self.model.landmarks)
        new.update(dict.fromkeys(missing, 0.0))
        if found:
            new.update(zip(found, (np.array(list(found.values())) @ self.model.weights).tolist(), strict=True))
        return new


def _different(texts: list[str], labels: list[int], size: int = 16) -> tuple[list[str], list[int]]:
    """Without exact and near copies of earlier texts: those that share half of the ``size``
    words of lowest hash with one of them."""
    holders: dict[int, list[int]] = {}
    out: tuple[list[str], list[int]] = ([], [])
    for n, (t, label) in enumerate(zip(texts, labels, strict=True)):
        sketch = sorted(xxhash.xxh64_intdigest(w) for w in units(t))[:size]
        shared = Counter(d for h in sketch for d in holders.get(h, ()))
        if sketch and shared and shared.most_common(1)[0][1] * 2 >= len(sketch):
            continue
        for h in sketch:
            holders.setdefault(h, []).append(n)
        out[0].append(t)
        out[1].append(int(label))
    return out


def _altered(word: str, letters: list[str]) -> set[str]:
    """A word with a letter put in, left out and doubled, at every place."""
    inside = range(1, len(word))
    put_in = {word[:k] + letters[(5 * k + 11 * j) % len(letters)] + word[k:] for k in inside for j in range(3)}
    left_out = {word[:k] + word[k + 1 :] for k in inside[:-1]}
    return put_in | left_out | {word[:k] + word[k] + word[k:] for k in range(len(word))}


def _toxic_words(toxic: Counter, clean: Counter, n: int, m: int) -> list[bytes]:
    """Words that go with the label, by log-likelihood ratio over what is to be expected by chance
    among so many words as frequent as they; if none does, the ten that do most."""
    alike = Counter(toxic[w] + clean[w] for w in toxic.keys() | clean.keys())
    ranked = []
    for w, a in toxic.items():
        b = clean[w]
        if a >= 2 and len(w) >= 2 and a * m > 4 * b * n:
            p = (a + b) / (n + m)
            ratio = a * np.log(a / (n * p)) + (b * np.log(b / (m * p)) if b else 0.0)
            ranked.append((ratio - np.log(alike[a + b]), w))
    ranked.sort(key=lambda x: (-x[0], x[1]))
    return [w for s, w in ranked if s >= 5.0] or [w for _, w in ranked[:10]]


def _spread(words: list[str], most: int, limit: float, among: list[str] = ()) -> list[str]:
    """The first words that aren't as like as ``limit`` to one before them or ``among``."""
    chosen, seen = [], [features(bordered(w)) for w in among]
    for w in words:
        own = features(bordered(w))
        if all(sum(x * f.get(k, 0.0) for k, x in own.items()) < limit for f in seen):
            chosen.append(w)
            seen.append(own)
            if len(chosen) == most:
                break
    return chosen


def _joins(words: list[str], texts: list[str], labels: list[int]) -> dict[str, set[str]]:
    """Toxic words cut in two, as first part to second parts; pairs that clean texts have are left out."""
    out: dict[str, set[str]] = {}
    for w in words:
        for k in range(1, len(w)):
            out.setdefault(w[:k], set()).add(w[k:])
    for text, label in zip(texts, labels, strict=True):
        if not label:
            low = text.lower().split()
            for a, b in zip(low, low[1:], strict=False):
                if a in out:
                    out[a].discard(b)
    return {a: b for a, b in out.items() if b}


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps; the last component is the bias.
    ``x`` is in single precision, as it has a row for each unit that comes into question."""
    w = np.zeros(x.shape[1] + 1)
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-9
    gaps = lambda w: 1 - y * (x @ w[:-1].astype(np.float32) + w[-1])
    loss = lambda w: 0.5 * (keep * w * w).sum() + 0.5 * (cost * np.maximum(0, gaps(w)) ** 2).sum()
    for _ in range(50):
        gap = gaps(w)
        on = np.flatnonzero(gap > 0)
        gradient, curved = keep * w, np.diag(keep)
        for k in range(0, len(on), _AT_ONCE):
            rows = on[k : k + _AT_ONCE]
            part = np.hstack([x[rows], np.ones((len(rows), 1))])
            gradient = gradient - part.T @ (cost[rows] * y[rows] * gap[rows])
            curved = curved + (part.T * cost[rows]) @ part
        step = np.linalg.solve(curved, gradient)
        size, now = 1.0, loss(w)
        while size > 1e-3 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-5 * max(1.0, np.abs(w).max()):
            break
    return w


def _curve(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps, with smoothed labels."""
    n, m = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (n + 1) / (n + 2), 1 / (m + 2))
    weight = np.where(y > 0, 0.5 / max(n, 1), 0.5 / max(m, 1))
    x, w = np.column_stack([f, np.ones_like(f)]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        gradient = x.T @ (weight * (p - goal)) + 1e-6 * w
        step = np.linalg.solve((x.T * (weight * np.maximum(p * (1 - p), 1e-9))) @ x + 1e-6 * np.eye(2), gradient)
        step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(texts: list[str], labels: list[int], most: tuple[int, int] = (MOST_TOXIC_LANDMARKS, MOST_CLEAN_LANDMARKS)) -> ToxicityModel | None:
    """A model from labelled texts; copies count once. None if only one label occurs."""
    texts, labels = _different(texts, labels)
    y = np.array(labels)
    n, m = int(y.sum()), int(len(y) - y.sum())
    if not n or not m:
        return None
    # units by number, for each sentence; the last of a document is the whole: words spelled across sentences
    number: dict[bytes, int] = {}
    of_unit: dict[bytes, list[int]] = {}

    def numbered(text: str) -> list[int]:
        found = sorted(units(text))  # in order, so that a machine fitted again is the same
        for u in [u for u in found if u not in of_unit]:
            of_unit[u] = [number.setdefault(p.encode(), len(number)) for p in windows(u.decode())]
        return [k for u in found for k in of_unit[u]]

    flats, counts = [], []
    for t in texts:
        own = [numbered(s) for s in [*_SENTENCE.split(t), t]]
        flats.append(np.fromiter(chain.from_iterable(own), np.int32))
        counts.append(np.array([len(x) for x in own]))
    known = list(number)
    whole = lambda which: [np.unique(x[len(x) - c[-1] :]) for x, c, label in zip(flats, counts, labels, strict=True) if label == which]
    toxic, clean = (Counter({known[k]: int(c[k]) for k in np.flatnonzero(c)}) for c in (np.bincount(np.concatenate(whole(1)), minlength=len(known)), np.bincount(np.concatenate(whole(0)), minlength=len(known))))
    del of_unit
    strong = _toxic_words(toxic, clean, n, m)
    if not strong:
        return None
    names = [w.decode() for w in strong]
    marks = _spread(names, most[0], TOXIC_SPREAD)
    first, others = Landmarks([bordered(w) for w in marks], KNEE), sorted(clean.keys() - set(strong))
    near = {w: float(v.max()) for low in range(0, len(others), _AT_ONCE) for w, v in described(others[low : low + _AT_ONCE], first).items()}
    like = _spread([w.decode() for w in sorted(near, key=lambda w: (-near[w], w))], most[1], CLEAN_SPREAD, marks)
    landmarks = Landmarks([bordered(w) for w in marks + like], KNEE)

    gram = shape(landmarks.values.T @ landmarks.values)
    size, vectors = np.linalg.eigh(gram)
    kept = size > 1e-6 * size.max()
    root = vectors[:, kept] / np.sqrt(size[kept])  # Nystroem: values @ root are coordinates in the kernel's space

    place, parts = np.full(len(known), -1), []
    for low in range(0, len(known), _AT_ONCE):
        found = described(known[low : low + _AT_ONCE], landmarks)
        place[[number[w] for w in found]] = np.arange(len(found)) + sum(map(len, parts))
        parts.append((np.array(list(found.values())).reshape(len(found), -1) @ root).astype(np.float32))
    z = np.concatenate(parts)
    del parts
    # the sentences that have units with values, one after the other
    doc = np.repeat(np.arange(len(texts)), [len(c) for c in counts])
    flat, lengths = place[np.concatenate(flats)], np.concatenate(counts)
    sentence = np.repeat(np.arange(len(doc)), lengths)[flat >= 0]
    flat, lengths = flat[flat >= 0], np.bincount(sentence, minlength=len(doc))
    doc, lengths = doc[lengths > 0], lengths[lengths > 0]
    starts = np.cumsum(lengths) - lengths
    del flats, counts, sentence

    letters = sorted({c for w in names for c in w})
    changed = {w: sorted(a for a in _altered(w, letters) if a.encode() not in clean and a.encode() not in toxic) for w in names}
    several, altered, altered_cost = [(a.encode(), toxic[w.encode()] ** 2 / len(v)) for w, v in changed.items() for a in v], [], []
    for low in range(0, len(several), _AT_ONCE):
        part = several[low : low + _AT_ONCE]
        found = described(list({a for a, _ in part}), landmarks)
        kept = [(a, c) for a, c in part if a in found]
        altered.append((np.array([found[a] for a, _ in kept]).reshape(len(kept), -1) @ root).astype(np.float32))
        altered_cost += [c for _, c in kept]
    altered, altered_cost = np.concatenate([*altered, np.zeros((0, root.shape[1]), np.float32)]), np.array(altered_cost)
    altered_cost *= _ALTERED_COST / max(1e-12, altered_cost.sum())

    pairs = np.unique(np.repeat(doc, lengths) * max(1, len(z)) + flat)  # each unit of a document once
    often = np.bincount((pairs % max(1, len(z)))[y[pairs // max(1, len(z))] == 0], minlength=len(z))
    del pairs
    common = np.flatnonzero(often)
    f = np.full(len(z), -1.0)
    f[[k for w in strong if (k := place[number[w]]) >= 0]] = 1.0
    w = np.zeros(root.shape[1] + 1)
    fixed = np.vstack([np.zeros((1, z.shape[1]), np.float32), z[common], altered])
    fixed_sign = np.r_[-np.ones(1 + len(common)), np.ones(len(altered))]
    fixed_cost = np.r_[1.0, _COMMON * np.minimum(often[common], 20) / m, altered_cost]
    for turn in range(_TURNS):
        # the highest sentences of each document, with the unit that makes each so high
        value = np.maximum.reduceat(f[flat], starts) if len(flat) else np.zeros(0)
        top = np.flatnonzero(f[flat] == np.repeat(value, lengths))
        unit = flat[top[np.searchsorted(top, starts)]]
        order = np.lexsort((unit, -value, doc))
        rank = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
        witness = unit[order[(rank == 0) & (y[doc[order]] == 1) & (value[order] > 0)]]
        nearest, times = np.unique(unit[order[(rank < _NEAREST) & (y[doc[order]] == 0) & (turn > 0)]], return_counts=True)
        x = np.vstack([fixed, z[nearest], z[witness]])
        sign = np.r_[fixed_sign, -np.ones(len(nearest)), np.ones(len(witness))]
        cost = np.r_[fixed_cost, times / m, np.full(len(witness), 1.0 / max(1, len(witness)))]
        w = _machine(x, sign, cost, _RIDGE)
        del x
        f = z @ w[:-1] + w[-1]
    worst = np.full(len(y), w[-1])
    np.maximum.at(worst, np.repeat(doc, lengths), f[flat])
    # beyond the margins a value says no more, and the machine's clean side stays under one half
    slope, offset = _curve(np.clip(worst, -1.0, 1.0), y)
    return ToxicityModel(landmarks, root @ w[:-1], float(w[-1]), slope, min(0.0, offset), _joins(names, texts, labels))


def scoring(model: ToxicityModel | None):
    """Arrow batches of (id, text) to (id, score)."""

    def run(batches):
        if model is None:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0.0] * batch.num_rows, pa.float64())], names=["id", "score"])
            return
        values = resident(("toxicity", tuple(model.landmarks.words), model.bias), lambda: UnitValues(model))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            worst = []
            for low in range(0, len(texts), _TOGETHER):
                bags = [units(t or "", model.joins) for t in texts[low : low + _TOGETHER]]
                known = values.learn(set().union(*bags))
                worst += [max(map(known.__getitem__, bag), default=0.0) for bag in bags]
            found = model.score(np.maximum(0.0, np.array(worst, float)) + model.bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["id", "score"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: tuple[int, int] = TRAIN_ROWS) -> list:
    """(text, label) of at most so many labelled documents, clean and toxic, that aren't held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    known = known.where(F.crc32(F.col("_id").cast("string")) % 5 != 0).withColumn("_order", F.xxhash64("_id"))
    # the ids are chosen first: they are few, so the texts needn't be shuffled
    chosen = [known.where(F.col("_label") == label).orderBy("_order", "_id").limit(rows[label]) for label in (0, 1)]
    chosen = F.broadcast(chosen[0].unionAll(chosen[1]))
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = texts.join(chosen, F.col("_doc") == F.col("_id")).select("_order", "_doc", "_text", "_label").collect()
    return [(r._text, r._label) for r in sorted(found, key=lambda r: (r._order, r._doc, r._text))]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: tuple[int, int] = TRAIN_ROWS) -> ToxicityModel | None:
    """A model from the labelled documents that ``training_rows`` finds, fitted on the driver; None without two labels."""
    found = training_rows(docs, labels, id_col, text_col, label_col, rows)
    model = fit([t for t, _ in found], [x for _, x in found])
    del found
    let_go()
    return model


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row, from its whole text alone.

    Null and empty texts score as texts without any word; without a model all scores are 0.
    Texts of any length are scored whole. Equal texts have equal scores; rows that repeat or
    share an id, or have none, have a row each. An empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.transform(mapped, scoring(model), "id long, score double").withColumnRenamed("id", id_col)


def not_toxic(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows whose score is under ``limit``, with all their columns, whatever these are called.

    Null and empty texts, repeated rows, null ids and empty tables are as in ``score``.
    """
    names = docs.columns

    def run(batches):
        judge = scoring(model)
        for batch in batches:
            place = names.index(text_col)
            found = next(judge(iter([pa.RecordBatch.from_arrays([batch.column(place), batch.column(place)], names=["id", "text"])])))
            yield batch.filter(pa.array(np.asarray(found.column(1)) < limit))

    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # names may hold dots
    return plain.transform(mapped, run, plain.schema).toDF(*names)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, as ``score`` says; a null id is
    never held out. Labels that are null, or of documents that aren't there, teach nothing."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
