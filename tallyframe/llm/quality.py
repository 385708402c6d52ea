"""Document quality: random Fourier features over statistics, ridge scores, isotonic calibration.

Statistics of each whole text are written once. Those of labelled documents, standardised, go
through ``FEATURES`` random cosines, whose products approximate a Gaussian kernel; tasks add up
the normal equations of their rows, and the sums of a few hundred rows square are solved on the
driver. The equations are kept apart by fold, so that leaving a fold out is a subtraction:
each labelled document gets a score from a model that hasn't seen it. These scores, counted in
``BINS``, are made monotone (pool adjacent violators), which turns a ridge score into the
share of good documents among those that score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, drop_staged, mapped, staged, table

FEATURES, BANDWIDTH, RIDGE, FOLDS, SEED = 256, 8.0, 1e-3, 4, 11
BINS, BIN_FROM, BIN_TO = 4096, -0.5, 1.5
#: Statistics are cut at so many standard deviations.
FARTHEST = 4.0
#: So much of a score is the ridge score itself, so that what isotonic steps make equal keeps its order.
RAW_SHARE = 0.01

STATISTICS = (
    "log_words", "log_chars", "word_length", "word_spread", "longest_word", "short_words", "different_words", "commonest_word", "different_pairs", "lines_a_word", "different_lines",
    "capitals", "digits", "blanks", "not_ascii", "stops", "commas", "exclaims", "marks", "other_marks", "entropy", "begins_large", "all_large", "ends_marked", "words_a_stop",
)
_KINDS = {
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "blanks": b" \t\n\x0b\x0c\r", "stops": b".", "commas": b",;:", "exclaims": b"!?",
    "marks": b"#$%&*|@^~<>{}[]\\", "other_marks": b"\"'()-_/+=`", "small": b"abcdefghijklmnopqrstuvwxyz",
}
_IS = {name: np.isin(np.arange(256), list(kind)) for name, kind in _KINDS.items()}
_BYTES = np.column_stack(list(_IS.values())).astype(float)
_MARKED = _IS["marks"] | _IS["other_marks"] | _IS["exclaims"]


def statistics(raw: bytes) -> list[float]:
    """``STATISTICS`` of a text in UTF-8; all finite, also for a text without words."""
    each = np.frombuffer(raw, np.uint8)
    seen = np.bincount(each, minlength=256)
    chars = int(seen.sum() - seen[0x80:0xC0].sum())
    blank = _IS["blanks"][each]
    begins, ends = np.flatnonzero(~blank & np.r_[True, blank[:-1]]), np.flatnonzero(~blank & np.r_[blank[1:], True])
    words, lines = raw.split(), raw.split(b"\n")
    n, c = max(1, len(words)), max(1, chars)
    place: dict[bytes, int] = {}
    codes = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
    lengths = ends - begins + 1 if words else np.zeros(1)
    large, small = (np.add.reduceat(_IS[kind][each], begins, dtype=np.int64) if words else np.zeros(1) for kind in ("capitals", "small"))
    often = int(np.bincount(codes).max()) if words else 0
    pairs = len(np.unique(codes[:-1] * len(place) + codes[1:])) if len(words) > 1 else 1
    share = seen[seen > 0] / max(1, len(raw))
    kinds = dict(zip(_KINDS, (seen @ _BYTES / c).tolist(), strict=True))
    return [
        np.log1p(len(words)), np.log1p(chars), lengths.mean(), lengths.std(), np.log1p(lengths.max()), (lengths <= 3).sum() / n, len(place) / n, often / n, pairs / max(1, n - 1),
        len(lines) / n, len(set(lines)) / len(lines), kinds["capitals"], kinds["digits"], kinds["blanks"], seen[0xC0:].sum() / c, kinds["stops"], kinds["commas"], kinds["exclaims"], kinds["marks"],
        kinds["other_marks"], float(-(share * np.log(share)).sum()), _IS["capitals"][each[begins]].sum() / n, ((large > 1) & (small == 0)).sum() / n, _MARKED[each[ends]].sum() / n,
        np.log1p(n / (1 + int(seen[ord(".")]))),
    ]


def _statistics(batches):
    for batch in batches:
        found = [list(map(float, statistics(x or b""))) for x in binary(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["id", "stats"])


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and stats of each row, from its whole text; null text is empty, null ids stay null."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).transform(mapped, _statistics, "id long, stats array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # FEATURES and a constant
    steps: np.ndarray  # ridge scores, ascending
    levels: np.ndarray  # shares of good documents at them

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return features(stats, self.mean, self.spread) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.ridge(stats)
        return (1 - RAW_SHARE) * np.interp(raw, self.steps, self.levels) + RAW_SHARE * np.clip(raw, 0, 1)


def features(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Rows of ``FEATURES`` cosines, whose products are near exp(-|x - y|^2 / 2 b^2), and a constant."""
    r = np.random.default_rng(SEED)
    directions, phases = r.standard_normal((len(mean), FEATURES)) / BANDWIDTH, r.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip((stats - mean) / spread, -FARTHEST, FARTHEST)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ directions + phases), np.ones((len(x), 1))])


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _equations(mean: np.ndarray, spread: np.ndarray):
    """Rows (fold, good, stats) to the task's sum of products, a row for each fold and line of its matrix."""

    def run(batches):
        size, sums = FEATURES + 2, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, good = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(float)
            z = np.column_stack([features(_matrix(batch.column(2)), mean, spread), good])
            for k in np.unique(fold).tolist():
                own = z[fold == k]
                sums[k] = sums.get(k, 0) + own.T @ own
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), size).cast(pa.list_(pa.float64()))], names=["fold", "line", "sums"]
            )

    return run


def _solved(sums: np.ndarray) -> np.ndarray:
    """Ridge weights from a matrix of products whose last line and column are those of the labels. The constant isn't held down."""
    x, y, rows = sums[:-1, :-1], sums[:-1, -1], sums[-2, -2]
    keep = np.full(len(x), RIDGE * max(1.0, rows))
    keep[-1] = 1e-9
    return np.linalg.solve(x + np.diag(keep), y)


def _left_out(mean: np.ndarray, spread: np.ndarray, weights: dict[int, np.ndarray]):
    """Rows (fold, good, stats) to (bin, good, raw) by the model that left the fold out."""

    def run(batches):
        for batch in batches:
            fold, z = batch.column(0).to_numpy(), features(_matrix(batch.column(2)), mean, spread)
            raw = np.zeros(len(fold))
            for k in np.unique(fold).tolist():
                raw[fold == k] = z[fold == k] @ weights[k]
            at = np.clip((raw - BIN_FROM) / (BIN_TO - BIN_FROM) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1), pa.array(raw)], names=["bin", "good", "raw"])

    return run


def isotonic(x: np.ndarray, good: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean x and share of good of the blocks that pooling adjacent violators leaves, for ascending x.
    Half a document of each label is added to a block, so no share is 0 or 1."""
    blocks: list[list[float]] = []
    for a, g, n in zip((x * rows).tolist(), good.tolist(), rows.tolist(), strict=True):
        blocks.append([a, g, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    a, g, n = np.array(blocks).T
    return a / n, np.maximum.accumulate((g + 0.5) / (n + 1))


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel | float:
    """A model from all labelled rows of ``described`` that aren't held out (CRC-32 of the id not 2 modulo 4).

    Of several labels of an id the highest counts; null labels, null ids and labels without a
    document teach nothing. With one label only the model is the share of good documents, and
    without any one half. Rows that repeat count each.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("good"))
    known = known.where(F.crc32(F.col("_id").cast("string")) % 4 != 2)
    rows = stats.join(known, F.col("id") == F.col("_id")).select((F.pmod(F.xxhash64("id"), F.lit(FOLDS))).cast("int").alias("fold"), "good", "stats")
    rows = staged(rows, "quality-rows")
    each = [f(F.col("stats")[k]) for f in (F.avg, F.stddev_pop) for k in range(len(STATISTICS))]
    n, good, *moments = rows.agg(F.count("*"), F.sum("good"), *each).first()
    if not n or good in (0, n):
        drop_staged(rows)
        return (good + 0.5) / (n + 1) if n else 0.5
    mean, spread = np.array(moments[: len(STATISTICS)]), np.array(moments[len(STATISTICS) :])
    spread = np.where(spread > 1e-9, spread, 1.0)

    partial = rows.transform(mapped, _equations(mean, spread), "fold int, line int, sums array<double>")
    summed = partial.groupBy("fold", "line").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).collect()
    of_fold = {k: np.zeros((FEATURES + 2, FEATURES + 2)) for k in range(FOLDS)}
    for r in summed:
        of_fold[r.fold][r.line] = r.sums
    whole = sum(of_fold.values())
    scored = rows.transform(mapped, _left_out(mean, spread, {k: _solved(whole - x) for k, x in of_fold.items()}), "bin int, good int, raw double")
    bins = scored.groupBy("bin").agg(F.avg("raw").alias("x"), F.sum("good").alias("good"), F.count("*").alias("rows")).orderBy("bin").collect()
    drop_staged(rows)
    steps, levels = isotonic(*(np.array([r[k] for r in bins], float) for k in (1, 2, 3)))
    return QualityModel(mean, spread, _solved(whole), steps, levels)


def score(stats: DataFrame, model: QualityModel | float) -> DataFrame:
    """id and score (0 to 1) of each row of ``described``; equal texts score alike."""

    def run(batches):
        for batch in batches:
            found = np.full(batch.num_rows, model) if isinstance(model, float) else model.score(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["id", "score"])

    return stats.select("id", "stats").transform(mapped, run, "id long, score double")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts score by the statistics of an empty text; rows that repeat or share
    an id have a row each, a null id is never held out; an empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    stats = staged(described(table(spark, sf_dir, "documents")), "quality-statistics")
    found = score(stats, train(stats, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 4 == 2, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
