"""How five document filters overlap: what each removes, at every step of every order.

A document is the set of filters that it fails, a number under 32. A table of 32 x 120 has,
for each such set and each order of the filters, the step at which the document goes, so a
document need not be run through any order. Arrow batches are counted by part and set, the
sets are looked up in the table, and the removals are added up by part, order and step, for
all documents and for those of each label; the tasks' partial arrays are summed.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WS_CLASS, mapped, staged, table

FILTERS = "ABCDE"
STEPS = len(FILTERS)
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
#: Fewest words; least per cent of different words; most per cent of capitals; marks that aren't allowed.
LEAST_WORDS, LEAST_DIFFERENT, MOST_CAPITALS, MARKS = 50, 65, 5, "[#$%&*|]"
#: A task hands on what it has counted once it holds so many parts.
PARTS_HELD = 512
_SUMS = ("removed", "good_lost", "toxic_lost", "fails", "alone")
_PARTIAL = "part string, filter_order string, documents long, " + ", ".join(f"{c} array<long>" for c in _SUMS)


def first_failures() -> np.ndarray:
    """32 x 120: the step, from 0, at which a document that fails this set of filters goes; 5 if it stays."""
    out = np.full((1 << STEPS, len(ORDERS)), STEPS)
    sets = np.arange(1 << STEPS)
    for k, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            out[(sets >> FILTERS.index(order[step]) & 1) == 1, k] = step
    return out


def failures(text: Column) -> Column:
    """The filters A to D that a text fails, as bits."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WS_CLASS), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    of_words = lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("u"))
    counts = F.transform(F.array(words), of_words)[0]  # the words are made once
    few = F.transform(F.array(counts), lambda c: F.when(c["n"] < LEAST_WORDS, 1).otherwise(0) + F.when(100 * c["u"].cast("long") < LEAST_DIFFERENT * c["n"].cast("long"), 2).otherwise(0))[0]
    return few + F.when(100 * capitals.cast("long") > MOST_CAPITALS * F.char_length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike(MARKS), 8).otherwise(0)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, failed (the filters failed, as bits), good, toxic: a row for each document.

    A text that a smaller id has too fails E; ids that are null count as larger than any
    other, and among themselves as equal, as are rows that share an id. Null text is empty,
    a null part too. Of a document's labels any that says 1 counts; documents without labels,
    and those without id, have none. Texts are compared by their SHA-256.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("_sha"), failures(text).alias("_failed"),
    )
    slim = staged(slim, "audit-rows")
    # of texts that stand alone nothing is kept, and what is joined is split where a text has many copies
    copies = slim.groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    copies = staged(copies.select("_sha", "_first"), "audit-copies")
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_of")).agg(is_one("quality").alias("_good"), is_one("toxic").alias("_toxic"))
    known = staged(known, "audit-labels")
    joined = slim.join(copies, "_sha", "left").join(known, F.col("_id") == F.col("_of"), "left")
    copied = F.coalesce(F.col("_first").isNotNull() & (F.col("_id").isNull() | (F.col("_first") < F.col("_id"))), F.lit(False))
    label = lambda c: F.coalesce(F.col(c), F.lit(False))
    return joined.select("part", (F.col("_failed") + F.when(copied, 16).otherwise(0)).cast("int").alias("failed"), label("_good").alias("good"), label("_toxic").alias("toxic"))


def _partial(parts: list[str], counts: np.ndarray):
    """Partial arrays of parts from ``counts``: parts x labels (all, good, toxic) x sets of filters."""
    first = first_failures()
    cells = np.arange(len(ORDERS))[None, :] * (STEPS + 1) + first  # set, order -> order and step
    width = len(ORDERS) * (STEPS + 1)
    at = (np.arange(len(parts))[:, None, None] * width + cells[None]).ravel()
    gone = [np.bincount(at, np.repeat(counts[:, k], len(ORDERS), axis=1).ravel(), len(parts) * width).reshape(-1, len(ORDERS), STEPS + 1)[:, :, :STEPS] for k in range(3)]
    bits = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS)) & 1
    fails = counts[:, 0] @ bits
    alone = counts[:, 0][:, 1 << np.arange(STEPS)]
    letters = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    sums = [*gone, fails[:, letters], alone[:, letters]]
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).reshape(-1).astype(np.int64)), STEPS).cast(pa.list_(pa.int64())) for x in sums]
    n = len(ORDERS)
    heads = [pa.array(parts, pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), n))), pa.array(list(ORDERS) * len(parts)), pa.array(np.repeat(counts[:, 0].sum(axis=1), n).astype(np.int64))]
    return pa.RecordBatch.from_arrays([*heads, *lists], names=["part", "filter_order", "documents", *_SUMS])


def _removals(batches):
    """Rows (part, failed, good, toxic) to the partial arrays of each part that the task has seen."""
    place: dict[str, int] = {}
    counts = np.zeros((0, 3, 1 << STEPS), np.int64)
    for batch in batches:
        part = batch.column(0).dictionary_encode()
        own = np.array([place.setdefault(p, len(place)) for p in part.dictionary.to_pylist()], np.int64)[part.indices.to_numpy()]
        if len(place) > len(counts):
            counts = np.concatenate([counts, np.zeros((len(place) - len(counts), 3, 1 << STEPS), np.int64)])
        cell = own * (1 << STEPS) + batch.column(1).to_numpy()
        for k, rows in enumerate((slice(None), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False))):
            counts[:, k] += np.bincount(cell[rows], minlength=len(place) << STEPS).reshape(-1, 1 << STEPS)
        if len(place) >= PARTS_HELD:
            yield from (_partial(names, counts[low : low + len(names)]) for low, names in _blocks(list(place)))
            place, counts = {}, counts[:0]
    if place:
        yield from (_partial(names, counts[low : low + len(names)]) for low, names in _blocks(list(place)))


def _blocks(names: list[str], size: int = 64):
    return ((low, names[low : low + size]) for low in range(0, len(names), size))


def audit(rows: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from ``judged`` rows.

    Columns: part, filter_order, step from 1, and counts of the part's documents: kept after
    the step, removed at it, redundant (fail its filter, but went before), unique_fails (fail
    its filter alone), good_lost and toxic_lost (removed at it, by label), shapley (what its
    filter removes over all orders). Counts are of rows: rows that repeat count each. Steps
    that remove nothing have rows too. An empty table has no parts and gives no rows.
    """
    partial = rows.select("part", "failed", "good", "toxic").transform(mapped, _removals, _PARTIAL)
    each = [F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in _SUMS for k in range(STEPS)]
    whole = partial.groupBy("part", "filter_order").agg(F.sum("documents").alias("documents"), *each)
    gone = lambda k: sum((F.col(f"removed{j}") for j in range(k + 1)), F.lit(0))
    steps = [
        F.struct(
            F.lit(k + 1).alias("step"), F.substring("filter_order", k + 1, 1).alias("_filter"), (F.col("documents") - gone(k)).alias("kept"), F.col(f"removed{k}").alias("removed"),
            (F.col(f"fails{k}") - F.col(f"removed{k}")).alias("redundant"), F.col(f"alone{k}").alias("unique_fails"),
            F.col(f"good_lost{k}").alias("good_lost"), F.col(f"toxic_lost{k}").alias("toxic_lost"),
        )
        for k in range(STEPS)
    ]
    flat = whole.select("part", "filter_order", F.inline(F.array(*steps)))
    return flat.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_filter"))).drop("_filter")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents by source, as ``judged`` and ``audit`` say."""
    return audit(judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d
), f AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first IS NOT NULL AND (doc_id IS NULL OR first < doc_id) THEN 'E' ELSE '' END AS fails
  FROM w
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), g AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.c NOT IN (b.c, c.c, d.c, e.c) AND b.c NOT IN (c.c, d.c, e.c) AND c.c NOT IN (d.c, e.c) AND d.c <> e.c
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), h AS (
  SELECT fails, filter_order, min(step) AS at FROM (SELECT DISTINCT fails FROM g), s WHERE contains(fails, f) GROUP BY fails, filter_order
), r AS (
  SELECT g.part, s.filter_order, s.step, s.f, sum(n) AS n,
    sum(CASE WHEN h.at = s.step THEN n ELSE 0 END) AS removed, sum(CASE WHEN h.at < s.step AND contains(g.fails, s.f) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN g.fails = s.f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN h.at = s.step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN h.at = s.step THEN toxic ELSE 0 END) AS toxic_lost
  FROM g CROSS JOIN s LEFT JOIN h ON h.fails = g.fails AND h.filter_order = s.filter_order GROUP BY g.part, s.filter_order, s.step, s.f
)
SELECT part, filter_order, step, CAST(n - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step) AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
