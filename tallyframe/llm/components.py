"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, mapped, staged

#: Edges that a task reduces to a forest before the rounds begin.
FOREST_EDGES = 1 << 19


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node) that connect what the edges connect: fewer than there are nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    low, high = np.minimum(ends[: len(a)], ends[len(a) :]), np.maximum(ends[: len(a)], ends[len(a) :])
    up = np.arange(len(nodes))
    while True:
        x, y = up[low], up[high]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(up, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up[up] != up).any():
            up = up[up]
    hung = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[hung], nodes[up[hung]]


def _forests(batches):
    held: list[list[np.ndarray]] = [[], []]
    size = 0

    def out():
        a, b = forest(*(np.concatenate(x) for x in held))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for k in range(2):
            held[k].append(batch.column(k).to_numpy(zero_copy_only=False))
        size += batch.num_rows
        if size > 2 * FOREST_EDGES:
            yield out()
            held, size = [[], []], 0
    if size:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) from edges (a, b): the smallest node that each can reach.

    Nodes without edges don't appear. Alternates two steps until nothing changes, each
    ending in a written table: every node's larger neighbours, then its smaller ones, are
    hung on the smallest node of its neighbourhood. Minima are aggregated before the
    shuffle and written, so that the join with them is one that Spark can split or
    broadcast when a node has very many neighbours. Takes about the logarithm of the
    longest path in rounds. Before the first, tasks of ``FOREST_EDGES`` edges each reduce theirs to
    forests, so that a crowd of nodes with links of every kind doesn't come with all of them.
    """
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    whole = staged(ends, "links")
    parts = max(1, -(-whole.count() // FOREST_EDGES))
    held = staged(whole.repartition(parts).transform(mapped, _forests, "a long, b long").distinct(), "edges")
    drop_staged(whole)
    while True:
        both = held.unionAll(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, "edges")
        drop_staged(least)
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        small = staged(small, "edges")
        drop_staged(least)
        drop_staged(large)
        # a forest of stars: no node that others hang on hangs on another
        hung = small.select(F.col("b").alias("root")).distinct().join(small.select(F.col("a").alias("root")), "root", "left_semi")
        several = small.groupBy("a").count().where("count > 1")
        done = hung.isEmpty() and several.isEmpty()
        drop_staged(held)
        held = small
        if done:
            break
    roots = held.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return held.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
