"""Tiles of vectors find those that are near, each pair once, however wide they are."""

from __future__ import annotations

import numpy as np
import pytest

from tallyframe.llm import embedding_dedup

BOXES = "tile long, grp string, low array<double>, high array<double>"


def boxes(u: np.ndarray, tile: int):
    parts = [u[rows][:, : embedding_dedup._BOX_AXES] for rows in embedding_dedup._cut(u, tile)]
    return [(k, "one", x.min(axis=0).tolist(), x.max(axis=0).tolist()) for k, x in enumerate(parts)]


def pairs_near(rows, threshold):
    low, high = (np.array([r[k] for r in rows]) for k in (2, 3))
    gap = np.maximum(0, np.maximum(low[:, None] - high[None], low[None] - high[:, None]))
    near = (gap**2).sum(axis=2) <= 2 - 2 * threshold + 1e-9
    return {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if near[i, j]}


@pytest.mark.parametrize(("stretch", "threshold"), [(1.0, 0.98), (4.0, 0.98), (4.0, 0.9999), (1.0, -0.5)])
def test_wide_tiles(spark, stretch, threshold):
    """20,000 vectors that have no near neighbours: no more candidates than pairs of tiles."""
    r = np.random.default_rng(3)
    x = r.standard_normal((20_000, 32)) * np.r_[np.full(3, stretch), np.ones(29)]
    rows = boxes(x / np.linalg.norm(x, axis=1)[:, None], 32 if threshold > 0.9 else 512)
    frame = spark.createDataFrame(rows, BOXES).repartition(4)
    met = [tuple(sorted(p)) for p in embedding_dedup.tiles_in_reach(frame, threshold).select("tile_a", "tile_b").collect()]
    assert len(met) == len(set(met)) <= len(rows) * (len(rows) - 1) // 2
    found = {tuple(sorted(p)) for p in embedding_dedup.near_tiles(frame, threshold).collect()}
    assert found == pairs_near(rows, threshold)


def test_narrow_and_wide_tiles_together(spark):
    """Clusters make narrow boxes, which look at few others; a wide one among them is still met."""
    r = np.random.default_rng(5)
    centres = r.standard_normal((900, 16))
    centres = centres / np.linalg.norm(centres, axis=1)[:, None]
    rows = [(k, "one", (c[:8] - 0.002).tolist(), (c[:8] + r.random(8) * 0.004).tolist()) for k, c in enumerate(np.repeat(centres, 2, axis=0))]
    rows += [(len(rows) + k, "one", (-np.ones(8) * s).tolist(), (np.ones(8) * s).tolist()) for k, s in enumerate((0.05, 0.3, 1.0))]
    rows += [(len(rows), "other", [0.0] * 8, [0.0] * 8), (len(rows) + 1, "short", [0.5], [0.6]), (len(rows) + 2, "short", [0.595], [0.65])]
    frame = spark.createDataFrame(rows, BOXES).repartition(4)
    met = embedding_dedup.tiles_in_reach(frame, 0.9999).count()
    assert met < 0.02 * len(rows) ** 2 / 2
    same = [r for r in rows if r[1] == "one"]
    found = {tuple(sorted(p)) for p in embedding_dedup.near_tiles(frame, 0.9999).collect()}
    assert found == pairs_near(same, 0.9999) | {(len(rows) - 2, len(rows) - 1)}


def test_one_label_in_many_wide_tiles(spark):
    """Against brute force: links over tile borders, where boxes are wide."""
    r = np.random.default_rng(7)
    x = r.standard_normal((600, 12)).astype(np.float32)
    x[300:400] = x[:100] + r.standard_normal((100, 12)).astype(np.float32) * 0.08
    x[400:430] = x[:30] * 2  # the same direction
    x[430:440] = x[:10]  # the same vector
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    got = {g.vec_id: (g.n_links, g.component_id) for g in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3), tile=16).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (u @ u.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    least = list(range(len(x)))
    for _ in range(20):
        least = [min([least[k], *(least[j] for j in np.flatnonzero(near[k]))]) for k in range(len(x))]
    assert got == {k: (int(near[k].sum()), least[k]) for k in range(len(x))}
