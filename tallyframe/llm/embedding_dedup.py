"""Embedding near-dedup within labels: PCA-ordered tiled comparison.

Vectors are rotated onto principal axes, so that most of a cosine is known after a few
leading dimensions. Vectors of one label are packed into tiles that are compact along these
axes; two tiles meet only if their boxes are near enough for the threshold. In a meeting the
products of the leading dimensions are accumulated first; by Cauchy-Schwarz the rest adds at
most the product of the suffix norms, and a pair whose bound is under the threshold is not
followed further. Pairs that remain are decided by the cosine of the original components in
double precision, so the axes bear on the speed alone and may be fitted on a sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import mapped, staged, table
from .components import components

THRESHOLD = 0.98
TILE = 2048
#: Tiles' worth of rows that are cut into tiles together, and axes that boxes have.
_CUT_TOGETHER, _BOX_AXES = 8, 8
#: Leading axes of the grids in whose cells tiles find one another.
_GRID_AXES = 3
#: The axes are fitted on so many vectors at most, and so many components in all.
FIT_ROWS, FIT_COMPONENTS = 20_000, 2_000_000
#: Sums of products in double precision are off by less.
_SLACK = 1e-9
_ROWS_AT_ONCE = 512

_TILES = "tile long, grp string, low array<double>, high array<double>, n int, nodes binary, copies binary, vectors binary"
_FOUND = "a long, b long, n long"


def _valid(vec: str, label: str):
    v = F.col(vec)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return F.col(label).isNotNull() & v.isNotNull() & F.coalesce(whole, F.lit(False)) & F.coalesce(some, F.lit(False))


def axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """For each number of components the principal axes within labels, strongest first.

    Fitted on a sample of FIT_ROWS vectors in the order of a hash, or fewer if they are
    long; what is found doesn't depend on it.
    """
    longest = nodes.agg(F.max(F.size("v"))).first()[0]
    if not longest:
        return {}
    rows = max(1, min(FIT_ROWS, FIT_COMPONENTS // longest))
    sample = nodes.select("grp", "v").orderBy(F.xxhash64("v"), "grp").limit(rows).collect()
    out: dict[int, np.ndarray] = {}
    for dims in {len(r.v) for r in sample}:
        x = _units(np.array([r.v for r in sample if len(r.v) == dims]))
        names = np.unique([r.grp for r in sample if len(r.v) == dims], return_inverse=True)[1]
        counts = np.bincount(names)[:, None]
        means = np.zeros((len(counts), dims))
        np.add.at(means, names, x)
        x = x - (means / counts)[names]
        _, vectors = np.linalg.eigh(x.T @ x)
        out[dims] = np.ascontiguousarray(vectors[:, ::-1])
    return out


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow and no underflow of the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _rotated(x: np.ndarray, basis: dict[int, np.ndarray]) -> np.ndarray:
    v = basis.get(x.shape[1])
    return _units(x) if v is None else _units(x) @ v


def _leading(basis):
    """Adds the first coordinate, by which vectors are dealt to tasks."""

    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            first = [float(_rotated(np.array([v], float), basis.value)[0, 0]) for v in rows] if len({len(v) for v in rows}) > 1 else _rotated(np.array(rows, float), basis.value)[:, 0] if rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.float64())], names=["node", "lead"])

    return run


def _cut(u: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of tiles: halved at the median of the widest leading axis until small enough."""
    done, todo = [], [np.arange(len(u))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        axis = np.ptp(u[rows][:, :_BOX_AXES], axis=0).argmax()
        order = rows[np.argsort(u[rows, axis], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return done


def _tiles(basis, tile: int, kind: str):
    """Rows sorted by label to tiles; ``kind`` is the components' type as numpy names it."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0

        def out():
            nonlocal made
            x = np.array(held["v"], float)
            u = _rotated(x, basis.value)[:, :_BOX_AXES]
            for rows in _cut(u, tile):
                values = [
                    part << 33 | made, grp, u[rows].min(axis=0).tolist(), u[rows].max(axis=0).tolist(), len(rows),
                    np.array(held["node"])[rows].astype("<i8").tobytes(), np.array(held["copies"])[rows].astype("<i8").tobytes(), x[rows].astype(kind).tobytes(),
                ]
                made += 1
                kinds = [pa.int64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                names = ["tile", "grp", "low", "high", "n", "nodes", "copies", "vectors"]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

        grp, held = None, {"node": [], "v": [], "copies": []}
        for batch in batches:
            for g, node, copies, v in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held["v"] and (g != grp or len(held["v"]) >= tile * _CUT_TOGETHER):
                    yield from out()
                    held = {"node": [], "v": [], "copies": []}
                grp = g
                held["node"].append(node)
                held["v"].append(v)
                held["copies"].append(copies)
        if held["v"]:
            yield from out()

    return run


def linked(x: np.ndarray, y: np.ndarray, basis: dict[int, np.ndarray], threshold: float, above: bool = False):
    """Row numbers (i, j) of all pairs whose cosine reaches the threshold, a piece of ``x`` at a time.

    ``above``: ``x`` and ``y`` are the same rows and only i < j is wanted.
    """
    ux, uy = _rotated(x, basis), _rotated(y, basis)
    dims = x.shape[1]
    steps = sorted({min(dims, k) for k in (16, 32, dims)})
    tails = {k: [np.sqrt(np.maximum(0, np.einsum("ij,ij->i", u[:, k:], u[:, k:]))) for u in (ux, uy)] for k in steps}
    ex, ey = _units(x), _units(y)
    for low in range(0, len(x), _ROWS_AT_ONCE):
        part = ux[low : low + _ROWS_AT_ONCE]
        k = steps[0]
        sums = part[:, :k] @ uy[:, :k].T
        open_ = sums + np.outer(tails[k][0][low : low + _ROWS_AT_ONCE], tails[k][1]) >= threshold - _SLACK
        if above:
            open_ &= np.arange(len(y))[None, :] > np.arange(low, low + len(part))[:, None]
        for start, end in zip(steps, steps[1:], strict=False):
            if open_.mean() < 0.02:
                break
            sums += part[:, start:end] @ uy[:, start:end].T
            open_ &= sums + np.outer(tails[end][0][low : low + _ROWS_AT_ONCE], tails[end][1]) >= threshold - _SLACK
        i, j = np.nonzero(open_)
        i += low
        good = np.empty(len(i), bool)
        for at in range(0, len(i), 65_536):
            a, b = i[at : at + 65_536], j[at : at + 65_536]
            good[at : at + 65_536] = np.einsum("ij,ij->i", ex[a], ey[b]) >= threshold
        yield i[good], j[good]


def _meet(basis, threshold: float, kind: str):
    """Pairs of tiles to (node, null, vectors linked to it) and edges (node, node, null)."""

    def run(batches):
        for batch in batches:
            for same, n, m, nodes_a, copies_a, vectors_a, nodes_b, copies_b, vectors_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, na, ca = np.frombuffer(vectors_a, kind).reshape(n, -1).astype(float), np.frombuffer(nodes_a, "<i8"), np.frombuffer(copies_a, "<i8")
                y, nb, cb = (x, na, ca) if same else (np.frombuffer(vectors_b, kind).reshape(m, -1).astype(float), np.frombuffer(nodes_b, "<i8"), np.frombuffer(copies_b, "<i8"))
                to_a, to_b = np.zeros(n, np.int64), np.zeros(len(y), np.int64)
                shift = 0 if same else n
                label = np.arange(n + (0 if same else m))
                left, right = [], []
                for i, j in linked(x, y, basis.value, threshold, same):
                    np.add.at(to_a, i, cb[j])
                    np.add.at(to_b, j, ca[i])
                    cuts = np.flatnonzero(np.diff(i, prepend=-1)).tolist() + [len(i)]
                    for low, high in zip(cuts, cuts[1:], strict=False):
                        me, others = int(i[low]), j[low:high] + shift
                        roots, first = np.unique(label[others], return_index=True)
                        apart = roots != label[me]
                        if apart.any():
                            left += [na[me]] * int(apart.sum())
                            right += nb[others[first[apart]] - shift].tolist()
                            merged = np.append(roots, label[me])
                            label[np.isin(label, merged)] = merged.min()
                if not left:
                    continue
                counted = [(na, to_a + to_b)] if same else [(na, to_a), (nb, to_b)]
                ids, sums = (np.concatenate([c[k] for c in counted]) for k in (0, 1))
                ids, sums = ids[sums > 0], sums[sums > 0]
                a = pa.array(np.concatenate([ids, np.array(left, np.int64)]))
                b = pa.array([None] * len(ids) + right, pa.int64())
                yield pa.RecordBatch.from_arrays([a, b, pa.array(sums.tolist() + [None] * len(left), pa.int64())], names=["a", "b", "n"])

    return run


def _reach(threshold: float) -> float:
    return float(np.sqrt(2 - 2 * threshold + _SLACK)) or 1e-9


def tiles_in_reach(box: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of different tiles of a label, each once, whose boxes (tile, grp, low, high) may be near, with both boxes.

    Each box has one cell, that of its lowest corner, in a grid as coarse as the box is wide; a box looks into the
    few cells, of its own grid and of coarser ones, in which the corner of a box may lie that is near it. So a
    pair is met once at most, however wide the boxes are.
    """
    reach = _reach(threshold)
    levels = max(1, int(np.ceil(np.log2(max(2.0, 2.0 / reach)))) + 1)  # coordinates of unit vectors lie between -1 and 1
    edge = lambda c, k: F.coalesce(F.get(c, F.lit(k)), F.lit(0.0))
    wide = F.greatest(*[edge("high", k) - edge("low", k) for k in range(_GRID_AXES)])
    own = F.least(F.greatest(F.ceil(F.log2(F.greatest(wide, F.lit(reach)) / reach)), F.lit(0)), F.lit(levels)).cast("int")
    placed = box.withColumn("level", own)
    size = lambda level: reach * F.pow(F.lit(2.0), level)
    sides = {s: placed.select(*[F.col(c).alias(f"{c}_{s}") for c in placed.columns]) for s in "ab"}
    a = sides["a"].withColumn("level", F.explode(F.sequence(F.col("level_a"), F.lit(levels))))
    b = sides["b"].withColumn("level", F.col("level_b"))
    for k in range(_GRID_AXES):
        low, high = F.floor((edge("low_a", k) - reach) / size(F.col("level"))) - 1, F.floor((edge("high_a", k) + reach) / size(F.col("level")))
        low, high = F.greatest(low, F.floor(F.lit(-1.001) / size(F.col("level")))), F.least(high, F.floor(F.lit(1.001) / size(F.col("level"))))
        a = a.withColumn(f"c{k}", F.explode(F.sequence(low, high)))
        b = b.withColumn(f"c{k}", F.floor(edge("low_b", k) / size(F.col("level"))))
    met = a.join(b.withColumnRenamed("grp_b", "grp_a"), ["grp_a", "level", *[f"c{k}" for k in range(_GRID_AXES)]])
    once = (F.col("level_a") < F.col("level_b")) | (F.col("tile_a") < F.col("tile_b"))
    return met.where(once)


def near_tiles(box: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(tile_a, tile_b): the pairs of different tiles of a label whose boxes are near enough for the threshold."""
    gap = F.zip_with(F.arrays_zip("low_a", "high_a"), F.arrays_zip("low_b", "high_b"), lambda p, q: F.greatest(F.lit(0.0), p["low_a"] - q["high_b"], q["low_b"] - p["high_a"]))
    near = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= 2 - 2 * threshold + _SLACK
    return tiles_in_reach(box, threshold).where(near).select("tile_a", "tile_b")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE
) -> DataFrame:
    """Each row's id, n_links, component_id and kept.

    Vectors with equal, non-null labels and equally many components are linked from a
    cosine of ``threshold`` on. Vectors that are null, empty, zero, or hold null or
    non-finite components are linked with nothing: n_links 0, component_id their own id.
    Equal vectors, told by 128 bits of hashes, are compared once. Rows that repeat, or share an id, are
    vectors of their own; null ids count as larger than any. A cosine of just the threshold links.
    Vectors may have any number of components. An empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    spark = vectors.sparkSession
    # single-precision components stay so until they are compared: half the bytes, the same numbers
    single = isinstance(vectors.select(vec_col).schema[0].dataType.elementType, FloatType)
    kind, stored = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast(stored).alias("v"))
    rows = rows.withColumn("grp", F.when(_valid("v", "label"), F.concat(F.size("v").cast("string"), F.lit(":"), F.col("label").cast("string"))))
    # vectors are recognised by 128 bits of hashes, so that they themselves are shuffled as little as may be
    keyed = rows.where("grp IS NOT NULL").select("id", "grp", "v", F.xxhash64("v").alias("k0"), F.xxhash64(F.lit("again"), "v").alias("k1"))
    nodes = keyed.groupBy("grp", "k0", "k1").agg(F.first("v").alias("v"), F.min("id").alias("first"), F.count("*").alias("copies"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")  # written: the numbers stay
    basis = spark.sparkContext.broadcast(axes(nodes))
    lead = staged(nodes.select("node", "v").transform(mapped, _leading(basis), "node long, lead double"), "leads")
    dealt = nodes.join(lead, "node").repartitionByRange("grp", "lead").sortWithinPartitions("grp", "lead")
    tiles = staged(dealt.select("grp", "node", "copies", "v").transform(mapped, _tiles(basis, tile, kind), _TILES), "tiles")

    pairs = staged(near_tiles(tiles.select("tile", "grp", "low", "high"), threshold), "tile-pairs")
    body = tiles.select("tile", "n", "nodes", "copies", "vectors")
    for side in "ab":
        pairs = pairs.join(body.select(*[F.col(c).alias(f"{c}_{side}") for c in body.columns]), f"tile_{side}")
    parts = [f"{c}_{s}" for s in "ab" for c in ("nodes", "copies", "vectors")]
    # a tile meets itself where it is read
    itself = body.select(F.lit(True).alias("same"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), *[(F.col(c[:-2]) if c.endswith("a") else F.lit(None).cast("binary")).alias(c) for c in parts])
    meetings = itself.unionByName(pairs.select(F.lit(False).alias("same"), "n_a", "n_b", *parts))
    found = staged(meetings.transform(mapped, _meet(basis, threshold, kind), _FOUND), "links")

    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    grouped = components(found.where("b IS NOT NULL").select("a", "b"))
    placed = nodes.select("grp", "k0", "k1", "node", "first", "copies").join(counts, "node", "left").join(grouped, "node", "left")
    placed = placed.select("grp", "k0", "k1", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    placed = staged(placed, "placed")
    least = staged(placed.groupBy("root").agg(F.min("first").alias("least")), "roots")
    known = placed.join(least, "root").select("grp", "k0", "k1", "n_links", "least")
    out = keyed.drop("v").join(known, ["grp", "k0", "k1"]).select("id", "n_links", F.col("least").alias("component_id"))
    alone = rows.where("grp IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionAll(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector. What is null, zero or not finite is linked with nothing, vectors that repeat count each,
    null ids come last, an empty table gives no rows: see ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
