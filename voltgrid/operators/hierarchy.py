"""Sums over all partners, and nearest partners, by a hierarchy of square tiles over both sides.

Level l cuts the square around all points into 2^l by 2^l tiles. Two tiles of one level that touch are opened into their
children while one of them holds many points; children that don't touch are *far*. Far tiles see each other through
Chebyshev points: a smooth kernel between them is a product of polynomials, whose error falls by a factor of 5.8 per degree
at this distance. Tiles that still touch when both are small are compared point by point. Every tile meets a bounded
number of tiles of its level, so work grows like the number of points, no tile is a hot key, and a dense spot only
means deeper levels there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize

#: Points per side of the Chebyshev grid of a tile: the interpolation error of a far pair is near 5.8^-ORDER.
ORDER = 10
#: Points that a tile holds when it is opened no more; the deepest level; the level where pairs start.
LEAF, DEEPEST, START = 256, 24, 2
#: Up to so many pairs, one tile on each side is compared point by point: the hierarchy saves nothing there.
FEW = 1 << 24


@lru_cache
def _nodes(order: int) -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev points in [-1, 1] and the polynomials T_1..T_(order-1) there."""
    t = np.cos((2 * np.arange(order) + 1) * math.pi / (2 * order))
    return t, np.cos(np.arange(1, order)[:, None] * np.arccos(t))


def _basis(x: np.ndarray, order: int) -> np.ndarray:
    """Value at ``x`` (in [-1, 1]) of the polynomial that is 1 at one Chebyshev point and 0 at the others: (points, order)."""
    _, tk = _nodes(order)
    return 1 / order + 2 / order * np.cos(np.arccos(np.clip(x, -1, 1))[:, None] * np.arange(1, order)) @ tk


def tile_basis(x: np.ndarray, y: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Weights of points, in tile coordinates from -1 to 1, on the tile's Chebyshev grid: (points, order^2)."""
    return (_basis(x, order)[:, :, None] * _basis(y, order)[:, None, :]).reshape(len(x), -1)


def tile_points(order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    t = _nodes(order)[0]
    return np.repeat(t, order), np.tile(t, order)


class Frame:
    """The square around all points: the lower corner and the edge of level 0; three numbers from one aggregate."""

    def __init__(self, *sides: DataFrame) -> None:
        ends = [s.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first() for s in sides]
        ends = [e for e in ends if e[0] is not None] or [(0.0, 0.0, 0.0, 0.0)]
        self.lat, self.lon = min(e[0] for e in ends), min(e[2] for e in ends)
        self.edge = max(max(e[1] for e in ends) - self.lat, max(e[3] for e in ends) - self.lon, 1e-9) * (1 + 1e-9)

    def cell(self, value: Column, origin: float) -> Column:
        return F.floor((value - origin) / self.edge * (1 << DEEPEST)).cast("long")

    def tiled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"cx": self.cell(F.col("lon"), self.lon), "cy": self.cell(F.col("lat"), self.lat)})

    def centre(self, level: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Middle (lat, lon) and half edge of tiles."""
        half = self.edge / 2.0 ** level / 2
        return self.lat + (2 * y + 1) * half, self.lon + (2 * x + 1) * half, half


def counts(cells: DataFrame, level: int) -> DataFrame:
    """(x, y, n) of the tiles of a level that hold points, from (cx, cy, n) of the deepest."""
    up = lambda c: F.shiftright(c, DEEPEST - level).alias(c[1:])
    return cells.groupBy(up("cx"), up("cy")).agg(F.sum("n").alias("n"))


def _touch(dx: Column, dy: Column) -> Column:
    return (F.abs(dx) <= 1) & (F.abs(dy) <= 1)


def pairs(targets: DataFrame, sources: DataFrame, frame: Frame, leaf: int = LEAF, widest: float | None = None, nothing: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Far and near pairs of tiles (level, x, y, sx, sy) that cover each pair of a target and a source once.

    ``targets`` and ``sources`` are (cx, cy, n). Tiles wider than ``widest`` are no far pair, unless they lie ``nothing``
    or more apart. Pairs of one level are found from those opened in the level before by joins on tiles.
    """
    far, near = [], []
    sizes = [s.agg(F.sum("n")).first()[0] or 0 for s in (targets, sources)]
    start = START
    if sizes[0] * sizes[1] <= FEW and leaf >= LEAF:
        start, leaf = 0, max(sizes)
    a, b = (counts(s, start).select(*[F.col(c).alias(p + c) for c in ("x", "y", "n")]) for s, p in ((targets, ""), (sources, "s")))
    now = materialize(a.crossJoin(F.broadcast(b)).withColumn("level", F.lit(start)))  # at most 16 tiles on each side
    for level in range(start, DEEPEST + 1):
        edge = frame.edge / 2.0 ** level
        dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
        apart = ~_touch(dx, dy)
        if widest is not None and edge > widest:
            gap = F.greatest(F.abs(dx), F.abs(dy)) - 1
            apart = apart & (gap * edge >= nothing) if nothing is not None else F.lit(False)
        small = (F.greatest("n", "sn") <= leaf) | F.lit(level == DEEPEST)
        keys = ["level", "x", "y", "sx", "sy"]
        far.append(now.filter(apart).select(*keys))
        near.append(now.filter(~apart & small).select(*keys))
        opened = now.filter(~apart & ~small).select("x", "y", "sx", "sy")
        if level == DEEPEST or opened.isEmpty():
            break
        up = lambda c: F.shiftright(c, 1)
        one = counts(targets, level + 1).select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("n").alias("an"), up("x").alias("x"), up("y").alias("y"))
        two = counts(sources, level + 1).select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("n").alias("bn"), up("x").alias("sx"), up("y").alias("sy"))
        now = materialize(opened.join(one, ["x", "y"]).join(two, ["sx", "sy"]).select(F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("an").alias("n"),
                          F.col("bx").alias("sx"), F.col("by").alias("sy"), F.col("bn").alias("sn"), F.lit(level + 1).alias("level")))
    union = lambda some: materialize(_all(some))
    return union(far), union(near)


def _all(some: Sequence[DataFrame]) -> DataFrame:
    out = some[0]
    for s in some[1:]:
        out = out.unionByName(s)
    return out


def _in_tiles(df: DataFrame, tiles: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``df`` (cx, cy) beside each tile (level, x, y) of ``tiles`` that holds them; levels are the few that occur."""
    levels = sorted(r["level"] for r in tiles.select("level").distinct().collect())
    at = F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.shiftright("cx", DEEPEST - v).alias("x"), F.shiftright("cy", DEEPEST - v).alias("y")) for v in levels])) if levels else F.explode(F.array().cast("array<struct<level: int, x: bigint, y: bigint>>"))
    return df.withColumn("_at", at).select(*columns, "_at.*").join(tiles.distinct(), ["level", "x", "y"], "left_semi")


def _grouped(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy("level", "x", "y").agg(F.collect_list(F.struct(*columns)).alias("rows"))


def _column(rows: pa.ListScalar, name: str) -> np.ndarray:
    return rows.values.field(name).to_numpy(zero_copy_only=False)


def _far_sums(t: DataFrame, s: DataFrame, far: DataFrame, frame: Frame, key: str, measures: Sequence[str], out: Sequence[str],
              kernel: Callable[[np.ndarray], dict[str, np.ndarray]], leaf: int, order: int, value_schema: str) -> list[DataFrame]:
    """Sums over far pairs, as rows per target and tile above it: up to the Chebyshev points of the sources' tiles, across to
    those of the targets' tiles, down to the targets."""
    gx, gy = tile_points(order)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Measures of sources on the Chebyshev points of each tile, added up in the task."""
        held: dict[tuple, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            at = np.array(list(held), np.int64).reshape(-1, 3)
            w = np.stack(list(held.values())) if held else np.empty((0, len(gx), len(measures)))
            held.clear()
            cols = [np.repeat(at[:, i], len(gx)) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array(cols[2]), pa.array(np.tile(np.arange(len(gx), dtype=np.int32), len(at))),
                                               *(pa.array(w[:, :, i].ravel()) for i in range(len(measures)))], names=["level", "x", "y", "m", *measures])

        for b in batches:
            if not b.num_rows:
                continue
            level, x, y = (b.column(c).to_numpy().astype(np.int64) for c in ("level", "x", "y"))
            mid_lat, mid_lon, half = frame.centre(level, x, y)
            basis = tile_basis((b.column("lon").to_numpy() - mid_lon) / half, (b.column("lat").to_numpy() - mid_lat) / half, order)
            values = np.stack([b.column(m).to_numpy() for m in measures], axis=1)
            tiles, place = np.unique(np.stack([level, x, y], axis=1), axis=0, return_inverse=True)
            by_tile = np.argsort(place.ravel(), kind="stable")
            cuts = np.searchsorted(place.ravel()[by_tile], np.arange(len(tiles) + 1))
            for k, at in enumerate(map(tuple, tiles.tolist())):
                some = by_tile[cuts[k]:cuts[k + 1]]
                held[at] = held.get(at, 0) + basis[some].T @ values[some]
            if len(held) > 2000:
                yield rows()
        yield rows()

    wanted = far.select("level", F.col("sx").alias("x"), F.col("sy").alias("y"))
    grid = _in_tiles(s, wanted, ["lat", "lon", *measures]).select("level", "x", "y", "lat", "lon", *measures).mapInArrow(weigh, "level int, x long, y long, m int, " + ", ".join(f"{m} double" for m in measures))
    grid = grid.groupBy("level", "x", "y", "m").agg(*[F.sum(m).alias(m) for m in measures])
    tiles = _grouped(grid, ["m", *measures]).withColumnsRenamed({"x": "sx", "y": "sy", "rows": "w"})
    met = far.join(tiles, ["level", "sx", "sy"]).groupBy("level", "x", "y").agg(F.collect_list(F.struct("sx", "sy", "w")).alias("from"))  # at most 27 tiles

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of far tiles at the Chebyshev points of each target tile."""
        for b in batches:
            found = []
            for level, x, y, some in zip(*(b.column(c).to_pylist() for c in ("level", "x", "y")), b.column("from"), strict=True):
                total, half = np.zeros((len(gx), len(out))), frame.edge / 2.0 ** level / 2
                for sx, sy, w in zip(_column(some, "sx").tolist(), _column(some, "sy").tolist(), some.values.field("w"), strict=True):
                    d = half * np.hypot((gx[:, None] - gx) + 2 * (x - sx), (gy[:, None] - gy) + 2 * (y - sy))
                    at = _column(w, "m")
                    values = np.stack([_column(w, m) for m in measures], axis=1)
                    total += np.hstack([v[:, at] @ values for v in kernel(d).values()])
                found.append(total.ravel())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("level", "x", "y")), pa.array(found, pa.list_(pa.float64()))], names=["level", "x", "y", "local"])

    locals_ = materialize(met.mapInArrow(local, "level int, x long, y long, local array<double>"))
    # Targets in packs of neighbours meet the sums of the tiles above them.
    depth = min(DEEPEST, max(START, math.ceil(math.log(max(1, t.count()) / leaf + 1, 4)) + 1))
    up = lambda c, v: F.shiftright(c, DEEPEST - v)
    packs = t.withColumns({"px": up("cx", depth), "py": up("cy", depth), "part": F.pmod(F.xxhash64(key), F.lit(64))}).groupBy("px", "py", "part").agg(F.collect_list(F.struct(key, "lat", "lon", "cx", "cy")).alias("rows"))
    levels = sorted(r["level"] for r in locals_.select("level").distinct().collect())
    above = [v for v in levels if v <= depth]
    below = [v for v in levels if v > depth]
    at = lambda v: F.struct(F.lit(v).alias("level"), F.shiftright("px", depth - v).alias("x"), F.shiftright("py", depth - v).alias("y"))
    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, level, x, y, values in zip(b.column("rows"), *(b.column(c).to_pylist() for c in ("level", "x", "y")), b.column("local"), strict=True):
                mid_lat, mid_lon, half = frame.centre(np.float64(level), x, y)
                basis = tile_basis((_column(rows, "lon") - mid_lon) / half, (_column(rows, "lat") - mid_lat) / half, order)
                v = basis @ values.values.to_numpy().reshape(len(gx), len(out))
                yield pa.RecordBatch.from_arrays([rows.values.field(key), *(pa.array(v[:, i]) for i in range(len(out)))], names=[key, *out])

    parts = []
    if above:
        spread = packs.withColumn("_at", F.explode(F.array(*[at(v) for v in above]))).select("rows", "_at.*")
        parts.append(spread.join(locals_, ["level", "x", "y"]).mapInArrow(evaluate, value_schema))
    if below:
        deep = _grouped(_in_tiles(t, locals_.filter(F.col("level") > depth).select("level", "x", "y"), [key, "lat", "lon"]), [key, "lat", "lon"])
        parts.append(deep.join(locals_, ["level", "x", "y"]).mapInArrow(evaluate, value_schema))
    return parts


def kernel_sums(targets: DataFrame, sources: DataFrame, key: str, measures: Sequence[str], kernel: Callable[[np.ndarray], dict[str, np.ndarray]],
                leaf: int = LEAF, order: int = ORDER, widest: float | None = None, nothing: float | None = None) -> DataFrame:
    """(key, one column per kernel and measure): for every target the sum of kernel(distance) times measure over all sources.

    ``targets`` is (key, lat, lon), ``sources`` is (lat, lon, measures), distances are planar degrees. ``kernel`` gives named
    arrays for an array of distances; it is smooth away from 0. The relative error is near 5.8^-``order`` for kernels
    that keep their size across a far pair of tiles; for others name the ``widest`` tile and the distance of ``nothing``.
    """
    given, own = list(measures), key
    key, measures = "_key", [f"_v{i}" for i in range(len(given))]
    frame = Frame(targets, sources)
    t = materialize(frame.tiled(targets.select(F.col(own).alias(key), "lat", "lon")))
    s = materialize(frame.tiled(sources.select("lat", "lon", *[F.col(g).cast("double").alias(m) for g, m in zip(given, measures)])))
    cells = [materialize(d.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))) for d in (t, s)]
    far, near = pairs(*cells, frame, leaf, widest, nothing)
    names = list(kernel(np.ones(1)))
    out = [f"{n}_{m}" for n in names for m in measures]
    key_type = t.schema[key].dataType.simpleString()
    sums = ", ".join(f"{c} double" for c in out)
    value_schema = f"{key} {key_type}, {sums}"
    parts = [] if far.isEmpty() else _far_sums(t, s, far, frame, key, measures, out, kernel, leaf, order, value_schema)

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for mine, theirs in zip(b.column("rows"), b.column("theirs"), strict=True):
                d = np.hypot(_column(mine, "lat")[:, None] - _column(theirs, "lat"), _column(mine, "lon")[:, None] - _column(theirs, "lon"))
                values = np.stack([_column(theirs, m) for m in measures], axis=1)
                v = np.hstack([k @ values for k in kernel(d).values()])
                yield pa.RecordBatch.from_arrays([mine.values.field(key), *(pa.array(v[:, i]) for i in range(len(out)))], names=[key, *out])

    ours = _grouped(_in_tiles(t, near.select("level", "x", "y"), [key, "lat", "lon"]), [key, "lat", "lon"])
    others = _grouped(_in_tiles(s, near.select("level", F.col("sx").alias("x"), F.col("sy").alias("y")), ["lat", "lon", *measures]), ["lat", "lon", *measures])
    met_near = near.join(ours, ["level", "x", "y"]).join(others.withColumnsRenamed({"x": "sx", "y": "sy", "rows": "theirs"}), ["level", "sx", "sy"])
    parts.append(met_near.select("rows", "theirs").mapInArrow(direct, value_schema))
    return _all(parts).groupBy(F.col(key).alias(own)).agg(*[F.sum(f"{n}_{m}").alias(f"{n}_{g}") for n in names for g, m in zip(given, measures)])


def _distance(low: str, high: str) -> tuple[Column, Column]:
    """Least and largest distance between points of two tiles, in edges."""
    gap = lambda d: F.greatest(F.abs(d) - 1, F.lit(0))
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    return F.hypot(gap(dx), gap(dy)).alias(low), F.hypot(F.abs(dx) + 1, F.abs(dy) + 1).alias(high)


def nearest_k(targets: DataFrame, sites: DataFrame, key: str, columns: Sequence[str], k: int, leaf: int = LEAF, few: int = FEW) -> DataFrame:
    """(key, dist, columns, rank): the ``k`` nearest sites of every target in planar degrees, exactly; fewer where there are fewer.

    Ties go by the order of ``columns``. ``targets`` is (key, lat, lon), ``sites`` (lat, lon, columns). Tiles of targets meet
    tiles of sites level by level. Where some tiles hold k sites, the largest distance to the nearest of these bounds the
    k-th distance of every point in the tile, and tiles that lie farther go. What is left when tiles are small is
    compared point by point, k rows a pair at most, and merged.
    """
    given, columns = list(columns), [f"_c{i}" for i in range(len(columns))]
    frame = Frame(targets, sites)
    t = materialize(frame.tiled(targets.select(F.col(key).alias("_key"), "lat", "lon")))
    s = materialize(frame.tiled(sites.select("lat", "lon", *[F.col(g).alias(c) for g, c in zip(given, columns, strict=True)])))
    cells = [materialize(d.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))) for d in (t, s)]
    sizes = [c.agg(F.sum("n")).first()[0] or 0 for c in cells]
    if sizes[0] * sizes[1] <= few:
        leaf = max(leaf, *sizes)
    a, b = (counts(c, 0).select(*[F.col(c).alias(p + c) for c in ("x", "y", "n")]) for c, p in zip(cells, ("", "s"), strict=True))
    now, near = a.crossJoin(F.broadcast(b)).withColumn("bound", F.lit(float("inf"))), []  # one tile on each side
    for level in range(DEEPEST + 1):
        edge = frame.edge / 2.0 ** level
        by_reach = Window.partitionBy("x", "y").orderBy("most", "sx", "sy").rowsBetween(Window.unboundedPreceding, 0)
        known = now.select("*", *_distance("least", "most")).withColumn("held", F.sum("sn").over(by_reach))
        reach = F.min(F.when(F.col("held") >= k, F.col("most") * edge)).over(Window.partitionBy("x", "y"))
        kept = materialize(known.withColumn("bound", F.least("bound", F.coalesce(reach, F.lit(float("inf"))))).filter(F.col("least") * edge <= F.col("bound") * (1 + 1e-9)))
        small = (F.greatest("n", "sn") <= leaf) | F.lit(level == DEEPEST)
        near.append(kept.filter(small).select(F.lit(level).alias("level"), "x", "y", "sx", "sy"))
        opened = kept.filter(~small).select("x", "y", "sx", "sy", "bound")
        if level == DEEPEST or opened.isEmpty():
            break
        up = lambda c: F.shiftright(c, 1)
        one = counts(cells[0], level + 1).select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("n").alias("an"), up("x").alias("x"), up("y").alias("y"))
        two = counts(cells[1], level + 1).select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("n").alias("bn"), up("x").alias("sx"), up("y").alias("sy"))
        now = opened.join(one, ["x", "y"]).join(two, ["sx", "sy"]).select(F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("an").alias("n"), F.col("bx").alias("sx"), F.col("by").alias("sy"), F.col("bn").alias("sn"), "bound")
    pairs_ = materialize(_all(near))
    mine = _grouped(_in_tiles(t, pairs_.select("level", "x", "y"), ["_key", "lat", "lon"]), ["_key", "lat", "lon"])
    theirs = _grouped(_in_tiles(s, pairs_.select("level", F.col("sx").alias("x"), F.col("sy").alias("y")), ["lat", "lon", *columns]), ["lat", "lon", *columns])
    met = pairs_.join(mine, ["level", "x", "y"]).join(theirs.withColumnsRenamed({"x": "sx", "y": "sy", "rows": "theirs"}), ["level", "sx", "sy"]).select("rows", "theirs")
    types = {f.name: f.dataType.simpleString() for f in (*t.schema, *s.schema)}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, sites_ in zip(b.column("rows"), b.column("theirs"), strict=True):
                values = {c: _column(sites_, c) for c in columns}
                order = np.lexsort([values[c] for c in reversed(columns)])  # ties by the columns: a stable sort keeps this order
                la, lo = _column(sites_, "lat")[order], _column(sites_, "lon")[order]
                for i in range(0, len(rows.values), 512):
                    part = rows.values.slice(i, 512)
                    d = np.hypot(part.field("lat").to_numpy()[:, None] - la, part.field("lon").to_numpy()[:, None] - lo)
                    best = np.argsort(d, axis=1, kind="stable")[:, :k]
                    line = np.repeat(np.arange(len(d)), best.shape[1])
                    picked = order[best.ravel()]
                    yield pa.RecordBatch.from_arrays([part.field("_key").take(pa.array(line)), pa.array(d[line, best.ravel()]), *(sites_.values.field(c).take(pa.array(picked)) for c in columns)], names=["_key", "dist", *columns])

    found = met.mapInArrow(compare, f"_key {types['_key']}, dist double, " + ", ".join(f"{c} {types[c]}" for c in columns))
    order = Window.partitionBy("_key").orderBy("dist", *columns)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumnsRenamed({"_key": key} | dict(zip(columns, given, strict=True)))
