"""Neighbourhood counts, decay densities and distance-weighted interpolation (pack against pack, see tiles)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.operators.hierarchy import kernel_sums, nearest_k
from voltgrid.operators.tiles import fold_near

RADII = (0.01, 0.02, 0.05)


def _label(r: float) -> str:
    return f"{int(round(r * 100))}km"


def _places(points: DataFrame) -> DataFrame:
    """(_place, lat, lon, k), written: each place once with its number of points, however many points share it."""
    return materialize(points.groupBy("lat", "lon").agg(F.count(F.lit(1)).cast("double").alias("k")).withColumn("_place", F.monotonically_increasing_id()))


def _at_places(points: DataFrame, places: DataFrame, sums: DataFrame, point_id: str, names: Sequence[str]) -> DataFrame:
    """Sums of their places for points, each less the point itself."""
    known = places.select("_place", "lat", "lon").join(sums, "_place")
    return points.select(point_id, "lat", "lon").join(known, ["lat", "lon"]).groupBy(point_id).agg(*[(F.sum(n) - 1).alias(n) for n in names])


def radius_counts(points: DataFrame, point_id: str, id_type: str = "string", radii: Sequence[float] = RADII) -> DataFrame:
    """Exact number of other points within each radius (degrees); points at one place are compared once."""
    names = [f"neighbors_within_{_label(r)}" for r in radii]

    def kernel(lv, rv):
        d, e = np.subtract.outer(lv["lat"], rv["lat"]), np.subtract.outer(lv["lon"], rv["lon"])
        np.sqrt(np.add(np.multiply(d, d, out=d), np.multiply(e, e, out=e), out=d), out=d)
        return {n: (np.less_equal(d, r, out=e) @ rv["k"]).astype(np.int64) for n, r in zip(names, radii)}

    places = _places(points)
    part = fold_near(places, places, ["_place", "lat", "lon"], ["lat", "lon", "k"], kernel, "_place long, " + ", ".join(f"{n} long" for n in names), 1, max(radii))
    return _at_places(points, places, part.groupBy("_place").agg(*[F.sum(n).alias(n) for n in names]), point_id, names)


def decay_density(points: DataFrame, point_id: str, id_type: str = "string", radii: Sequence[float] = RADII) -> DataFrame:
    """Sum of exp(-d / r) over the other points, for all radii in one pass over a hierarchy of tiles; points at one place once.

    Tiles see each other as wholes where they are at most two radii wide, or lie so far apart that e^-40 is left; the
    relative error is near 1e-8 whatever the number of points.
    """
    names = {r: f"weighted_density_{_label(r)}" for r in radii}
    places = _places(points)
    sums = kernel_sums(places.select("_place", "lat", "lon"), places, "_place", ["k"], lambda d: {n: np.exp(-d / r) for r, n in names.items()},
                       widest=2 * min(radii), nothing=40 * max(radii))
    return _at_places(points, places, sums.select("_place", *[F.col(f"{n}_k").alias(n) for n in names.values()]), point_id, list(names.values()))


def histogram_density(points: DataFrame, radii: Sequence[float] = RADII) -> DataFrame:
    """Approximate density: points in the own square of edge r/2 (self included), squares anchored at the minimum."""
    lo = points.agg(F.min("lat").alias("_lat0"), F.min("lon").alias("_lon0"))
    out = points.crossJoin(F.broadcast(lo))
    for r in radii:
        by, bx = f"_by{_label(r)}", f"_bx{_label(r)}"
        out = (out.withColumn(by, F.floor((F.col("lat") - F.col("_lat0")) / (r / 2)))
               .withColumn(bx, F.floor((F.col("lon") - F.col("_lon0")) / (r / 2))))
        n = out.groupBy(by, bx).agg(F.count(F.lit(1)).alias(f"density_{_label(r)}"))
        out = out.join(n, [by, bx]).drop(by, bx)
    return out.drop("_lat0", "_lon0")


def idw(cells: DataFrame, stations: DataFrame, targets: Sequence[str], power: float = 2.0, eps: float = 1e-10) -> DataFrame:
    """Inverse-distance weighting of all targets at once, planar degrees, every cell with every station.

    Stations at one place are merged first (weight = their number). Near tiles are summed station by station, far ones
    through the Chebyshev points of a hierarchy of tiles; the relative error is near 1e-7.
    """
    merged = stations.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("k"), *[F.sum(y).alias(y) for y in targets])
    sums = kernel_sums(cells.select("grid_id", "lat", "lon"), merged, "grid_id", ["k", *targets], lambda d: {"w": (1.0 / (d + eps)) ** power})
    return sums.select("grid_id", *[(F.col(f"w_{y}") / (F.col("w_k") + eps)).alias(y) for y in targets])


def _copies_merged(stations: DataFrame, target: str) -> DataFrame:
    """Equal stations as one row with a weight, so that copies neither fill one pack nor get lost."""
    return stations.groupBy("lat", "lon", target).agg(F.count(F.lit(1)).alias("_k"))


def local_interpolation(cells: DataFrame, stations: DataFrame, target: str, scale: float = 1.0, k: int = 3,
                        noise_seed: int | None = None) -> DataFrame:
    """Stations within 3·scale km, else the k nearest: weights (d + .1)^-1.5, damped by exp(-dmin / (2·scale)).

    Distances are planar degrees times 111.32. Stations within the radius are summed over neighbouring buckets; cells
    without one take their nearest from a hierarchy of tiles. The random factor of the original is off unless a seed is given.
    """
    from voltgrid.functions.hashing import normal

    radius = 3.0 * scale
    merged = materialize(_copies_merged(stations, target))

    def kernel(lv, rv):
        d = np.sqrt((lv["lat"][:, None] - rv["lat"]) ** 2 + (lv["lon"][:, None] - rv["lon"]) ** 2) * 111.32
        inside = d <= radius
        w = np.where(inside, (d + 0.1) ** -1.5, 0.0) * rv["_k"]
        return {"_n": inside.sum(axis=1), "_w": w.sum(axis=1), "_wy": w @ rv[target], "_d": np.where(inside, d, np.inf).min(axis=1)}

    part = fold_near(cells, merged, ["grid_id", "lat", "lon"], ["lat", "lon", target, "_k"], kernel, "grid_id string, _n long, _w double, _wy double, _d double", 1, radius / 111.32)
    inside = materialize(part.groupBy("grid_id").agg(F.sum("_n").alias("_n"), F.sum("_w").alias("_w"), F.sum("_wy").alias("_wy"), F.min("_d").alias("_d")).filter("_n > 0").select("grid_id", "_w", "_wy", "_d"))
    rest = cells.select("grid_id", "lat", "lon").join(inside, "grid_id", "left_anti")
    near = nearest_k(rest, merged, "grid_id", [target, "_k"], k).withColumn("_d", F.col("dist") * 111.32)
    upto = Window.partitionBy("grid_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # k rows a cell at most
    copies = F.greatest(F.least("_k", k - F.coalesce(F.sum("_k").over(upto), F.lit(0))), F.lit(0))
    w = F.pow(F.col("_d") + 0.1, F.lit(-1.5)) * F.col("_copies")
    far = near.withColumn("_copies", copies).groupBy("grid_id").agg(F.sum(w).alias("_w"), F.sum(w * F.col(target)).alias("_wy"), F.min("_d").alias("_d"))
    value = F.col("_wy") / F.col("_w") * F.exp(-F.col("_d") / (2.0 * scale))
    if noise_seed is not None:
        value = value * F.greatest(F.lit(0.1), 1.0 + 0.1 * scale * normal(noise_seed, F.col("grid_id")))
    return inside.unionByName(far).select("grid_id", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias(target))


def decayed_demand(cells: DataFrame, stations: DataFrame, target: str, scale: float = 1.0, max_abs_lat: float = 70.0) -> DataFrame:
    """Mean of exp(-d / (2·scale))·y over stations within 5·scale km (great circle), damped by the scale; else 0."""
    radius = 5.0 * scale
    edge = radius / (111.0 * math.cos(math.radians(max_abs_lat)))

    def kernel(lv, rv):
        la, lo = np.radians(lv["lat"])[:, None], np.radians(lv["lon"])[:, None]
        rb, ro = np.radians(rv["lat"]), np.radians(rv["lon"])
        a = np.sin((rb - la) / 2) ** 2 + np.cos(la) * np.cos(rb) * np.sin((ro - lo) / 2) ** 2
        d = 2 * 6371.0 * np.arcsin(np.sqrt(a))
        inside = d <= radius
        return {"_n": (inside * rv["_k"]).sum(axis=1),
                "_s": np.where(inside, np.exp(-d / (2 * scale)) * rv[target] * rv["_k"], 0.0).sum(axis=1)}

    part = fold_near(cells, _copies_merged(stations, target), ["grid_id", "lat", "lon"], ["lat", "lon", target, "_k"], kernel,
                     "grid_id string, _n long, _s double", 1, edge)
    g = part.groupBy("grid_id").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    value = F.col("_s") / F.col("_n") / (1.0 + 0.2 * scale)
    got = g.filter("_n > 0").select("grid_id", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias(target))
    return cells.select("grid_id").join(got, "grid_id", "left").fillna(0.0, [target])


def fill_cells(cells: DataFrame, grid_demand: DataFrame, estimate: DataFrame, mode: str = "synthetic") -> DataFrame:
    """Real score where the cell has stations, else the estimate, with fixed proxy shares for the other columns."""
    shares = {"synthetic": (0.7, 0.3, 0.5), "interpolated": (1.0, 1.0, 0.6)}[mode]
    est = estimate.select("grid_id", F.col("demand_score").alias("_est"))
    j = cells.select("grid_id").join(grid_demand, "grid_id", "left").join(est, "grid_id", "left")
    missing = F.col("num_stations").isNull()
    proxy = dict(zip(("kwh_normalized", "hours_normalized", "avg_occupancy"), shares))
    zero = ("num_stations", "num_chargers", "total_kwh", "total_hours", "kwh_per_charger", "hours_per_charger")
    return j.select(
        "grid_id", F.coalesce("demand_score", "_est").alias("demand_score"), missing.alias(f"is_{mode}"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
        *[F.coalesce(c, F.col("_est") * s).alias(c) for c, s in proxy.items()])
