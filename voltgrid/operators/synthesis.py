"""Seeded synthesis: city and grid trajectories, augmentation of training rows, traffic demand variations.

Draws are keyed hashes (see hashing), so a result depends on the seed and the row keys, not on the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.functions.hashing import exponential, normal, uniform
from voltgrid.functions.onerow import with_globals
from voltgrid.operators.ordered import percentiles, row_numbers
from voltgrid.operators.selection import binned
from voltgrid.operators.tiles import _packs

# Fixed values. Trip patterns: points from / to, spread from / to (degrees), minutes from / to, mean kWh, mean hours, vehicle type.
PATTERNS = [
    ("commuter", 15, 30, 0.01, 0.05, 30, 60, 60.0, 2.5, "sedan"),
    ("shopping", 10, 20, 0.005, 0.02, 15, 45, 35.0, 1.8, "suv"),
    ("leisure", 8, 25, 0.003, 0.03, 20, 90, 45.0, 2.0, "crossover"),
    ("business", 12, 22, 0.008, 0.025, 10, 40, 25.0, 1.2, "sedan"),
    ("residential", 6, 15, 0.002, 0.01, 5, 25, 20.0, 1.0, "compact"),
]
_FIELDS = ("pattern", "n_lo", "n_hi", "s_lo", "s_hi", "m_lo", "m_hi", "mean_kwh", "mean_hours", "vehicle_type")


def _between(lo, hi, seed: int, *keys: Column) -> Column:
    lo, hi = (F.lit(v) if not isinstance(v, Column) else v for v in (lo, hi))
    return lo + (hi - lo) * uniform(seed, *keys)


def _vehicles(areas: DataFrame, per_area: int) -> DataFrame:
    return areas.withColumn("vehicle_no", F.explode(F.sequence(F.lit(0), F.lit(per_area - 1)))).repartition("area_id", "vehicle_no")


def city_trajectories(areas: DataFrame, per_area: int = 2000, seed: int = 42, stations: int = 50) -> DataFrame:
    """Patterned trips around the centre of each area, with energy, charging hours, station and vehicle type."""
    v = _vehicles(areas, per_area)
    key = (F.col("area_id"), F.col("vehicle_no"))
    u = lambda tag: uniform(seed, *key, F.lit(tag))
    table = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(row, _FIELDS)]) for row in PATTERNS])
    v = v.withColumn("p", F.explode(F.array(table[F.floor(u("pattern") * len(PATTERNS)).cast("int")]))).select("area_id", "vehicle_no", "p.*", (
        (F.col("min_lat") + F.col("max_lat")) / 2).alias("clat"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("clon"))
    v = v.withColumn("points", F.floor(F.col("n_lo") + u("n") * (F.col("n_hi") - F.col("n_lo"))).cast("int"))
    for axis in ("lat", "lon"):
        v = v.withColumn(f"spread_{axis}", _between(F.col("s_lo"), F.col("s_hi"), seed, *key, F.lit(f"s{axis}")))
        for end in ("a", "b"):
            s = F.col(f"spread_{axis}")
            step = F.least(F.greatest(normal(seed, *key, F.lit(axis + end)) * s / 2, -s), s)
            v = v.withColumn(f"{axis}_{end}", F.col(f"c{axis}") + step)
    pts = v.withColumn("point_order", F.explode(F.sequence(F.lit(0), F.col("points") - 1)))
    k = (*key, F.col("point_order"))
    t = F.when(F.col("points") > 1, F.col("point_order") / (F.col("points") - 1)).otherwise(0.0)
    for axis in ("lat", "lon"):
        s = F.col(f"spread_{axis}")
        line = F.col(f"{axis}_a") + t * (F.col(f"{axis}_b") - F.col(f"{axis}_a"))
        curve = 0.1 * F.sin(np.pi * t) * s * 0.1
        wander = F.when(F.col("point_order") == 0, 0.0).otherwise(normal(seed, *k, F.lit(axis)) * s * 0.05)
        pts = pts.withColumn(axis, line + F.when(F.col("pattern") == "commuter", 0.0).when(F.col("pattern") == "shopping", curve).otherwise(wander))
    minutes = F.col("point_order") * _between(F.col("m_lo"), F.col("m_hi"), seed, *k, F.lit("m")) / F.col("points")
    return pts.select("area_id", F.concat_ws("_", F.lit("vehicle"), "area_id", "vehicle_no").alias("veh_id"), "point_order", "pattern", "vehicle_type", "lat", "lon",
                      (minutes * 60).alias("t"), exponential(seed, F.col("mean_kwh"), *k, F.lit("kwh")).alias("kwh"), exponential(seed, F.col("mean_hours"), *k, F.lit("h")).alias("hours"),
                      F.concat_ws("_", F.lit("synthetic_station"), F.pmod(F.col("vehicle_no") + F.col("point_order"), F.lit(stations))).alias("station_id"))


def grid_trajectories(cells: DataFrame, per_cell: int = 1000, seed: int = 42) -> DataFrame:
    """Straight noisy lines of 5 to 14 points with 60 s steps inside each cell's box."""
    v = cells.select("grid_id", "min_lat", "max_lat", "min_lon", "max_lon").withColumn("vehicle_no", F.explode(F.sequence(F.lit(0), F.lit(per_cell - 1)))).repartition("grid_id", "vehicle_no")
    key = (F.col("grid_id"), F.col("vehicle_no"))
    for axis in ("lat", "lon"):
        for end in ("a", "b"):
            v = v.withColumn(f"{axis}_{end}", _between(F.col(f"min_{axis}"), F.col(f"max_{axis}"), seed, *key, F.lit(axis + end)))
    v = v.withColumn("points", (5 + F.floor(10 * uniform(seed, *key, F.lit("n")))).cast("int"))
    p = v.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("points") - 1)))
    t = F.col("j") / (F.col("points") - 1)
    at = lambda axis: F.col(f"{axis}_a") + (F.col(f"{axis}_b") - F.col(f"{axis}_a")) * t + 0.001 * normal(seed, *key, F.col("j"), F.lit(axis))
    return p.select("grid_id", F.concat_ws("_", F.lit("vehicle"), "grid_id", "vehicle_no").alias("veh_id"), at("lat").alias("lat"), at("lon").alias("lon"), (F.col("j") * 60.0).alias("t"))


def random_walks(cells: DataFrame, per_cell: int = 3, seed: int = 42, step: float = 0.005) -> DataFrame:
    """Clamped random walks of 10 to 19 points per vehicle; each step is clamped to the box, hence a small fold."""
    v = cells.select("grid_id", "min_lat", "max_lat", "min_lon", "max_lon").withColumn("vehicle_no", F.explode(F.sequence(F.lit(0), F.lit(per_cell - 1))))
    key = (F.col("grid_id"), F.col("vehicle_no"))
    n = (10 + F.floor(10 * uniform(seed, *key, F.lit("n")))).cast("int")
    start = F.struct(_between(F.col("min_lat"), F.col("max_lat"), seed, *key, F.lit("lat")).alias("lat"), _between(F.col("min_lon"), F.col("max_lon"), seed, *key, F.lit("lon")).alias("lon"))
    clamp = lambda x, a: F.greatest(F.col(f"min_{a}"), F.least(F.col(f"max_{a}"), x))
    move = lambda acc, j, a: clamp(F.element_at(acc, -1)[a] + step * normal(seed, *key, j, F.lit("d" + a)), a)
    path = F.aggregate(F.sequence(F.lit(1), n - 1), F.array(start), lambda acc, j: F.array_append(acc, F.struct(move(acc, j, "lat").alias("lat"), move(acc, j, "lon").alias("lon"))))
    return v.select("grid_id", F.concat_ws("_", F.lit("vehicle"), "grid_id", "vehicle_no").alias("veh_id"), F.posexplode(path).alias("j", "p")).select(
        "grid_id", "veh_id", "p.lat", "p.lon", (F.col("j") * 60.0).alias("t"))


def charging_points(areas: DataFrame, per_area: int = 500, seed: int = 42) -> DataFrame:
    """Minimal charging points around the centre with hourly time stamps."""
    v = _vehicles(areas, per_area)
    key = (F.col("area_id"), F.col("vehicle_no"))
    return v.select("area_id", ((F.col("min_lat") + F.col("max_lat")) / 2 + 0.05 * normal(seed, *key, F.lit("lat"))).alias("lat"), ((F.col("min_lon") + F.col("max_lon")) / 2 + 0.05 * normal(seed, *key, F.lit("lon"))).alias("lon"),
                    exponential(seed, F.lit(50.0), *key, F.lit("kwh")).alias("kwh"), exponential(seed, F.lit(2.0), *key, F.lit("h")).alias("hours"), (F.col("vehicle_no") * 3600.0).alias("t"),
                    F.concat_ws("_", F.lit("synthetic"), "area_id", "vehicle_no").alias("station_id"))


# --- augmentation -------------------------------------------------------------------------------------------

def _indexed(df: DataFrame, columns: Sequence[str], row_id: str, keys: Sequence[str] = ()) -> DataFrame:
    return materialize(row_numbers(df.select(row_id, *keys, *columns), list(keys), [row_id], "_rn"))


def _bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: 1 and 99 percent quantiles and sample std of every column."""
    melted = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in columns])).alias("r")).select("r.*")
    q = percentiles(melted, ["f"], "v", {"lo": 0.01, "hi": 0.99})
    one = q.agg(*[F.max(F.when(F.col("f") == c, F.col(e))).alias(f"_{e}_{c}") for c in columns for e in ("lo", "hi")])
    return materialize(one.crossJoin(F.broadcast(df.agg(*[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"_sd_{c}") for c in columns]))))


def _clip(value: Column, c: str) -> Column:
    return F.least(F.greatest(value, F.col(f"_lo_{c}")), F.col(f"_hi_{c}"))


def _draws(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).withColumnRenamed("id", "_draw")


def noise_samples(df: DataFrame, features: Sequence[str], target: str, row_id: str, n: int, factor: float = 0.1, seed: int = 42) -> DataFrame:
    """Bootstrap rows plus N(0, factor·std) noise (half on the target), clipped to the 1–99 % range."""
    cols = [*features, target]
    rows = _indexed(df, cols, row_id)
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    pick = _draws(df, n).crossJoin(F.broadcast(total)).withColumn("_rn", F.floor(uniform(seed, F.col("_draw")) * F.col("_n")) + 1)
    j = pick.join(rows, "_rn").crossJoin(F.broadcast(_bounds(df, cols)))
    amount = lambda c: factor * (0.5 if c == target else 1.0)
    return j.select(*[_clip(F.col(c) + amount(c) * F.col(f"_sd_{c}") * normal(seed, F.col("_draw"), F.lit(c)), c).alias(c) for c in cols])


def _feature_packs(drawn: DataFrame, rows: DataFrame, features: Sequence[str], row_id: str, k: int) -> DataFrame:
    """Packs of drawn rows (``l_`` columns) beside the packs of rows (``r_`` columns) of their bin that may hold one of the k nearest rows.

    Packs are boxes of a lattice over the features, as many as the rows of the bin need; a box with more rows is split. Bounds of boxes
    leave out what is farther than k + 1 rows for sure. Of rows with equal features the first k + 1 count.
    """
    finite = F.lit(True)
    for f in features:
        finite = finite & F.coalesce(F.abs(F.col(f)) < float("inf"), F.lit(False))
    same = Window.partitionBy("bin", *features).orderBy(row_id)
    first = rows.filter(finite).withColumn("_nth", F.row_number().over(same)).filter(F.col("_nth") <= k + 1).select("bin", F.col(row_id).alias("_other"), *features)
    first = materialize(first)
    frame = materialize(first.groupBy("bin").agg(F.count(F.lit(1)).alias("_all"), *[e(f).alias(f"_{n}_{f}") for f in features for n, e in (("from", F.min), ("to", F.max))]))

    def packed(df: DataFrame, names: Sequence[str], size: int, side: str) -> DataFrame:
        parts = F.ceil(F.pow(F.col("_all") / 512, F.lit(1 / len(features))))
        at = lambda f: F.when(F.col(f"_to_{f}") > F.col(f"_from_{f}"), F.floor((F.col(f) - F.col(f"_from_{f}")) / (F.col(f"_to_{f}") - F.col(f"_from_{f}")) * parts)).otherwise(F.lit(0).cast("long"))
        boxed = df.join(F.broadcast(frame), "bin").withColumns({f"_c{i}": at(f) for i, f in enumerate(features)}).select("bin", *names, *[f"_c{i}" for i in range(len(features))])
        packs = _packs(boxed, names, size, ["bin", *[f"_c{i}" for i in range(len(features))]])
        lo, hi = ([end(F.col(f"_pts.{f}")).alias(f"{side}_{n}_{f}") for f in features] for n, end in (("lo", F.array_min), ("hi", F.array_max)))
        return materialize(packs.select("bin", F.monotonically_increasing_id().alias(f"_{side}"), F.size("_pts").alias(f"{side}_n"), *lo, *hi, *[F.col(f"_pts.{c}").alias(f"{side}_{c}") for c in names]))

    left, right = packed(drawn.filter(finite), ["_key", "_self", *features], 256, "l"), packed(first, ["_other", *features], 512, "r")
    box = lambda df, side: df.select("bin", f"_{side}", f"{side}_n", *[f"{side}_{n}_{f}" for f in features for n in ("lo", "hi")])
    met = box(left, "l").join(box(right, "r"), "bin")
    c, zero = F.col, F.lit(0.0)
    gap = sum((F.pow(F.greatest(c(f"l_lo_{f}") - c(f"r_hi_{f}"), c(f"r_lo_{f}") - c(f"l_hi_{f}"), zero), F.lit(2.0)) for f in features), zero)
    span = sum((F.pow(F.greatest(c(f"l_hi_{f}") - c(f"r_lo_{f}"), c(f"r_hi_{f}") - c(f"l_lo_{f}")), F.lit(2.0)) for f in features), zero)
    near = Window.partitionBy("_l").orderBy("_most", "_r").rowsBetween(Window.unboundedPreceding, 0)
    met = met.select("_l", "_r", "r_n", F.sqrt(gap).alias("_least"), F.sqrt(span).alias("_most")).withColumn("_held", F.sum("r_n").over(near))
    reach = F.coalesce(F.min(F.when(F.col("_held") > k, F.col("_most"))).over(Window.partitionBy("_l")), F.lit(float("inf")))
    kept = materialize(met.withColumn("_reach", reach).filter(F.col("_least") <= F.col("_reach") * (1 + 1e-9)).select("_l", "_r"))
    arrays = lambda df, side, names: df.select(f"_{side}", *[f"{side}_{n}" for n in names])
    return (kept.join(arrays(left, "l", ["_key", "_self", *features]), "_l").join(arrays(right, "r", ["_other", *features]).hint("merge"), "_r").drop("_l", "_r"))


def smote_samples(df: DataFrame, features: Sequence[str], target: str, row_id: str, n: int, k: int = 4, bins: int = 5, seed: int = 42) -> DataFrame:
    """Oversampling over target bins: a drawn row moves towards one of its k nearest rows of the bin.

    The n draws, with replacement, go round the bins in turn. Neighbours are exact: drawn rows are packed against
    the packs of their bin, and only k candidates per pack leave the kernel. A row alone in its bin has no neighbour to
    move to and stays where it is.
    """
    cols = [*features, target]
    b = binned(df, [target], row_id, bins).select(row_id, "bin")
    rows = _indexed(df.join(b, row_id), cols, row_id, ["bin"])
    stats = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("_n"), F.avg(target).alias("_m"), F.coalesce(F.stddev_samp(target), F.lit(0.0)).alias("_s"), F.min(target).alias("_a"), F.max(target).alias("_z"))
    turn = Window.partitionBy(F.lit(0)).orderBy("bin")  # one row per bin
    turns = stats.withColumn("_turn", F.row_number().over(turn) - 1).withColumn("_turns", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    draws = turns.withColumn("_d", F.explode(F.sequence(F.col("_turn").cast("long"), F.lit(n - 1).cast("long"), F.col("_turns")))) if n else turns.withColumn("_d", F.lit(0).cast("long")).limit(0)
    draws = draws.filter(F.col("_d") % F.col("_turns") == F.col("_turn")).withColumn("_rn", F.floor(uniform(seed, F.col("bin"), F.col("_d")) * F.col("_n")) + 1)
    base = materialize(draws.join(rows, ["bin", "_rn"]).withColumn("_key", F.concat_ws("/", "bin", "_d")))
    pairs = _feature_packs(base.select("bin", "_key", F.col(row_id).alias("_self"), *features), rows, features, row_id, k)

    def nearest_rows(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                x, y = (np.stack([np.asarray(r[f"{s}_{f}"], float) for f in features], axis=1) for s in "lr")
                d = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))
                other = np.asarray(r["r__other"])
                d[np.asarray(r["l__self"])[:, None] == other[None, :]] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                rec = pd.DataFrame({"_key": np.repeat(np.asarray(r["l__key"]), near.shape[1]), "_dist": np.take_along_axis(d, near, 1).ravel(), "_other": other[near].ravel()})
                yield rec[np.isfinite(rec["_dist"])]

    id_type = dict(df.dtypes)[row_id]
    cand = pairs.mapInPandas(nearest_rows, f"_key string, _dist double, _other {id_type}")
    best = cand.groupBy("_key").agg(F.slice(F.array_sort(F.collect_list(F.struct("_dist", "_other"))), 1, k).alias("_c"))
    pick = best.withColumn("_i", F.floor(uniform(seed, F.col("_key"), F.lit("nb")) * F.size("_c")).cast("int")).select("_key", F.get("_c", F.col("_i"))["_other"].alias("_other"))
    nb = rows.select(F.col(row_id).alias("_other"), *[F.col(f).alias(f"_nb_{f}") for f in features])
    j = base.join(pick, "_key", "left").join(nb, "_other", "left").crossJoin(F.broadcast(_bounds(df, cols)))
    g = uniform(seed, F.col("_key"), F.lit("gap"))
    y = F.col("_m") + 0.3 * F.col("_s") * normal(seed, F.col("_key"), F.lit("y"))
    y = F.least(F.greatest(y, F.col("_a") * 0.8), F.col("_z") * 1.2)
    return j.select(*[_clip(F.col(f) + F.coalesce(g * (F.col(f"_nb_{f}") - F.col(f)), F.lit(0.0)), f).alias(f) for f in features], _clip(y, target).alias(target))


def mixture_samples(df: DataFrame, features: Sequence[str], target: str, n: int, components: int = 5, percentile: float = 0.75, seed: int = 42) -> DataFrame:
    """Samples of a Gaussian mixture fitted to the high-demand rows (target at or above the percentile), clipped to the
    1-99 % range of the columns.

    Where fewer than ten rows qualify, all rows are taken; there is a component for each ten rows, ``components`` at most
    and one at least.
    """
    cols = [*features, target]
    cut = percentiles(df, [], target, {"_cut": percentile})
    high = materialize(df.crossJoin(F.broadcast(cut)).filter(F.col(target) >= F.col("_cut")).select(*cols))
    if (size := high.count()) < 10:
        high = df.select(*cols)
        size = high.count()
    model = GaussianMixture(k=max(1, min(components, size // 10)), seed=seed, featuresCol="v").fit(materialize(VectorAssembler(inputCols=cols, outputCol="v").transform(high)))
    # Component parameters: k small matrices, known to be of the feature count's size.
    weights = np.cumsum(model.weights)
    means = [g.mean.toArray() for g in model.gaussians]
    roots = [np.linalg.cholesky(g.cov.toArray() + 1e-9 * np.eye(len(cols))) for g in model.gaussians]
    z = _draws(df, n).select(uniform(seed, F.col("_draw"), F.lit("c")).alias("_u"), *[normal(seed, F.col("_draw"), F.lit(c)).alias(c) for c in cols])

    def shape(batches):
        for pdf in batches:
            comp = np.minimum(np.searchsorted(weights, pdf["_u"].to_numpy()), len(weights) - 1)
            raw, out = pdf[cols].to_numpy(), np.empty((len(pdf), len(cols)))
            for c in np.unique(comp):
                rows = comp == c
                out[rows] = means[c] + raw[rows] @ roots[c].T
            yield pd.DataFrame(out, columns=cols)

    drawn = z.mapInPandas(shape, ", ".join(f"{c} double" for c in cols))
    return drawn.crossJoin(F.broadcast(_bounds(df, cols))).select(*[_clip(F.col(c), c).alias(c) for c in cols])


# Shares of the generators in each mix.
MIXES = {"noise": {"noise": 1.0}, "smote": {"smote": 1.0}, "gmm": {"gmm": 1.0}, "mixed": {"gmm": 0.4, "smote": 0.3, "noise": 0.3}, "ctgan_smote": {"gmm": 0.7, "smote": 0.3}}


def augment(df: DataFrame, features: Sequence[str], target: str, row_id: str, method: str = "mixed", ratio: float = 0.5, balance: bool = True, seed: int = 42) -> DataFrame:
    """Original rows plus synthetic ones (``source`` says which); pure methods get a small balancing top-up."""
    if method not in MIXES:
        raise ValueError(f"unknown method {method}, choose from {sorted(MIXES)}")
    size = df.count()
    total = int(size * ratio)
    make = {"noise": lambda k: noise_samples(df, features, target, row_id, k, seed=seed), "smote": lambda k: smote_samples(df, features, target, row_id, k, seed=seed),
            "gmm": lambda k: mixture_samples(df, features, target, k, seed=seed)}
    out = df.select(*features, target, F.lit("original").alias("source"))
    for kind, share in MIXES[method].items():
        out = out.unionByName(make[kind](int(total * share)).withColumn("source", F.lit(kind)))
    if balance and method in ("noise", "gmm"):
        out = out.unionByName(make["smote"](max(20, size // 10)).withColumn("source", F.lit("balance")))
    return out


# --- traffic ------------------------------------------------------------------------------------------------

def vary_demand(trips: DataFrame, trip_id: str, depart: str, scale: float | None = None, shift: float = 600.0, seed: int = 42) -> DataFrame:
    """Scale trip demand by U(.9, 1.1) (extra copies drawn with replacement, or a sample) and shift departures by ±600 s."""
    factor = scale if scale is not None else float(0.9 + 0.2 * np.random.RandomState(seed).random_sample())
    rows = materialize(row_numbers(trips, [], [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(trip_id).cast("string"))), F.col(trip_id)], "_rn"))
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    if factor < 1:
        chosen = rows.crossJoin(F.broadcast(n)).filter(F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") * factor))).withColumn("_copy", F.lit(0).cast("long")).drop("_n")
    else:
        more = n.withColumn("_copy", F.explode(F.when(F.floor(F.col("_n") * (factor - 1)) >= 1, F.sequence(F.lit(1).cast("long"), F.floor(F.col("_n") * (factor - 1)))).otherwise(F.array().cast("array<bigint>"))))
        extra = more.withColumn("_rn", F.floor(uniform(seed, F.col("_copy"), F.lit("x")) * F.col("_n")) + 1).drop("_n").join(rows, "_rn")
        chosen = rows.withColumn("_copy", F.lit(0).cast("long")).unionByName(extra)
    move = (2 * uniform(seed, F.col(trip_id), F.col("_copy"), F.lit("t")) - 1) * shift
    return chosen.withColumn(depart, F.greatest(F.lit(0.0), F.col(depart) + move)).withColumnRenamed("_copy", "copy").drop("_rn")


def random_trips(edges: DataFrame, n: int, horizon: float = 3600.0, buffer: float = 300.0, seed: int = 42) -> DataFrame:
    """Trips between two different random edges with a random departure."""
    rows = materialize(row_numbers(edges.select("edge_id", "edge_no"), [], ["edge_no"], "_rn"))
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    d = _draws(edges, n).crossJoin(F.broadcast(total))
    a = F.floor(uniform(seed, F.col("_draw"), F.lit("a")) * F.col("_n"))
    hop = 1 + F.floor(uniform(seed, F.col("_draw"), F.lit("b")) * (F.col("_n") - 1))
    d = d.withColumn("_a", a + 1).withColumn("_b", F.pmod(a + hop, F.col("_n")) + 1)
    side = lambda c, name: rows.select(F.col("_rn").alias(c), F.col("edge_id").alias(name))
    return d.join(side("_a", "from_edge"), "_a").join(side("_b", "to_edge"), "_b").select(
        F.concat(F.lit("random_"), F.col("_draw")).alias("trip_id"), "from_edge", "to_edge", ((horizon - buffer) * uniform(seed, F.col("_draw"), F.lit("d"))).alias("depart"), F.lit("random").alias("origin"))


def hybrid_trips(observed: DataFrame, edges: DataFrame, seed: int = 42) -> DataFrame:
    """Observed trips with their own ends plus 100 to 200 random ones."""
    extra = 100 + int(np.random.RandomState(seed).randint(101))
    real = observed.select(F.col("veh_id").alias("trip_id"), "from_edge", "to_edge", "depart", F.lit("observed").alias("origin"))
    return real.unionByName(random_trips(edges, extra, seed=seed))
