"""Vehicle points: time normalisation, trips, dwells, low-charge points, demand points.

Points have veh_id, lat, lon, t (seconds) and ord, a tie-breaker that fixes the order of equal times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions import geo
from voltgrid.functions.durable import materialize
from voltgrid.functions.hashing import normal, uniform
from voltgrid.functions.onerow import with_globals, with_group_stats
from voltgrid.operators.ordered import SLICE, following, previous, row_numbers, running, slices

ORDER = ("t", "ord")

# Simulated battery of the low-charge points (fixed values).
BATTERY_KWH, KWH_PER_KM, RECHARGE_TO = 35.0, 0.2, 0.8


def _scaled(t: Column, lo: Column, hi: Column, span: float) -> Column:
    return F.when(hi > lo, (t - lo) / (hi - lo) * span).otherwise(F.lit(0.0))


def normalize_per_vehicle(points: DataFrame, span: float = 3600.0) -> DataFrame:
    """Times of each vehicle to [0, span]; a single or constant time gives 0."""
    s = with_group_stats(points, ["veh_id"], F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    return s.withColumn("t", _scaled(F.col("t"), F.col("_lo"), F.col("_hi"), span)).drop("_lo", "_hi")


def normalize_all(points: DataFrame, raw: str = "timestamp", span: float = 3600.0) -> DataFrame:
    """Text times to numbers (rows that do not parse are dropped), then the whole set to [0, span]."""
    t = points.withColumn("t", F.col(raw).try_cast("double")).filter(F.col("t").isNotNull() & ~F.isnan("t"))
    s = with_globals(t, F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    return s.withColumn("t", _scaled(F.col("t"), F.col("_lo"), F.col("_hi"), span)).drop("_lo", "_hi")


def in_box(points: DataFrame, box: dict[str, float]) -> DataFrame:
    return points.filter(F.col("lat").between(box["min_lat"], box["max_lat"])
                         & F.col("lon").between(box["min_lon"], box["max_lon"]))


def destinations(points: DataFrame) -> DataFrame:
    """Last row of each vehicle."""
    last = points.groupBy("veh_id").agg(F.max_by(F.struct("lat", "lon", "t"), F.struct(*ORDER)).alias("_r"))
    return last.select("veh_id", "_r.*")


def long_dwells(points: DataFrame, hours: float = 2.0, radius_km: float = 0.05, sliced: bool = False) -> DataFrame:
    """Points whose successor is nearer than 50 m and later than the threshold."""
    nxt = following(points, ["veh_id"], ORDER, {"_lat": "lat", "_lon": "lon", "_t": "t"}, sliced)
    d = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    wait = F.col("_t") - F.col("t")
    return (nxt.withColumn("dwell_seconds", wait).filter((d < radius_km) & (wait > hours * 3600))
            .drop("_lat", "_lon", "_t"))


def low_charge_points(points: DataFrame, threshold: float = 0.2, sliced: bool = False) -> DataFrame:
    """Points where the simulated charge falls below the threshold; the battery is then set to 80 %.

    After a recharge the level is known, so the next one is the first row whose running use exceeds that of the recharge
    by a fixed amount. That row is found for every row at once, by sorting rows and targets together; the rows that the
    chain from each vehicle's first recharge reaches are then marked by pointer doubling, in as many rounds as the
    logarithm of the recharges. A vehicle with most of the rows is spread like any other.
    """
    key = ["veh_id"]
    base = points if sliced else slices(points.select("veh_id", "lat", "lon", "t", "ord"), key, ORDER)
    lagged = previous(base, key, ORDER, {"_lat": "lat", "_lon": "lon"}, sliced=True)
    km = F.coalesce(geo.haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")), F.lit(0.0))
    used = materialize(lagged.select("veh_id", "lat", "lon", "t", "ord", SLICE, (km * KWH_PER_KM).alias("_used")))
    steps = materialize(running(used, key, ORDER, {"_sum": ("sum", "_used"), "_rn": ("count", F.lit(1))}, sliced=True).select("veh_id", "lat", "lon", "t", "ord", "_sum", "_rn"))
    first, again = BATTERY_KWH * (1 - threshold), BATTERY_KWH * (RECHARGE_TO - threshold)
    none = F.lit(None).cast("long")
    rows = steps.select("veh_id", F.col("_sum").alias("_at"), F.lit(0).alias("_late"), F.col("_rn").alias("_row"), none.alias("_from"))
    targets = steps.select("veh_id", (F.col("_sum") + again).alias("_at"), F.lit(1).alias("_late"), none.alias("_row"), F.col("_rn").alias("_from"))
    starts = steps.filter("_rn = 1").select("veh_id", F.lit(first).alias("_at"), F.lit(1).alias("_late"), none.alias("_row"), F.lit(0).cast("long").alias("_from"))
    order = [F.col("_at").desc(), F.col("_late").desc(), F.col("_row").desc()]
    ahead = running(rows.unionByName(targets).unionByName(starts), key, order, {"_next": ("min", "_row")})
    links = materialize(ahead.filter("_from IS NOT NULL AND _next IS NOT NULL").select("veh_id", "_from", "_next"))
    reached = materialize(links.filter("_from = 0").select("veh_id", F.col("_next").alias("_rn")))
    hops, count = links.filter("_from > 0"), reached.count()
    while True:
        further = reached.join(hops, (reached["veh_id"] == hops["veh_id"]) & (reached["_rn"] == hops["_from"])).select(reached["veh_id"], F.col("_next").alias("_rn"))
        reached = materialize(reached.unionByName(further).distinct())
        if reached.count() == count:
            break
        count = reached.count()
        onward = hops.select(F.col("veh_id").alias("_v"), F.col("_from").alias("_mid"), F.col("_next").alias("_end"))
        hops = materialize(hops.join(onward, (hops["veh_id"] == onward["_v"]) & (hops["_next"] == onward["_mid"])).select("veh_id", "_from", F.col("_end").alias("_next")))
    chain = reached.select("veh_id", F.col("_rn").alias("_from")).join(steps.select("veh_id", F.col("_rn").alias("_from"), F.col("_sum").alias("_base")), ["veh_id", "_from"])
    chain = chain.withColumn("_full", F.lit(BATTERY_KWH * RECHARGE_TO)).unionByName(steps.filter("_rn = 1").select(
        "veh_id", F.lit(0).cast("long").alias("_from"), F.lit(0.0).alias("_base"), F.lit(float(BATTERY_KWH)).alias("_full")))
    low = chain.join(links, ["veh_id", "_from"]).select("veh_id", F.col("_next").alias("_rn"), "_base", "_full").join(steps, ["veh_id", "_rn"])
    return low.select("veh_id", "lat", "lon", "t", "ord", ((F.col("_full") - (F.col("_sum") - F.col("_base"))) / BATTERY_KWH).alias("soc"))


def demand_points(points: DataFrame, hours: float = 2.0, threshold: float = 0.2) -> DataFrame:
    """Destinations, dwells and low-charge points in one typed table; the points are sorted once for all."""
    base = slices(points.select("veh_id", "lat", "lon", "t", "ord"), ["veh_id"], ORDER)
    kinds = {"trip_destination": destinations(base), "long_dwell": long_dwells(base, hours, sliced=True),
             "low_soc": low_charge_points(base, threshold, sliced=True)}
    out = None
    for kind, df in kinds.items():
        part = df.select("veh_id", "lat", "lon", "t", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


def od_pairs(points: DataFrame) -> DataFrame:
    """First and last point of vehicles with at least two points."""
    key = F.struct(*ORDER)
    g = points.groupBy("veh_id").agg(
        F.min_by(F.struct("lat", "lon", "t"), key).alias("a"), F.max_by(F.struct("lat", "lon", "t"), key).alias("b"),
        F.count(F.lit(1)).alias("points"))
    return g.filter("points >= 2").select(
        "veh_id", "points", F.col("a.lat").alias("from_lat"), F.col("a.lon").alias("from_lon"), F.col("a.t").alias("t0"),
        F.col("b.lat").alias("to_lat"), F.col("b.lon").alias("to_lon"), F.col("b.t").alias("t1"))


def trips(points: DataFrame, seed: int = 42, horizon: float = 2400.0, min_move: float = 0.0005,
          min_seconds: float = 15.0) -> DataFrame:
    """Trips with a seeded departure and duration, long enough in space and time, by departure."""
    key = F.col("veh_id")
    od = od_pairs(points)
    length = F.when(F.col("t1") > F.col("t0"), 60.0 + 540.0 * uniform(seed, key, F.lit("len"))).otherwise(F.lit(120.0))
    timed = od.withColumn("depart", horizon * uniform(seed, key, F.lit("dep"))).withColumn("duration", length)
    moved = (F.abs(F.col("to_lat") - F.col("from_lat")) >= min_move) | (F.abs(F.col("to_lon") - F.col("from_lon")) >= min_move)
    ok = (F.col("from_lat").between(-90, 90) & F.col("to_lat").between(-90, 90)
          & F.col("from_lon").between(-180, 180) & F.col("to_lon").between(-180, 180))
    return timed.filter(moved & (F.col("duration") >= min_seconds) & ok)


def via_points(points: DataFrame, seed: int = 42, most: int = 3, jitter: float = 1e-4) -> DataFrame:
    """Up to three inner points per vehicle at even steps, each moved by a seeded jitter."""
    n = with_group_stats(row_numbers(points, ["veh_id"], ORDER, "_rn"), ["veh_id"], F.count(F.lit(1)).alias("_n"))
    wanted = F.when(F.col("_n") > 4, F.least(F.lit(most), F.floor(F.col("_n") / 15))).otherwise(F.lit(0))
    step = F.greatest(F.lit(2), F.floor(F.col("_n") / (wanted + 1)))
    idx = F.col("_rn") - 1
    chosen = n.withColumn("_want", wanted).withColumn("_step", step).filter(
        (F.col("_want") > 0) & (idx > 0) & (idx % F.col("_step") == 0) & (idx < F.col("_n") - F.col("_step"))
        & (idx / F.col("_step") <= F.col("_want")))
    shift = lambda tag: (2 * uniform(seed, F.col("veh_id"), F.col("ord"), F.lit(tag)) - 1) * jitter
    return chosen.select("veh_id", (idx / F.col("_step")).cast("int").alias("via"), (F.col("lat") + shift("lat")).alias("lat"),
                         (F.col("lon") + shift("lon")).alias("lon"))


def edge_trips(points: DataFrame, edges: DataFrame, seed: int = 42, within_m: float = 400.0) -> DataFrame:
    """Trips between the nearest edges of the first and last point; same-edge trips are dropped."""
    from voltgrid.operators.roads import nearest_edge

    od = od_pairs(points)
    ends = None
    for side in ("from", "to"):
        p = od.select("veh_id", F.col(f"{side}_lat").alias("lat"), F.col(f"{side}_lon").alias("lon"))
        hit = nearest_edge(p, edges, "veh_id", within_m).select("veh_id", F.col("edge_id").alias(f"{side}_edge"))
        ends = hit if ends is None else ends.join(hit, "veh_id")
    depart = F.greatest(F.lit(0.0), F.col("t0") / 1000 + 60.0 * normal(seed, F.col("veh_id")))
    return (od.join(ends, "veh_id").filter("from_edge <> to_edge")
            .select("veh_id", depart.alias("depart"), "from_edge", "to_edge"))


def extent(points: DataFrame) -> DataFrame:
    return points.agg(F.count(F.lit(1)).alias("points"), F.count_distinct("veh_id").alias("vehicles"),
                      F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"),
                      F.max("lon").alias("max_lon"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))
