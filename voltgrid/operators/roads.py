"""Road edges and lanes: points along a polyline, candidate sites, nearest edges, snapping, stops.

Edges carry edge_id, edge_no (file order), length_m, passenger and ``shape``, an array of (x, y) in metres.
Coordinates relate to degrees by a plane with a fixed origin (see ``to_xy`` / ``to_lat_lon``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.geo import widened
from voltgrid.functions.hashing import ord_sum
from voltgrid.operators.ordered import row_numbers
from voltgrid.operators.tiles import bucket, fold_near, nearest

# Local plane: origin and metres per degree.
ORIGIN_LAT, ORIGIN_LON, M_PER_LAT, M_PER_LON = 42.217, -83.8084, 111320.0, 82000.0

# Station constants (fixed values).
POWER_W, EFFICIENCY = 50000.0, 0.95


def to_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    return (lon - ORIGIN_LON) * M_PER_LON, (lat - ORIGIN_LAT) * M_PER_LAT


def to_lat_lon(x: Column, y: Column) -> tuple[Column, Column]:
    return ORIGIN_LAT + y / M_PER_LAT, ORIGIN_LON + x / M_PER_LON


def point_at(shape: Column, pos: Column) -> Column:
    """struct(x, y) at ``pos`` metres along the polyline; the last vertex beyond its end."""
    start = F.struct(F.lit(0.0).alias("gone"), shape[0]["x"].alias("x"), shape[0]["y"].alias("y"),
                     shape[0]["x"].alias("px"), shape[0]["y"].alias("py"), F.lit(False).alias("done"))

    def step(acc, p):
        seg = F.hypot(p["x"] - acc["px"], p["y"] - acc["py"])
        here = ~acc["done"] & (acc["gone"] + seg >= pos)
        ratio = F.when(seg > 0, (pos - acc["gone"]) / seg).otherwise(0.0)
        x = F.when(acc["done"], acc["x"]).when(here, acc["px"] + ratio * (p["x"] - acc["px"])).otherwise(p["x"])
        y = F.when(acc["done"], acc["y"]).when(here, acc["py"] + ratio * (p["y"] - acc["py"])).otherwise(p["y"])
        return F.struct((acc["gone"] + seg).alias("gone"), x.alias("x"), y.alias("y"), p["x"].alias("px"),
                        p["y"].alias("py"), (acc["done"] | here).alias("done"))

    return F.aggregate(F.slice(shape, F.lit(2), F.size(shape)), start, step,
                       lambda acc: F.struct(acc["x"].alias("x"), acc["y"].alias("y")))


def _inside(lat: Column, lon: Column, box: dict[str, float], margin: float) -> Column:
    b = widened(box, margin)
    return (lat > b["min_lat"]) & (lat < b["max_lat"]) & (lon > b["min_lon"]) & (lon < b["max_lon"])


def candidate_sites(edges: DataFrame, box: dict[str, float], margin: float = 0.005) -> DataFrame:
    """Sites along passenger lanes of at least 20 m near the box: positions 15 … len-10, step max(25, len/8)."""
    ok = edges.filter(~F.col("edge_id").startswith(":") & (F.col("length_m") >= 20) & F.col("passenger"))
    probes = F.transform(F.array(*[F.lit(f) for f in (0.1, 0.3, 0.5, 0.7, 0.9)]),
                         lambda f: point_at(F.col("shape"), f * F.col("length_m")))
    touches = F.exists(probes, lambda p: _inside(*to_lat_lon(p["x"], p["y"]), box, margin))
    whole = F.floor("length_m").cast("int")
    last, step = whole - 11, F.greatest(F.lit(25), F.floor(F.col("length_m") / 8).cast("int"))
    pos = F.when(last >= 15, F.sequence(F.lit(15), last, step)).otherwise(F.array().cast("array<int>"))
    sites = (ok.filter(touches).withColumn("position", F.explode(pos))
             .withColumn("_p", F.explode(F.array(point_at(F.col("shape"), F.col("position").cast("double"))))))
    lat, lon = to_lat_lon(F.col("_p.x"), F.col("_p.y"))
    return (sites.withColumn("lat", lat).withColumn("lon", lon).filter(_inside(F.col("lat"), F.col("lon"), box, margin))
            .select("edge_id", F.concat("edge_id", F.lit("_0")).alias("lane"), "position",
                    F.least(F.col("position") + 15, F.col("length_m")).alias("end_position"), "lat", "lon"))


def fraction_sites(edges: DataFrame, fractions: tuple[float, ...] = (0.2, 0.5, 0.8)) -> DataFrame:
    """Positions at fixed fractions of each edge, located at the edge start, one row per (edge, position)."""
    f = F.explode(F.array(*[F.lit(v) for v in fractions]))
    lat, lon = to_lat_lon(F.col("shape")[0]["x"], F.col("shape")[0]["y"])
    return (edges.filter(~F.col("edge_id").startswith(":")).withColumn("_f", f)
            .withColumn("position", F.col("_f") * F.col("length_m")).filter(F.col("position") < F.col("length_m"))
            .select("edge_id", F.concat("edge_id", F.lit("_0")).alias("lane"), "position", lat.alias("lat"), lon.alias("lon"))
            .dropDuplicates(["edge_id", "position"]))


def fallback_sites(edges: DataFrame, n: int) -> DataFrame:
    """Midpoints of the first 3n passenger lanes in file order, three to choose from for each site asked."""
    mid = edges.filter(~F.col("edge_id").startswith(":")).filter("passenger").orderBy("edge_no").limit(3 * n).withColumn(
        "_p", F.explode(F.array(point_at(F.col("shape"), F.col("length_m") / 2))))
    lat, lon = to_lat_lon(F.col("_p.x"), F.col("_p.y"))
    return mid.select("edge_id", F.concat("edge_id", F.lit("_0")).alias("lane"), (F.col("length_m") / 2).alias("position"),
                      F.least(F.col("length_m") / 2 + 10, F.col("length_m")).alias("end_position"), lat.alias("lat"), lon.alias("lon"))


def every_kth_edge(edges: DataFrame, n: int, order: str = "edge_no") -> DataFrame:
    """Every k-th edge in file order, k = max(1, edges // n), at most n."""
    numbered = row_numbers(edges, [], [order], "_rn").crossJoin(
        F.broadcast(edges.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / n)).alias("_k"))))
    at = F.col("_rn") - 1
    return numbered.filter((at % F.col("_k") == 0) & (at / F.col("_k") < n)).drop("_rn", "_k")


def _segments(edges: DataFrame, size: float) -> DataFrame:
    """Edge pieces with the buckets their boxes cover."""
    n = F.size("shape")
    pairs = F.arrays_zip(F.slice("shape", F.lit(1), n - 1).alias("a"), F.slice("shape", F.lit(2), n - 1).alias("b"))
    seg = edges.select("edge_id", F.explode(pairs).alias("s")).select(
        "edge_id", *[F.col(f"s.{p}.{c}").alias(f"{c}{k}") for k, p in enumerate("ab") for c in "xy"])
    span = lambda c: F.explode(F.sequence(bucket(F.least(f"{c}0", f"{c}1"), size), bucket(F.greatest(f"{c}0", f"{c}1"), size)))
    return seg.withColumn("_bx", span("y")).withColumn("_by", span("x"))


def nearest_edge(points: DataFrame, edges: DataFrame, point_id: str, within_m: float = 1000.0,
                 id_type: str = "string") -> DataFrame:
    """Nearest edge (distance to its polyline in metres) within the radius; ties to the lowest edge id."""
    x, y = to_xy(F.col("lat"), F.col("lon"))
    pts = points.select(point_id, x.alias("x"), y.alias("y"))

    def kernel(lv, rv):
        px, py = lv["x"][:, None], lv["y"][:, None]
        dx, dy = rv["x1"] - rv["x0"], rv["y1"] - rv["y0"]
        u = np.clip(((px - rv["x0"]) * dx + (py - rv["y0"]) * dy) / np.maximum(dx * dx + dy * dy, 1e-12), 0, 1)
        d = np.hypot(px - (rv["x0"] + u * dx), py - (rv["y0"] + u * dy))
        j = d.argmin(axis=1)
        return {"edge_id": rv["edge_id"][j], "dist_m": d[np.arange(len(j)), j]}

    part = fold_near(pts, _segments(edges, within_m), [point_id, "x", "y"], ["edge_id", "x0", "y0", "x1", "y1"], kernel,
                     f"{point_id} {id_type}, edge_id string, dist_m double", 1, within_m, ("y", "x"), ("y", "x"))
    # Rounded so that a point at the shared end of two edges goes to the lower id.
    best = part.groupBy(point_id).agg(F.min(F.struct(F.round("dist_m", 6).alias("dist_m"), F.col("edge_id"))).alias("_b"))
    return best.select(point_id, "_b.edge_id", "_b.dist_m").filter(F.col("dist_m") <= within_m)


def snap_to_edge(points: DataFrame, edges: DataFrame, point_id: str, box: dict[str, float] | None = None,
                 within_m: float = 1000.0, id_type: str = "string") -> DataFrame:
    """Nearest edge with a shape point in the box, then the clamped projection on each of its pieces."""
    usable = edges
    if box is not None:
        usable = edges.filter(F.exists("shape", lambda p: (
            to_lat_lon(p["x"], p["y"])[0].between(box["min_lat"], box["max_lat"])
            & to_lat_lon(p["x"], p["y"])[1].between(box["min_lon"], box["max_lon"]))))
    hit = nearest_edge(points, usable, point_id, within_m, id_type)
    j = (points.select(point_id, F.col("lat").alias("_plat"), F.col("lon").alias("_plon")).join(hit, point_id)
         .join(usable.select("edge_id", "shape", "length_m"), "edge_id"))
    deg = F.transform("shape", lambda p: F.struct(to_lat_lon(p["x"], p["y"])[0].alias("lat"), to_lat_lon(p["x"], p["y"])[1].alias("lon")))
    j = j.withColumn("_d", F.explode(F.array(deg)))
    n = F.size("_d")

    def project(i):
        a, b = F.get(F.col("_d"), i), F.get(F.col("_d"), i + 1)
        dlat, dlon = b["lat"] - a["lat"], b["lon"] - a["lon"]
        u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("_plon") - a["lon"]) * dlon + (F.col("_plat") - a["lat"]) * dlat)
                                           / (dlon * dlon + dlat * dlat + 1e-10)))
        lat, lon = a["lat"] + u * dlat, a["lon"] + u * dlon
        dist = F.hypot(F.col("_plon") - lon, F.col("_plat") - lat)
        return F.struct(dist.alias("d"), i.alias("i"), (i + u).alias("at"), lat.alias("lat"), lon.alias("lon"))

    best = F.array_min(F.transform(F.sequence(F.lit(0), n - 2), project))
    out = j.withColumn("_b", F.explode(F.array(best)))
    return out.select(point_id, "edge_id", F.concat("edge_id", F.lit("_0")).alias("lane"),
                      (F.col("_b.at") * F.col("length_m") / (n - 1)).alias("position"), F.col("_b.lat").alias("lat"),
                      F.col("_b.lon").alias("lon"), "dist_m")


def clamp_site(placements: DataFrame, lanes: DataFrame) -> DataFrame:
    """Station extents inside their lanes: lanes of 5 m or more, start <= len - 5, end >= start + 5 and <= len."""
    j = placements.join(lanes.filter("lane_length >= 5"), "lane")
    ln = F.col("lane_length")
    start0 = F.coalesce("position", F.lit(0.0))
    start = F.greatest(F.lit(0.0), F.least(start0, ln - 5))
    end = F.greatest(start + 5, F.least(F.coalesce(F.col("end_position"), start0 + 15), ln))
    bad = (start >= end) | (end > ln)
    return j.select("station_id", "lane", F.when(bad, 0.0).otherwise(start).alias("start_pos"),
                    F.when(bad, F.least(F.lit(15.0), ln)).otherwise(end).alias("end_pos"),
                    F.lit(POWER_W).alias("power"), F.lit(EFFICIENCY).alias("efficiency"))


def resolve_lanes(placements: DataFrame, edges: DataFrame) -> DataFrame:
    """Placement edge -> first lane and a 10 m site at least 5 m from the ends; sink and source edges dropped."""
    usable = placements.filter(~F.col("edge_id").endswith("-sink") & ~F.col("edge_id").endswith("-source"))
    j = usable.join(edges.select("edge_id", "length_m"), "edge_id")
    pos = F.greatest(F.lit(5.0), F.least(F.coalesce("position", F.col("length_m") / 2), F.col("length_m") - 5))
    return j.withColumn("lane", F.concat("edge_id", F.lit("_0"))).withColumn("position", pos).withColumn(
        "end_position", F.least(F.col("position") + 10, F.col("length_m") - 1))


def initial_soc(vehicle_id: Column) -> Column:
    return 0.6 + 0.4 * (ord_sum(vehicle_id) % 1000) / 1000.0


def assign_stops(routes: DataFrame, stations: DataFrame, starts: DataFrame, low_soc: float = 0.4,
                 chance: int = 15) -> DataFrame:
    """Charging stop of each trip.

    First route edge (by pos) that has a station, station chosen by the id hash; else, for trips below ``low_soc``
    whose hash % 100 < ``chance``, the station nearest to the start.
    routes: trip_id, pos, edge_id; stations: station_id, edge_id, lat, lon; starts: trip_id, lat, lon.
    """
    listed = row_numbers(stations, ["edge_id"], ["station_id"], "_k")
    counts = stations.groupBy("edge_id").agg(F.count(F.lit(1)).alias("_n"))
    first = (routes.join(counts, "edge_id").groupBy("trip_id")
             .agg(F.min_by(F.struct("edge_id", "_n"), F.struct("pos", "edge_id")).alias("_e")).select("trip_id", "_e.*"))
    via = (first.withColumn("_k", ord_sum(F.col("trip_id")) % F.col("_n") + 1)
           .join(listed.select("edge_id", "_k", "station_id"), ["edge_id", "_k"])
           .select("trip_id", "station_id", F.lit("on_route").alias("reason")))
    rest = (starts.join(first.select("trip_id"), "trip_id", "left_anti")
            .filter((initial_soc(F.col("trip_id")) < low_soc) & (ord_sum(F.col("trip_id")) % 100 < chance)))
    near = nearest(rest, stations, "trip_id", "station_id").select("trip_id", "station_id", F.lit("nearest").alias("reason"))
    return via.unionByName(near)


def edge_use(routes: DataFrame) -> DataFrame:
    """How many routed trips run over each edge."""
    return routes.groupBy("edge_id").agg(F.count_distinct("trip_id").alias("paths"))


def top_edges(flow: DataFrame, k: int) -> DataFrame:
    """The k busiest edges."""
    return flow.orderBy(F.col("entered").desc(), "edge_id").limit(k)
