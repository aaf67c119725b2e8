"""Trajectories and roads."""

from pyspark.sql import functions as F

from voltgrid.operators import roads, tiles, trajectories as tr
from voltgrid.functions.hashing import normal_sql, uniform_sql
from voltgrid.plans.catalog.demand import r6, rnd
from voltgrid.plans.catalog.features import rs
from voltgrid.plans.registry import query, view

view("v_pts", "SELECT veh_id, lat, lon, epoch(ts) AS t, week, ord FROM fx_points")
_W = "PARTITION BY veh_id ORDER BY t, ord"


def pts(t):
    return t.fx("points").select("veh_id", "lat", "lon", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1e6).alias("t"), "week", "ord")


def hav(a, b, c, d):
    return (f"2 * 6371 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) "
            f"* pow(sin(radians({d} - {b}) / 2), 2)))")


@query("prj29_normalize_per_vehicle", """SELECT ord, round(CASE WHEN hi > lo THEN (t - lo) / (hi - lo) * 3600 ELSE 0 END, 4) AS t FROM
 (SELECT *, min(t) OVER (PARTITION BY veh_id) AS lo, max(t) OVER (PARTITION BY veh_id) AS hi FROM v_pts) q""")
def _(t):
    return tr.normalize_per_vehicle(pts(t)).select("ord", rnd("t", 4).alias("t"))


@query("prj30_normalize_all", """SELECT ord, round((t - lo) / (hi - lo) * 3600, 4) AS t FROM (SELECT *, min(t) OVER () AS lo, max(t) OVER () AS hi
 FROM v_pts WHERE ord % 5 <> 0) q""")
def _(t):
    raw = pts(t).withColumn("timestamp", F.when(F.col("ord") % 5 == 0, F.lit("n/a")).otherwise(F.col("t").cast("string")))
    return tr.normalize_all(raw.drop("t")).select("ord", rnd("t", 4).alias("t"))


BOX = {"min_lat": 42.23, "max_lat": 42.31, "min_lon": -83.79, "max_lon": -83.70}


@query("prj31_box_filter", "SELECT ord FROM fx_points WHERE lat BETWEEN 42.23 AND 42.31 AND lon BETWEEN -83.79 AND -83.70")
def _(t):
    return tr.in_box(t.fx("points"), BOX).select("ord")


view("v_dest", "SELECT veh_id, lat, lon, t FROM (SELECT *, row_number() OVER (PARTITION BY veh_id ORDER BY t DESC, ord DESC) AS k FROM v_pts) q WHERE k = 1")
view("v_dwell", f"""SELECT veh_id, lat, lon, t, ord, t2 - t AS dwell_seconds FROM (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(t) OVER w AS t2
 FROM v_pts WINDOW w AS ({_W})) q WHERE {hav('lat', 'lon', 'lat2', 'lon2')} < 0.05 AND t2 - t > 7200""")
view("v_used", f"""SELECT veh_id, lat, lon, t, ord, row_number() OVER w AS rn, coalesce({hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) * 0.2 AS used
 FROM v_pts WINDOW w AS ({_W})""")
@query("win01_trip_destination", f"SELECT veh_id, {rs('lat', 'lon')}, round(t, 3) AS t FROM v_dest")
def _(t):
    return tr.destinations(pts(t)).select("veh_id", *r6("lat", "lon"), rnd("t", 3).alias("t"))


@query("win02_long_dwell", "SELECT veh_id, ord, round(dwell_seconds, 3) AS dwell_seconds FROM v_dwell")
def _(t):
    return tr.long_dwells(pts(t)).select("veh_id", "ord", rnd("dwell_seconds", 3).alias("dwell_seconds"))


# The fold written as a recursive query over row numbers, one step per row of the longest vehicle.
_FOLD = """WITH RECURSIVE u AS MATERIALIZED (SELECT * FROM v_used), fold(veh_id, rn, energy, soc) AS (SELECT veh_id, rn, 35e0, 1e0 FROM u WHERE rn = 1 UNION ALL
 SELECT u.veh_id, u.rn, CASE WHEN (f.energy - u.used) / 35e0 < 0.2 THEN 28e0 ELSE f.energy - u.used END, (f.energy - u.used) / 35e0
 FROM fold f JOIN u ON u.veh_id = f.veh_id AND u.rn = f.rn + 1)"""
_LOW = """SELECT u.veh_id, u.ord, round(f.soc, 6) AS soc FROM fold f JOIN u ON u.veh_id = f.veh_id AND u.rn = f.rn WHERE f.rn > 1 AND f.soc < 0.2"""


@query("win04_low_charge_points", f"{_FOLD} {_LOW}")
def _(t):
    return tr.low_charge_points(pts(t)).select("veh_id", "ord", *r6("soc"))


@query("win05_demand_points", f"""{_FOLD} SELECT kind, count(*) AS n, round(sum(lat), 4) AS lat, round(sum(lon), 4) AS lon FROM (SELECT 'trip_destination' AS kind, lat, lon FROM v_dest
 UNION ALL SELECT 'long_dwell', lat, lon FROM v_dwell UNION ALL SELECT 'low_soc', u.lat, u.lon FROM fold f JOIN u ON u.veh_id = f.veh_id AND u.rn = f.rn
 WHERE f.rn > 1 AND f.soc < 0.2) q GROUP BY 1""")
def _(t):
    return tr.demand_points(pts(t)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("lat"), 4).alias("lat"),
                                                        rnd(F.sum("lon"), 4).alias("lon"))


view("v_od", f"""SELECT veh_id, count(*) AS points, arg_min(lat, (t, ord)) AS from_lat, arg_min(lon, (t, ord)) AS from_lon, min(t) AS t0,
 arg_max(lat, (t, ord)) AS to_lat, arg_max(lon, (t, ord)) AS to_lon, max(t) AS t1 FROM v_pts GROUP BY 1 HAVING count(*) >= 2""")


@query("win06_od_pairs", f"SELECT veh_id, points, {rs('from_lat', 'from_lon', 'to_lat', 'to_lon')} FROM v_od")
def _(t):
    return tr.od_pairs(pts(t)).select("veh_id", "points", *r6("from_lat", "from_lon", "to_lat", "to_lon"))


@query("win07_trips", f"""SELECT veh_id, round(2400 * {uniform_sql(42, 'veh_id', "'dep'")}, 6) AS depart, round(duration, 6) AS duration, {rs('from_lat', 'from_lon', 'to_lat', 'to_lon')} FROM
 (SELECT *, CASE WHEN t1 > t0 THEN 60 + 540 * {uniform_sql(42, 'veh_id', "'len'")} ELSE 120 END AS duration FROM v_od) q
 WHERE (abs(to_lat - from_lat) >= 0.0005 OR abs(to_lon - from_lon) >= 0.0005) AND duration >= 15""")
def _(t):
    return tr.trips(pts(t)).select("veh_id", *r6("depart", "duration", "from_lat", "from_lon", "to_lat", "to_lon"))


def _jitter(axis: str) -> str:
    return f"round({axis} + (2 * {uniform_sql(42, 'veh_id', 'ord', chr(39) + axis + chr(39))} - 1) * 1e-4, 6) AS {axis}"


@query("prj40_via_points", f"""SELECT veh_id, CAST(i / step AS INT) AS via, {_jitter('lat')}, {_jitter('lon')} FROM (SELECT *, greatest(2, floor(n / (want + 1))) AS step FROM
 (SELECT *, row_number() OVER ({_W}) - 1 AS i, count(*) OVER (PARTITION BY veh_id) AS n, CASE WHEN count(*) OVER (PARTITION BY veh_id) > 4
 THEN least(3, floor(count(*) OVER (PARTITION BY veh_id) / 15)) ELSE 0 END AS want FROM v_pts) a) b WHERE want > 0 AND i > 0 AND i % step = 0 AND i < n - step AND i / step <= want""")
def _(t):
    return tr.via_points(pts(t)).select("veh_id", "via", *r6("lat", "lon"))


@query("agg69_extent", """SELECT count(*) AS points, count(DISTINCT veh_id) AS vehicles, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat,
 round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon, round(min(t), 3) AS t_first, round(max(t), 3) AS t_last FROM v_pts""")
def _(t):
    return tr.extent(pts(t)).select("points", "vehicles", *r6("min_lat", "max_lat", "min_lon", "max_lon"),
                                    rnd("t_first", 3).alias("t_first"), rnd("t_last", 3).alias("t_last"))


# --- roads --------------------------------------------------------------------------------------------------
# Each edge is two straight pieces of 5s metres: (4s, 3s) and then (5s, 0), s = length / 10.
view("v_shape", """SELECT *, (lon0 + 83.8084) * 82000 AS x0, (lat0 - 42.217) * 111320 AS y0, length_m / 10 AS s FROM fx_edges""")


def edges(t):
    e = t.fx("edges")
    x, y = roads.to_xy(F.col("lat0"), F.col("lon0"))
    s = F.col("length_m") / 10
    pt = lambda a, b: F.struct((x + a * s).alias("x"), (y + b * s).alias("y"))
    return e.withColumn("shape", F.array(pt(0.0, 0.0), pt(4.0, 3.0), pt(9.0, 3.0)))


def _at(pos):
    return (f"(x0 + s * CASE WHEN {pos} <= 5 * s THEN 4 * {pos} / (5 * s) WHEN {pos} <= 10 * s THEN 4 + ({pos} - 5 * s) / s ELSE 9 END)",
            f"(y0 + s * CASE WHEN {pos} <= 5 * s THEN 3 * {pos} / (5 * s) ELSE 3 END)")


def _ll(x, y):
    return f"(42.217 + {y} / 111320)", f"(-83.8084 + {x} / 82000)"


_PX, _PY = _at("(length_m * k / 4)")


@query("gen30_point_along_edge", f"SELECT edge_id, k, round({_PX}, 4) AS x, round({_PY}, 4) AS y FROM v_shape CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) v(k)")
def _(t):
    e = edges(t).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    e = e.withColumn("p", roads.point_at(F.col("shape"), F.col("length_m") * F.col("k") / 4))
    return e.select("edge_id", "k", rnd("p.x", 4).alias("x"), rnd("p.y", 4).alias("y"))


def _in_box(lat, lon, m=0.005):
    return f"{lat} > 42.23 - {m} AND {lat} < 42.31 + {m} AND {lon} > -83.79 - {m} AND {lon} < -83.70 + {m}"


_PROBE = " OR ".join(f"({_in_box(*_ll(*_at(f'({f} * length_m)')))})" for f in (0.1, 0.3, 0.5, 0.7, 0.9))
_SX, _SY = _at("p")
view("v_site", f"""SELECT edge_id, p AS position, least(p + 15, length_m) AS end_position, {_ll(_SX, _SY)[0]} AS lat, {_ll(_SX, _SY)[1]} AS lon FROM
 (SELECT *, unnest(range(15, CAST(floor(length_m) AS INT) - 10, greatest(25, CAST(floor(length_m / 8) AS INT)))) AS p FROM v_shape
 WHERE length_m >= 20 AND passenger AND ({_PROBE})) q WHERE {_in_box(*_ll(_SX, _SY))}""")


@query("gen17_candidate_sites", f"SELECT edge_id, CAST(position AS INT) AS position, end_position, {rs('lat', 'lon')} FROM v_site")
def _(t):
    return roads.candidate_sites(edges(t), BOX).select("edge_id", "position", "end_position", *r6("lat", "lon"))


@query("gen18_fraction_sites", "SELECT DISTINCT edge_id, round(f * length_m, 6) AS position FROM fx_edges CROSS JOIN (VALUES (0.2e0), (0.5e0), (0.8e0)) v(f) WHERE f * length_m < length_m")
def _(t):
    return roads.fraction_sites(edges(t)).select("edge_id", *r6("position"))


@query("gen31_fallback_sites", f"""SELECT edge_id, length_m / 2 AS position, {', '.join(f'round({e}, 6) AS {n}' for e, n in zip(_ll(*_at('(length_m / 2)')), ('lat', 'lon')))}
 FROM (SELECT * FROM v_shape WHERE passenger ORDER BY edge_no LIMIT 60) b""")
def _(t):
    return roads.fallback_sites(edges(t), 20).select("edge_id", "position", *r6("lat", "lon"))


@query("gen26_every_kth_edge", """SELECT edge_id FROM (SELECT edge_id, row_number() OVER (ORDER BY edge_no) - 1 AS nr, greatest(1, floor(count(*) OVER () / 60)) AS k FROM fx_edges) q
 WHERE nr % k = 0 AND nr / k < 60""")
def _(t):
    return roads.every_kth_edge(edges(t), 60).select("edge_id")


@query("jon08_nearest_site", """SELECT osmid, site_id, round(d, 6) AS dist FROM (SELECT osmid, site_id, sqrt(pow(e.lat - s.lat, 2) + pow(e.lon - s.lon, 2)) AS d,
 row_number() OVER (PARTITION BY osmid ORDER BY sqrt(pow(e.lat - s.lat, 2) + pow(e.lon - s.lon, 2)), site_id) AS k FROM fx_elements e CROSS JOIN fx_sites s) q WHERE k = 1""")
def _(t):
    return tiles.nearest(t.fx("elements"), t.fx("sites"), "osmid", "site_id", point_type="long").select("osmid", "site_id", *r6("dist"))


def _seg(ax, ay, bx, by):
    u = f"least(1, greatest(0, ((px - {ax}) * ({bx} - {ax}) + (py - {ay}) * ({by} - {ay})) / greatest(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2), 1e-12)))"
    return f"sqrt(pow(px - ({ax} + {u} * ({bx} - {ax})), 2) + pow(py - ({ay} + {u} * ({by} - {ay})), 2))"


view("v_near_edge", f"""SELECT site_id, edge_id, dist_m FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY dist_m, edge_id) AS k FROM
 (SELECT p.site_id, e.edge_id, round(least({_seg('x0', 'y0', '(x0 + 4 * s)', '(y0 + 3 * s)')}, {_seg('(x0 + 4 * s)', '(y0 + 3 * s)', '(x0 + 9 * s)', '(y0 + 3 * s)')}), 6) AS dist_m
 FROM (SELECT *, (lon + 83.8084) * 82000 AS px, (lat - 42.217) * 111320 AS py FROM fx_sites) p CROSS JOIN v_shape e) d) q WHERE k = 1 AND dist_m <= 400""")


@query("jon09_nearest_edge", "SELECT site_id, edge_id, round(dist_m, 4) AS dist_m FROM v_near_edge")
def _(t):
    return roads.nearest_edge(t.fx("sites"), edges(t), "site_id", 400.0).select("site_id", "edge_id", rnd("dist_m", 4).alias("dist_m"))


def _proj(i):
    (a, b) = ((("lat0", "lon0"), _ll("(x0 + 4 * s)", "(y0 + 3 * s)")), (_ll("(x0 + 4 * s)", "(y0 + 3 * s)"), _ll("(x0 + 9 * s)", "(y0 + 3 * s)")))[i]
    u = f"least(1, greatest(0, ((lon - {a[1]}) * ({b[1]} - {a[1]}) + (lat - {a[0]}) * ({b[0]} - {a[0]})) / (pow({b[1]} - {a[1]}, 2) + pow({b[0]} - {a[0]}, 2) + 1e-10)))"
    return f"{i} + {u} AS at{i}, {a[0]} + {u} * ({b[0]} - {a[0]}) AS la{i}, {a[1]} + {u} * ({b[1]} - {a[1]}) AS lo{i}"


@query("jon24_snap_to_edge", f"""SELECT site_id, edge_id, round((CASE WHEN d0 <= d1 THEN at0 ELSE at1 END) * length_m / 2, 4) AS position,
 round(CASE WHEN d0 <= d1 THEN la0 ELSE la1 END, 6) AS lat, round(CASE WHEN d0 <= d1 THEN lo0 ELSE lo1 END, 6) AS lon FROM (SELECT *,
 sqrt(pow(lon - lo0, 2) + pow(lat - la0, 2)) AS d0, sqrt(pow(lon - lo1, 2) + pow(lat - la1, 2)) AS d1 FROM (SELECT p.site_id, p.lat, p.lon, e.edge_id, e.length_m, {_proj(0)}, {_proj(1)}
 FROM v_near_edge n JOIN fx_sites p ON p.site_id = n.site_id JOIN v_shape e ON e.edge_id = n.edge_id) a) b""")
def _(t):
    return roads.snap_to_edge(t.fx("sites"), edges(t), "site_id", None, 400.0).select(
        "site_id", "edge_id", rnd("position", 4).alias("position"), *r6("lat", "lon"))


view("v_end_edge", f"""SELECT veh_id, side, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY veh_id, side ORDER BY dist_m, edge_id) AS k FROM
 (SELECT p.veh_id, side, e.edge_id, round(least({_seg('x0', 'y0', '(x0 + 4 * s)', '(y0 + 3 * s)')}, {_seg('(x0 + 4 * s)', '(y0 + 3 * s)', '(x0 + 9 * s)', '(y0 + 3 * s)')}), 6) AS dist_m
 FROM (SELECT *, (lon + 83.8084) * 82000 AS px, (lat - 42.217) * 111320 AS py FROM (SELECT veh_id, 'from' AS side, from_lat AS lat, from_lon AS lon FROM v_od UNION ALL
 SELECT veh_id, 'to', to_lat, to_lon FROM v_od) o) p CROSS JOIN v_shape e) d) q WHERE k = 1 AND dist_m <= 400""")
view("v_edge_trips", f"""SELECT o.veh_id, round(greatest(0, o.t0 / 1000 + 60 * {normal_sql(42, 'o.veh_id')}), 6) AS depart, a.edge_id AS from_edge, b.edge_id AS to_edge FROM v_od o
 JOIN v_end_edge a ON a.veh_id = o.veh_id AND a.side = 'from' JOIN v_end_edge b ON b.veh_id = o.veh_id AND b.side = 'to' WHERE a.edge_id <> b.edge_id""")


@query("win08_edge_trips", "SELECT * FROM v_edge_trips")
def _(t):
    return tr.edge_trips(pts(t), edges(t)).select("veh_id", *r6("depart"), "from_edge", "to_edge")


@query("agg62_edge_use", "SELECT edge_id, count(DISTINCT trip_id) AS paths FROM fx_route_edges GROUP BY 1")
def _(t):
    return roads.edge_use(t.fx("route_edges"))


@query("prj33_site_clamp", """SELECT edge_id || '_' || k AS station_id, CASE WHEN st >= en OR en > length_m THEN 0 ELSE st END AS start_pos,
 CASE WHEN st >= en OR en > length_m THEN least(15, length_m) ELSE en END AS end_pos, 50000e0 AS power, 0.95e0 AS efficiency FROM (SELECT *, greatest(st + 5, least(p0 + 15, length_m)) AS en FROM
 (SELECT *, greatest(0, least(p0, length_m - 5)) AS st FROM (SELECT edge_id, length_m / 3 AS length_m, k, k * 40e0 AS p0 FROM fx_edges CROSS JOIN (VALUES (0), (1), (3)) v(k)) a
 WHERE length_m >= 5) b) c""")
def _(t):
    e = t.fx("edges").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))))
    lane = F.concat("edge_id", F.lit("_0"))
    p = e.select(F.concat_ws("_", "edge_id", "k").alias("station_id"), lane.alias("lane"), (F.col("k") * 40.0).alias("position"),
                 F.lit(None).cast("double").alias("end_position"))
    lanes = t.fx("edges").select(lane.alias("lane"), (F.col("length_m") / 3).alias("lane_length"))
    return roads.clamp_site(p, lanes).select("station_id", "start_pos", "end_pos", "power", "efficiency")


@query("jon25_lane_resolution", """SELECT site_id, greatest(5, least(100e0, length_m - 5)) AS position, least(greatest(5, least(100e0, length_m - 5)) + 10, length_m - 1) AS end_position
 FROM (SELECT site_id, 'e_' || (site_no % 60) AS edge_id FROM fx_sites WHERE site_no % 9 <> 0) p JOIN fx_edges e ON p.edge_id = e.edge_id""")
def _(t):
    no = F.col("site_no")
    p = t.fx("sites").select("site_id", F.concat(F.lit("e_"), no % 60, F.when(no % 9 == 0, "-sink").otherwise("")).alias("edge_id"), F.lit(100.0).alias("position"))
    return roads.resolve_lanes(p, edges(t)).select("site_id", "position", "end_position")


_ORDS = "list_sum(list_transform(str_split(trip_id, ''), lambda c: ascii(c)))"
view("v_trip", f"SELECT trip_id, {_ORDS} AS h FROM (SELECT DISTINCT trip_id FROM fx_route_edges) q")
view("v_estation", "SELECT 's' || lpad(CAST(site_no AS VARCHAR), 6, '0') AS station_id, 'e_' || (site_no % 60) AS edge_id, lat, lon FROM fx_sites")
view("v_first", """SELECT trip_id, arg_min(r.edge_id, (pos, r.edge_id)) AS edge_id FROM fx_route_edges r WHERE edge_id IN (SELECT edge_id FROM v_estation) GROUP BY 1""")


def _stations(t):
    no = F.col("site_no")
    return t.fx("sites").select(F.concat(F.lit("s"), F.lpad(no.cast("string"), 6, "0")).alias("station_id"),
                                F.concat(F.lit("e_"), (no % 60).cast("string")).alias("edge_id"), "lat", "lon")


@query("jon18_charging_stops", """SELECT f.trip_id, s.station_id, 'on_route' AS reason FROM v_first f JOIN v_trip t ON f.trip_id = t.trip_id JOIN
 (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY station_id) - 1 AS k, count(*) OVER (PARTITION BY edge_id) AS n FROM v_estation) s ON s.edge_id = f.edge_id AND s.k = t.h % s.n
 UNION ALL SELECT trip_id, station_id, 'nearest' FROM (SELECT trip_id, station_id, row_number() OVER (PARTITION BY trip_id ORDER BY sqrt(pow(a.lat0 - s.lat, 2) + pow(a.lon0 - s.lon, 2)), station_id) AS k
 FROM (SELECT t.trip_id, e.lat0, e.lon0 FROM v_trip t JOIN (SELECT trip_id, arg_min(edge_id, (pos, edge_id)) AS edge_id FROM fx_route_edges GROUP BY 1) o ON o.trip_id = t.trip_id
 JOIN fx_edges e ON e.edge_id = o.edge_id WHERE t.trip_id NOT IN (SELECT trip_id FROM v_first) AND 0.6 + 0.4 * (h % 1000) / 1000 < 0.7 AND h % 100 < 15) a CROSS JOIN v_estation s) q WHERE k = 1""")
def _(t):
    r = t.fx("route_edges")
    first = r.groupBy("trip_id").agg(F.min_by("edge_id", F.struct("pos", "edge_id")).alias("edge_id"))
    starts = first.join(t.fx("edges").select("edge_id", F.col("lat0").alias("lat"), F.col("lon0").alias("lon")), "edge_id").drop("edge_id")
    return roads.assign_stops(r, _stations(t), starts, low_soc=0.7)


@query("prj35_initial_soc", f"SELECT trip_id, round(0.6 + 0.4 * (h % 1000) / 1000, 6) AS soc, round(64000 * (0.6 + 0.4 * (h % 1000) / 1000), 4) AS charge_wh FROM v_trip")
def _(t):
    v = t.fx("route_edges").select("trip_id").distinct().withColumn("soc", roads.initial_soc(F.col("trip_id")))
    return v.select("trip_id", *r6("soc"), rnd(F.col("soc") * 64000, 4).alias("charge_wh"))


@query("set01_union_files", "SELECT source, count(*) AS n FROM (SELECT 'points' AS source, ord FROM fx_points UNION ALL SELECT 'dwell', ord FROM v_dwell) q GROUP BY 1")
def _(t):
    a = pts(t).select(F.lit("points").alias("source"), "ord")
    b = tr.long_dwells(pts(t)).select(F.lit("dwell").alias("source"), "ord")
    return a.unionByName(b).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
