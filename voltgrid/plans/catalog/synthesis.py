"""Synthesis, candidates and combinations."""

import numpy as np
from pyspark.sql import functions as F

from voltgrid.functions.hashing import exponential_sql, normal_sql, uniform_sql
from voltgrid.operators import candidates as cand, models, roads, synthesis as syn, trajectories as tr
from voltgrid.plans.catalog.demand import r6, rnd
from voltgrid.plans.catalog.features import rs
from voltgrid.plans.catalog.models import FX, train_rows
from voltgrid.plans.catalog.trajectories import BOX, edges, pts
from voltgrid.plans.registry import query, view


_V = ("grid_id", "vehicle_no")
_A = ("area_id", "vehicle_no")
_CITY = 100
_KINDS = ", ".join("(" + ", ".join([str(i), *(repr(x) if isinstance(x, str) else f"{x}::DOUBLE" for x in row)]) + ")" for i, row in enumerate(syn.PATTERNS))


def _q(text: str) -> str:
    return f"'{text}'"


def _end_sql(axis: str, end: str) -> str:
    s = f"spread_{axis}"
    return f"(min_{axis} + max_{axis}) / 2 + least(greatest({normal_sql(42, *_A, _q(axis + end))} * {s} / 2, -{s}), {s}) AS {axis}_{end}"


def _city_sql(axis: str) -> str:
    wander = f"CASE WHEN j = 0 THEN 0 ELSE {normal_sql(42, *_A, 'j', _q(axis))} * spread_{axis} * 0.05 END"
    return f"""round({axis}_a + s * ({axis}_b - {axis}_a) + CASE pattern WHEN 'commuter' THEN 0 WHEN 'shopping' THEN 0.1 * sin(pi() * s) * spread_{axis} * 0.1 ELSE {wander} END, 6) AS {axis}"""


view("v_city", f"""SELECT *, {', '.join(_end_sql(a, e) for a in ('lat', 'lon') for e in 'ab')}, CAST(floor(n_lo + {uniform_sql(42, *_A, _q('n'))} * (n_hi - n_lo)) AS INT) AS points FROM
 (SELECT *, s_lo + (s_hi - s_lo) * {uniform_sql(42, *_A, _q('slat'))} AS spread_lat, s_lo + (s_hi - s_lo) * {uniform_sql(42, *_A, _q('slon'))} AS spread_lon FROM
 (SELECT *, CAST(floor({uniform_sql(42, *_A, _q('pattern'))} * {len(syn.PATTERNS)}) AS INT) AS kind FROM fx_areas CROSS JOIN (SELECT unnest(range(0, {_CITY})) AS vehicle_no) v) a
 JOIN (VALUES {_KINDS}) p(kind, pattern, n_lo, n_hi, s_lo, s_hi, m_lo, m_hi, mean_kwh, mean_hours, vehicle_type) ON p.kind = a.kind) b""")


@query("gen09_city_trajectories", f"""SELECT area_id, 'vehicle_' || area_id || '_' || vehicle_no AS veh_id, CAST(j AS INT) AS point_order, pattern, vehicle_type, {_city_sql('lat')}, {_city_sql('lon')},
 round(j * (m_lo + (m_hi - m_lo) * {uniform_sql(42, *_A, 'j', _q('m'))}) / points * 60, 6) AS t, round({exponential_sql(42, 'mean_kwh', *_A, 'j', _q('kwh'))}, 6) AS kwh,
 round({exponential_sql(42, 'mean_hours', *_A, 'j', _q('h'))}, 6) AS hours, 'synthetic_station_' || (vehicle_no + j) % 50 AS station_id FROM
 (SELECT *, CASE WHEN points > 1 THEN j / (points - 1) ELSE 0 END AS s FROM (SELECT *, unnest(range(0, points)) AS j FROM v_city) x) y""")
def _(t):
    return syn.city_trajectories(t.fx("areas"), _CITY).select("area_id", "veh_id", "point_order", "pattern", "vehicle_type", *r6("lat", "lon", "t", "kwh", "hours"), "station_id")




def _line_sql(axis: str) -> str:
    a, b = (f"(min_{axis} + (max_{axis} - min_{axis}) * {uniform_sql(42, *_V, chr(39) + axis + end + chr(39))})" for end in "ab")
    return f"round({a} + ({b} - {a}) * (j / (points - 1)) + 0.001 * {normal_sql(42, *_V, 'j', chr(39) + axis + chr(39))}, 6) AS {axis}"


@query("gen10_grid_trajectories", f"""SELECT grid_id, 'vehicle_' || grid_id || '_' || vehicle_no AS veh_id, {_line_sql('lat')}, {_line_sql('lon')}, j * 60e0 AS t FROM
 (SELECT *, unnest(range(0, points)) AS j FROM (SELECT *, CAST(5 + floor(10 * {uniform_sql(42, *_V, "'n'")}) AS INT) AS points FROM fx_cells CROSS JOIN (SELECT unnest(range(0, 50)) AS vehicle_no) v) a) b""")
def _(t):
    return syn.grid_trajectories(t.fx("cells"), 50).select("grid_id", "veh_id", *r6("lat", "lon"), "t")


def _walk_sql(axis: str) -> str:
    return f"greatest(min_{axis}, least(max_{axis}, {axis} + 0.005 * {normal_sql(42, *_V, 'j + 1', _q('d' + axis))}))"


@query("gen11_random_walks", f"""WITH RECURSIVE w AS (SELECT *, 0::BIGINT AS j, min_lat + (max_lat - min_lat) * {uniform_sql(42, *_V, _q('lat'))} AS lat, min_lon + (max_lon - min_lon) * {uniform_sql(42, *_V, _q('lon'))} AS lon,
 10 + floor(10 * {uniform_sql(42, *_V, _q('n'))}) AS n FROM fx_cells CROSS JOIN (SELECT unnest(range(0, 3)) AS vehicle_no) v
 UNION ALL SELECT * REPLACE (j + 1 AS j, {_walk_sql('lat')} AS lat, {_walk_sql('lon')} AS lon) FROM w WHERE j + 1 < n)
 SELECT grid_id, 'vehicle_' || grid_id || '_' || vehicle_no AS veh_id, round(lat, 6) AS lat, round(lon, 6) AS lon, j * 60e0 AS t FROM w""")
def _(t):
    return syn.random_walks(t.fx("cells"), 3).select("grid_id", "veh_id", *r6("lat", "lon"), "t")


@query("gen12_charging_points", f"""SELECT area_id, round((min_lat + max_lat) / 2 + 0.05 * {normal_sql(42, *_A, "'lat'")}, 6) AS lat, round((min_lon + max_lon) / 2 + 0.05 * {normal_sql(42, *_A, "'lon'")}, 6) AS lon,
 round({exponential_sql(42, '50', *_A, "'kwh'")}, 6) AS kwh, round({exponential_sql(42, '2', *_A, "'h'")}, 6) AS hours, vehicle_no * 3600e0 AS t, 'synthetic_' || area_id || '_' || vehicle_no AS station_id
 FROM fx_areas CROSS JOIN (SELECT unnest(range(0, 500)) AS vehicle_no) v""")
def _(t):
    return syn.charging_points(t.fx("areas")).select("area_id", *r6("lat", "lon", "kwh", "hours"), "t", "station_id")


def _noise_sql(c: str) -> str:
    amount = 0.05 if c == "y" else 0.1
    return f"round(least(greatest({c} + {amount} * sd_{c} * {normal_sql(42, 'draw', _q(c))}, lo_{c}), hi_{c}), 6) AS {c}"


@query("gen13_noise_samples", f"""SELECT {', '.join(map(_noise_sql, (*FX, 'y')))} FROM (SELECT draw, floor({uniform_sql(42, 'draw')} * (SELECT count(*) FROM v_train)) + 1 AS rn FROM (SELECT unnest(range(0, 300)) AS draw) d) p
 JOIN (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM v_train) r ON r.rn = p.rn CROSS JOIN
 (SELECT {', '.join(f'quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}, stddev_samp({c}) AS sd_{c}' for c in (*FX, 'y'))} FROM v_train) b""")
def _(t):
    return syn.noise_samples(train_rows(t), FX, "y", "id", 300).select(*r6(*FX, "y"))


@query("gen14_smote_samples")
def _(t):
    return syn.smote_samples(train_rows(t), FX, "y", "id", 300)


@query("gen15_mixture_samples")
def _(t):
    return syn.mixture_samples(train_rows(t), FX, "y", 300, components=3)


@query("gen16_augmentation")
def _(t):
    return syn.augment(train_rows(t), FX, "y", "id", "mixed", 0.3).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


_FACTOR = 0.9 + 0.2 * np.random.RandomState(42).random_sample()


@query("gen27_vary_demand", f"""SELECT trip_id, round(greatest(0, depart + (2 * {uniform_sql(42, 'trip_id', '0', "'t'")} - 1) * 600), 6) AS depart, 0::BIGINT AS copy FROM
 (SELECT o_orderkey AS trip_id, CAST(o_orderkey % 3600 AS DOUBLE) AS depart, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) AS rn, count(*) OVER () AS n FROM orders) q
 WHERE rn <= greatest(1, floor(n * {_FACTOR!r}::DOUBLE))""")
def _(t):
    o = t.raw("orders").select(F.col("o_orderkey").alias("trip_id"), (F.col("o_orderkey") % 3600).cast("double").alias("depart"))
    return syn.vary_demand(o, "trip_id", "depart").select("trip_id", *r6("depart"), "copy")


_EXTRA = 100 + int(np.random.RandomState(42).randint(101))


@query("gen33_random_trips", f"""WITH e AS (SELECT edge_id, row_number() OVER (ORDER BY edge_no) - 1 AS k, count(*) OVER () AS n FROM fx_edges),
 d AS (SELECT draw, n, floor({uniform_sql(42, 'draw', "'a'")} * n) AS a, 1 + floor({uniform_sql(42, 'draw', "'b'")} * (n - 1)) AS hop FROM (SELECT unnest(range(0, {_EXTRA})) AS draw) r CROSS JOIN (SELECT max(n) AS n FROM e) m)
 SELECT veh_id AS trip_id, from_edge, to_edge, depart, 'observed' AS origin FROM v_edge_trips UNION ALL
 SELECT 'random_' || draw, x.edge_id, y.edge_id, round(3300 * {uniform_sql(42, 'draw', "'d'")}, 6), 'random' FROM d JOIN e x ON x.k = d.a JOIN e y ON y.k = (d.a + d.hop) % d.n""")
def _(t):
    return syn.hybrid_trips(tr.edge_trips(pts(t), edges(t)), edges(t)).select("trip_id", "from_edge", "to_edge", *r6("depart"), "origin")


def sites(t):
    n = F.col("site_no")
    return t.fx("sites").select(F.concat(F.lit("g"), (n % 3).cast("string")).alias("grid_id"), "site_id", F.concat(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (n % 3 + 1).cast("int")), F.lit("_"), n.cast("string")).alias("edge_id"),
                                "lat", "lon", F.element_at(F.array(F.lit("kmeans"), F.lit("random"), F.lit("uniform")), (F.floor(n / 3) % 3 + 1).cast("int")).alias("source_method"))


view("v_gsites", """SELECT 'g' || CAST(site_no % 3 AS INT) AS grid_id, site_id, list_value('a', 'b', 'c')[CAST(site_no % 3 AS INT) + 1] || '_' || site_no AS edge_id,
 list_value('kmeans', 'random', 'uniform')[CAST(floor(site_no / 3e0) AS INT) % 3 + 1] AS source_method, list_value('n', 's', 'e', 'w')[CAST(floor(site_no / 3e0) AS INT) % 4 + 1] AS prefix FROM fx_sites""")
view("v_slots", "SELECT unnest(range(1, 4)) AS slot")


def _first_valid(picks: str, count: int) -> str:
    """Of picks (grid_id, draw, site_id, edge_id): the first ``count`` different combinations of three sites on three edges."""
    return f"""SELECT grid_id, sites FROM (SELECT grid_id, sites, row_number() OVER (PARTITION BY grid_id ORDER BY draw) AS k FROM
 (SELECT grid_id, sites, min(draw) AS draw FROM (SELECT grid_id, draw, array_to_string(list_sort(list(site_id)), ',') AS sites FROM ({picks}) p GROUP BY 1, 2
 HAVING count(*) = 3 AND count(DISTINCT site_id) = 3 AND count(DISTINCT edge_id) = 3) c GROUP BY 1, 2) f) r WHERE k <= {count}"""


def _draws_sql(count: int) -> str:
    return f"(SELECT unnest(range(1, {8 * count + 1})) AS draw) d"


def _diverse_sql(stratum: str, count: int, source: str = "v_gsites") -> str:
    key = ("m.grid_id", "draw", f"m.{stratum}")
    return f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY grid_id, {stratum} ORDER BY site_id) AS rn,
 row_number() OVER (PARTITION BY grid_id ORDER BY site_id) AS ra FROM {source}),
 m AS (SELECT grid_id, {stratum}, count(*) AS m FROM ranked GROUP BY 1, 2), n AS (SELECT grid_id, count(*) AS n FROM ranked GROUP BY 1),
 u AS (SELECT m.grid_id, m.{stratum}, draw, floor({uniform_sql(42, *key)} * m) + 1 AS rn, {uniform_sql(43, *key)} AS u FROM m CROSS JOIN {_draws_sql(count)}),
 one AS (SELECT * FROM (SELECT grid_id, {stratum}, draw, rn, row_number() OVER (PARTITION BY grid_id, draw ORDER BY u) AS s FROM u) q WHERE s <= 3),
 have AS (SELECT o.grid_id, o.draw, r.site_id, r.edge_id FROM one o JOIN ranked r ON r.grid_id = o.grid_id AND r.{stratum} = o.{stratum} AND r.rn = o.rn),
 short AS (SELECT grid_id, draw, count(*) AS k FROM have GROUP BY 1, 2 HAVING count(*) < 3),
 hole AS (SELECT short.grid_id, short.draw, floor({uniform_sql(44, 'short.grid_id', 'draw', 'slot')} * n) + 1 AS ra
 FROM short JOIN n ON n.grid_id = short.grid_id CROSS JOIN v_slots WHERE slot > k),
 fill AS (SELECT h.grid_id, h.draw, r.site_id, r.edge_id FROM hole h JOIN ranked r ON r.grid_id = h.grid_id AND r.ra = h.ra)
 {_first_valid('SELECT * FROM have UNION ALL SELECT * FROM fill', count)}"""


def _sets(df):
    return df.select("grid_id", F.concat_ws(",", "sites").alias("sites"))


_RANDOM = f"""SELECT d.grid_id, draw, r.site_id, r.edge_id FROM (SELECT grid_id, draw, floor({uniform_sql(42, 'grid_id', 'draw', 'slot')} * n) + 1 AS rn
 FROM (SELECT grid_id, count(*) AS n FROM v_gsites GROUP BY 1) g CROSS JOIN {_draws_sql(2000)} CROSS JOIN v_slots) d
 JOIN (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY site_id) AS rn FROM v_gsites) r ON r.grid_id = d.grid_id AND r.rn = d.rn"""
_ROUND = """SELECT p.grid_id, draw, r.site_id, r.edge_id FROM p JOIN (SELECT *, row_number() OVER (PARTITION BY grid_id, source_method ORDER BY site_id) AS rn
 FROM v_gsites) r ON r.grid_id = p.grid_id AND r.source_method = p.source_method AND r.rn = p.rn"""


@query("gen19_random_combinations", _first_valid(_RANDOM, 2000))
def _(t):
    return _sets(cand.random_combinations(sites(t), 3, 2000))


@query("gen20_method_diverse", _diverse_sql("source_method", 400))
def _(t):
    return _sets(cand.diverse_combinations(sites(t), "source_method", 3, 400))


@query("gen21_spread_combinations")
def _(t):
    return cand.spread_combinations(sites(t), 3, 800)


@query("gen22_stratified_combinations", f"""WITH s AS (SELECT grid_id, source_method, row_number() OVER (PARTITION BY grid_id ORDER BY source_method) AS s,
 count(*) OVER (PARTITION BY grid_id) AS ns, m FROM (SELECT grid_id, source_method, count(*) AS m FROM v_gsites GROUP BY 1, 2) q),
 d AS (SELECT g.grid_id, draw, slot, (draw + slot) % ns + 1 AS s FROM (SELECT DISTINCT grid_id, ns FROM s) g CROSS JOIN {_draws_sql(400)} CROSS JOIN v_slots),
 p AS (SELECT d.grid_id, draw, source_method, floor({uniform_sql(42, 'd.grid_id', 'draw', 'slot')} * m) + 1 AS rn FROM d JOIN s ON s.grid_id = d.grid_id AND s.s = d.s)
 {_first_valid(_ROUND, 400)}""")
def _(t):
    return _sets(cand.stratified_combinations(sites(t), "source_method", 3, 400))


@query("gen24_prefix_combinations", _diverse_sql("prefix", 400, "(SELECT grid_id, site_id, prefix || '_' || site_id AS edge_id, prefix FROM v_gsites) v"))
def _(t):
    named = F.element_at(F.array(*map(F.lit, "nsew")), (F.floor(F.col("site_id").cast("long") / 3) % 4 + 1).cast("int"))
    s = sites(t).withColumn("edge_id", F.concat_ws("_", named, "site_id"))
    return _sets(cand.diverse_combinations(s.withColumn("prefix", F.split("edge_id", "_")[0]), "prefix", 3, 400))


@query("gen32_placement_configurations")
def _(t):
    # Three grids of very different size.
    n = F.col("site_no")
    s = t.fx("sites").select(F.when(n % 10 == 0, "small").when(n % 10 <= 3, "medium").otherwise("large").alias("grid_id"), "site_id", F.concat(F.lit("e_"), n.cast("string")).alias("edge_id"), "lat", "lon")
    return cand.placement_configurations(s, 3)


@query("gen23_stratified_sites", """SELECT site_id FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN k <= q THEN 0 ELSE 1 END, h, site_id) AS o FROM (SELECT *, row_number() OVER (PARTITION BY ra, rb ORDER BY h, site_id) AS k,
 greatest(1, floor(40 / (SELECT count(*) FROM (SELECT DISTINCT round(lat, 1), round(lon, 1) FROM fx_sites) d))) AS q FROM (SELECT site_id, md5('42|' || site_id) AS h, round(lat, 1) AS ra, round(lon, 1) AS rb FROM fx_sites) a) b) c WHERE o <= 40""")
def _(t):
    return cand.stratified_sites(t.fx("sites"), 40).select("site_id")


view("v_lattice", """SELECT area_id, i * 4 + j AS k, min_lat + (i + 1) * (max_lat - min_lat) / 5 AS lat, min_lon + (j + 1) * (max_lon - min_lon) / 5 AS lon FROM fx_areas, (SELECT unnest(range(4)) AS i) a, (SELECT unnest(range(4)) AS j) b WHERE i * 4 + j < 10""")


@query("gen25_target_lattice", f"SELECT area_id, CAST(k AS INT) AS k, {rs('lat', 'lon')} FROM v_lattice")
def _(t):
    return cand.target_lattice(t.fx("areas"), 10).select("area_id", "k", *r6("lat", "lon"))


@query("ml20_uniform_spacing", """SELECT area_id, CAST(k AS INT) AS k, site_id FROM (SELECT l.area_id, l.k, s.site_id, row_number() OVER (PARTITION BY l.area_id, l.k ORDER BY sqrt(pow(l.lat - s.lat, 2) + pow(l.lon - s.lon, 2)), s.site_id) AS r FROM v_lattice l CROSS JOIN fx_sites s) q WHERE r = 1""")
def _(t):
    return cand.uniform_spacing(t.fx("areas"), t.fx("sites"), 10).select("area_id", "k", "site_id")


@query("ml20_random_sites", "SELECT site_id FROM (SELECT site_id FROM fx_sites ORDER BY md5('42|' || site_id) LIMIT 20) q")
def _(t):
    return cand.random_sites(t.fx("sites"), 20).select("site_id")


@query("ml20_grid_centres", """SELECT grid_id, site_id FROM (SELECT c.grid_id, s.site_id, row_number() OVER (PARTITION BY c.grid_id ORDER BY sqrt(pow(c.lat - s.lat, 2) + pow(c.lon - s.lon, 2)), s.site_id) AS r FROM
 (SELECT * FROM v_cells ORDER BY md5('42|' || grid_id) LIMIT 20) c CROSS JOIN fx_sites s) q WHERE r = 1""")
def _(t):
    return cand.grid_centres(t.fx("cells"), t.fx("sites"), 20).select("grid_id", "site_id")


@query("ml20_uniform_random", "SELECT edge_id FROM (SELECT edge_id FROM fx_edges WHERE length_m > 10 ORDER BY md5('42|' || edge_id) LIMIT 25) q")
def _(t):
    return cand.uniform_random(edges(t), 25).select("edge_id")


def _as_pool(df, method, key):
    return df.select(F.lit(method).alias("source_method"), F.col(key).cast("string").alias("place"), "lat", "lon")


@query("ml21_candidate_pool")
def _(t):
    n = cand.pool_size(3)
    s = t.fx("sites")
    u = cand.uniform_spacing(t.fx("areas"), s, 4).join(s.select("site_id", "lat", "lon"), "site_id")
    k = models.cluster_placement(t.fx("points"), s, 12).select(F.col("cluster"), F.col("site_lat").alias("lat"), F.col("site_lon").alias("lon"))
    return (_as_pool(k, "kmeans", "cluster").unionByName(_as_pool(cand.random_sites(s, n), "random", "site_id")).unionByName(_as_pool(u, "uniform", "site_id"))
            .unionByName(_as_pool(cand.uniform_random(edges(t), n), "uniform_random", "edge_id")))


@query("ml22_all_baselines")
def _(t):
    s = t.fx("sites")
    parts = [cand.random_sites(s, 8).select("method", "lat", "lon"), cand.grid_centres(t.fx("cells"), s, 8).select("method", "lat", "lon"), cand.uniform_random(edges(t), 8).select("method", "lat", "lon"),
             models.cluster_placement(t.fx("points"), s, 8).select(F.lit("kmeans").alias("method"), "lat", "lon"),
             cand.uniform_spacing(t.fx("areas"), s, 4).join(s.select("site_id", "lat", "lon"), "site_id").select("method", "lat", "lon")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("ml24_diagonal_baseline", """SELECT area_id, CAST(k AS INT) AS k, round(min_lat + (max_lat - min_lat) * k / 4, 6) AS lat, round(min_lon + (max_lon - min_lon) * k / 4, 6) AS lon FROM fx_areas, (SELECT unnest(range(1, 4)) AS k) q""")
def _(t):
    return cand.diagonal(t.fx("areas"), 3).select("area_id", "k", *r6("lat", "lon"))


@query("ml24_engine_baselines")
def _(t):
    p = cand.diagonal(t.fx("areas"), 3).unionByName(cand.box_random(t.fx("areas"), 3))
    k = models.cluster_placement(t.fx("points"), t.fx("sites"), 3).select(F.lit("city").alias("area_id"), F.col("cluster").cast("int").alias("k"), "lat", "lon", F.lit("kmeans").alias("method"))
    return cand.with_nearest_edge(p.unionByName(k), edges(t))


@query("set05_combination_dedup", """SELECT edges, min(trip) AS trip FROM (SELECT trip, array_to_string(list_sort(list(DISTINCT edge_id)), ',') AS edges FROM (SELECT CAST(trip_id AS BIGINT) AS trip, 'e_' || (CAST(substr(edge_id, 3) AS INT) % 5) AS edge_id FROM fx_route_edges) a GROUP BY 1) q GROUP BY 1""")
def _(t):
    # A trip has a handful of edges; five names remain here, so that combinations repeat.
    r = t.fx("route_edges").select(F.col("trip_id").cast("long").alias("draw"), F.concat(F.lit("e_"), (F.substring("edge_id", 3, 9).cast("int") % 5).cast("string")).alias("e"))
    c = r.groupBy("draw").agg(F.collect_set("e").alias("sites")).withColumn("grid_id", F.lit("all"))
    return cand.first_of_equal(c).select(F.concat_ws(",", "sites").alias("edges"), F.col("draw").alias("trip"))


@query("rnk08_top_edges_in_box", """SELECT edge_id FROM (SELECT f.edge_id, lat0, lon0 FROM fx_edge_flow f JOIN fx_edges e ON e.edge_id = f.edge_id WHERE lat0 BETWEEN 42.23 AND 42.31 AND lon0 BETWEEN -83.79 AND -83.70 ORDER BY entered DESC, f.edge_id LIMIT 100) q""")
def _(t):
    f = t.fx("edge_flow").join(t.fx("edges").select("edge_id", F.col("lat0").alias("lat"), F.col("lon0").alias("lon")), "edge_id")
    return roads.top_edges(tr.in_box(f, BOX), 100).select("edge_id")


@query("prj44_consistent_ids", """SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'g' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'c' || s_suppkey END AS grid_id, 'v' || s_nationkey AS veh_id FROM supplier""")
def _(t):
    from voltgrid.functions.ids import first_present
    k = F.col("s_suppkey")
    s = t.raw("supplier").select(F.when(k % 3 == 0, F.concat(F.lit("g"), k)).alias("grid_id"), F.when(k % 3 == 1, F.concat(F.lit("c"), k)).alias("cell_id"), F.concat(F.lit("v"), F.col("s_nationkey")).alias("vehicle_id"))
    return s.select(first_present(s, ("grid_id", "cell_id", "id")).alias("grid_id"), first_present(s, ("VehId", "vehicle_id")).alias("veh_id"))
