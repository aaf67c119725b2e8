"""Event-log KPIs and rewards."""

from pyspark.sql import functions as F

from voltgrid.operators import events as ev
from voltgrid.operators.ordered import gini
from voltgrid.operators.spatial import one_cell_per_point, points_in_cells
from voltgrid.plans.catalog.demand import r6, rnd
from voltgrid.plans.catalog.features import rs
from voltgrid.plans.catalog.trajectories import edges
from voltgrid.plans.registry import query, view

EP = ["episode"]

view("v_vlast", """SELECT episode, id, arg_max(energy_consumed, k) AS e, arg_max(actual_battery_capacity / maximum_battery_capacity, k) AS soc,
 max(time) - min(time) AS trip, count(*) AS n FROM (SELECT *, (time, energy_consumed, actual_battery_capacity) AS k FROM fx_battery) q GROUP BY 1, 2""")


@query("agg21_fleet_battery", """SELECT episode, round(avg(soc), 6) AS mean_final_soc, round(var_pop(soc), 6) AS soc_variance,
 round(avg(CASE WHEN soc < 0.3 THEN 1e0 ELSE 0 END), 6) AS pct_low_soc, round(sum(e), 3) AS total_energy_consumed,
 round(coalesce(avg(trip) FILTER (n > 1), 0), 6) AS avg_trip_duration FROM v_vlast GROUP BY 1""")
def _(t):
    return ev.fleet_battery(t.fx("battery"), EP).select("episode", *r6("mean_final_soc", "soc_variance", "pct_low_soc"),
                                                        rnd("total_energy_consumed", 3).alias("total_energy_consumed"), *r6("avg_trip_duration"))


def _gini_sql(source, keys, value, name):
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    sel = f"{keys}, " if keys else ""
    return (f"SELECT {sel}CASE WHEN max(tot) = 0 THEN 0 ELSE (max(n) + 1 - 2 * sum(cum) / max(tot)) / max(n) END AS {name} FROM (SELECT {sel}"
            f"sum({value}) OVER ({part} ORDER BY {value} ROWS UNBOUNDED PRECEDING) AS cum, sum({value}) OVER ({part}) AS tot, count(*) OVER ({part}) AS n FROM {source}) g {group}")


view("v_st_util", """SELECT episode, station_id, sum(charging_end - charging_begin) / 3600 AS util, avg(charging_end - charging_begin) AS m FROM fx_charge_events GROUP BY 1, 2""")
view("v_st_util0", """SELECT episode, station_id, sum(charging_end - charging_begin) / 3600 AS util, avg(charging_end - charging_begin) AS m FROM fx_charge_events
 WHERE charging_begin <> 0 AND charging_end <> 0 GROUP BY 1, 2""")
view("v_gini", _gini_sql("v_st_util", "episode", "util", "g"))
view("v_gini0", _gini_sql("v_st_util0", "episode", "util", "g"))


def _charge_sql(v, g, cond):
    return f"""SELECT '{v}' AS rule, e.episode, count(*) AS total_charging_events, round(avg(charging_end - charging_begin) {cond}, 6) AS avg_charging_duration,
 round(max(m.m), 6) AS mean_station_duration, round(max(g.g), 6) AS utilisation_gini FROM fx_charge_events e JOIN (SELECT episode, avg(m) AS m FROM {v} GROUP BY 1) m ON m.episode = e.episode
 JOIN {g} g ON g.episode = e.episode GROUP BY 2"""


@query("agg22_charging_summary", _charge_sql("v_st_util", "v_gini", "").replace("'v_st_util'", "'all'") + " UNION ALL " +
       _charge_sql("v_st_util0", "v_gini0", "FILTER (charging_begin <> 0)").replace("'v_st_util0'", "'drop_zero'"))
def _(t):
    out = None
    for rule, flag in (("all", False), ("drop_zero", True)):
        p = ev.charging_summary(t.fx("charge_events"), EP, 3600.0, flag).select(
            F.lit(rule).alias("rule"), "episode", "total_charging_events", *r6("avg_charging_duration", "mean_station_duration", "utilisation_gini"))
        out = p if out is None else out.unionByName(p)
    return out


@query("agg23_gini", f"SELECT method, round(g, 6) AS gini FROM ({_gini_sql('fx_episodes', 'method', 'reward', 'g')}) q")
def _(t):
    return gini(t.fx("episodes"), ["method"], "reward").select("method", *r6("gini"))


view("v_charging_score", """SELECT n.episode, 0.5 * least(1, n / 50.0) + 0.3 * exp(-0.2 * var) + 0.2 * eff AS charging_score FROM (SELECT episode, var_pop(v) AS var,
 avg(greatest(0, 1 - t / v / 600)) AS eff FROM (SELECT episode, station_id, count(DISTINCT vehicle_id) AS v, sum(charging_end - charging_begin) AS t FROM fx_charge_events GROUP BY 1, 2) q GROUP BY 1) a
 JOIN (SELECT episode, count(DISTINCT vehicle_id) AS n FROM fx_charge_events GROUP BY 1) n ON n.episode = a.episode""")
view("v_network_score", """SELECT episode, 0.6 * arg_max(arrived, time) / arg_max(loaded, time) + 0.4 * least(coalesce(avg(mean_speed) FILTER (running > 0), 0) / 15, 1) AS network_score FROM fx_summary GROUP BY 1""")
view("v_veh", """SELECT episode, id, avg(soc) AS avg_soc, arg_max(soc, (time, soc)) AS final_soc, min(soc) AS min_soc, count(*) AS n FROM
 (SELECT *, actual_battery_capacity / maximum_battery_capacity AS soc FROM fx_battery) q GROUP BY 1, 2""")
view("v_profile", """SELECT episode, coalesce(avg(0.45 / (1 + exp(-8 * (avg_soc - 0.25))) + 0.35 / (1 + exp(-12 * (final_soc - 0.40))) + 0.2 * (1 - pow(1 - min_soc, 2))) FILTER (n >= 2), 0) AS soc_profile FROM v_veh GROUP BY 1""")
view("v_levels", "SELECT episode, 1 - pow(avg(CASE WHEN final_soc < 0.6 THEN 1e0 ELSE 0 END), 2) AS low_soc, exp(-50 * stddev_pop(final_soc)) AS soc_spread FROM v_veh GROUP BY 1")
view("v_vel", """SELECT episode, id, time, soc, CASE WHEN dt > 0 THEN ds / dt END AS soc_velocity FROM (SELECT episode, id, time, soc, soc - lag(soc) OVER w AS ds, time - lag(time) OVER w AS dt FROM
 (SELECT *, actual_battery_capacity / maximum_battery_capacity AS soc FROM fx_battery) q WINDOW w AS (PARTITION BY episode, id ORDER BY time, soc)) z""")
view("v_eff", "SELECT episode, least(quantile_cont(soc_velocity, 0.5) / greatest(quantile_cont(soc_velocity, 0.9), 1e-6), 1) AS charge_efficiency FROM v_vel WHERE soc_velocity > 0 GROUP BY 1")
view("v_improve", """SELECT episode, coalesce(0.25 * (tanh(5 * (a - lag(a) OVER w)) + 1) + 0.25 * (tanh(10 * (m - lag(m) OVER w)) + 1), 0.5) AS fleet_improvement FROM
 (SELECT episode, avg(avg_soc) AS a, avg(min_soc) AS m FROM v_veh WHERE n > 1 GROUP BY 1) q WINDOW w AS (ORDER BY episode)""")
view("v_energy", """SELECT episode, 0.7 * r / greatest(0.7 * r, e) AS energy_score FROM (SELECT episode, e, avg(e) OVER (ORDER BY episode ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS r FROM
 (SELECT episode, avg(e) AS e FROM (SELECT episode, id, arg_min(energy_consumed, (time, energy_consumed, actual_battery_capacity)) AS e FROM fx_battery GROUP BY 1, 2) a GROUP BY 1) b) c""")
view("v_battery_score", """SELECT p.episode, soc_profile, charge_efficiency, energy_score, soc_spread, low_soc, fleet_improvement, 0.35 * soc_profile + 0.25 * coalesce(charge_efficiency, 0) + 0.15 * energy_score
 + 0.15 * soc_spread + 0.10 * low_soc AS battery_score FROM v_profile p LEFT JOIN v_eff e ON e.episode = p.episode JOIN v_energy n ON n.episode = p.episode JOIN v_levels l ON l.episode = p.episode
 LEFT JOIN v_improve i ON i.episode = p.episode""")
view("v_fgini", _gini_sql("(SELECT * FROM fx_edge_flow WHERE entered > 0) ff", "episode", "entered", "g"))
view("v_traffic_score", """SELECT a.episode, 0.4 * (1 - g) + 0.4 * least(1, v / 15) + 0.2 * f AS traffic_score FROM (SELECT episode, avg(speed) AS v, avg(CASE WHEN speed >= 7.5 THEN 1e0 ELSE 0 END) AS f
 FROM fx_edge_flow WHERE entered > 0 GROUP BY 1) a JOIN v_fgini g ON g.episode = a.episode""")


@query("agg24_charging_score", f"SELECT episode, {rs('charging_score')} FROM v_charging_score")
def _(t):
    return ev.charging_score(t.fx("charge_events"), EP).select("episode", *r6("charging_score"))


@query("agg25_network_score", f"SELECT episode, {rs('network_score')} FROM v_network_score")
def _(t):
    return ev.network_score(t.fx("summary"), EP).select("episode", *r6("network_score"))


_BS = ("soc_profile", "charge_efficiency", "energy_score", "soc_spread", "low_soc", "fleet_improvement", "battery_score")


@query("agg26_battery_score", f"SELECT episode, {rs(*_BS)} FROM v_battery_score")
def _(t):
    return ev.battery_score(t.fx("battery")).select("episode", *r6(*_BS))


@query("agg27_soc_profile", f"SELECT episode, {rs('soc_profile')} FROM v_profile")
def _(t):
    return ev.soc_profile(ev.vehicle_soc(t.fx("battery"), EP), EP).select("episode", *r6("soc_profile"))


@query("agg28_charge_efficiency", f"SELECT episode, {rs('charge_efficiency')} FROM v_eff")
def _(t):
    return ev.charge_efficiency(t.fx("battery"), EP).select("episode", *r6("charge_efficiency"))


@query("agg29_fleet_improvement", f"SELECT episode, {rs('fleet_improvement')} FROM v_improve")
def _(t):
    return ev.fleet_improvement(ev.vehicle_soc(t.fx("battery"), EP)).select("episode", *r6("fleet_improvement"))


@query("agg30_soc_levels", f"SELECT episode, {rs('low_soc', 'soc_spread')} FROM v_levels")
def _(t):
    return ev.soc_levels(ev.vehicle_soc(t.fx("battery"), EP), EP).select("episode", *r6("low_soc", "soc_spread"))


@query("agg31_energy_score", f"SELECT episode, {rs('energy_score')} FROM v_energy")
def _(t):
    return ev.energy_score(t.fx("battery")).select("episode", *r6("energy_score"))


@query("agg32_traffic_score", f"SELECT episode, {rs('traffic_score')} FROM v_traffic_score")
def _(t):
    return ev.traffic_score(t.fx("edge_flow"), EP).select("episode", *r6("traffic_score"))


view("v_logged", "SELECT episode FROM fx_battery UNION SELECT episode FROM fx_charge_events UNION SELECT episode FROM fx_summary")
view("v_parts", """SELECT a.episode, l.episode IS NOT NULL AS logged, coalesce(charging_score, 0) AS charging_score, coalesce(network_score, 0) AS network_score, coalesce(battery_score, 0) AS battery_score,
 coalesce(traffic_score, 0) AS traffic_score FROM (SELECT episode FROM v_logged UNION SELECT episode FROM fx_edge_flow) a LEFT JOIN v_logged l ON l.episode = a.episode LEFT JOIN v_battery_score b ON b.episode = a.episode
 LEFT JOIN v_charging_score c ON c.episode = a.episode LEFT JOIN v_network_score n ON n.episode = a.episode LEFT JOIN v_traffic_score f ON f.episode = a.episode""")
view("v_reward", """SELECT *, CASE WHEN NOT logged THEN 0.05 WHEN total = 0 THEN 0.1 ELSE least(greatest(total, 0), 1) END AS reward FROM
 (SELECT *, 0.3 * charging_score + 0.3 * network_score + 0.3 * battery_score + 0.1 * traffic_score AS total FROM v_parts) q""")


@query("agg33_episode_reward", f"SELECT episode, {rs('charging_score', 'network_score', 'battery_score', 'traffic_score', 'reward')}, round(0.3 * battery_score, 6) AS weighted_battery FROM v_reward")
def _(t):
    return ev.episode_reward(t.fx("battery"), t.fx("charge_events"), t.fx("summary"), t.fx("edge_flow")).select(
        "episode", *r6("charging_score", "network_score", "battery_score", "traffic_score", "reward", "weighted_battery"))


view("v_util", """SELECT episode, station_id, least(1, sum(greatest(0, charging_end - charging_begin)) / 300) AS utilisation,
 least(100, sum(charging_end - charging_begin) / 86400 * 100) AS day_pct FROM fx_charge_events GROUP BY 1, 2""")


@query("agg34_station_utilisation", f"SELECT episode, station_id, {rs('utilisation', 'day_pct')} FROM v_util")
def _(t):
    return ev.station_utilisation(t.fx("charge_events"), EP, 300.0).select("episode", "station_id", *r6("utilisation", "day_pct"))


_TT = "SELECT CAST(o_custkey % 20 AS INT) AS episode, CAST(o_orderkey AS DOUBLE) AS time, o_totalprice / 100e0 AS duration, CAST(o_orderkey * 31 % 900 AS DOUBLE) AS waiting FROM orders"
view("v_tt", _TT)


@query("agg35_side_scores", """SELECT t.episode, round(tt, 6) AS travel_time_score, round(ls, 6) AS load_score, round(es, 6) AS charged_energy_score, round((SELECT count(DISTINCT edge_id) FROM v_shape JOIN fx_sites ON
 sqrt(pow(x0 + 4.5 * s - (lon + 83.8084) * 82000, 2) + pow(y0 + 1.5 * s - (lat - 42.217) * 111320, 2)) <= 500) / (SELECT count(*) FROM v_shape), 6) AS coverage_score FROM
 (SELECT episode, 0.7 * least(1, 1200 / greatest(1, arg_min(duration, time))) + 0.3 * least(1, 300 / greatest(1, arg_min(waiting, time))) AS tt FROM v_tt GROUP BY 1) t
 JOIN (SELECT episode, least(greatest(1 - stddev_pop(entered) / (avg(entered) + 1e-6) - max(entered) / (3 * avg(entered) + 1e-6), 0), 1) AS ls FROM fx_edge_flow GROUP BY 1) l ON l.episode = t.episode
 JOIN (SELECT episode, least(1, 30 / greatest(avg(total_energy_charged), 1e-6)) AS es FROM fx_charge_events GROUP BY 1) e ON e.episode = t.episode""")
def _(t):
    o = t.raw("orders")
    tt = o.select((F.col("o_custkey") % 20).cast("int").alias("episode"), F.col("o_orderkey").cast("double").alias("time"),
                  (F.col("o_totalprice") / 100).alias("duration"), (F.col("o_orderkey") * 31 % 900).cast("double").alias("waiting"))
    e = edges(t).select("edge_id", ((F.col("shape")[0]["y"] + F.col("shape")[2]["y"]) / 2).alias("lat"), ((F.col("shape")[0]["x"] + F.col("shape")[2]["x"]) / 2).alias("lon"))
    s = t.fx("sites").select(F.col("site_id").alias("station_id"), ((F.col("lat") - 42.217) * 111320).alias("lat"), ((F.col("lon") + 83.8084) * 82000).alias("lon"))
    return (ev.travel_time_score(tt, EP).join(ev.load_score(t.fx("edge_flow"), EP), EP).join(ev.charged_energy_score(t.fx("charge_events"), EP), EP)
            .crossJoin(F.broadcast(ev.coverage_score(e, s))).select("episode", *r6("travel_time_score", "load_score", "charged_energy_score", "coverage_score")))


view("v_queue", """SELECT *, greatest(0, coalesce(lag(charging_end) OVER (PARTITION BY episode, station_id ORDER BY charging_begin, charging_end, vehicle_id), 0) - charging_begin) / 60 AS wait_min FROM fx_charge_events""")


@query("win09_queue_waits", "SELECT episode, station_id, count(*) AS n, round(sum(wait_min), 6) AS wait_min FROM v_queue GROUP BY 1, 2")
def _(t):
    return ev.queue_waits(t.fx("charge_events"), EP).groupBy("episode", "station_id").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("wait_min"), 6).alias("wait_min"))


@query("win03_soc_velocity", "SELECT episode, id, count(soc_velocity) AS n, round(sum(soc_velocity), 6) AS total FROM v_vel GROUP BY 1, 2")
def _(t):
    return ev.soc_steps(t.fx("battery"), EP).groupBy("episode", "id").agg(F.count("soc_velocity").alias("n"), rnd(F.sum("soc_velocity"), 6).alias("total"))


@query("win20_ordered_soc", """SELECT episode, id, row_number() OVER (PARTITION BY episode, id ORDER BY time, soc) AS step, round(soc, 6) AS soc FROM v_vel""")
def _(t):
    return ev.ordered_soc(t.fx("battery"), EP).select("episode", "id", "step", *r6("soc"))


view("v_need", "SELECT DISTINCT episode, id FROM fx_battery WHERE actual_battery_capacity / maximum_battery_capacity < 0.2")
view("v_unserved", """SELECT n.episode, 100.0 * count(*) FILTER (c.vehicle_id IS NULL) / count(*) AS pct_unserved_demand FROM v_need n LEFT JOIN
 (SELECT DISTINCT episode, vehicle_id FROM fx_charge_events) c ON c.episode = n.episode AND c.vehicle_id = n.id GROUP BY 1""")


# Every line item is a charge here, in the episode of its part: with charges in the episode of its supplier, as in
# fx_charge_events, every vehicle in need would have charged by the same row, and the difference would be empty.
view("v_charged", "SELECT DISTINCT CAST(l_partkey % 20 AS INT) AS episode, CAST(l_orderkey AS STRING) AS vehicle_id FROM lineitem")


@query("jon21_unserved", """SELECT n.episode, round(100.0 * count(*) FILTER (c.vehicle_id IS NULL) / count(*), 6) AS pct_unserved_demand FROM v_need n LEFT JOIN v_charged c
 ON c.episode = n.episode AND c.vehicle_id = n.id GROUP BY 1""")
def _(t):
    charges = t.raw("lineitem").select((F.col("l_partkey") % 20).cast("int").alias("episode"), F.col("l_orderkey").cast("string").alias("vehicle_id"))
    return ev.unserved_pct(t.fx("battery"), charges, EP).select("episode", *r6("pct_unserved_demand"))


view("v_szone", """SELECT station_id, min(grid_id) AS grid_id FROM fx_stations JOIN fx_station_cells ON latitude > min_lat AND latitude < max_lat AND longitude > min_lon AND longitude < max_lon GROUP BY 1""")
view("v_zratio", """SELECT e.episode, c.grid_id, coalesce(n, 0) / (1e0 + cell_order % 3) AS ratio FROM (SELECT DISTINCT episode FROM fx_charge_events) e CROSS JOIN fx_station_cells c LEFT JOIN
 (SELECT episode, grid_id, count(*) AS n FROM fx_charge_events x JOIN v_szone z ON z.station_id = x.station_id GROUP BY 1, 2) s ON s.episode = e.episode AND s.grid_id = c.grid_id""")
view("v_zgini", _gini_sql("v_zratio", "episode", "ratio", "g"))
view("v_kpi", """SELECT d.episode, avg_detour_time_min, pct_unserved_demand, q AS avg_queueing_time_min, u AS avg_charger_utilization_pct, en AS total_energy_consumed_kwh, vmt AS total_vmt, g AS gini_coefficient_service FROM
 (SELECT CAST(l_suppkey % 20 AS INT) AS episode, avg(greatest(0, l_extendedprice / 100 - l_quantity * 10)) / 60 AS avg_detour_time_min FROM lineitem GROUP BY 1) d JOIN v_unserved n ON n.episode = d.episode
 JOIN (SELECT episode, avg(wait_min) AS q FROM v_queue GROUP BY 1) q ON q.episode = d.episode JOIN (SELECT episode, avg(day_pct) AS u FROM v_util GROUP BY 1) u ON u.episode = d.episode
 JOIN (SELECT episode, sum(energy_consumed) / 1000 AS en FROM fx_battery GROUP BY 1) b ON b.episode = d.episode JOIN (SELECT episode, sum(running * mean_speed * 0.000621371) AS vmt FROM fx_summary GROUP BY 1) s ON s.episode = d.episode
 JOIN v_zgini g ON g.episode = d.episode""")
KPIS = ("avg_detour_time_min", "pct_unserved_demand", "avg_queueing_time_min", "avg_charger_utilization_pct", "total_energy_consumed_kwh", "total_vmt", "gini_coefficient_service")


def kpis(t):
    li = t.raw("lineitem").select((F.col("l_suppkey") % 20).cast("int").alias("episode"), (F.col("l_quantity") * 10).alias("original"), (F.col("l_extendedprice") / 100).alias("actual"))
    st = t.fx("stations").select("station_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    zone = one_cell_per_point(points_in_cells(st, t.fx("station_cells"), 0.05), "station_id").select("station_id", "grid_id")
    zones = t.fx("station_cells").select("grid_id", (1.0 + F.col("cell_order") % 3).alias("demand"))
    return ev.kpi_set(t.fx("battery"), t.fx("charge_events"), t.fx("summary"), li, zone, zones, EP)


@query("agg36_kpi_set", f"SELECT episode, {rs(*KPIS, d=5)} FROM v_kpi")
def _(t):
    return kpis(t).select("episode", *[rnd(c, 5).alias(c) for c in KPIS])


@query("agg68_kpi_table", "SELECT episode, " + ", ".join(
    f"printf('%.{d}f{'%%' if 'pct' in c else ''}', round({c}, {d})) AS {c}" for c, d in ev.KPI_FORMATS.items())
    + """, CASE WHEN total_vmt > 1.1 * (SELECT avg(total_vmt) FROM v_kpi) THEN 'raise acceleration' WHEN total_vmt < 0.9 * (SELECT avg(total_vmt) FROM v_kpi) THEN 'lower acceleration' ELSE 'keep' END AS advice FROM v_kpi""")
def _(t):
    from voltgrid.functions.durable import materialize
    from voltgrid.functions.onerow import with_globals
    k = materialize(kpis(t))
    advice = with_globals(k, F.avg("total_vmt").alias("_m")).select("episode", ev.calibration_rule(F.lit("travel_time"), F.col("total_vmt"), F.col("_m")).alias("advice"))
    return ev.kpi_table(k, "episode").join(advice, "episode")


@query("agg71_placement_evaluation", """SELECT b.episode, bn AS battery_data_points, sn AS summary_data_points, n AS total_charging_events, v AS unique_vehicles_charged, round(e, 4) AS total_energy_transferred, round(u, 6) AS avg_utilization FROM
 (SELECT episode, count(*) AS bn FROM fx_battery GROUP BY 1) b JOIN (SELECT episode, count(*) AS sn FROM fx_summary GROUP BY 1) s ON s.episode = b.episode JOIN (SELECT episode, count(*) AS n, count(DISTINCT vehicle_id) AS v,
 sum(total_energy_charged) AS e FROM fx_charge_events GROUP BY 1) c ON c.episode = b.episode JOIN (SELECT episode, avg(utilisation) AS u FROM v_util GROUP BY 1) u ON u.episode = b.episode""")
def _(t):
    return ev.placement_evaluation(t.fx("battery"), t.fx("charge_events"), t.fx("summary"), EP).select(
        "episode", "battery_data_points", "summary_data_points", "total_charging_events", "unique_vehicles_charged",
        rnd("total_energy_transferred", 4).alias("total_energy_transferred"), *r6("avg_utilization"))


@query("agg72_simulation_projection", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END AS simulation_reward, o_orderstatus = 'F' AS simulation_success, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey END AS charging_events,
 CAST(0 AS DOUBLE) AS traffic_impact FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    o = t.raw("orders").select(k, F.when(k % 3 != 0, F.col("o_totalprice")).alias("simulation_reward"),
                               F.when(F.col("o_orderstatus") == "F", True).alias("simulation_success"), F.when(k % 4 != 0, F.col("o_custkey")).alias("charging_events"))
    return ev.simulation_projection(o, ["o_orderkey"]).select("o_orderkey", "simulation_reward", "simulation_success", "charging_events", "traffic_impact")


view("v_two", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'observed' ELSE 'simulated' END AS side, o_totalprice AS v FROM orders")
view("v_bins", """SELECT b, coalesce(o, 0) / no / w + 1e-10 AS p, coalesce(s, 0) / ns / w + 1e-10 AS q FROM (SELECT unnest(range(50)) AS b) g LEFT JOIN (SELECT least(CAST(floor((v - lo) / (hi - lo) * 50) AS INT), 49) AS bb,
 count(*) FILTER (side = 'observed') AS o, count(*) FILTER (side = 'simulated') AS s FROM v_two, (SELECT min(v) AS lo, max(v) AS hi FROM v_two) r GROUP BY 1) c ON c.bb = g.b,
 (SELECT count(*) FILTER (side = 'observed') AS no, count(*) FILTER (side = 'simulated') AS ns, (max(v) - min(v)) / 50 AS w FROM v_two) n""")


@query("agg60_divergence", """SELECT round(kl, 9) AS kl, round(js, 9) AS js, round(ks, 6) AS ks, round(observed_mean, 4) AS observed_mean, round(simulated_mean, 4) AS simulated_mean, round(observed_std, 4) AS observed_std,
 round(simulated_std, 4) AS simulated_std, js < 0.05 AS is_valid FROM (SELECT sum(p * ln(p / q)) AS kl, sum(0.5 * p * ln(p / ((p + q) / 2)) + 0.5 * q * ln(q / ((p + q) / 2))) AS js FROM v_bins) d,
 (SELECT max(abs(co / no - cs / ns)) AS ks FROM (SELECT v, sum(CASE WHEN side = 'observed' THEN 1 ELSE 0 END) OVER (ORDER BY v) AS co, sum(CASE WHEN side = 'simulated' THEN 1 ELSE 0 END) OVER (ORDER BY v) AS cs,
 count(*) FILTER (side = 'observed') OVER () AS no, count(*) FILTER (side = 'simulated') OVER () AS ns FROM v_two) c) k, (SELECT avg(v) FILTER (side = 'observed') AS observed_mean, avg(v) FILTER (side = 'simulated') AS simulated_mean,
 stddev_pop(v) FILTER (side = 'observed') AS observed_std, stddev_pop(v) FILTER (side = 'simulated') AS simulated_std FROM v_two) m""")
def _(t):
    s = t.raw("orders").select(F.when(F.col("o_orderkey") % 3 == 0, "observed").otherwise("simulated").alias("side"), F.col("o_totalprice").alias("v"))
    return ev.divergence(s, "side", "v").select(rnd("kl", 9).alias("kl"), rnd("js", 9).alias("js"), *r6("ks"),
                                                *[rnd(c, 4).alias(c) for c in ("observed_mean", "simulated_mean", "observed_std", "simulated_std")], "is_valid")
