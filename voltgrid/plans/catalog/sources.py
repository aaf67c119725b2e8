"""Sources and sinks: each query writes tables in the foreign layout beside the checkpoints and reads them back."""

import math

from pyspark.sql import functions as F

from voltgrid.functions.durable import scratch_path
from voltgrid.operators import demand, runs
from voltgrid.plans.catalog.demand import grid_demand, r6, rnd, scored
from voltgrid.plans.catalog.features import feat, rs
from voltgrid.plans.catalog.runs import place, run_table
from voltgrid.plans.catalog.trajectories import edges, pts
from voltgrid.plans.registry import query, view
from voltgrid.sources import simulation_xml as sx, stores, tables as src


@query("src01_trip_csv", """SELECT week, count(*) AS n, count(DISTINCT veh_id) AS vehicles, round(sum(lat), 4) AS lat, round(min(t), 3) AS t0 FROM (SELECT CAST(week AS VARCHAR) AS week, veh_id, lat, epoch(ts) AS t FROM fx_points WHERE ord % 10 <> 0) q GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "trips")
    # A tenth of the rows gets an impossible latitude, and the file set is split by week as in the original data.
    p = pts(t).withColumn("lat", F.when(F.col("ord") % 10 == 0, F.lit("bad")).otherwise(F.col("lat").cast("string")))
    out = p.select(F.date_format("week", "yyMMdd").alias("w"), F.col("veh_id").alias("VehId"), (F.col("t") * 1000).alias("Timestamp(ms)"), F.col("lat").alias("Latitude[deg]"),
                   F.col("lon").alias("Longitude[deg]"), F.lit("x").alias("Other"))
    out.withColumn("VED", F.col("w")).drop("w").write.option("header", True).partitionBy("VED").csv(path)  # one folder per calendar week
    return src.trip_csv(t.spark, path).groupBy(F.col("week").cast("string").alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("veh_id").alias("vehicles"), rnd(F.sum("lat"), 4).alias("lat"), rnd(F.min("t"), 3).alias("t0"))


def _wide(t, path, measure):
    monthly = t.fx("charging").groupBy(F.date_trunc("month", "ts").alias("time"), "station_id").agg(rnd(F.sum(measure), 6).alias(measure))
    src.write_wide_csv(monthly, f"{path}/{measure}", "time", "station_id", measure)
    return [f"{path}/{measure}"]


view("v_monthly", "SELECT date_trunc('month', ts)::TIMESTAMP AS ts, station_id, round(sum(kwh), 6) AS kwh, round(sum(hours), 6) AS hours FROM fx_charging GROUP BY 1, 2")


@query("src02_wide_series_csv", "SELECT m.station_id, count(*) AS months, round(sum(kwh), 4) AS kwh, round(sum(hours), 4) AS hours, max(charge_count) AS charge_count FROM v_monthly m JOIN fx_stations s ON s.station_id = m.station_id GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "wide")
    t.fx("stations").select(F.col("station_id").alias("TAZID"), "longitude", "latitude", "charge_count").write.option("header", True).csv(f"{path}/inf")
    series = src.wide_series_csv(t.spark, {"kwh": _wide(t, path, "kwh"), "hours": _wide(t, path, "hours")})
    info = src.station_csv(t.spark, f"{path}/inf", "first")
    return series.filter("kwh IS NOT NULL").join(info, "station_id").groupBy("station_id").agg(
        F.count(F.lit(1)).alias("months"), rnd(F.sum("kwh"), 4).alias("kwh"), rnd(F.sum("hours"), 4).alias("hours"), F.max("charge_count").alias("charge_count"))


@query("src03_zone_series_csv", "SELECT station_id, longitude, charge_count, CAST(charge_count / 3 AS INT) AS fast_count FROM fx_stations".replace("CAST(charge_count / 3 AS INT)", "CAST(floor(charge_count / 3) AS INT)"))
def _(t):
    path = scratch_path(t.spark, "zones")
    s = t.fx("stations")
    s.select(F.col("station_id").alias("grid"), F.col("longitude").alias("lon"), F.col("latitude").alias("la"), F.col("charge_count").alias("count"),
             F.floor(F.col("charge_count") / 3).alias("fast_count"), F.lit(0).alias("slow_count")).write.option("header", True).csv(path)
    return src.station_csv(t.spark, path, "second").select("station_id", "longitude", "charge_count", "fast_count")


@query("src04_session_csv", """SELECT grid_id, round(sum(d), 4) AS total_hours, round(sum(k), 4) AS total_kwh FROM (SELECT CAST(l_suppkey AS VARCHAR) AS station_id, sum(l_discount * 100) AS d, sum(l_quantity) AS k FROM lineitem GROUP BY 1) a
 JOIN (SELECT station_id, 'grid_' || (charge_count % 9) AS grid_id FROM fx_stations WHERE charge_count % 7 <> 0) m ON m.station_id = a.station_id GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "sessions")
    li = t.raw("lineitem").withColumn("station_id", F.col("l_suppkey").cast("string"))
    li.select("station_id", (F.col("l_discount") * 100).alias("duration_hours"), F.lit(1).alias("sessions")).write.option("header", True).csv(f"{path}/occ")
    li.select("station_id", F.col("l_quantity").alias("kwh_dispensed"), F.lit(2).alias("num_chargers"), F.col("l_orderkey").alias("row_order")).write.option("header", True).csv(f"{path}/vol")
    k = F.col("charge_count")
    t.fx("stations").select("station_id", F.when(k % 7 != 0, F.concat(F.lit("grid_"), k % 9)).alias("grid_id")).write.option("header", True).csv(f"{path}/map")
    occ, vol, mapping = src.session_csv(t.spark, f"{path}/occ", f"{path}/vol", f"{path}/map")
    g = demand.sessions_by_grid(demand.session_merge(occ, vol, ["row_order"]), mapping)
    return g.select("grid_id", rnd("total_hours", 4).alias("total_hours"), rnd("total_kwh", 4).alias("total_kwh"))


@query("src05_custom_trajectories", "SELECT fmt, count(*) AS n, round(sum(kwh), 4) AS kwh FROM (SELECT unnest(['csv', 'parquet']) AS fmt, l_quantity AS kwh FROM lineitem) q GROUP BY 1")
def _(t):
    path, out = scratch_path(t.spark, "custom"), None
    d = t.raw("lineitem").select((F.lit(42.2) + F.col("l_tax")).alias("lat"), (F.lit(-83.7) + F.col("l_tax")).alias("lon"), F.col("l_quantity").alias("kwh"), F.col("l_discount").alias("hours"))
    for fmt in ("csv", "parquet"):
        d.write.option("header", True).format(fmt).save(f"{path}/points.{fmt}")
        p = src.custom_trajectories(t.spark, f"{path}/points.{fmt}").agg(F.lit(fmt).alias("fmt"), F.count(F.lit(1)).alias("n"), rnd(F.sum("kwh"), 4).alias("kwh"))
        out = p if out is None else out.unionByName(p)
    return out


#: Rows of an XML file, about: a task reads a file whole.
XML_ROWS = 400_000


def _dealt(df, *by):
    """Rows dealt by their element to as many tasks as keep a file of elements at about ``XML_ROWS`` rows, at any size."""
    return df.repartition(max(1, math.ceil(df.count() / XML_ROWS)), *by)


def _write_xml(df, path, tag, root):
    df.write.format("xml").option("rowTag", tag).option("rootTag", root).option("maxRecordsPerFile", XML_ROWS).save(path)
    return path


@query("src07_battery_xml", "SELECT id, count(*) AS n, round(sum(energy_consumed), 4) AS energy, round(avg(actual_battery_capacity), 3) AS capacity FROM fx_battery GROUP BY 1")
def _(t):
    # Rows of one time stamp and episode share elements of a thousand vehicle numbers each.
    b = t.fx("battery").withColumn("_time", F.col("time")).withColumn("_part", F.floor(F.col("id").cast("long") / 1000))
    steps = _dealt(b, "episode", "_time", "_part").groupBy("episode", "_time", "_part").agg(F.collect_list(F.struct(F.col("id").alias("_id"), F.col("energy_consumed").alias("_energyConsumed"), F.col("actual_battery_capacity").alias("_actualBatteryCapacity"),
                                                                                F.col("maximum_battery_capacity").alias("_maximumBatteryCapacity"))).alias("vehicle")).drop("episode", "_part")
    path = _write_xml(steps, scratch_path(t.spark, "battery"), "timestep", "battery-export")
    return sx.battery(t.spark, path).groupBy("id").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("energy_consumed"), 4).alias("energy"), rnd(F.avg("actual_battery_capacity"), 3).alias("capacity"))


@query("src08_charging_xml", "SELECT station_id, count(*) AS n, round(sum(total_energy_charged), 4) AS energy, round(sum(charging_end - charging_begin), 3) AS busy FROM fx_charge_events GROUP BY 1")
def _(t):
    e = t.fx("charge_events").withColumn("_part", F.col("charging_begin"))
    st = _dealt(e, "station_id", "_part").groupBy(F.col("station_id").alias("_id"), "_part").agg(F.collect_list(F.struct(F.col("vehicle_id").alias("_id"), F.col("total_energy_charged").alias("_totalEnergyChargedIntoVehicle"), F.col("charging_begin").alias("_chargingBegin"),
                                                                                      F.col("charging_end").alias("_chargingEnd"))).alias("vehicle")).drop("_part")
    path = _write_xml(st, scratch_path(t.spark, "charging"), "chargingStation", "chargingstations-export")
    return sx.charging_events(t.spark, path).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("total_energy_charged"), 4).alias("energy"), rnd(F.sum(F.col("charging_end") - F.col("charging_begin")), 3).alias("busy"))


_SUMMARY_SQL = "SELECT loaded, count(*) AS n, CAST(sum(arrived) AS BIGINT) AS arrived, round(sum(mean_speed), 4) AS speed FROM fx_summary GROUP BY 1"


def _summary_rows(t):
    s = t.fx("summary")
    odd = F.col("time") % 2 == 1
    return s.select(F.col("time").alias("_time"), F.col("loaded").alias("_loaded"), F.col("running").alias("_running"), F.col("mean_speed").alias("_meanSpeed"),
                    F.when(~odd, F.col("arrived")).alias("_arrived"), F.when(odd, F.col("arrived")).alias("_ended"))


def _sum_up(s):
    return s.groupBy("loaded").agg(F.count(F.lit(1)).alias("n"), F.sum("arrived").alias("arrived"), rnd(F.sum("mean_speed"), 4).alias("speed"))


@query("src09_summary_xml", _SUMMARY_SQL)
def _(t):
    return _sum_up(sx.summary(t.spark, _write_xml(_summary_rows(t), scratch_path(t.spark, "summary"), "step", "summary")))


@query("src10_edge_flow_xml", "SELECT edge_id, entered, speed FROM (SELECT edge_id, entered, speed FROM fx_edge_flow) q")
def _(t):
    f = t.fx("edge_flow")
    # Two intervals per edge: the first carries stale values that the second overwrites.
    two = f.withColumn("_begin", F.explode(F.array(F.lit(0.0), F.lit(900.0)))).withColumn("entered", F.when(F.col("_begin") == 0, 1e6).otherwise(F.col("entered")))
    iv = two.withColumn("_g", F.pmod(F.xxhash64("edge_id"), F.lit(64))).groupBy("_begin", "_g").agg(F.collect_list(F.struct(F.col("edge_id").alias("_id"), F.col("entered").alias("_entered"), F.lit(0.0).alias("_left"), F.col("speed").alias("_speed"))).alias("edge")).drop("_g")
    path = _write_xml(iv, scratch_path(t.spark, "flow"), "interval", "meandata")
    return sx.edge_flow(t.spark, path).select("edge_id", "entered", "speed")


def _broken(df, path, tag, names):
    """Broken markup: elements without a root and with stray text between them."""
    attr = lambda n: F.coalesce(F.concat(F.lit(f' {n}="'), F.col(f"_{n}").cast("string"), F.lit('"')), F.lit(""))
    df.select(F.concat(F.lit(f"<broken & <{tag}"), *map(attr, names), F.lit("/> <unclosed")).alias("value")).write.text(path)
    return path


@query("src11_malformed_xml", _SUMMARY_SQL)
def _(t):
    return _sum_up(sx.summary_by_pattern(t.spark, _broken(_summary_rows(t), scratch_path(t.spark, "broken"), "step", ("time", "loaded", "running", "meanSpeed", "arrived", "ended"))))


@query("src11_malformed_battery", "SELECT id, count(*) AS n, round(sum(energy_consumed), 4) AS energy, round(max(maximum_battery_capacity), 3) AS capacity FROM fx_battery GROUP BY 1")
def _(t):
    b = t.fx("battery").select(F.col("id").alias("_id"), F.col("energy_consumed").alias("_energyConsumed"), F.col("maximum_battery_capacity").alias("_maximumBatteryCapacity"))
    found = sx.battery_by_pattern(t.spark, _broken(b, scratch_path(t.spark, "broken"), "vehicle", ("id", "energyConsumed", "maximumBatteryCapacity")))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("energy_consumed"), 4).alias("energy"), rnd(F.max("maximum_battery_capacity"), 3).alias("capacity"))


@query("src11_malformed_charging", "SELECT vehicle_id, count(*) AS n, round(sum(total_energy_charged), 4) AS energy, round(sum(charging_end - charging_begin), 3) AS busy FROM fx_charge_events GROUP BY 1")
def _(t):
    e = t.fx("charge_events").select(F.col("vehicle_id").alias("_id"), F.col("total_energy_charged").alias("_totalEnergyChargedIntoVehicle"), F.col("charging_begin").alias("_chargingBegin"), F.col("charging_end").alias("_chargingEnd"))
    found = sx.charging_by_pattern(t.spark, _broken(e, scratch_path(t.spark, "broken"), "vehicle", ("id", "totalEnergyChargedIntoVehicle", "chargingBegin", "chargingEnd")))
    return found.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("total_energy_charged"), 4).alias("energy"), rnd(F.sum(F.col("charging_end") - F.col("charging_begin")), 3).alias("busy"))


@query("src11_malformed_flow", 'SELECT edge_id, round(entered, 4) AS entered, 0e0 AS "left", round(speed, 4) AS speed FROM fx_edge_flow')
def _(t):
    f = t.fx("edge_flow").select(F.col("edge_id").alias("_id"), F.col("entered").alias("_entered"), F.col("speed").alias("_speed"))
    found = sx.flow_by_pattern(t.spark, _broken(f, scratch_path(t.spark, "broken"), "edge", ("id", "entered", "speed")))
    return found.select("edge_id", rnd("entered", 4).alias("entered"), "left", rnd("speed", 4).alias("speed"))


@query("src11_rejected_records", "SELECT loaded, count(*) AS n FROM fx_summary WHERE loaded % 5 = 0 GROUP BY 1")
def _(t):
    # A fifth of the steps has an attribute without quotes.
    s = t.fx("summary").withColumn("_q", F.when(F.col("loaded") % 5 == 0, F.lit("")).otherwise(F.lit('"')))
    path = scratch_path(t.spark, "rejected")
    s.select(F.concat(F.lit('<step time="'), "time", F.lit('" loaded="'), "loaded", F.lit('" running='), "_q", "running", "_q", F.lit("/>")).alias("value")).write.text(path)
    bad = sx.rejected(t.spark, path, "step")
    return bad.select(F.regexp_extract("s", 'loaded="([0-9]+)"', 1).cast("int").alias("loaded")).groupBy("loaded").agg(F.count(F.lit(1)).alias("n"))


@query("src12_score_sink", "SELECT count(*) AS n, round(avg(demand_score), 6) AS mean, round(stddev_samp(demand_score), 6) AS std, round(min(demand_score), 6) AS min, round(max(demand_score), 6) AS max, 0.7 AS kwh_weight FROM v_scored")
def _(t):
    path = scratch_path(t.spark, "scores")
    stores.save_scores(scored(t), path)
    return stores.load_metadata(t.spark, path).select("n", *r6("mean", "std", "min", "max"), "kwh_weight")


@query("src13_score_readback", "SELECT station_id, round(demand_score, 6) AS demand_score FROM v_scored")
def _(t):
    path = scratch_path(t.spark, "scores")
    stores.save_scores(scored(t).select("station_id", "demand_score"), path)
    return stores.load_scores(t.spark, path, "station_id string, demand_score double").select("station_id", *r6("demand_score"))


@query("src14_training_table", f"SELECT grid_id, {rs('road_density_total', 'mixed_use_index')} FROM v_feat")
def _(t):
    path = scratch_path(t.spark, "training")
    stores.save_training(feat(t), path)
    return t.spark.read.parquet(path).select("grid_id", *r6("road_density_total", "mixed_use_index"))


@query("src15_episode_log", "SELECT grid_id, method, count(*) AS episodes, round(sum(reward), 5) AS reward, max(k) AS last_episode FROM (SELECT *, row_number() OVER (PARTITION BY grid_id, method ORDER BY episode) AS k FROM fx_episodes) q GROUP BY 1, 2")
def _(t):
    path = scratch_path(t.spark, "episodes")
    # Result rows carry their rewards as one array per run, as the original's result records do (800 episodes at most there).
    r = runs.numbered(t.fx("episodes")).groupBy("grid_id", "method").agg(F.sort_array(F.collect_list(F.struct("rn", "reward"))).alias("e")).select("grid_id", "method", F.col("e.reward").alias("rewards"))
    stores.save_episodes(r, path)
    return t.spark.read.parquet(path).groupBy("grid_id", "method").agg(F.count(F.lit(1)).alias("episodes"), rnd(F.sum("reward"), 5).alias("reward"), F.max("episode").cast("long").alias("last_episode"))


@query("src16_station_coordinates", """SELECT p.grid_id, p.method, count(*) AS stations, round(sum(lat), 5) AS lat, round(max(best_reward), 6) AS reward FROM v_place p JOIN (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY coalesce(best_reward, 0) DESC, method) AS k FROM v_runs) r
 ON r.grid_id = p.grid_id AND r.method = p.method AND r.k = 1 GROUP BY 1, 2""")
def _(t):
    path = scratch_path(t.spark, "stations")
    stores.station_coordinates(runs.best_per_grid(run_table(t)), place(t)).write.json(path)
    back = t.spark.read.schema("id string, grid_id string, method string, lat double, lon double, reward double").json(path)
    return back.groupBy("grid_id", "method").agg(F.count(F.lit(1)).alias("stations"), rnd(F.sum("lat"), 5).alias("lat"), rnd(F.max("reward"), 6).alias("reward"))


@query("src17_metric_sinks", "SELECT method, count(*) AS runs, round(avg(best_reward), 6) AS mean_reward FROM v_runs GROUP BY ROLLUP(method)")
def _(t):
    path = scratch_path(t.spark, "metrics")
    stores.save_metrics(runs.method_performance(run_table(t)), path)
    return t.spark.read.schema("method string, runs long, mean_reward double").json(f"{path}/json").select("method", "runs", *r6("mean_reward"))


@query("src18_report_sinks", "SELECT grid_id, method, round(best_reward, 6) AS best_reward, convergence_episode, action_diversity FROM v_runs")
def _(t):
    path = scratch_path(t.spark, "reports")
    nested = run_table(t).select("grid_id", "method", F.struct("best_reward", "average_reward", "convergence_achieved", "convergence_episode", "total_episodes", "action_diversity", "cumulative_regret").alias("stats"))
    parts = stores.report_tables(nested)
    for name, df in parts.items():
        df.write.parquet(f"{path}/{name}")
    j = None
    for name, cols in (("raw", ["best_reward"]), ("convergence", ["convergence_episode"]), ("bandit", ["action_diversity"])):
        p = t.spark.read.parquet(f"{path}/{name}").select("grid_id", "method", *cols)
        j = p if j is None else j.join(p, ["grid_id", "method"])
    return j.withColumn("best_reward", rnd("best_reward", 6))


@query("src19_checkpoint_store", "SELECT grid_id, count(*) AS n, count(DISTINCT total_episodes) AS configs FROM v_runs GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "checkpoints")
    r = run_table(t)
    for hybrid in (True, False):  # two batches appended to one store
        stores.save_checkpoints(r.filter(runs.is_hybrid() == hybrid), path, ["grid_id", "total_episodes"])
    return t.spark.read.parquet(path).groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("config_hash").alias("configs"))


@query("set07_append_summary", "SELECT method, 2 * count(*) AS n FROM v_runs GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "summary")
    r = run_table(t).select("grid_id", "method", "best_reward")
    stores.append_summary(r, path)
    stores.append_summary(r, path)
    return t.spark.read.parquet(path).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("src20_station_xml", """SELECT CAST(edge_no AS VARCHAR) AS station_id, round(42.217 + (y0 + 3 * s) / 111320, 6) AS lat, round(-83.8084 + (x0 + s * (4 + (0.8 * length_m - 5 * s) / s)) / 82000, 6) AS lon, 50e0 AS power_kw FROM v_shape""")
def _(t):
    e = edges(t)
    s = e.select(F.col("edge_no").cast("string").alias("_id"), F.concat("edge_id", F.lit("_0")).alias("_lane"), (F.col("length_m") * 0.8).alias("_startPos"), F.lit(50000.0).alias("_power"))
    path = _write_xml(s, scratch_path(t.spark, "sites"), "chargingStation", "additional")
    return sx.station_sites(t.spark, path, e).select("station_id", *r6("lat", "lon"), "power_kw")
