"""Demand scores and allocation."""

from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.operators import allocation, demand, spatial
from voltgrid.plans import allocation as plan
from voltgrid.plans.registry import NUDGE, query, view


def rnd(c, digits):
    """Rounding for comparison: a nudge far below the last digit takes exact ties out of the reach of summation order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + NUDGE, digits) if digits < 9 else F.round(c, digits)


def r6(*names):
    return [rnd(n, 6).alias(n) for n in names]


@query("prj01_unpivot_series", """SELECT p.period, s.station_id, round(k.kwh, 6) AS kwh FROM (SELECT DISTINCT date_trunc('month', ts) AS period FROM fx_charging) p
 CROSS JOIN (SELECT DISTINCT station_id FROM fx_stations) s LEFT JOIN (SELECT date_trunc('month', ts) AS period, station_id, sum(kwh) AS kwh FROM fx_charging GROUP BY 1, 2) k
 ON k.period = p.period AND k.station_id = s.station_id""")
def _(t):
    monthly = t.fx("charging").groupBy(F.date_trunc("month", "ts").alias("period"), "station_id").agg(F.sum("kwh").alias("kwh"))
    known = t.fx("stations").select("station_id").distinct()  # stations without a charge have a column too
    every = known.join(monthly, "station_id", "left").select("period", "station_id", "kwh")
    wide, header = demand.widen(every, "period", "station_id", "kwh")
    return demand.unpivot_arrays(wide.filter("period IS NOT NULL"), header, "period", "kwh").withColumn("kwh", rnd("kwh", 6))


view("v_dirty", """SELECT station_id, CASE WHEN kwh < 5 THEN NULL WHEN kwh < 10 THEN CAST('nan' AS DOUBLE)
 WHEN kwh < 15 THEN CAST('infinity' AS DOUBLE) ELSE kwh END AS kwh FROM fx_charging""")


@query("prj02_clean_numbers", """SELECT station_id, round(sum(CASE WHEN kwh IS NULL OR isnan(kwh) OR isinf(kwh)
 THEN 0 ELSE kwh END), 6) AS kwh FROM v_dirty GROUP BY 1""")
def _(t):
    k = F.col("kwh")
    bad = t.fx("charging").withColumn("kwh", F.when(k < 5, F.lit(None)).when(k < 10, F.lit(float("nan")))
                                      .when(k < 15, F.lit(float("inf"))).otherwise(k))
    return bad.groupBy("station_id").agg(rnd(F.sum(demand.clean_number(F.col("kwh"))), 6).alias("kwh"))


@query("prj03_valid_stations", """SELECT 'nonzero' AS rule, station_id FROM fx_stations WHERE latitude <> 0
 AND longitude <> 0 AND latitude IS NOT NULL UNION ALL SELECT 'known', station_id FROM fx_stations
 WHERE latitude IS NOT NULL AND longitude IS NOT NULL UNION ALL
 SELECT 'extent', station_id FROM fx_stations WHERE abs(latitude) > 0.1 AND abs(longitude) > 0.1""")
def _(t):
    s = t.fx("stations")
    parts = [demand.valid_stations(s, r).select(F.lit(r).alias("rule"), "station_id")
             for r in ("nonzero", "known", "extent")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("prj04_per_charger", """SELECT s.station_id,
 round(sum(kwh) / greatest(max(charge_count), 1), 6) AS kwh_station_rule,
 round(sum(kwh) / (CASE WHEN max(charge_count) = 0 THEN 1 ELSE max(charge_count) END), 6) AS kwh_grid_rule
 FROM fx_charging c JOIN fx_stations s ON c.station_id = s.station_id GROUP BY 1""")
def _(t):
    tot = t.fx("charging").groupBy("station_id").agg(F.sum("kwh").alias("kwh")).join(t.fx("stations"), "station_id")
    return tot.select("station_id",
                      rnd(demand.per_charger(F.col("kwh"), F.col("charge_count")), 6).alias("kwh_station_rule"),
                      rnd(demand.per_charger(F.col("kwh"), F.col("charge_count"), "zero_as_one"), 6)
                      .alias("kwh_grid_rule"))


@query("prj05_non_negative_metrics", """SELECT c_custkey, c_acctbal FROM customer
 WHERE c_acctbal IS NOT NULL AND c_acctbal >= 0""")
def _(t):
    return demand.non_negative(t.raw("customer"), ["c_acctbal"]).select("c_custkey", "c_acctbal")


_PERIOD_UNION = " UNION ALL ".join(
    f"""SELECT '{code}' AS freq, station_id, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS period, sum(kwh) AS kwh,
 sum(hours) AS hours, avg(occupancy) AS occupancy FROM fx_charging GROUP BY 1, 2, 3"""
    for code, unit in demand.PERIODS.items())
view("v_resampled", _PERIOD_UNION)


@query("agg02_time_resample", """SELECT freq, station_id, period, round(kwh, 6) AS kwh, round(hours, 6) AS hours,
 round(occupancy, 6) AS occupancy FROM v_resampled""")
def _(t):
    out = None
    for code in demand.PERIODS:
        part = demand.resample(t.fx("charging"), code).select(
            F.lit(code).alias("freq"), "station_id", "period", *r6("kwh", "hours", "occupancy"))
        out = part if out is None else out.unionByName(part)
    return out


view("v_station_totals", """SELECT station_id, sum(kwh) AS total_kwh, sum(hours) AS total_hours,
 avg(occupancy) AS avg_occupancy FROM v_resampled WHERE freq = 'W' GROUP BY 1""")


@query("agg03_station_totals", """SELECT freq, station_id, round(sum(kwh), 6) AS total_kwh,
 round(sum(hours), 6) AS total_hours, round(avg(occupancy), 6) AS avg_occupancy
 FROM v_resampled GROUP BY 1, 2""")
def _(t):
    out = None
    for code in demand.PERIODS:
        part = demand.station_totals(t.fx("charging"), code).select(
            F.lit(code).alias("freq"), "station_id", *r6("total_kwh", "total_hours", "avg_occupancy"))
        out = part if out is None else out.unionByName(part)
    return out


view("v_metrics", """SELECT t.station_id, latitude, longitude, greatest(charge_count, 1) AS num_chargers, total_kwh,
 total_hours, total_kwh / greatest(charge_count, 1) AS kwh_per_charger,
 total_hours / greatest(charge_count, 1) AS hours_per_charger, avg_occupancy
 FROM v_station_totals t JOIN fx_stations s ON t.station_id = s.station_id
 WHERE latitude <> 0 AND longitude <> 0""")
view("v_scored", """SELECT m.*, (kwh_per_charger - k0) / greatest(k1 - k0, 1e-8) AS kwh_normalized,
 (hours_per_charger - h0) / greatest(h1 - h0, 1e-8) AS hours_normalized,
 0.7 * ((kwh_per_charger - k0) / greatest(k1 - k0, 1e-8)) + 0.3 * ((hours_per_charger - h0)
 / greatest(h1 - h0, 1e-8)) AS demand_score
 FROM v_metrics m CROSS JOIN (SELECT min(kwh_per_charger) AS k0, max(kwh_per_charger) AS k1,
 min(hours_per_charger) AS h0, max(hours_per_charger) AS h1 FROM v_metrics) g""")
view("v_varied", """SELECT *, hours_normalized AS demand_score_hours_only,
 0.25 * kwh_normalized + 0.75 * hours_normalized AS demand_score_kwh25_hrs75,
 0.5 * kwh_normalized + 0.5 * hours_normalized AS demand_score_balanced,
 0.75 * kwh_normalized + 0.25 * hours_normalized AS demand_score_kwh75_hrs25,
 kwh_normalized AS demand_score_kwh_only FROM v_scored""")


def metrics(t):
    return materialize(demand.station_metrics(t.fx("charging"), t.fx("stations"), "W"))


def scored(t):
    return demand.score_stations(metrics(t))


def varied(t):
    return demand.score_variations(metrics(t))


@query("prj24_normalize_eps", """SELECT station_id, round(kwh_normalized, 6) AS kwh_normalized,
 round(hours_normalized, 6) AS hours_normalized FROM v_scored""")
def _(t):
    n = demand.normalize_eps(metrics(t), {"kwh_per_charger": "kwh_normalized",
                                          "hours_per_charger": "hours_normalized"})
    return n.select("station_id", *r6("kwh_normalized", "hours_normalized"))


@query("prj06_weighted_score", "SELECT station_id, round(demand_score, 6) AS demand_score FROM v_scored")
def _(t):
    return scored(t).select("station_id", *r6("demand_score"))


_VAR_COLS = [f"demand_score_{n}" for n in demand.VARIATIONS]
_VAR_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in _VAR_COLS)


@query("prj07_score_variations", f"SELECT station_id, {_VAR_SQL} FROM v_varied")
def _(t):
    return varied(t).select("station_id", *r6(*_VAR_COLS))


@query("jon03_outer_merge_variations", """SELECT coalesce(a.station_id, b.station_id) AS station_id,
 round(a.demand_score_kwh_only, 6) AS demand_score_kwh_only,
 round(b.demand_score_balanced, 6) AS demand_score_balanced
 FROM (SELECT * FROM v_varied WHERE num_chargers > 5) a FULL OUTER JOIN
 (SELECT * FROM v_varied WHERE num_chargers < 30) b ON a.station_id = b.station_id""")
def _(t):
    v = varied(t)
    merged = demand.merge_variations({
        "kwh_only": v.filter("num_chargers > 5").select("station_id",
                                                        F.col("demand_score_kwh_only").alias("demand_score")),
        "balanced": v.filter("num_chargers < 30").select("station_id",
                                                         F.col("demand_score_balanced").alias("demand_score"))})
    return merged.select("station_id", *r6("demand_score_kwh_only", "demand_score_balanced"))


_ROW = ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_shipdate", "l_returnflag", "l_linestatus")
_ROW_SQL = ", ".join(_ROW)


@query("agg01_grid_charging", f"""SELECT grid_id, round(sum(l_quantity), 6) AS total_kwh,
 round(sum(l_discount * 100), 6) AS total_hours, max(CASE WHEN rn = 1 THEN l_linenumber END) AS num_chargers FROM
 (SELECT *, 'grid_' || (l_suppkey % 25) AS grid_id, row_number() OVER (PARTITION BY l_suppkey % 25
 ORDER BY {_ROW_SQL}, l_suppkey) AS rn FROM lineitem) q GROUP BY 1""")
def _(t):
    rows = t.raw("lineitem").select(
        F.concat(F.lit("grid_"), (F.col("l_suppkey") % 25).cast("string")).alias("grid_id"), *_ROW, "l_suppkey",
        F.col("l_quantity").alias("kwh"), (F.col("l_discount") * 100).alias("hours"),
        F.col("l_linenumber").alias("chargers"))
    return demand.charging_by_grid(rows, [*_ROW, "l_suppkey"]).select(
        "grid_id", *r6("total_kwh", "total_hours"), "num_chargers")


def _sessions(t):
    li = t.raw("lineitem").withColumn("station_id", F.col("l_suppkey").cast("string"))
    occ = li.select("station_id", (F.col("l_discount") * 100).alias("duration_hours"),
                                                 F.col("l_linenumber").alias("sessions"))
    vol = li.select("station_id", F.col("l_quantity").alias("kwh_dispensed"),
                                                 F.col("l_linenumber").alias("num_chargers"), *_ROW)
    return demand.session_merge(occ, vol, list(_ROW))


view("v_sessions", f"""SELECT o.station_id, total_hours, sessions, total_kwh, num_chargers FROM
 (SELECT CAST(l_suppkey AS VARCHAR) AS station_id, sum(l_discount * 100) AS total_hours,
 sum(l_linenumber) AS sessions FROM lineitem GROUP BY 1) o JOIN
 (SELECT CAST(l_suppkey AS VARCHAR) AS station_id, sum(l_quantity) AS total_kwh,
 max(CASE WHEN rn = 1 THEN l_linenumber END) AS num_chargers FROM (SELECT *, row_number() OVER
 (PARTITION BY l_suppkey ORDER BY {_ROW_SQL}) AS rn FROM lineitem) q GROUP BY 1) v
 ON o.station_id = v.station_id""")


@query("jon01_session_merge", """SELECT station_id, round(total_hours, 6) AS total_hours, CAST(sessions AS BIGINT)
 AS sessions, round(total_kwh, 6) AS total_kwh, num_chargers FROM v_sessions""")
def _(t):
    return _sessions(t).select("station_id", *r6("total_hours"), "sessions", *r6("total_kwh"), "num_chargers")


view("v_mapping", """SELECT station_id, CASE WHEN charge_count % 7 = 0 THEN NULL ELSE
 'grid_' || (charge_count % 9) END AS grid_id FROM fx_stations""")


def _mapping(t):
    k = F.col("charge_count")
    return t.fx("stations").select("station_id", F.when(k % 7 != 0, F.concat(F.lit("grid_"), k % 9)).alias("grid_id"))


@query("jon02_mapping_left_drop", """SELECT s.station_id, m.grid_id FROM v_sessions s LEFT JOIN v_mapping m
 ON s.station_id = m.station_id WHERE m.grid_id IS NOT NULL""")
def _(t):
    return (_sessions(t).join(_mapping(t), "station_id", "left").filter("grid_id IS NOT NULL")
            .select("station_id", "grid_id"))


@query("agg04_sessions_by_grid", """SELECT grid_id, round(sum(total_kwh), 6) AS total_kwh, round(sum(total_hours), 6)
 AS total_hours, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(num_chargers) AS BIGINT) AS num_chargers
 FROM v_sessions s JOIN v_mapping m ON s.station_id = m.station_id WHERE grid_id IS NOT NULL GROUP BY 1""")
def _(t):
    return demand.sessions_by_grid(_sessions(t), _mapping(t)).select(
        "grid_id", *r6("total_kwh", "total_hours"), "sessions", "num_chargers")


@query("jon20_common_stations", """SELECT station_id, count(*) AS n FROM fx_charging WHERE station_id IN
 (SELECT vehicle_station FROM (SELECT station_id AS vehicle_station FROM fx_charge_events) q) AND station_id IN
 (SELECT station_id FROM fx_stations WHERE charge_count > 3) GROUP BY 1""")
def _(t):
    return demand.common_stations(t.fx("charging"), t.fx("charge_events"),
                                  t.fx("stations").filter("charge_count > 3")).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("set03_station_intersect", """SELECT station_id FROM fx_charging INTERSECT
 SELECT station_id FROM fx_stations WHERE charge_count > 3""")
def _(t):
    return t.fx("charging").select("station_id").intersect(
        t.fx("stations").filter("charge_count > 3").select("station_id"))


@query("agg06_quality_report", """SELECT count(*) AS n_grids, count(*) FILTER (demand_score IS NULL) AS n_nan,
 count(*) FILTER (demand_score < 0) AS n_negative, count(*) FILTER (demand_score > 1) AS n_above_one,
 round(avg(demand_score), 6) AS mean, round(stddev_samp(demand_score), 6) AS std, round(min(demand_score), 6) AS min,
 round(max(demand_score), 6) AS max, round(quantile_cont(demand_score, 0.25), 6) AS q25,
 round(quantile_cont(demand_score, 0.5), 6) AS q50, round(quantile_cont(demand_score, 0.75), 6) AS q75
 FROM v_scored""")
def _(t):
    return demand.quality_report(scored(t)).select(
        "n_grids", "n_nan", "n_negative", "n_above_one", *r6("mean", "std", "min", "max", "q25", "q50", "q75"))


# --- cells -------------------------------------------------------------------------------------------------

view("v_station_cell", """SELECT station_id, max_by(grid_id, cell_order) AS grid_id FROM v_scored s
 JOIN fx_station_cells c ON latitude > min_lat AND latitude < max_lat AND longitude > min_lon
 AND longitude < max_lon GROUP BY 1""")
view("v_grid_base", """SELECT grid_id, count(*) AS num_stations, sum(num_chargers) AS num_chargers,
 sum(total_kwh) AS total_kwh, sum(total_hours) AS total_hours, avg(avg_occupancy) AS avg_occupancy,
 avg(latitude) AS latitude, avg(longitude) AS longitude,
 sum(total_kwh) / sum(num_chargers) AS kwh_per_charger, sum(total_hours) / sum(num_chargers) AS hours_per_charger
 FROM v_scored s JOIN v_station_cell c ON s.station_id = c.station_id GROUP BY 1""")
view("v_grid_demand", """SELECT b.*, (kwh_per_charger - k0) / greatest(k1 - k0, 1e-8) AS kwh_normalized,
 (hours_per_charger - h0) / greatest(h1 - h0, 1e-8) AS hours_normalized,
 0.7 * ((kwh_per_charger - k0) / greatest(k1 - k0, 1e-8)) + 0.3 * ((hours_per_charger - h0)
 / greatest(h1 - h0, 1e-8)) AS demand_score FROM v_grid_base b CROSS JOIN
 (SELECT min(kwh_per_charger) AS k0, max(kwh_per_charger) AS k1, min(hours_per_charger) AS h0,
 max(hours_per_charger) AS h1 FROM v_grid_base) g""")


def grid_demand(t):
    return materialize(demand.grid_demand(plan.stations_in_cells(scored(t), t.fx("station_cells"), 0.05)))


@query("jon06_station_cell", "SELECT station_id, grid_id FROM v_station_cell")
def _(t):
    return plan.stations_in_cells(scored(t), t.fx("station_cells"), 0.05).select("station_id", "grid_id")


_GRID_COLS = ("total_kwh", "total_hours", "avg_occupancy", "latitude", "longitude", "kwh_per_charger",
              "hours_per_charger", "kwh_normalized", "hours_normalized", "demand_score")


@query("agg05_grid_demand", "SELECT grid_id, num_stations, CAST(num_chargers AS BIGINT) AS num_chargers, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in _GRID_COLS) + " FROM v_grid_demand")
def _(t):
    return grid_demand(t).select("grid_id", "num_stations", "num_chargers", *r6(*_GRID_COLS))


@query("win14_demand_share", """SELECT grid_id, round(demand_score / (SELECT sum(demand_score) FROM v_grid_demand), 6)
 AS share FROM v_grid_demand""")
def _(t):
    return allocation.demand_share(grid_demand(t)).select("grid_id", *r6("share"))


view("v_quota", """SELECT grid_id, num_stations, demand_score, latitude, share, round(share * 1000, 9) AS quota FROM
 (SELECT *, demand_score / (SELECT sum(demand_score) FROM v_grid_demand) AS share FROM v_grid_demand) q""")
view("v_allocated", """SELECT *, CAST(floor(quota) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY quota - floor(quota) DESC,
 grid_id) <= (SELECT 1000 - sum(floor(quota)) FROM v_quota) THEN 1 ELSE 0 END AS stations FROM v_quota""")
_ALLOC_SQL = """SELECT grid_id, num_stations, round(demand_score, 6) AS demand_score, round(share, 6) AS share,
 CAST(stations AS BIGINT) AS stations FROM v_allocated"""


@query("win15_largest_remainder", "SELECT grid_id, CAST(stations AS BIGINT) AS stations FROM v_allocated")
def _(t):
    return allocation.largest_remainder(grid_demand(t), 1000).select("grid_id", "stations")


@query("plan_station_allocation", _ALLOC_SQL)
def _(t):
    return plan.station_allocation(t.fx("charging"), t.fx("stations"), t.fx("station_cells"), 0.05, 1000).select(
        "grid_id", "num_stations", *r6("demand_score", "share"), "stations")


@query("win16_robust_allocation", """SELECT grid_id, CAST(floor(quota) AS BIGINT) + CASE WHEN row_number() OVER
 (ORDER BY quota - floor(quota) DESC, latitude, grid_id) <= (SELECT 1000 - sum(floor(quota)) FROM v_quota) THEN 1
 ELSE 0 END AS stations, CAST(floor(1000 / (SELECT count(*) FROM v_quota)) AS BIGINT) AS zero_demand,
 CAST(greatest(1, floor(1000 / (SELECT count(*) FROM v_quota))) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY
 grid_id) <= 1000 - greatest(1, floor(1000 / (SELECT count(*) FROM v_quota))) * (SELECT count(*) FROM v_quota)
 THEN 1 ELSE 0 END AS no_prediction FROM v_quota""")
def _(t):
    g = grid_demand(t).withColumn("pos", F.struct("latitude", "grid_id"))
    a = allocation.robust_split(g, 1000, "pos").select("grid_id", "stations")
    z = allocation.zero_demand_split(g, 1000).select("grid_id", F.col("stations").alias("zero_demand"))
    n = allocation.no_prediction_split(g, 1000, "grid_id").select("grid_id", F.col("stations").alias("no_prediction"))
    return a.join(z, "grid_id").join(n, "grid_id")


@query("win17_fixed_allocation", "SELECT grid_id, 2 AS stations FROM v_grid_demand")
def _(t):
    return allocation.fixed_split(grid_demand(t), 2).select("grid_id", "stations")


@query("jon22_default_demand", """SELECT c.grid_id, round(coalesce(d.demand_score, 1.0), 6) AS demand
 FROM fx_station_cells c LEFT JOIN v_grid_demand d ON c.grid_id = d.grid_id""")
def _(t):
    pred = grid_demand(t).select("grid_id", F.col("demand_score").alias("prediction"))
    return allocation.with_default_demand(t.fx("station_cells").select("grid_id"), pred).select(
        "grid_id", *r6("demand"))
