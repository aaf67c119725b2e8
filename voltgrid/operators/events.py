"""KPIs and rewards from simulation event logs; one result row per episode (or whatever the keys are)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.functions.onerow import with_globals
from voltgrid.operators.ordered import gini, percentiles, previous, row_numbers, trailing

# Score weights and constants (fixed values).
REWARD_WEIGHTS = {"charging_score": 0.30, "network_score": 0.30, "battery_score": 0.30, "traffic_score": 0.10}
REFERENCE_SPEED = 15.0
MILES_PER_M = 0.000621371
DAY_SECONDS = 86400.0


def _row_order() -> Column:
    """Order of battery rows of one vehicle; the values break equal times."""
    return F.struct("time", "energy_consumed", "actual_battery_capacity")


def fleet_battery(battery: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final SoC mean / population variance / share below 30 %, energy of the last rows, mean trip time."""
    v = battery.groupBy(*keys, "id").agg(
        F.max_by(F.struct("energy_consumed", "actual_battery_capacity", "maximum_battery_capacity"), _row_order()).alias("l"),
        (F.max("time") - F.min("time")).alias("trip"), F.count(F.lit(1)).alias("n"))
    cap = F.col("l.maximum_battery_capacity")
    soc = F.when(cap > 0, F.col("l.actual_battery_capacity") / cap)
    return v.withColumn("soc", soc).groupBy(*keys).agg(
        F.coalesce(F.avg("soc"), F.lit(0.0)).alias("mean_final_soc"), F.coalesce(F.var_pop("soc"), F.lit(0.0)).alias("soc_variance"),
        F.coalesce(F.avg((F.col("soc") < 0.3).cast("double")), F.lit(0.0)).alias("pct_low_soc"),
        F.sum("l.energy_consumed").alias("total_energy_consumed"),
        F.coalesce(F.avg(F.when(F.col("n") > 1, F.col("trip"))), F.lit(0.0)).alias("avg_trip_duration"))


def charging_summary(events: DataFrame, keys: Sequence[str], sim_seconds: float, drop_zero_begin: bool = False) -> DataFrame:
    """Utilisation Gini over stations, mean of station mean durations, event count, mean duration.

    ``drop_zero_begin`` repeats the original's treatment of an event that begins at 0 as missing.
    """
    used = events.filter("charging_begin <> 0 AND charging_end <> 0") if drop_zero_begin else events
    d = used.withColumn("d", F.col("charging_end") - F.col("charging_begin"))
    st = d.groupBy(*keys, "station_id").agg(F.sum("d").alias("s"), F.avg("d").alias("m")).withColumn("util", F.col("s") / sim_seconds)
    total = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_charging_events"))
    out = (total.join(d.groupBy(*keys).agg(F.avg("d").alias("avg_charging_duration")), list(keys), "left")
           .join(st.groupBy(*keys).agg(F.avg("m").alias("mean_station_duration")), list(keys), "left")
           .join(gini(materialize(st), keys, "util", "utilisation_gini"), list(keys), "left"))
    return out.fillna(0.0, ["avg_charging_duration", "mean_station_duration", "utilisation_gini"])


def charging_score(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    st = events.groupBy(*keys, "station_id").agg(
        F.count_distinct("vehicle_id").alias("v"), F.sum(F.col("charging_end") - F.col("charging_begin")).alias("t"))
    eff = F.greatest(F.lit(0.0), 1.0 - F.col("t") / F.col("v") / 600.0)
    a = st.groupBy(*keys).agg(F.var_pop("v").alias("var"), F.avg(eff).alias("eff"))
    n = events.groupBy(*keys).agg(F.count_distinct("vehicle_id").alias("n"))
    score = 0.5 * F.least(F.lit(1.0), F.col("n") / 50.0) + 0.3 * F.exp(-0.2 * F.col("var")) + 0.2 * F.col("eff")
    return a.join(n, list(keys)).select(*keys, score.alias("charging_score"))


def network_score(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Completion of the last step and mean speed of steps with running vehicles."""
    g = summary.groupBy(*keys).agg(F.max_by(F.struct("loaded", "arrived"), "time").alias("l"),
                                   F.avg(F.when(F.col("running") > 0, F.col("mean_speed"))).alias("v"))
    done = F.when(F.col("l.loaded") > 0, F.col("l.arrived") / F.col("l.loaded")).otherwise(0.0)
    speed = F.least(F.coalesce("v", F.lit(0.0)) / REFERENCE_SPEED, F.lit(1.0))
    return g.select(*keys, (0.6 * done + 0.4 * speed).alias("network_score"))


def soc_rows(battery: DataFrame) -> DataFrame:
    """SoC per row: capacity <= 0 counts as 100, a missing charge as 50."""
    cap = F.coalesce(F.when(F.col("maximum_battery_capacity") > 0, F.col("maximum_battery_capacity")), F.lit(100.0))
    return battery.withColumn("soc", F.coalesce("actual_battery_capacity", F.lit(50.0)) / cap)


def soc_steps(battery: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SoC change per second between consecutive rows of a vehicle (null on its first row and on equal times)."""
    rows = soc_rows(battery).select(*keys, "id", "time", "soc")
    s = previous(rows, [*keys, "id"], ["time", "soc"], {"_t": "time", "_s": "soc"})
    dt = F.col("time") - F.col("_t")
    return s.withColumn("soc_velocity", F.when(dt > 0, (F.col("soc") - F.col("_s")) / dt)).drop("_t", "_s")


def ordered_soc(battery: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SoC rows numbered by time within the vehicle."""
    return row_numbers(soc_rows(battery).select(*keys, "id", "time", "soc"), [*keys, "id"], ["time", "soc"], "step")


def _sigmoid(x: Column, k: float, x0: float) -> Column:
    return 1.0 / (1.0 + F.exp(-k * (x - x0)))


def vehicle_soc(battery: DataFrame, keys: Sequence[str]) -> DataFrame:
    return soc_rows(battery).groupBy(*keys, "id").agg(
        F.avg("soc").alias("avg_soc"), F.max_by("soc", F.struct("time", "soc")).alias("final_soc"),
        F.min("soc").alias("min_soc"), F.min_by("energy_consumed", _row_order()).alias("first_energy"), F.count(F.lit(1)).alias("n"))


def soc_profile(vehicles: DataFrame, keys: Sequence[str]) -> DataFrame:
    gap = 1.0 - F.col("min_soc")
    s = (0.45 * _sigmoid(F.col("avg_soc"), 8.0, 0.25) + 0.35 * _sigmoid(F.col("final_soc"), 12.0, 0.40) + 0.20 * (1.0 - gap * gap))
    return vehicles.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("n") >= 2, s)), F.lit(0.0)).alias("soc_profile"))


def soc_levels(vehicles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Low-SoC score 1 - share(final < .6)^2 and spread score exp(-50 std)."""
    low = F.avg((F.col("final_soc") < 0.60).cast("double"))
    return vehicles.groupBy(*keys).agg(F.greatest(F.lit(0.0), 1.0 - low * low).alias("low_soc"),
                                       F.exp(-50.0 * F.stddev_pop("final_soc")).alias("soc_spread"))


def charge_efficiency(battery: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median over 90th percentile of the positive SoC velocities."""
    v = materialize(soc_steps(battery, keys).filter("soc_velocity > 0").select(*keys, "soc_velocity"))
    q = percentiles(v, keys, "soc_velocity", {"_m": 0.5, "_p": 0.9})
    return q.select(*keys, F.least(F.col("_m") / F.greatest("_p", F.lit(1e-6)), F.lit(1.0)).alias("charge_efficiency"))


def fleet_improvement(vehicles: DataFrame, episode: str = "episode") -> DataFrame:
    """tanh-scaled change of fleet SoC against the previous episode; .5 on the first."""
    two = vehicles.filter("n > 1").groupBy(episode).agg(F.avg("avg_soc").alias("a"), F.avg("min_soc").alias("m"))
    p = previous(two, [], [episode], {"_a": "a", "_m": "m"})
    score = 0.25 * (F.tanh(5 * (F.col("a") - F.col("_a"))) + 1.0) + 0.25 * (F.tanh(10 * (F.col("m") - F.col("_m"))) + 1.0)
    return p.select(episode, F.coalesce(score, F.lit(0.5)).alias("fleet_improvement"))


def energy_score(battery: DataFrame, episode: str = "episode", vehicles: DataFrame | None = None) -> DataFrame:
    """Energy of each vehicle's first row, against .7 of the mean over the last five episodes."""
    v = vehicles if vehicles is not None else vehicle_soc(battery, [episode])
    avg = materialize(v.groupBy(episode).agg(F.avg("first_energy").alias("avg_energy")))
    counted = row_numbers(avg.filter("avg_energy >= 1e-6"), [], [episode], "_rn")
    roll = trailing(counted, [], "_rn", 5, {"_mean": F.avg("avg_energy")})
    ref = 0.7 * F.col("_mean")
    scored = roll.select(episode, F.least(F.greatest(ref / F.greatest(ref, F.col("avg_energy")), F.lit(0.0)), F.lit(1.0)).alias("_s"))
    return avg.join(scored, episode, "left").select(episode, F.coalesce("_s", F.lit(1.0)).alias("energy_score"))


def battery_score(battery: DataFrame, episode: str = "episode") -> DataFrame:
    keys = [episode]
    v = materialize(vehicle_soc(battery, keys))
    j = (soc_profile(v, keys).join(charge_efficiency(battery, keys), keys, "left").join(energy_score(battery, episode, v), keys, "left")
         .join(soc_levels(v, keys), keys, "left").join(fleet_improvement(v, episode), keys, "left"))
    c = lambda n: F.coalesce(F.when(~F.isnan(n), F.col(n)), F.lit(0.0))
    raw = (0.35 * c("soc_profile") + 0.25 * c("charge_efficiency") + 0.15 * c("energy_score") + 0.15 * c("soc_spread")
           + 0.10 * c("low_soc"))
    return j.withColumn("battery_score", F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def traffic_score(flow: DataFrame, keys: Sequence[str]) -> DataFrame:
    used = materialize(flow.filter("entered > 0"))
    a = used.groupBy(*keys).agg(F.avg("speed").alias("v"), F.avg((F.col("speed") >= 0.5 * REFERENCE_SPEED).cast("double")).alias("free"))
    g = gini(used, keys, "entered", "g")
    score = 0.4 * (1 - F.col("g")) + 0.4 * F.least(F.lit(1.0), F.col("v") / REFERENCE_SPEED) + 0.2 * F.col("free")
    return a.join(g, list(keys)).select(*keys, score.alias("traffic_score"))


def episode_reward(battery: DataFrame, events: DataFrame, summary: DataFrame, flow: DataFrame, episode: str = "episode") -> DataFrame:
    """Weighted reward with components; .05 without any log, .1 when all scores are 0, clipped to [0, 1]."""
    keys = [episode]
    parts = [charging_score(events, keys), network_score(summary, keys),
             battery_score(battery, episode).select(episode, "battery_score"), traffic_score(flow, keys)]
    logged = (battery.select(episode).union(events.select(episode)).union(summary.select(episode)).distinct()
              .withColumn("_logged", F.lit(True)))
    j = logged.join(flow.select(episode).distinct(), episode, "full_outer")
    for p in parts:
        j = j.join(p, episode, "left")
    j = j.fillna(0.0, list(REWARD_WEIGHTS))
    total = sum((w * F.col(c) for c, w in REWARD_WEIGHTS.items()), F.lit(0.0))
    reward = (F.when(F.col("_logged").isNull(), 0.05).when(total == 0, 0.1)
              .otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))))
    return j.select(episode, *REWARD_WEIGHTS, *[(F.col(c) * w).alias(f"weighted_{c.split('_')[0]}") for c, w in REWARD_WEIGHTS.items()],
                    reward.alias("reward"))


def station_utilisation(events: DataFrame, keys: Sequence[str], sim_seconds: float) -> DataFrame:
    """Share of the run (capped at 1) and percent of a day (capped at 100) that each station is busy."""
    d = F.col("charging_end") - F.col("charging_begin")
    g = events.groupBy(*keys, "station_id").agg(F.sum(F.greatest(F.lit(0.0), d)).alias("_p"), F.sum(d).alias("_d"))
    share = F.least(F.lit(1.0), F.col("_p") / sim_seconds) if sim_seconds > 0 else F.lit(0.0)
    return g.select(*keys, "station_id", share.alias("utilisation"),
                    F.least(F.lit(100.0), F.col("_d") / DAY_SECONDS * 100).alias("day_pct"))


def travel_time_score(trips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First row per key of (time, duration, waiting)."""
    f = trips.groupBy(*keys).agg(F.min_by(F.struct("duration", "waiting"), "time").alias("f"))
    return f.select(*keys, (0.7 * F.least(F.lit(1.0), 1200 / F.greatest(F.lit(1.0), "f.duration"))
                            + 0.3 * F.least(F.lit(1.0), 300 / F.greatest(F.lit(1.0), "f.waiting"))).alias("travel_time_score"))


def load_score(flow: DataFrame, keys: Sequence[str], load: str = "entered") -> DataFrame:
    g = flow.groupBy(*keys).agg(F.avg(load).alias("m"), F.stddev_pop(load).alias("s"), F.max(load).alias("x"))
    raw = 1.0 - F.col("s") / (F.col("m") + 1e-6) - F.col("x") / (3 * F.col("m") + 1e-6)
    return g.select(*keys, F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)).alias("load_score"))


def charged_energy_score(events: DataFrame, keys: Sequence[str], expected: float = 30.0) -> DataFrame:
    g = events.groupBy(*keys).agg(F.avg("total_energy_charged").alias("e"))
    return g.select(*keys, F.least(F.lit(1.0), expected / F.greatest("e", F.lit(1e-6))).alias("charged_energy_score"))


def coverage_score(edge_centres: DataFrame, stations: DataFrame, within: float = 500.0) -> DataFrame:
    """Share of edge centres (edge_id, lat, lon in metres) with a station (station_id, lat, lon) in reach."""
    from voltgrid.operators.tiles import nearest

    hit = nearest(edge_centres, stations, "edge_id", "station_id", within=within)
    n = edge_centres.agg(F.count(F.lit(1)).alias("_n"))
    return hit.agg(F.count(F.lit(1)).alias("_h")).crossJoin(F.broadcast(n)).select((F.col("_h") / F.col("_n")).alias("coverage_score"))


# --- KPI set ------------------------------------------------------------------------------------------------

def unserved_pct(battery: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percent of vehicles that fell below 20 % SoC and never charged."""
    need = battery.filter("actual_battery_capacity / maximum_battery_capacity < 0.2").select(*keys, F.col("id").alias("vehicle_id")).distinct()
    unserved = need.join(events.select(*keys, "vehicle_id").distinct(), [*keys, "vehicle_id"], "left_anti")
    a = need.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    b = unserved.groupBy(*keys).agg(F.count(F.lit(1)).alias("_u"))
    return a.join(b, list(keys), "left").select(*keys, (100.0 * F.coalesce("_u", F.lit(0)) / F.col("_n")).alias("pct_unserved_demand"))


def queue_waits(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Minutes waited: end of the station's previous event minus own begin, at least 0."""
    p = previous(events, [*keys, "station_id"], ["charging_begin", "charging_end", "vehicle_id"], {"_end": "charging_end"})
    wait = F.greatest(F.lit(0.0), F.coalesce("_end", F.lit(0.0)) - F.col("charging_begin"))
    return p.withColumn("wait_min", wait / 60.0).drop("_end")


def service_gini(events: DataFrame, station_zone: DataFrame, zones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gini of events per unit of zone demand; every zone counts in every key, also with no event."""
    seen = events.join(station_zone, "station_id").groupBy(*keys, "grid_id").agg(F.count(F.lit(1)).alias("_s"))
    # Zones without an event have ratio 0: they only enlarge the population, so no key x zone table is built.
    ratios = seen.join(zones.select("grid_id", "demand"), "grid_id").withColumn("ratio", F.col("_s") / F.col("demand"))
    return gini(materialize(ratios.select(*keys, "ratio")), keys, "ratio", "gini_coefficient_service",
                population=zones.select("grid_id").distinct())


def kpi_set(battery: DataFrame, events: DataFrame, summary: DataFrame, trips: DataFrame, station_zone: DataFrame,
            zones: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    detour = trips.groupBy(*keys).agg((F.avg(F.greatest(F.lit(0.0), F.col("actual") - F.col("original"))) / 60.0).alias("avg_detour_time_min"))
    queue = queue_waits(events, keys).groupBy(*keys).agg(F.avg("wait_min").alias("avg_queueing_time_min"))
    util = station_utilisation(events, keys, 1.0).groupBy(*keys).agg(F.avg("day_pct").alias("avg_charger_utilization_pct"))
    energy = battery.groupBy(*keys).agg((F.sum("energy_consumed") / 1000.0).alias("total_energy_consumed_kwh"))
    vmt = summary.groupBy(*keys).agg(F.sum(F.col("running") * F.col("mean_speed") * MILES_PER_M).alias("total_vmt"))
    out = detour
    for part in (unserved_pct(battery, events, keys), queue, util, energy, vmt, service_gini(events, station_zone, zones, keys)):
        out = out.join(part, keys, "full_outer")
    return out.fillna(0.0)


KPI_FORMATS = {"avg_detour_time_min": 2, "pct_unserved_demand": 1, "avg_queueing_time_min": 2,
               "avg_charger_utilization_pct": 1, "total_energy_consumed_kwh": 0, "gini_coefficient_service": 3}


def kpi_table(kpis: DataFrame, key: str) -> DataFrame:
    """KPIs as text with their fixed decimals."""
    return kpis.select(key, *[F.format_string(f"%.{d}f" + ("%%" if "pct" in c else ""), F.round(c, d)).alias(c) for c, d in KPI_FORMATS.items()])


def calibration_rule(metric: Column, simulated: Column, observed: Column) -> Column:
    """Advice when the simulated mean is more than 10 % off the observed one."""
    high, low = simulated > observed * 1.1, simulated < observed * 0.9
    return (F.when((metric == "travel_time") & high, "raise acceleration").when((metric == "travel_time") & low, "lower acceleration")
            .when((metric == "speed_distribution") & high, "lower speed limits").when((metric == "speed_distribution") & low, "raise speed limits")
            .otherwise("keep"))


def placement_evaluation(battery: DataFrame, events: DataFrame, summary: DataFrame, keys: Sequence[str], sim_seconds: float = 300.0) -> DataFrame:
    keys = list(keys)
    e = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_charging_events"), F.count_distinct("vehicle_id").alias("unique_vehicles_charged"),
                                  F.sum("total_energy_charged").alias("total_energy_transferred"))
    u = station_utilisation(events, keys, sim_seconds).groupBy(*keys).agg(F.avg("utilisation").alias("avg_utilization"))
    b = battery.groupBy(*keys).agg(F.count(F.lit(1)).alias("battery_data_points"))
    s = summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("summary_data_points"))
    return b.join(s, keys, "full_outer").join(e, keys, "left").join(u, keys, "left").fillna(0)


SIMULATION_FIELDS = {"simulation_reward": 0.0, "charging_efficiency": 0.0, "network_utilization": 0.0, "battery_management": 0.0,
                     "traffic_impact": 0.0, "charging_events": 0, "battery_data_points": 0, "simulation_duration": 0, "vehicles_processed": 0}


def simulation_projection(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Simulation metric columns with defaults where absent or null."""
    cols = [F.coalesce(F.col(c), F.lit(d)).alias(c) if c in results.columns else F.lit(d).alias(c) for c, d in SIMULATION_FIELDS.items()]
    ok = F.coalesce("simulation_success", F.lit(False)) if "simulation_success" in results.columns else F.lit(False)
    return results.select(*keys, ok.alias("simulation_success"), *cols)


def divergence(samples: DataFrame, side: str, value: str, bins: int = 50, threshold: float = 0.05) -> DataFrame:
    """KL, JS and two-sample KS between ``side`` = 'observed' and 'simulated', over shared bins; means and stds."""
    from voltgrid.operators.ordered import running

    s = with_globals(samples.select(side, value), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    spread = F.col("_hi") > F.col("_lo")
    b = F.when(spread, F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    obs, sim = F.col(side) == "observed", F.col(side) == "simulated"
    counts = s.withColumn("_b", b).groupBy("_b").agg(F.count_if(obs).alias("o"), F.count_if(sim).alias("s"), F.first("_lo").alias("lo"), F.first("_hi").alias("hi"))
    grid = samples.sparkSession.range(bins).select(F.col("id").cast("int").alias("_b")).join(counts, "_b", "left")
    t = with_globals(grid, F.sum("o").alias("_no"), F.sum("s").alias("_ns"), F.max("lo").alias("_l"), F.max("hi").alias("_h"))
    width = F.when(F.col("_h") > F.col("_l"), (F.col("_h") - F.col("_l")) / bins).otherwise(1.0)
    p = F.coalesce("o", F.lit(0)) / F.col("_no") / width + 1e-10
    q = F.coalesce("s", F.lit(0)) / F.col("_ns") / width + 1e-10
    d = t.select(p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2).agg(
        F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"),
        F.sum(0.5 * F.col("p") * F.log(F.col("p") / F.col("m")) + 0.5 * F.col("q") * F.log(F.col("q") / F.col("m"))).alias("js"))
    per_value = samples.groupBy(value).agg(F.count_if(obs).alias("o"), F.count_if(sim).alias("s"))
    cdf = with_globals(running(per_value, [], [value], {"co": ("sum", "o"), "cs": ("sum", "s")}), F.max("co").alias("_no"), F.max("cs").alias("_ns"))
    ks = cdf.agg(F.max(F.abs(F.col("co") / F.col("_no") - F.col("cs") / F.col("_ns"))).alias("ks"))
    moments = samples.agg(F.avg(F.when(obs, F.col(value))).alias("observed_mean"), F.avg(F.when(sim, F.col(value))).alias("simulated_mean"),
                          F.stddev_pop(F.when(obs, F.col(value))).alias("observed_std"), F.stddev_pop(F.when(sim, F.col(value))).alias("simulated_std"))
    return d.crossJoin(F.broadcast(ks)).crossJoin(F.broadcast(moments)).withColumn("is_valid", F.col("js") < threshold)
