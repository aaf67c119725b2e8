"""Placement validation and the scores of a set of placements, alone and together with run and simulation metrics.

Placements have grid_id, method, edge_id, lat, lon and an id; a set is one (grid_id, method).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.geo import widened
from voltgrid.operators.runs import RUN, is_hybrid
from voltgrid.operators.tiles import nearest, pairwise_mean_distance

# Normalisers of the scores (fixed values).
TYPICAL_STEP = 0.01
SPREAD = 0.02
CITY_LAT_RANGE, CITY_LON_RANGE = 0.1309, 0.1337
BASELINES = ("Random", "Uniform", "K-Means")


def _cap(c: Column) -> Column:
    return F.least(F.lit(1.0), c)


def _in_box(box: dict[str, float], margin: float = 0.0) -> Column:
    b = widened(box, margin)
    return F.col("lat").between(b["min_lat"], b["max_lat"]) & F.col("lon").between(b["min_lon"], b["max_lon"])


def validate(placements: DataFrame, box: dict[str, float], edge_mids: DataFrame | None = None, margin: float = 0.01) -> DataFrame:
    """Keep usable placements. Baseline methods are repaired: missing edge and lane ids are made up from the position,
    positions outside the box snap to the nearest edge midpoint in the box (or are clipped without edges)."""
    base = F.col("method").isin(*BASELINES)
    made = F.concat_ws("_", F.lit("fallback"), (F.col("lat") * 1000).cast("int"), (F.col("lon") * 1000).cast("int"))
    edge = F.coalesce("edge_id", F.when(base, made))
    p = placements.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("edge_id", edge)
    p = p.withColumn("lane", F.coalesce("lane", F.when(base, F.concat("edge_id", F.lit("_0")))))
    p = p.filter(F.col("edge_id").isNotNull() & F.col("lane").isNotNull())
    inside = p.filter(_in_box(box, margin))
    outside = p.filter(base & ~_in_box(box, margin))
    if edge_mids is None:
        clip = lambda c, lo, hi: F.least(F.greatest(F.col(c), F.lit(box[lo])), F.lit(box[hi]))
        fixed = outside.withColumn("lat", clip("lat", "min_lat", "max_lat")).withColumn("lon", clip("lon", "min_lon", "max_lon"))
    else:
        usable = edge_mids.filter(_in_box(box))
        near = nearest(outside, usable, "station_id", "edge_id").select("station_id", F.col("edge_id").alias("_e"))
        at = usable.select(F.col("edge_id").alias("_e"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
        fixed = (outside.join(near, "station_id").join(at, "_e").withColumn("edge_id", F.col("_e")).withColumn("lane", F.concat("_e", F.lit("_0")))
                 .withColumn("lat", F.col("_lat")).withColumn("lon", F.col("_lon")).select(*p.columns))
    return inside.unionByName(fixed)


def set_metrics(placements: DataFrame, box: dict[str, float], point_id: str = "station_id") -> DataFrame:
    """All placement-set metrics in one aggregate, one edge-count aggregate and one pair-distance pass."""
    has_edge = F.col("edge_id").isNotNull() & (F.col("edge_id") != "")
    edges = placements.filter(has_edge).groupBy(*RUN, "edge_id").agg(F.count(F.lit(1)).alias("c"))
    even = edges.groupBy(*RUN).agg(F.count(F.lit(1)).alias("unique_edges"), (F.stddev_pop("c") / F.avg("c")).alias("_cv"))
    kind = F.when(F.col("edge_id").contains("_"), F.split("edge_id", "_")[0]).otherwise("default")
    prefix = placements.filter(has_edge).groupBy(*RUN, kind.alias("_k")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    # -sum(p log2 p) = log2 n - sum(c log2 c) / n with n = all placements of the set.
    ent = prefix.groupBy(*RUN).agg(F.sum(F.col("c") * F.log2("c")).alias("_cl"), F.sum("c").alias("_cs"), F.count(F.lit(1)).alias("_kinds"))
    g = placements.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("num_placements"), F.count_if(has_edge).alias("_edges"), F.count_if(_in_box(box)).alias("_ok"),
        F.stddev_pop("lat").alias("_slat"), F.stddev_pop("lon").alias("_slon"), F.var_pop("lat").alias("_vlat"), F.var_pop("lon").alias("_vlon"),
        (F.max("lat") - F.min("lat")).alias("_rlat"), (F.max("lon") - F.min("lon")).alias("_rlon"),
        F.count_if((F.col("lat") != 0) & (F.col("lon") != 0)).alias("valid_coordinates"))
    pairs = pairwise_mean_distance(placements, RUN, point_id, "_pd")
    j = g.join(even, RUN, "left").join(ent, RUN, "left").join(pairs, RUN, "left").fillna(0, ["unique_edges", "_cs"])
    n, many = F.col("num_placements"), F.col("num_placements") > 1
    kinds = F.coalesce("_kinds", F.lit(0))
    entropy = (F.coalesce("_cs", F.lit(0.0)) * F.log2(n.cast("double")) - F.coalesce("_cl", F.lit(0.0))) / n
    norm = F.when(kinds > 1, entropy / F.log2(kinds.cast("double"))).otherwise(entropy)
    out = j.withColumns({
        "edge_coverage": F.col("_edges") / n, "network_integration": _cap(F.col("unique_edges") / n),
        "spatial_diversity": F.when(many, _cap((F.col("_slat") + F.col("_slon")) / SPREAD)).otherwise(0.0),
        "grid_compliance": F.col("_ok") / n,
        "spatial_coverage": F.when(many, _cap(F.col("_rlat") * F.col("_rlon") / TYPICAL_STEP**2)).otherwise(0.0),
        "edge_distribution": F.when(F.col("unique_edges") == 0, 0.0).when(F.col("unique_edges") == 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("_cv"))),
        "spatial_clustering": _cap(F.coalesce("_pd", F.lit(0.0)) / TYPICAL_STEP),
        "range_diversity": F.when(many, _cap(0.5 * F.col("_rlat") / CITY_LAT_RANGE + 0.5 * F.col("_rlon") / CITY_LON_RANGE)).otherwise(0.0),
        "prefix_entropy": _cap(norm), "city_edge_coverage": _cap(F.col("unique_edges") / 1000.0), "small_edge_coverage": _cap(F.col("unique_edges") / 10.0),
        "placement_variance": F.when(many, (F.col("_vlat") + F.col("_vlon")) / 2).otherwise(0.0)})
    return out.drop("_edges", "_ok", "_slat", "_slon", "_vlat", "_vlon", "_rlat", "_rlon", "_cv", "_cl", "_cs", "_kinds", "_pd")


def quality(df: DataFrame) -> DataFrame:
    """Analyzer quality (.4 edge, .3 diversity, .3 compliance) and engine quality (.5 / .3 / .2, own rule for one station)."""
    c = F.col
    engine = F.when(c("num_placements") == 1, 0.4 * c("valid_coordinates") + 0.3 * c("edge_coverage") + 0.3 * c("grid_compliance")).otherwise(
        0.5 * c("range_diversity") + 0.3 * c("edge_distribution") + 0.2 * c("grid_compliance"))
    return df.withColumns({
        "placement_quality": 0.4 * c("edge_coverage") + 0.3 * c("spatial_diversity") + 0.3 * c("grid_compliance"),
        "engine_quality": _cap(engine),
        "engine_diversity": F.when(c("num_placements") > 1, (c("range_diversity") + c("edge_distribution")) / 2).otherwise(0.0)})


def fallback_reward(df: DataFrame) -> DataFrame:
    """Reward of a set that was not simulated; values below .1 are lifted to .05 + min(.05, value)."""
    c = F.col
    base = (0.30 * c("city_edge_coverage") + 0.25 * c("spatial_diversity") + 0.25 * c("grid_compliance") + 0.10 * c("network_integration")
            + 0.05 * c("edge_distribution") + 0.05 * c("spatial_clustering"))
    r = F.greatest(F.lit(0.0), _cap(base))
    lifted = F.when((c("city_edge_coverage") > 0) & (r < 0.1), 0.05 + F.least(F.lit(0.05), r)).otherwise(r)
    simple = (c("valid_coordinates") + 0.5 * c("edge_coverage") * c("num_placements")) / c("num_placements")
    return df.withColumn("fallback_reward", lifted).withColumn("simple_fallback", simple)


def reward_floor(reward: Column, charging_events: Column, battery_rows: Column, placements: Column) -> Column:
    """A zero reward becomes .1 when the run logged data and .05 when it only has placements."""
    return (F.when(reward != 0, reward).when((charging_events > 0) | (battery_rows > 0), 0.1).when(placements > 0, 0.05).otherwise(0.0))


def _yes(flag: str) -> Column:
    return F.col(flag).cast("double")


def exploration(df: DataFrame) -> DataFrame:
    """Exploration balance, exploration value and overall diversity."""
    best, avg = F.col("best_reward"), F.col("average_reward")
    balance = F.when(best == 0, 0.0).otherwise(0.4 * avg / best + 0.3 * _cap(F.greatest(F.lit(0.0), F.col("exploration_efficiency")) / 10)
                                               + 0.3 * _cap(F.greatest(F.lit(0.0), F.col("action_diversity")) / 5))
    gain = F.when(avg > 0, (F.least(best / avg, F.lit(1.5)) - 1) / 0.5).otherwise(0.0)
    value = 0.5 * gain + 0.3 * F.when(F.col("convergence_achieved"), 1.0).otherwise(0.3) + 0.2 * F.col("engine_diversity")
    return df.withColumns({"exploration_balance": balance,
                           "exploration_value": F.when(F.col("total_episodes") == 0, 0.0).otherwise(_cap(value)),
                           "overall_diversity": (F.col("spatial_diversity") * 2 + F.col("edge_distribution")) / 3})


def learning(df: DataFrame) -> DataFrame:
    """Adaptability, learning-curve quality and learning rate."""
    sim, best, n = F.col("simulation_reward"), F.col("best_reward"), F.col("total_episodes")
    rate = F.when(n > 0, best / n).otherwise(0.0)
    return df.withColumns({"adaptability_score": (F.col("spatial_diversity") + F.when(sim > 0, _cap(sim / 10)).otherwise(0.0)) / 2,
                           "learning_curve_quality": (_yes("convergence_achieved") + rate) / 2, "learning_rate": _cap(rate)})


def overall_performance(df: DataFrame) -> DataFrame:
    primary = F.when(F.col("simulation_reward") > 0, F.col("simulation_reward")).otherwise(F.col("best_reward"))
    return df.withColumn("overall_performance", _cap(0.7 * primary + 0.3 * F.col("placement_quality")))


def empirical(sim: Column, ok: Column) -> Column:
    c = F.col
    return (0.4 * F.when(sim > 0, _cap(sim)).otherwise(0.0) + 0.3 * ok + 0.1 * c("charging_efficiency") + 0.1 * c("network_utilization")
            + 0.05 * c("battery_management") + 0.05 * F.greatest(F.lit(0.0), 1.0 - c("traffic_impact")))


def research_set(df: DataFrame) -> DataFrame:
    """The twelve research measures; hybrids earn a bonus for shown learning and for exploration."""
    sim, ok, n = F.col("simulation_reward"), F.col("simulation_success"), F.col("num_placements")
    perf = F.when(ok & (sim > 0), _cap(sim)).when(ok, 0.5).otherwise(0.0)
    charge = F.when(F.col("charging_events") > 0, _cap(F.col("charging_events") / 10.0)).otherwise(0.0)
    batt = F.when(F.col("battery_data_points") > 0, _cap(F.col("battery_data_points") / 100.0 * F.col("mean_final_soc"))).otherwise(0.0)
    net = F.when(F.col("network_utilization") > 0, _cap(F.col("network_utilization"))).otherwise(F.col("edge_coverage"))
    rel = F.when(ok & (n > 0), 1.0).when(ok | (n > 0), 0.5).otherwise(0.0)
    eff = F.when(F.col("total_episodes") > 0, _cap(sim / F.col("total_episodes"))).otherwise(F.when(ok, 0.5).otherwise(0.0))
    better = F.col("late_average") > F.col("early_average")
    learn = F.when(~is_hybrid(), 0.0).when(F.col("convergence_achieved") & (F.col("total_episodes") > 3), _cap(sim)).when(
        (F.col("total_episodes") > 5) & better, F.least(F.lit(0.5), 2 * (F.col("late_average") - F.col("early_average")))).otherwise(0.0)
    quality_ = 0.4 * F.col("edge_coverage") + 0.3 * F.col("spatial_diversity") + 0.3 * F.col("grid_compliance")
    out = df.withColumns({
        "simulation_performance": perf, "placement_quality": quality_, "charging_utilization": charge, "battery_score": batt, "network_score": net,
        "method_reliability": rel, "computational_efficiency": eff, "learning_capability": learn, "diversity_value": F.col("spatial_diversity"),
        "empirical_performance": empirical(sim, ok.cast("double")),
        "practical_applicability": 0.6 * ok.cast("double") + 0.4 * F.col("small_edge_coverage")})
    base = (0.40 * F.col("simulation_performance") + 0.25 * F.col("placement_quality") + 0.15 * F.col("charging_utilization")
            + 0.10 * F.col("battery_score") + 0.10 * F.col("network_score"))
    bonus = F.when(is_hybrid(), 0.15 * F.col("learning_capability") + 0.10 * F.col("diversity_value")).otherwise(0.0)
    return out.withColumn("overall_performance", base + bonus)


RESEARCH = ("simulation_performance", "placement_quality", "charging_utilization", "battery_score", "network_score", "method_reliability",
            "computational_efficiency", "learning_capability", "diversity_value", "overall_performance", "empirical_performance", "practical_applicability")


def efficiency_set(df: DataFrame) -> DataFrame:
    """Efficiency measures, and the statistics the original sets by rule (named heuristic_*)."""
    sim, ok, n, var = F.col("simulation_reward"), F.col("simulation_success"), F.col("num_placements"), F.col("placement_variance")
    place = _cap(n / 3.0)
    simulated = F.when(ok & (sim > 0), _cap(sim)).when(ok, 0.5).otherwise(0.0)
    time = F.when(F.col("execution_time") > 0, _cap(sim / (F.col("execution_time") / 60.0))).otherwise(1.0)
    return df.withColumns({
        "placement_efficiency": place, "simulation_efficiency": simulated, "time_efficiency": time,
        "overall_efficiency": 0.3 * place + 0.5 * simulated + 0.2 * time,
        "heuristic_reward_variance": F.when(sim > 0, sim * 0.1).otherwise(0.0),
        "heuristic_confidence": F.when(n < 5, 0.90).when(n > 20, 0.99).otherwise(0.95),
        "heuristic_p_value": F.when(var > 0.01, 0.01).when(var < 0.001, 0.1).otherwise(0.05)})


def comparison_set(df: DataFrame) -> DataFrame:
    """Performance indicators and research columns of the method comparison; needs ``quality`` columns."""
    h, n, best, avg = is_hybrid(), F.col("num_placements"), F.col("best_reward"), F.col("average_reward")
    name = F.lower("method")
    consistency = F.when(best == 0, 0.0).otherwise(_cap(avg / best))
    method_score = (F.when(h & name.contains("ucb"), 0.9).when(h & name.contains("epsilon"), 0.8).when(h & name.contains("thompson"), 0.85)
                    .when(h, 0.7).otherwise(0.6))
    return df.withColumns({
        "reliability": F.when(n > 0, 1.0).otherwise(0.0), "efficiency": F.when(h, best).otherwise(F.col("edge_coverage")),
        "consistency": consistency, "robustness": (F.col("spatial_diversity") + consistency) / 2,
        "scalability": F.when(n == 0, 0.0).otherwise(_cap(F.col("total_episodes") / n / 10)),
        # The caller's metrics never name a method type here, so every method gets the baseline factor.
        "adaptability": _cap(0.8 * F.col("spatial_diversity")),
        "innovation": _cap(F.col("placement_quality") * F.when(h, 1.5).otherwise(0.7)), "methodology": method_score,
        "theoretical_contribution": F.when(h, 0.8).otherwise(0.4),
        "load_efficiency": F.when((n == 0) | (F.col("total_episodes") == 0), 0.0).otherwise(_cap(F.col("total_episodes") / n / 5)),
        "stability": _yes("convergence_achieved")})


COMPARISON = ("reliability", "efficiency", "consistency", "robustness", "scalability", "adaptability", "innovation", "methodology",
              "theoretical_contribution", "load_efficiency", "stability")


def best_placement_summary(placements: DataFrame, runs: DataFrame) -> DataFrame:
    """Per method over all grids: share of grids, reward statistics, placements, unique edges, extent, consistency."""
    grids = runs.agg(F.count_distinct("grid_id").alias("_g"))
    r = runs.groupBy("method").agg(F.count(F.lit(1)).alias("grids"), F.avg("best_reward").alias("reward_mean"), F.stddev_pop("best_reward").alias("reward_std"),
                                   F.avg("convergence_rate").alias("convergence_rate_mean"))
    p = placements.groupBy("method").agg(F.count(F.lit(1)).alias("total_placements"), F.count_distinct("edge_id").alias("unique_edges"),
                                         (F.max("lat") - F.min("lat") + F.max("lon") - F.min("lon")).alias("spatial_diversity"))
    out = r.join(p, "method", "left").crossJoin(F.broadcast(grids))
    return out.withColumns({"percentage": 100.0 * F.col("grids") / F.col("_g"), "avg_placements_per_grid": F.col("total_placements") / F.col("_g"),
                            "reward_consistency": F.when(F.col("reward_mean") > 0, 1 - F.col("reward_std") / F.col("reward_mean")).otherwise(0.0)}).drop("_g")


def plot_bounds(stations: DataFrame, cells: DataFrame, pad: float = 0.1) -> DataFrame:
    """Extent of stations and cells widened by a tenth of its size on every side."""
    u = stations.select("lat", "lon").unionByName(cells.select(F.col("min_lat").alias("lat"), F.col("min_lon").alias("lon"))).unionByName(
        cells.select(F.col("max_lat").alias("lat"), F.col("max_lon").alias("lon")))
    e = u.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    dlat, dlon = (F.col("b") - F.col("a")) * pad, (F.col("d") - F.col("c")) * pad
    return e.select((F.col("a") - dlat).alias("min_lat"), (F.col("b") + dlat).alias("max_lat"), (F.col("c") - dlon).alias("min_lon"), (F.col("d") + dlon).alias("max_lon"))
