"""Statistics of logged optimisation runs: episodes -> runs -> methods -> comparisons.

Episodes have grid_id, method, episode (order), arm and reward; a run is one (grid_id, method).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.functions.onerow import with_globals, with_group_stats
from voltgrid.functions.special import normal_p_value, t_p_value
from voltgrid.operators.ordered import percentiles, row_numbers, running, trailing

RUN = ["grid_id", "method"]


def is_hybrid(method: str | Column = "method") -> Column:
    c = F.col(method) if isinstance(method, str) else method
    return F.lower(c).contains("hybrid")


def rating(score: Column) -> Column:
    return F.when(score > 0.7, "Excellent").when(score > 0.5, "Good").otherwise("Fair")


def assessment(score: Column) -> Column:
    return (F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "moderate")
            .when(score >= 0.2, "weak").otherwise("poor"))


# --- per episode --------------------------------------------------------------------------------------------

def numbered(episodes: DataFrame) -> DataFrame:
    return row_numbers(episodes, RUN, ["episode"], "rn")


def regret_curve(episodes: DataFrame) -> DataFrame:
    """Instantaneous, cumulative and average regret against the best reward of the run."""
    best = with_group_stats(episodes, RUN, F.max("reward").alias("_best"))
    inst = best.withColumn("regret", F.col("_best") - F.col("reward")).drop("_best")
    out = running(inst, RUN, ["episode"], {"cumulative_regret": ("sum", "regret"), "rn": ("count", F.lit(1))})
    return out.withColumn("average_regret", F.col("cumulative_regret") / F.col("rn"))


def best_so_far(episodes: DataFrame) -> DataFrame:
    return running(episodes, RUN, ["episode"], {"best_reward": ("max", "reward"), "rn": ("count", F.lit(1))})


def early_stop(episodes: DataFrame, patience: int) -> DataFrame:
    """True where the mean of the last ``patience`` rewards is below .8 of the mean so far."""
    r = running(episodes, RUN, ["episode"], {"rn": ("count", F.lit(1)), "_sum": ("sum", "reward")})
    t = trailing(r, RUN, "rn", patience, {"_recent": F.avg("reward")})
    stop = (F.col("rn") >= patience) & (F.col("_recent") < 0.8 * F.col("_sum") / F.col("rn"))
    return t.withColumn("stop", stop).drop("_sum", "_recent")


def convergence(episodes: DataFrame, limit: float = 0.01, window: int = 5, at_least: int = 10) -> DataFrame:
    """True where the population variance of the last rewards is below the limit."""
    t = trailing(numbered(episodes), RUN, "rn", window, {"_var": F.var_pop("reward")})
    return t.withColumn("converged", (F.col("rn") >= at_least) & (F.col("_var") < limit)).drop("_var")


# --- per run ------------------------------------------------------------------------------------------------

def run_table(episodes: DataFrame) -> DataFrame:
    """One row per run with rewards, regret, diversity, convergence and halves of the reward curve."""
    e = materialize(convergence(episodes))
    n = e.groupBy(*RUN).agg(F.count(F.lit(1)).alias("_n"))
    half = F.floor(F.col("_n") / 2)
    first_half, second_half = F.col("rn") <= half, F.col("rn") > half
    g = e.join(n, RUN).groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("total_episodes"), F.max("reward").alias("best_reward"), F.max_by("reward", "episode").alias("final_reward"),
        F.avg("reward").alias("average_reward"), F.stddev_pop("reward").alias("reward_std"), F.sum("reward").alias("_sum"),
        F.count_distinct("arm").alias("action_diversity"), F.min(F.when(F.col("converged"), F.col("rn"))).alias("convergence_episode"),
        F.avg(F.when(first_half, F.col("reward"))).alias("early_average"), F.avg(F.when(second_half, F.col("reward"))).alias("late_average"))
    best, avg, total = F.col("best_reward"), F.col("average_reward"), F.col("total_episodes")
    return g.withColumns({
        "convergence_achieved": F.col("convergence_episode").isNotNull(),
        "cumulative_regret": best * total - F.col("_sum"),
        "average_regret": (best * total - F.col("_sum")) / total,
        "exploration_efficiency": F.col("action_diversity") / total,
        "sample_efficiency": best / total,
        "convergence_rate": F.when((best > 0) & (avg > 0), F.least(F.lit(1.0), avg / best)).otherwise(0.0)}).drop("_sum")


def regret_bound(arms: Column, pulls: Column) -> Column:
    """8 sqrt(K T ln T), 0 for T <= 1."""
    return F.when((pulls > 1) & (arms > 0), 8 * F.sqrt(arms * pulls * F.log(pulls.cast("double")))).otherwise(0.0)


def bandit_metrics(runs: DataFrame, fixed_arms: int = 3) -> DataFrame:
    """Hybrid runs keep their metrics, others get zeros; the bound applies to UCB runs with a fixed arm count."""
    h = is_hybrid()
    keep = lambda c: F.when(h, F.col(c)).otherwise(F.lit(0.0)).alias(c)
    bound = F.when(h & F.lower("method").contains("ucb"), regret_bound(F.lit(fixed_arms), F.col("total_episodes"))).otherwise(0.0)
    return runs.select(*RUN, h.alias("is_bandit_method"), keep("best_reward"), keep("average_reward"), keep("convergence_rate"), keep("sample_efficiency"),
                       keep("cumulative_regret"), keep("average_regret"), F.when(h, F.col("total_episodes")).otherwise(0).alias("total_episodes"),
                       F.when(h, F.col("best_reward") / F.col("total_episodes")).otherwise(0.0).alias("exploration_efficiency"), bound.alias("regret_bound"))


def adaptive_budget(alloc: DataFrame, stations: str = "stations", confidence: float = 0.95) -> DataFrame:
    """Episode budget from the size of the action space, min(75^n, 10000)."""
    n = F.col(stations)
    space = F.least(F.pow(F.lit(75.0), n), F.lit(10000.0))
    scale = F.when(space <= 100, 1.0).when(space <= 1000, 2.0).when(space <= 5000, 3.0).otherwise(4.0)
    base = F.when(space <= 100, 50).when(space <= 1000, 200).when(space <= 5000, 500).otherwise(1000)
    # Shares as whole hundredths: products such as 0.3 * k would fall just below a whole number.
    share = lambda c, hundredths: F.floor(c * hundredths / 100).cast("long")
    out = alloc.withColumn("action_space_size", space.cast("long")).withColumn("station_factor", 1.0 + (n - 2) * 0.3)
    out = out.withColumn("max_episodes", share(base * scale, 100 + (n - 2) * 30))
    m = F.col("max_episodes")
    conf = F.greatest(F.lit(0.90), F.least(F.lit(0.99), F.lit(confidence) + (n - 2) * 0.02))
    return out.withColumns({"min_episodes": F.greatest(F.lit(50), share(m, 30)), "exploration_episodes": share(m, 40),
                            "exploitation_episodes": share(m, 60), "early_stopping_patience": F.greatest(F.lit(20), share(m, 15)),
                            "confidence_threshold": conf})


def sampled_budget(alloc: DataFrame, stations: str = "stations", actual: str | None = None) -> DataFrame:
    """Episodes for 20 % of the action space, four each, within [200, 800]; space = min(C(60n, n), 2000)."""
    n = F.col(stations)
    comb = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(1.0),
                       lambda acc, i: acc * (60.0 * n - n + i) / i)
    space = F.least(F.when(n >= 1, F.round(comb)).otherwise(1.0), F.lit(2000.0))
    if actual is not None:
        space = F.coalesce(F.col(actual).cast("double"), space)
    out = alloc.withColumn("action_space", space.cast("long"))
    target = F.floor(F.round(F.col("action_space") * 0.2, 9)) * 4
    return out.withColumn("episodes", F.greatest(F.lit(200), F.least(target, F.lit(800))).cast("long"))


# --- per method ---------------------------------------------------------------------------------------------

def reward_moments(episodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, population std, exact quartiles, skewness (n >= 3) and excess kurtosis (n >= 4)."""
    n = F.count("reward")
    g = episodes.groupBy(*keys).agg(
        n.alias("n"), F.avg("reward").alias("reward_mean"), F.stddev_pop("reward").alias("reward_std"), F.min("reward").alias("reward_min"),
        F.max("reward").alias("reward_max"), F.when(n >= 3, F.coalesce(F.skewness("reward"), F.lit(0.0))).otherwise(0.0).alias("reward_skewness"),
        F.when(n >= 4, F.coalesce(F.kurtosis("reward"), F.lit(0.0))).otherwise(0.0).alias("reward_kurtosis"))
    q = percentiles(episodes, keys, "reward", {"reward_q25": 0.25, "reward_median": 0.5, "reward_q75": 0.75})
    return g.join(q, list(keys))


def method_performance(runs: DataFrame) -> DataFrame:
    """Per method and in total (method null)."""
    conv = F.col("convergence_achieved").cast("double")
    return runs.rollup("method").agg(
        F.avg("best_reward").alias("mean_reward"), F.stddev_pop("best_reward").alias("std_reward"), F.min("best_reward").alias("min_reward"),
        F.max("best_reward").alias("max_reward"), F.count(F.lit(1)).alias("runs"), F.avg("total_episodes").alias("mean_episodes"),
        F.sum("total_episodes").alias("total_episodes"), F.avg(conv).alias("convergence_rate"))


def city_metrics(runs: DataFrame) -> DataFrame:
    """Non-zero rewards only."""
    r = F.when(F.col("best_reward") != 0, F.col("best_reward"))
    s = F.when(F.col("simulation_reward") != 0, F.col("simulation_reward"))
    return runs.agg(F.count_distinct("grid_id").alias("total_grids"), F.avg(r).alias("mean_reward"), F.stddev_pop(r).alias("std_reward"),
                    F.avg(s).alias("mean_simulation_reward"), F.stddev_pop(s).alias("std_simulation_reward"))


def _cv(c: str) -> Column:
    return F.when(F.avg(c) > 0, F.stddev_pop(c) / F.avg(c)).otherwise(0.0)


def cross_grid(runs: DataFrame, measures: Mapping[str, str]) -> DataFrame:
    """Per method mean / std / min / max of each measure, exact median of the first, coefficients of variation."""
    aggs = [F.count(F.lit(1)).alias("total_grids_tested"), F.avg(F.col("convergence_achieved").cast("double")).alias("success_rate")]
    for col, name in measures.items():
        aggs += [F.avg(col).alias(f"mean_{name}"), F.stddev_pop(col).alias(f"std_{name}"), F.min(col).alias(f"min_{name}"),
                 F.max(col).alias(f"max_{name}"), _cv(col).alias(f"{name}_cv")]
    first_col, first_name = next(iter(measures.items()))
    med = percentiles(runs, ["method"], first_col, {f"median_{first_name}": 0.5})
    out = runs.groupBy("method").agg(*aggs).join(med, "method")
    return out.withColumn(f"{first_name}_consistency", 1.0 - F.least(F.lit(1.0), F.col(f"{first_name}_cv")))


def grid_variability(runs: DataFrame) -> DataFrame:
    return runs.groupBy("grid_id").agg(F.var_pop("best_reward").alias("reward_variance"), F.stddev_pop("best_reward").alias("reward_std"),
                                       (F.max("best_reward") - F.min("best_reward")).alias("reward_range"), F.count(F.lit(1)).alias("method_count"))


def hybrid_vs_baseline(runs: DataFrame, with_p: bool = False) -> DataFrame:
    """Means, improvement, pooled-variance t statistic and effect size of hybrid against other methods."""
    h = is_hybrid()
    r = lambda cond: F.when(cond, F.col("best_reward"))
    a = runs.agg(*[f(r(c)).alias(f"{p}_{n}") for p, c in (("h", h), ("b", ~h)) for n, f in (
        ("n", F.count), ("mean", F.avg), ("var", F.var_samp), ("vpop", F.var_pop), ("std", F.stddev_pop))])
    df = F.col("h_n") + F.col("b_n") - 2
    pooled = ((F.col("h_n") - 1) * F.col("h_var") + (F.col("b_n") - 1) * F.col("b_var")) / df
    t = (F.col("h_mean") - F.col("b_mean")) / F.sqrt(pooled * (1 / F.col("h_n") + 1 / F.col("b_n")))
    gap = F.col("h_mean") - F.col("b_mean")
    out = a.select(F.col("h_mean").alias("hybrid_mean_reward"), F.col("h_std").alias("hybrid_std_reward"), F.col("b_mean").alias("baseline_mean_reward"),
                   F.col("b_std").alias("baseline_std_reward"), F.when(F.col("b_mean") > 0, gap / F.col("b_mean")).otherwise(0.0).alias("performance_improvement"),
                   t.alias("t_statistic"), (gap / F.sqrt((F.col("h_vpop") + F.col("b_vpop")) / 2)).alias("effect_size"), df.alias("degrees"))
    if with_p:
        out = out.withColumn("p_value", t_p_value(F.col("t_statistic"), F.col("degrees")))
        out = out.withColumn("significant", F.col("p_value") < 0.05).withColumn("highly_significant", F.col("p_value") < 0.01)
    return out


def method_pairs(df: DataFrame, method: str = "method") -> DataFrame:
    """Unordered pairs of the (few) distinct methods."""
    m = materialize(df.select(method).distinct())
    a, b = m.select(F.col(method).alias("method1")), m.select(F.col(method).alias("method2"))
    return a.join(b, F.col("method1") < F.col("method2"))


def pairwise_t(rewards: DataFrame, method: str = "method", value: str = "reward", with_p: bool = False) -> DataFrame:
    """Two-sample t tests with pooled variance for all method pairs; needs two values on both sides."""
    m = materialize(rewards.groupBy(method).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")))
    side = lambda k: m.select(F.col(method).alias(f"method{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("n", "mean", "var")])
    j = side(1).join(side(2), F.col("method1") < F.col("method2")).filter("n1 > 1 AND n2 > 1")
    df = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / df
    t = (F.col("mean1") - F.col("mean2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    out = j.select("method1", "method2", t.alias("t_statistic"), df.alias("degrees"))
    return out.withColumn("p_value", t_p_value(F.col("t_statistic"), F.col("degrees"))) if with_p else out


def mann_whitney(rewards: DataFrame, method: str = "method", value: str = "reward", with_p: bool = False) -> DataFrame:
    """U of the first method for all pairs, with tie-corrected z and (optionally) significance 1 - p.

    Rewards are reduced to counts per (pair, value) first; U needs only the running count of the second method.
    """
    pairs = method_pairs(rewards, method)
    sides = pairs.select(F.col("method1").alias("_m"), "*").unionByName(pairs.select(F.col("method2").alias("_m"), "*"))
    counted = rewards.groupBy(F.col(method).alias("_m"), value).agg(F.count(F.lit(1)).alias("_c"))
    j = counted.join(sides, "_m")
    v = j.groupBy("method1", "method2", value).agg(F.sum(F.when(F.col("_m") == F.col("method1"), F.col("_c")).otherwise(0)).alias("a"),
                                                   F.sum(F.when(F.col("_m") == F.col("method2"), F.col("_c")).otherwise(0)).alias("b"))
    keys = ["method1", "method2"]
    r = running(v, keys, [value], {"_cb": ("sum", "b")})
    tie = F.col("a") + F.col("b")
    s = r.groupBy(*keys).agg(F.sum(F.col("a") * (F.col("_cb") - F.col("b") / 2.0)).alias("u_statistic"), F.sum("a").alias("n1"), F.sum("b").alias("n2"),
                             F.sum((tie * tie * tie - tie).cast("double")).alias("_ties"))
    n = F.col("n1") + F.col("n2")
    var = F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("_ties") / (n * (n - 1)))
    dev = F.abs(F.col("u_statistic") - F.col("n1") * F.col("n2") / 2.0) - 0.5
    out = s.withColumn("z", F.when(var > 0, F.greatest(dev, F.lit(0.0)) / F.sqrt(var)).otherwise(0.0)).drop("_ties")
    return out.withColumn("significance", 1 - normal_p_value(F.col("z"))) if with_p else out


def compare_methods(runs: DataFrame) -> DataFrame:
    """Per method best reward, convergence and speed, with the overall bests alongside."""
    m = runs.groupBy("method").agg(F.max("best_reward").alias("best_reward"), F.min("convergence_episode").alias("convergence_episode"),
                                   F.max(F.col("convergence_achieved").cast("int")).cast("boolean").alias("convergence_achieved"), F.avg("seconds").alias("seconds"))
    out = with_globals(materialize(m), F.max("best_reward").alias("best_overall"), F.min("best_reward").alias("worst_overall"),
                       F.avg(F.col("convergence_achieved").cast("double")).alias("convergence_rate"), F.avg("convergence_episode").alias("avg_episodes_to_convergence"),
                       F.min_by("method", F.struct("seconds", "method")).alias("fastest_method"), F.min("seconds").alias("_fast"))
    return (out.withColumn("reward_range", F.col("best_overall") - F.col("worst_overall"))
            .withColumn("speedup", F.when(F.col("seconds") > 0, F.col("_fast") / F.col("seconds")).otherwise(F.lit(float("inf")))).drop("_fast"))


def _small_rank(df: DataFrame, order: Sequence[Column], name: str, keys: Sequence[str] = ()) -> DataFrame:
    return row_numbers(df, list(keys), list(order), name)


def reward_ranking(methods: DataFrame) -> DataFrame:
    """Rank by reward, and by convergence episode among the converged."""
    r = _small_rank(methods, [F.col("best_reward").desc(), F.col("method")], "reward_rank").select("method", "reward_rank")
    c = _small_rank(methods.filter("convergence_achieved"), [F.col("convergence_episode"), F.col("method")], "convergence_rank").select("method", "convergence_rank")
    return r.join(c, "method", "left")


def best_per_grid(runs: DataFrame, order: str = "method") -> DataFrame:
    """Run with the largest reward per grid (null counts 0); first method in order wins ties."""
    reward = F.coalesce("best_reward", F.lit(0.0))
    best = runs.groupBy("grid_id").agg(F.min_by(F.struct(*[c for c in runs.columns if c != "grid_id"]), F.struct(-reward, F.col(order))).alias("_r"))
    return best.select("grid_id", "_r.*")


HIGHER_IS_BETTER = ("avg_charger_utilization_pct",)
LOWER_IS_BETTER = ("avg_detour_time_min", "pct_unserved_demand", "avg_queueing_time_min", "total_energy_consumed_kwh", "gini_coefficient_service")


def metric_ranking(kpis: DataFrame, strategy: str, metrics: Sequence[str]) -> DataFrame:
    """Rank of every strategy per metric; metrics without a listed direction rank high values first."""
    long = kpis.unpivot([strategy], [*metrics], "metric", "value")
    signed = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("value")).otherwise(-F.col("value"))
    return _small_rank(long.withColumn("_s", signed), [F.col("_s"), F.col(strategy)], "rank", ["metric"]).drop("_s")


def overall_winner(ranking: DataFrame, strategy: str) -> DataFrame:
    wins = ranking.filter("rank = 1").groupBy(strategy).agg(F.count(F.lit(1)).alias("wins"))
    return wins.orderBy(F.col("wins").desc(), strategy).limit(1)


def best_by_type(methods: DataFrame) -> DataFrame:
    """Best hybrid by reward, best baseline by edge coverage."""
    h = methods.filter(is_hybrid()).agg(F.lit("hybrid").alias("kind"), F.min_by("method", F.struct(-F.col("best_reward"), F.col("method"))).alias("method"), F.max("best_reward").alias("score"))
    b = methods.filter(~is_hybrid()).agg(F.lit("baseline").alias("kind"), F.min_by("method", F.struct(-F.col("edge_coverage"), F.col("method"))).alias("method"), F.max("edge_coverage").alias("score"))
    return h.unionByName(b)


def policy_summary(runs: DataFrame) -> DataFrame:
    """Mean of the best rewards per grid with its rating, best method by mean reward, findings text."""
    best = best_per_grid(runs).agg(F.avg("best_reward").alias("overall_score"), F.count(F.lit(1)).alias("grids_optimized"))
    means = runs.groupBy("method").agg(F.avg("best_reward").alias("m"), F.stddev_pop("best_reward").alias("s"), F.count(F.lit(1)).alias("n"))
    top = means.agg(F.min_by(F.struct("method", "m", "s", "n"), F.struct(-F.col("m"), F.col("method"))).alias("t"))
    j = best.crossJoin(F.broadcast(top))
    s = F.col("overall_score")
    label = F.initcap(F.replace(F.replace(F.col("t.method"), F.lit("_"), F.lit(" ")), F.lit("hybrid "), F.lit("")))
    text = F.concat_ws("; ", F.concat(rating(s), F.lit(" placement quality")), F.concat(F.col("grids_optimized").cast("string"), F.lit(" grids optimized")),
                       F.concat(F.lit("recommended method: "), label))
    return j.select("overall_score", "grids_optimized", rating(s).alias("rating"), F.col("t.method").alias("best_method"), F.col("t.m").alias("best_method_score"),
                    F.when(F.col("t.n") > 1, 1 - F.col("t.s")).otherwise(1.0).alias("consistency"), text.alias("findings"))


def candidate_usage(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("method").agg(F.count(F.lit(1)).alias("uses"))


def run_outcomes(results: DataFrame) -> DataFrame:
    """Success and failure counts per method (``error`` null means success)."""
    return results.groupBy("method").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("error").isNull()).alias("successes"),
                                         F.count_if(F.col("error").isNotNull()).alias("failures"))


def run_summary(results: DataFrame) -> DataFrame:
    """Counts by status and type with mean reward, and a one-line report per type."""
    kind = F.when(is_hybrid(), "hybrid").otherwise("baseline")
    g = results.withColumn("kind", kind).groupBy("kind").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("error").isNull()).alias("successes"),
        F.avg(F.when(F.col("error").isNull(), F.col("best_reward"))).alias("mean_reward"), F.avg("diversity").alias("mean_diversity"))
    return g.withColumn("report", F.concat(F.col("kind"), F.lit(": "), F.col("successes").cast("string"), F.lit("/"), F.col("runs").cast("string"), F.lit(" runs succeeded")))


# Bounds of valid metrics (fixed values).
METRIC_RULES = {"best_reward": (0.0, 1.0), "average_reward": (0.0, 1.0), "exploration_efficiency": (0.0, 1.0), "convergence_rate": (0.0, 1.0), "total_episodes": (1.0, 1e9)}


def metric_violations(runs: DataFrame, rules: Mapping[str, tuple[float, float]] = METRIC_RULES) -> DataFrame:
    """Null and out-of-range counts per method and metric."""
    aggs = []
    for c, (lo, hi) in rules.items():
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"), F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"{c}_out_of_range")]
    return runs.groupBy("method").agg(*aggs)


def regret_summary(episodes: DataFrame) -> DataFrame:
    """Per method: final, mean, max, min and variance of the cumulative regret of its curve over all runs."""
    c = regret_curve(episodes)
    return c.groupBy("method").agg(F.max_by("cumulative_regret", F.struct("rn", "episode")).alias("final_regret"), F.avg("cumulative_regret").alias("avg_regret"),
                                   F.max("cumulative_regret").alias("max_regret"), F.min("cumulative_regret").alias("min_regret"),
                                   F.var_pop("cumulative_regret").alias("regret_variance"), F.count(F.lit(1)).alias("episodes"))


def resume(wanted: DataFrame, checkpoints: DataFrame, config: Sequence[str]) -> DataFrame:
    """Grids still to run: no checkpoint with the same configuration."""
    return wanted.join(checkpoints, ["grid_id", *config], "left_anti")
