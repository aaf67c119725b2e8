"""Run logs, bandit statistics, placement scores and comparisons."""

from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.functions.hashing import ord_sum
from voltgrid.functions.seeds import deterministic_seed
from voltgrid.operators import bandits, placements as pl, runs
from voltgrid.plans.catalog.demand import r6, rnd
from voltgrid.plans.catalog.events import KPIS, kpis
from voltgrid.plans.catalog.features import rs
from voltgrid.plans.catalog.trajectories import BOX, edges, pts
from voltgrid.plans.registry import query, view

R = "grid_id, method"
_W = "PARTITION BY grid_id, method ORDER BY episode"
view("v_num", f"SELECT *, row_number() OVER ({_W}) AS rn FROM fx_episodes")


def ep(t):
    return t.fx("episodes")


view("v_regret", f"""SELECT grid_id, method, episode, rn, best - reward AS regret, sum(best - reward) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS cumulative_regret
 FROM (SELECT *, max(reward) OVER (PARTITION BY grid_id, method) AS best FROM v_num) q""")


@query("win10_regret_curve", f"SELECT {R}, episode, round(regret, 6) AS regret, round(cumulative_regret, 5) AS cumulative_regret, round(cumulative_regret / rn, 6) AS average_regret FROM v_regret")
def _(t):
    return runs.regret_curve(ep(t)).select("grid_id", "method", "episode", *r6("regret"), rnd("cumulative_regret", 5).alias("cumulative_regret"),
                                              rnd("average_regret", 6).alias("average_regret"))


@query("win11_best_so_far", f"SELECT {R}, episode, round(max(reward) OVER ({_W} ROWS UNBOUNDED PRECEDING), 6) AS best_reward FROM fx_episodes")
def _(t):
    return runs.best_so_far(ep(t)).select("grid_id", "method", "episode", *r6("best_reward"))


@query("win12_early_stop", f"""SELECT {R}, episode, rn >= 8 AND recent < 0.8 * overall AS stop FROM (SELECT *, avg(reward) OVER ({_W} ROWS 7 PRECEDING) AS recent,
 avg(reward) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS overall FROM v_num) q""")
def _(t):
    return runs.early_stop(ep(t), 8).select("grid_id", "method", "episode", "stop")


view("v_conv", f"SELECT *, rn >= 10 AND var_pop(reward) OVER ({_W} ROWS 4 PRECEDING) < 0.01 AS converged FROM v_num")


@query("win13_convergence", f"SELECT {R}, episode, converged FROM v_conv")
def _(t):
    return runs.convergence(ep(t)).select("grid_id", "method", "episode", "converged")


view("v_runs", f"""SELECT {R}, count(*) AS total_episodes, max(reward) AS best_reward, arg_max(reward, episode) AS final_reward, avg(reward) AS average_reward, stddev_pop(reward) AS reward_std,
 count(DISTINCT arm) AS action_diversity, min(rn) FILTER (converged) AS convergence_episode, min(rn) FILTER (converged) IS NOT NULL AS convergence_achieved,
 avg(reward) FILTER (rn <= floor(n / 2)) AS early_average, avg(reward) FILTER (rn > floor(n / 2)) AS late_average, max(reward) * count(*) - sum(reward) AS cumulative_regret,
 (max(reward) * count(*) - sum(reward)) / count(*) AS average_regret, count(DISTINCT arm) / count(*) AS exploration_efficiency, max(reward) / count(*) AS sample_efficiency,
 CASE WHEN max(reward) > 0 AND avg(reward) > 0 THEN least(1, avg(reward) / max(reward)) ELSE 0 END AS convergence_rate
 FROM (SELECT *, count(*) OVER (PARTITION BY grid_id, method) AS n FROM v_conv) q GROUP BY 1, 2""")


def run_table(t):
    return materialize(runs.run_table(ep(t)))


_RUNS = ("best_reward", "final_reward", "average_reward", "reward_std", "cumulative_regret", "average_regret", "exploration_efficiency")


@query("agg56_optimisation_metrics", f"SELECT {R}, total_episodes, action_diversity, convergence_episode, {rs(*_RUNS)} FROM v_runs")
def _(t):
    return runs.run_table(ep(t)).select("grid_id", "method", "total_episodes", "action_diversity", "convergence_episode", *r6(*_RUNS))


_BM = ("best_reward", "average_reward", "convergence_rate", "sample_efficiency", "cumulative_regret", "average_regret", "exploration_efficiency", "regret_bound")
_HY = "contains(method, 'hybrid')"


@query("agg55_bandit_metrics", f"""SELECT {R}, {_HY} AS is_bandit_method, CASE WHEN {_HY} THEN total_episodes ELSE 0 END AS total_episodes, {', '.join(
    f'round(CASE WHEN {_HY} THEN {c} ELSE 0 END, 6) AS {c}' for c in _BM[:6])}, round(CASE WHEN {_HY} THEN best_reward / total_episodes ELSE 0 END, 6) AS exploration_efficiency,
 round(CASE WHEN contains(method, 'ucb') AND total_episodes > 1 THEN 8 * sqrt(3 * total_episodes * ln(total_episodes)) ELSE 0 END, 6) AS regret_bound FROM v_runs""")
def _(t):
    return runs.bandit_metrics(run_table(t)).select("grid_id", "method", "is_bandit_method", "total_episodes", *r6(*_BM))


view("v_alloc_n", "SELECT grid_id, count(*) AS stations FROM fx_placements GROUP BY 1")


@query("prj36_adaptive_budget", """SELECT grid_id, stations, CAST(space AS BIGINT) AS action_space_size, m AS max_episodes, greatest(50, CAST(floor(round(m * 0.3, 9)) AS BIGINT)) AS min_episodes,
 CAST(floor(round(m * 0.4, 9)) AS BIGINT) AS exploration_episodes, greatest(20, CAST(floor(round(m * 0.15, 9)) AS BIGINT)) AS early_stopping_patience,
 round(greatest(0.9, least(0.99, 0.95 + (stations - 2) * 0.02)), 6) AS confidence_threshold FROM (SELECT *, CAST(floor(round(1000 * 4 * (1 + (stations - 2) * 0.3), 9)) AS BIGINT) AS m FROM
 (SELECT grid_id, stations, least(pow(75e0, stations), 10000) AS space FROM v_alloc_n WHERE stations > 2) a) b""")
def _(t):
    a = t.fx("placements").groupBy("grid_id").agg(F.count(F.lit(1)).alias("stations")).filter("stations > 2")
    return runs.adaptive_budget(a).select("grid_id", "stations", "action_space_size", "max_episodes", "min_episodes", "exploration_episodes",
                                          "early_stopping_patience", *r6("confidence_threshold"))


@query("prj37_sampled_budget", """SELECT id, n, CAST(space AS BIGINT) AS action_space, greatest(200, least(CAST(floor(round(space * 0.2, 9)) AS BIGINT) * 4, 800)) AS episodes FROM
 (SELECT s_suppkey AS id, s_suppkey % 4 + 1 AS n, least(round(CASE s_suppkey % 4 + 1 WHEN 1 THEN 60e0 WHEN 2 THEN 120e0 * 119 / 2 ELSE 2000e0 END), 2000) AS space FROM supplier) q""")
def _(t):
    a = t.raw("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4 + 1).alias("n"))
    return runs.sampled_budget(a, "n").select("id", "n", "action_space", "episodes")


@query("prj34_deterministic_seed", """SELECT grid_id, episode, CAST((42 + list_sum(list_transform(str_split(grid_id, ''), lambda c: ascii(c))) % 100000 + 10000 * episode) % 2147483647 AS BIGINT) AS seed FROM fx_episodes""")
def _(t):
    return ep(t).select("grid_id", "episode", deterministic_seed(42, F.col("grid_id"), F.col("episode")).alias("seed"))


@query("prj38_rating_buckets", f"""SELECT {R}, CASE WHEN best_reward > 0.7 THEN 'Excellent' WHEN best_reward > 0.5 THEN 'Good' ELSE 'Fair' END AS rating, CASE WHEN average_reward >= 0.8 THEN 'excellent'
 WHEN average_reward >= 0.6 THEN 'good' WHEN average_reward >= 0.4 THEN 'moderate' WHEN average_reward >= 0.2 THEN 'weak' ELSE 'poor' END AS assessment FROM v_runs""")
def _(t):
    return run_table(t).select("grid_id", "method", runs.rating(F.col("best_reward")).alias("rating"), runs.assessment(F.col("average_reward")).alias("assessment"))


_MOM = ("reward_mean", "reward_std", "reward_min", "reward_max", "reward_skewness", "reward_kurtosis", "reward_q25", "reward_median", "reward_q75")
_SK = "(sum(pow((reward - m) / s, 3)) / count(*))"


@query("agg38_reward_moments", """SELECT method, count(*) AS n, round(avg(reward), 6) AS reward_mean, round(stddev_pop(reward), 6) AS reward_std, round(min(reward), 6) AS reward_min, round(max(reward), 6) AS reward_max,
 round(avg(pow((reward - m) / s, 3)), 6) AS reward_skewness, round(avg(pow((reward - m) / s, 4)) - 3, 6) AS reward_kurtosis, round(quantile_cont(reward, 0.25), 6) AS reward_q25,
 round(quantile_cont(reward, 0.5), 6) AS reward_median, round(quantile_cont(reward, 0.75), 6) AS reward_q75 FROM (SELECT *, avg(reward) OVER (PARTITION BY method) AS m, stddev_pop(reward) OVER (PARTITION BY method) AS s FROM fx_episodes) q GROUP BY 1""")
def _(t):
    return runs.reward_moments(ep(t), ["method"]).select("method", "n", *r6(*_MOM))


@query("agg39_method_performance", """SELECT method, round(avg(best_reward), 6) AS mean_reward, round(stddev_pop(best_reward), 6) AS std_reward, round(min(best_reward), 6) AS min_reward, round(max(best_reward), 6) AS max_reward,
 count(*) AS runs, round(avg(total_episodes), 6) AS mean_episodes, CAST(sum(total_episodes) AS BIGINT) AS total_episodes, round(avg(CAST(convergence_achieved AS INT)), 6) AS convergence_rate FROM v_runs GROUP BY ROLLUP(method)""")
def _(t):
    return runs.method_performance(run_table(t)).select("method", *r6("mean_reward", "std_reward", "min_reward", "max_reward"), "runs", *r6("mean_episodes"), "total_episodes", *r6("convergence_rate"))


view("v_sim", f"""SELECT *, CASE WHEN total_episodes % 3 = 0 THEN 0 ELSE average_reward END AS simulation_reward, average_reward > 0.3 AS simulation_success, CAST(total_episodes % 13 AS INT) AS charging_events,
 CAST(total_episodes % 150 AS INT) AS battery_data_points, average_reward AS mean_final_soc, CASE WHEN total_episodes % 2 = 0 THEN 0 ELSE reward_std END AS network_utilization, reward_std AS charging_efficiency,
 late_average AS battery_management, early_average AS traffic_impact, total_episodes * 0.5e0 AS execution_time FROM v_runs""")


def simulated(t):
    n, avg, std = F.col("total_episodes"), F.col("average_reward"), F.col("reward_std")
    return materialize(run_table(t).withColumns({
        "simulation_reward": F.when(n % 3 == 0, 0.0).otherwise(avg), "simulation_success": avg > 0.3, "charging_events": (n % 13).cast("int"),
        "battery_data_points": (n % 150).cast("int"), "mean_final_soc": avg, "network_utilization": F.when(n % 2 == 0, 0.0).otherwise(std),
        "charging_efficiency": std, "battery_management": F.col("late_average"), "traffic_impact": F.col("early_average"), "execution_time": n * 0.5}))


@query("agg40_city_metrics", """SELECT count(DISTINCT grid_id) AS total_grids, round(avg(nullif(best_reward, 0)), 6) AS mean_reward, round(stddev_pop(nullif(best_reward, 0)), 6) AS std_reward,
 round(avg(nullif(simulation_reward, 0)), 6) AS mean_simulation_reward, round(stddev_pop(nullif(simulation_reward, 0)), 6) AS std_simulation_reward FROM v_sim""")
def _(t):
    return runs.city_metrics(simulated(t)).select("total_grids", *r6("mean_reward", "std_reward", "mean_simulation_reward", "std_simulation_reward"))


_MEAS = {"best_reward": "reward", "total_episodes": "episodes", "convergence_rate": "convergence", "average_reward": "average", "reward_std": "spread", "simulation_reward": "simulation",
         "exploration_efficiency": "exploration", "cumulative_regret": "regret", "late_average": "late", "early_average": "early"}


@query("agg42_cross_grid_deviation", "SELECT method, count(*) AS total_grids_tested, round(avg(CAST(convergence_achieved AS INT)), 6) AS success_rate, " + ", ".join(
    f"round(avg({c}), 6) AS mean_{n}, round(stddev_pop({c}), 6) AS std_{n}, round(min({c}), 6) AS min_{n}, round(max({c}), 6) AS max_{n}, round(CASE WHEN avg({c}) > 0 THEN stddev_pop({c}) / avg({c}) ELSE 0 END, 6) AS {n}_cv" for c, n in _MEAS.items())
    + ", round(quantile_cont(best_reward, 0.5), 6) AS median_reward, round(1 - least(1, stddev_pop(best_reward) / avg(best_reward)), 6) AS reward_consistency FROM v_sim GROUP BY 1")
def _(t):
    d = runs.cross_grid(simulated(t), _MEAS)
    return d.select("method", "total_grids_tested", *r6(*[c for c in d.columns if c not in ("method", "total_grids_tested")]))


@query("agg42_grid_variability", "SELECT grid_id, round(var_pop(best_reward), 6) AS reward_variance, round(stddev_pop(best_reward), 6) AS reward_std, round(max(best_reward) - min(best_reward), 6) AS reward_range, count(*) AS method_count FROM v_runs GROUP BY 1")
def _(t):
    return runs.grid_variability(run_table(t)).select("grid_id", *r6("reward_variance", "reward_std", "reward_range"), "method_count")


@query("agg43_cross_grid_simple", """SELECT method, count(*) AS total_grids_tested, round(avg(best_reward), 6) AS mean_reward, round(stddev_pop(best_reward), 6) AS std_reward, round(avg(total_episodes), 6) AS mean_episodes,
 round(avg(convergence_rate), 6) AS mean_convergence, round(avg(CAST(convergence_achieved AS INT)), 6) AS success_rate FROM v_runs GROUP BY 1""")
def _(t):
    d = runs.cross_grid(run_table(t), {"best_reward": "reward", "total_episodes": "episodes", "convergence_rate": "convergence"})
    return d.select("method", "total_grids_tested", *r6("mean_reward", "std_reward", "mean_episodes", "mean_convergence", "success_rate"))


_HVB = ("hybrid_mean_reward", "hybrid_std_reward", "baseline_mean_reward", "baseline_std_reward", "performance_improvement", "t_statistic", "effect_size")


@query("agg44_hybrid_vs_baseline", f"""SELECT {rs(*_HVB)}, degrees FROM (SELECT hm AS hybrid_mean_reward, hs AS hybrid_std_reward, bm AS baseline_mean_reward, bs AS baseline_std_reward, (hm - bm) / bm AS performance_improvement,
 (hm - bm) / sqrt(((hn - 1) * hv + (bn - 1) * bv) / (hn + bn - 2) * (1 / hn + 1 / bn)) AS t_statistic, (hm - bm) / sqrt((hs * hs + bs * bs) / 2) AS effect_size, hn + bn - 2 AS degrees FROM (SELECT
 count(*) FILTER ({_HY}) AS hn, avg(average_reward) FILTER ({_HY}) AS hm, stddev_pop(average_reward) FILTER ({_HY}) AS hs, var_samp(average_reward) FILTER ({_HY}) AS hv,
 count(*) FILTER (NOT {_HY}) AS bn, avg(average_reward) FILTER (NOT {_HY}) AS bm, stddev_pop(average_reward) FILTER (NOT {_HY}) AS bs, var_samp(average_reward) FILTER (NOT {_HY}) AS bv FROM v_runs) a) b""")
def _(t):
    r = run_table(t).withColumn("best_reward", F.col("average_reward"))
    return runs.hybrid_vs_baseline(r).select(*r6(*_HVB), "degrees")


@query("agg44_hybrid_vs_baseline_p")
def _(t):
    return runs.hybrid_vs_baseline(run_table(t).withColumn("best_reward", F.col("average_reward")), with_p=True)


view("v_mm", "SELECT method, count(*) AS n, avg(reward) AS m, var_samp(reward) AS v FROM fx_episodes GROUP BY 1")


@query("agg45_pairwise_t", """SELECT a.method AS method1, b.method AS method2, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)), 6) AS t_statistic, a.n + b.n - 2 AS degrees
 FROM v_mm a JOIN v_mm b ON a.method < b.method""")
def _(t):
    return runs.pairwise_t(ep(t)).select("method1", "method2", *r6("t_statistic"), "degrees")


@query("jon23_method_pairs", "SELECT a.method AS method1, b.method AS method2, round(a.m - b.m, 6) AS gap FROM v_mm a JOIN v_mm b ON a.method < b.method")
def _(t):
    m = materialize(ep(t).groupBy("method").agg(F.avg("reward").alias("m")))
    p = runs.method_pairs(m)
    a, b = m.select(F.col("method").alias("method1"), F.col("m").alias("a")), m.select(F.col("method").alias("method2"), F.col("m").alias("b"))
    return p.join(a, "method1").join(b, "method2").select("method1", "method2", rnd(F.col("a") - F.col("b"), 6).alias("gap"))


@query("agg45_mann_whitney", """SELECT method1, method2, count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n2, round(sum(r) FILTER (one) - count(*) FILTER (one) * (count(*) FILTER (one) + 1) / 2, 3) AS u_statistic FROM (SELECT method1, method2, one,
 rank() OVER (PARTITION BY method1, method2 ORDER BY reward) + (count(*) OVER (PARTITION BY method1, method2, reward) - 1) / 2 AS r FROM (SELECT a.method AS method1, b.method AS method2, e.method = a.method AS one, e.reward FROM v_mm a JOIN v_mm b ON a.method < b.method
 JOIN fx_episodes e ON e.method IN (a.method, b.method)) x) y GROUP BY 1, 2""")
def _(t):
    return runs.mann_whitney(ep(t)).select("method1", "method2", "n1", "n2", rnd("u_statistic", 3).alias("u_statistic"))


@query("agg45_significance")
def _(t):
    return runs.pairwise_t(ep(t), with_p=True).join(runs.mann_whitney(ep(t), with_p=True), ["method1", "method2"])


view("v_m", """SELECT method, max(best_reward) AS best_reward, min(convergence_episode) AS convergence_episode, bool_or(convergence_achieved) AS convergence_achieved, avg(execution_time) AS seconds FROM v_sim GROUP BY 1""")


def methods(t):
    return runs.compare_methods(simulated(t).withColumn("seconds", F.col("execution_time")))


@query("agg37_compare_methods", """SELECT method, convergence_episode, (SELECT arg_min(method, (seconds, method)) FROM v_m) AS fastest_method, round((SELECT min(seconds) FROM v_m) / seconds, 6) AS speedup,
 round((SELECT max(best_reward) - min(best_reward) FROM v_m), 6) AS reward_range, round((SELECT avg(convergence_episode) FROM v_m), 6) AS avg_episodes_to_convergence FROM v_m""")
def _(t):
    return methods(t).select("method", "convergence_episode", "fastest_method", *r6("speedup", "reward_range", "avg_episodes_to_convergence"))


@query("rnk07_reward_ranking", """SELECT m.method, row_number() OVER (ORDER BY best_reward DESC, m.method) AS reward_rank, c.k AS convergence_rank FROM v_m m LEFT JOIN
 (SELECT method, row_number() OVER (ORDER BY convergence_episode, method) AS k FROM v_m WHERE convergence_achieved) c ON c.method = m.method""")
def _(t):
    return runs.reward_ranking(methods(t))


@query("rnk02_best_per_grid", "SELECT grid_id, method, round(best_reward, 6) AS best_reward FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY coalesce(best_reward, 0) DESC, method) AS k FROM v_runs) q WHERE k = 1")
def _(t):
    return runs.best_per_grid(run_table(t)).select("grid_id", "method", *r6("best_reward"))


_LONGK = " UNION ALL ".join(f"SELECT episode, '{k}' AS metric, {k} AS value, {'1' if k in runs.LOWER_IS_BETTER else '-1'} * {k} AS s FROM v_kpi" for k in KPIS)
view("v_rank", f"SELECT episode, metric, row_number() OVER (PARTITION BY metric ORDER BY round(s, 9), episode) AS rank FROM ({_LONGK}) q")


def ranking(t):
    k = materialize(kpis(t)).select("episode", *[rnd(c, 9).alias(c) for c in KPIS])
    return runs.metric_ranking(k, "episode", KPIS)


@query("rnk01_metric_ranking", "SELECT episode, metric, rank FROM v_rank")
def _(t):
    return ranking(t).select("episode", "metric", "rank")


@query("rnk03_overall_winner", "SELECT episode, count(*) AS wins FROM v_rank WHERE rank = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(t):
    return runs.overall_winner(ranking(t), "episode")


@query("agg58_policy_summary", """SELECT round((SELECT avg(b) FROM (SELECT max(best_reward) AS b FROM v_runs GROUP BY grid_id) x), 6) AS overall_score, (SELECT count(DISTINCT grid_id) FROM v_runs) AS grids_optimized,
 method AS best_method, round(m, 6) AS best_method_score, round(1 - s, 6) AS consistency FROM (SELECT method, avg(best_reward) AS m, stddev_pop(best_reward) AS s FROM v_runs GROUP BY 1) q ORDER BY m DESC, method LIMIT 1""")
def _(t):
    return runs.policy_summary(run_table(t)).select(*r6("overall_score"), "grids_optimized", "best_method", *r6("best_method_score", "consistency"))


@query("agg61_candidate_usage", "SELECT method, count(*) AS uses FROM fx_episodes GROUP BY 1")
def _(t):
    return runs.candidate_usage(ep(t))


def outcomes(t):
    return run_table(t).withColumn("error", F.when(F.col("total_episodes") % 5 == 0, "timeout")).withColumn("diversity", F.col("exploration_efficiency"))


view("v_out", "SELECT *, CASE WHEN total_episodes % 5 = 0 THEN 'timeout' END AS error FROM v_runs")


@query("agg57_run_outcomes", "SELECT method, count(*) AS runs, count(*) FILTER (error IS NULL) AS successes, count(error) AS failures FROM v_out GROUP BY 1")
def _(t):
    return runs.run_outcomes(outcomes(t))


@query("agg65_run_summary", f"""SELECT CASE WHEN {_HY} THEN 'hybrid' ELSE 'baseline' END AS kind, count(*) AS runs, count(*) FILTER (error IS NULL) AS successes, round(avg(best_reward) FILTER (error IS NULL), 6) AS mean_reward,
 round(avg(exploration_efficiency), 6) AS mean_diversity FROM v_out GROUP BY 1""")
def _(t):
    return runs.run_summary(outcomes(t)).select("kind", "runs", "successes", *r6("mean_reward", "mean_diversity"))


@query("agg63_metric_violations", "SELECT method, " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}_nulls, count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS {c}_out_of_range" for c, (lo, hi) in {**runs.METRIC_RULES, "cumulative_regret": (0.0, 20.0)}.items()) + " FROM v_runs GROUP BY 1")
def _(t):
    return runs.metric_violations(run_table(t), {**runs.METRIC_RULES, "cumulative_regret": (0.0, 20.0)})


@query("agg64_regret_summary", """SELECT method, round(arg_max(cumulative_regret, (rn, episode)), 5) AS final_regret, round(avg(cumulative_regret), 5) AS avg_regret, round(max(cumulative_regret), 5) AS max_regret, round(min(cumulative_regret), 5) AS min_regret,
 round(var_pop(cumulative_regret), 5) AS regret_variance, count(*) AS episodes FROM v_regret GROUP BY 1""")
def _(t):
    return runs.regret_summary(ep(t)).select("method", *[rnd(c, 5).alias(c) for c in ("final_regret", "avg_regret", "max_regret", "min_regret", "regret_variance")], "episodes")


@query("jon19_resume", "SELECT DISTINCT grid_id, method FROM v_runs WHERE (grid_id, method) NOT IN (SELECT (grid_id, method) FROM v_runs WHERE convergence_achieved)")
def _(t):
    r = run_table(t)
    return runs.resume(r.select("grid_id", "method"), r.filter("convergence_achieved").select("grid_id", "method"), ["method"])


# --- bandits ------------------------------------------------------------------------------------------------
view("v_arm", f"SELECT {R}, arm, count(*) AS pulls, sum(reward) AS total_reward, avg(reward) AS mean_reward, coalesce(stddev_samp(reward), 0) AS std FROM fx_episodes GROUP BY 1, 2, 3")
view("v_margin", """SELECT *, CASE WHEN pulls = 1 THEN greatest(0.3, 0.5 - abs(mean_reward - 0.5)) WHEN pulls < 30 THEN CASE WHEN std < 1e-6 THEN 0.1 ELSE least(1, CASE WHEN pulls = 2 THEN 12.706 WHEN pulls <= 6 THEN 2.571 ELSE 2.262 END
 * std / sqrt(pulls) * (1 + 1 / pulls) * CASE WHEN abs(mean_reward) > 1e-6 THEN 1 / abs(mean_reward) ELSE 2 END) END ELSE least(1, 1.96 * std / sqrt(pulls) / CASE WHEN abs(mean_reward) > 1e-6 THEN abs(mean_reward) ELSE 1 END) END AS w FROM v_arm""")


def arms(t):
    return bandits.arm_statistics(ep(t))


@query("ban01_arm_statistics", f"SELECT {R}, arm, pulls, {rs('total_reward', 'mean_reward')} FROM v_arm")
def _(t):
    return arms(t).select("grid_id", "method", "arm", "pulls", *r6("total_reward", "mean_reward"))


@query("ban02_arm_intervals", f"SELECT {R}, arm, round(greatest(0, 0.5 - w / 2), 6) AS lower, round(least(1, 0.5 + w / 2), 6) AS upper FROM v_margin")
def _(t):
    return bandits.arm_intervals(arms(t)).select("grid_id", "method", "arm", *r6("lower", "upper"))


@query("ban03_best_arm", f"""SELECT {R}, arm, pulls, round(w, 6) AS width, pulls >= 10 AND w < 0.1 AS met, pulls >= 50 AND mean_reward <> 0 AND w / abs(mean_reward) < 0.05 AS strict_met
 FROM (SELECT *, row_number() OVER (PARTITION BY grid_id, method ORDER BY mean_reward DESC, arm) AS k FROM v_margin) q WHERE k = 1""")
def _(t):
    return bandits.threshold_met(arms(t)).select("grid_id", "method", "arm", "pulls", *r6("width"), "met", "strict_met")


@query("ban04_ucb_values", f"""SELECT {R}, arm, round(mean_reward + sqrt(2 * ln(n) / pulls), 6) AS ucb, round(sqrt(2 * ln(n) / pulls), 6) AS bonus, round(8 * sqrt(k * n * ln(n)), 4) AS regret_bound
 FROM (SELECT *, sum(pulls) OVER (PARTITION BY grid_id, method) AS n, count(*) OVER (PARTITION BY grid_id, method) AS k FROM v_arm) q""")
def _(t):
    return bandits.ucb_values(arms(t)).select("grid_id", "method", "arm", *r6("ucb", "bonus"), rnd("regret_bound", 4).alias("regret_bound"))


@query("ban08_beta_posterior", f"""SELECT {R}, arm, a AS alpha, b AS beta, round(a / (a + b), 6) AS mean, round(a * b / (pow(a + b, 2) * (a + b + 1)), 6) AS variance FROM
 (SELECT {R}, arm, count(*) FILTER (reward > 0.5) + 1 AS a, count(*) FILTER (NOT reward > 0.5) + 1 AS b FROM fx_episodes GROUP BY 1, 2, 3) q""")
def _(t):
    return bandits.beta_posterior(ep(t), 0.5).select("grid_id", "method", "arm", "alpha", "beta", *r6("mean", "variance"))


@query("ban08_beta_interval")
def _(t):
    return bandits.beta_interval(bandits.beta_posterior(ep(t), 0.5)).select("grid_id", "method", "arm", "lower", "upper")


view("v_armrun", f"""SELECT {R}, episode, arm, rn, count(*) OVER w AS n, avg(reward) OVER w AS m, coalesce(stddev_samp(reward) OVER w, 0) AS s FROM v_num WINDOW w AS (PARTITION BY grid_id, method, arm ORDER BY episode ROWS UNBOUNDED PRECEDING)""")


# Sums of every arm up to each episode, and the arm with the best mean so far.
view("v_armsofar", f"""SELECT {R}, episode, cand, n, s / n AS m, sqrt(greatest(q - n * (s / n) * (s / n), 0) / greatest(n - 1, 1)) AS s FROM
 (SELECT r.grid_id, r.method, r.episode, a.arm AS cand, sum(CASE WHEN r.arm = a.arm THEN 1e0 ELSE 0e0 END) OVER w AS n, sum(CASE WHEN r.arm = a.arm THEN reward ELSE 0e0 END) OVER w AS s,
 sum(CASE WHEN r.arm = a.arm THEN reward * reward ELSE 0e0 END) OVER w AS q FROM v_num r JOIN (SELECT DISTINCT {R}, arm FROM v_num) a ON a.grid_id = r.grid_id AND a.method = r.method
 WINDOW w AS (PARTITION BY r.grid_id, r.method, a.arm ORDER BY r.episode ROWS UNBOUNDED PRECEDING)) x WHERE n > 0""")
view("v_bestsofar", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {R}, episode ORDER BY m DESC, cand) AS k FROM v_armsofar) x WHERE k = 1")
_WIDTH = """CASE WHEN n = 1 THEN greatest(0.3, 0.5 - abs(m - 0.5)) WHEN n < 30 THEN CASE WHEN s < 1e-6 THEN 0.1
 ELSE least(1, CASE WHEN n = 2 THEN 12.706 WHEN n <= 6 THEN 2.571 ELSE 2.262 END * s / sqrt(n) * (1 + 1 / n) * CASE WHEN abs(m) > 1e-6 THEN 1 / abs(m) ELSE 2 END) END
 ELSE least(1, 1.96 * s / sqrt(n) / CASE WHEN abs(m) > 1e-6 THEN abs(m) ELSE 1 END) END"""


@query("ban09_confidence_trace", f"""SELECT o.grid_id, o.method, o.episode, arm, round(0.5 - w / 2, 6) AS confidence_lower, round(0.5 + w / 2, 6) AS confidence_upper, round(w, 6) AS confidence_width, round(b.top, 6) AS best_action_confidence,
 sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o.grid_id, o.method ORDER BY o.episode ROWS UNBOUNDED PRECEDING)::BIGINT AS action_diversity, round(sqrt(2 * ln(rn) / n), 6) AS exploration_bonus
 FROM (SELECT *, {_WIDTH} AS w FROM v_armrun) o JOIN (SELECT {R}, episode, {_WIDTH} AS top FROM v_bestsofar) b ON b.grid_id = o.grid_id AND b.method = o.method AND b.episode = o.episode""")
def _(t):
    return bandits.confidence_trace(ep(t)).select("grid_id", "method", "episode", "arm", *r6("confidence_lower", "confidence_upper", "confidence_width", "best_action_confidence"), "action_diversity", *r6("exploration_bonus"))



@query("ban05_ucb_replay")
def _(t):
    return bandits.replay(ep(t), ("hybrid_ucb",))


@query("ban06_epsilon_replay")
def _(t):
    return bandits.replay(ep(t), ("hybrid_epsilon",))


@query("ban07_thompson_replay")
def _(t):
    return bandits.replay(ep(t), ("hybrid_thompson",))


@query("ban10_policy_comparison")
def _(t):
    return bandits.policy_comparison(bandits.replay(ep(t), tuple(bandits.POLICIES)))


@query("ban11_proximity_score", """SELECT site_id, round(least(1 - (d - lo) / (hi - lo) + 0.1, 1), 6) AS proximity_score FROM (SELECT *, min(d) OVER () AS lo, max(d) OVER () AS hi FROM
 (SELECT site_id, min(sqrt(pow(s.lat - p.lat, 2) + pow(s.lon - p.lon, 2))) AS d FROM fx_sites s CROSS JOIN fx_points p GROUP BY 1) a) b""")
def _(t):
    s = t.fx("sites").withColumn("edge_id", F.concat(F.lit("e_"), F.col("site_id")))
    return bandits.proximity_score(s, t.fx("points"), "site_id").select("site_id", *r6("proximity_score"))


view("v_bar", f"""SELECT 'bandit_optimization' AS method, e.reward FROM fx_episodes e JOIN (SELECT grid_id, arm FROM (SELECT grid_id, arm, row_number() OVER (PARTITION BY grid_id ORDER BY avg(reward) DESC, arm) AS k FROM fx_episodes WHERE {_HY} GROUP BY 1, 2) q
 WHERE k = 1) b ON b.grid_id = e.grid_id AND b.arm = e.arm WHERE {_HY} UNION ALL SELECT method, reward FROM fx_episodes WHERE NOT {_HY}""")


@query("ban12_best_vs_heuristics", "SELECT method, count(*) AS n, round(avg(reward), 6) AS reward_mean, round(stddev_pop(reward), 6) AS reward_std, round(quantile_cont(reward, 0.5), 6) AS reward_median FROM v_bar GROUP BY 1")
def _(t):
    return runs.reward_moments(bandits.best_arm_rewards(ep(t)), ["method"]).select("method", "n", *r6("reward_mean", "reward_std", "reward_median"))


@query("ban13_best_episode", f"SELECT {R}, episode, arm, round(reward, 6) AS reward FROM (SELECT *, row_number() OVER (PARTITION BY grid_id, method ORDER BY reward DESC, episode) AS k FROM fx_episodes) q WHERE k = 1")
def _(t):
    return bandits.best_episode(ep(t)).select("grid_id", "method", "episode", "arm", *r6("reward"))


# --- placements ---------------------------------------------------------------------------------------------
_NAMES = {"m0": "hybrid_ucb", "m1": "hybrid_epsilon", "m2": "hybrid_thompson", "m3": "kmeans", "m4": "uniform"}
_MAP = "CASE method " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + " END"
view("v_place", f"SELECT grid_id, {_MAP} AS method, CASE WHEN edge_id = 'e_7' THEN NULL ELSE edge_id END AS edge_id, lat, lon, round(lat * 10000) AS k FROM fx_placements")


def place(t):
    p = t.fx("placements")
    return p.select("grid_id", F.expr(_MAP).alias("method"), F.when(F.col("edge_id") != "e_7", F.col("edge_id")).alias("edge_id"), "lat", "lon",
                    F.concat_ws("/", "edge_id", F.col("lat"), F.col("lon")).alias("station_id"))


_IB = "lat BETWEEN 42.23 AND 42.31 AND lon BETWEEN -83.79 AND -83.70"
view("v_set", f"""SELECT g.*, n AS num_placements, coalesce(ue, 0) AS unique_edges, ne / n AS edge_coverage, least(1, coalesce(ue, 0) / n) AS network_integration, CASE WHEN n > 1 THEN least(1, (sla + slo) / 0.02) ELSE 0 END AS spatial_diversity, ok / n AS grid_compliance,
 CASE WHEN n > 1 THEN least(1, rla * rlo / 0.0001) ELSE 0 END AS spatial_coverage, CASE WHEN coalesce(ue, 0) = 0 THEN 0 WHEN ue = 1 THEN 1 ELSE greatest(0, 1 - cv) END AS edge_distribution, least(1, coalesce(pd, 0) / 0.01) AS spatial_clustering,
 CASE WHEN n > 1 THEN least(1, 0.5 * rla / 0.1309 + 0.5 * rlo / 0.1337) ELSE 0 END AS range_diversity, CASE WHEN ne = 0 THEN 0 ELSE least(1, -(ne / n) * log2(ne / n)) END AS prefix_entropy, least(1, coalesce(ue, 0) / 1000) AS city_edge_coverage,
 least(1, coalesce(ue, 0) / 10) AS small_edge_coverage, CASE WHEN n > 1 THEN (vla + vlo) / 2 ELSE 0 END AS placement_variance, n AS valid_coordinates FROM (SELECT {R}, count(*) AS n, count(edge_id) AS ne, count(*) FILTER ({_IB}) AS ok, stddev_pop(lat) AS sla, stddev_pop(lon) AS slo,
 var_pop(lat) AS vla, var_pop(lon) AS vlo, max(lat) - min(lat) AS rla, max(lon) - min(lon) AS rlo FROM v_place GROUP BY 1, 2) g LEFT JOIN (SELECT grid_id AS g2, method AS m2, count(*) AS ue, stddev_pop(c) / avg(c) AS cv FROM (SELECT {R}, edge_id, count(*) AS c FROM v_place
 WHERE edge_id IS NOT NULL GROUP BY 1, 2, 3) e GROUP BY 1, 2) e ON g2 = grid_id AND m2 = method LEFT JOIN (SELECT a.grid_id AS g3, a.method AS m3, avg(sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2))) AS pd FROM (SELECT *, row_number() OVER () AS i FROM v_place) a JOIN
 (SELECT *, row_number() OVER () AS i FROM v_place) b ON a.grid_id = b.grid_id AND a.method = b.method AND (a.lat, a.lon) < (b.lat, b.lon) GROUP BY 1, 2) p ON g3 = grid_id AND m3 = method""")


def sets(t):
    return materialize(pl.set_metrics(place(t), BOX))


for _q, _c in (("agg46_placement_metrics", ("edge_coverage", "spatial_diversity", "grid_compliance", "network_integration")),
               ("agg47_placement_shape", ("spatial_coverage", "edge_distribution", "spatial_clustering", "network_integration")),
               ("agg49_engine_diversity", ("range_diversity", "prefix_entropy", "grid_compliance", "city_edge_coverage", "small_edge_coverage"))):
    @query(_q, f"SELECT {R}, num_placements, unique_edges, {rs(*_c)} FROM v_set")
    def _(t, cols=_c):
        return sets(t).select("grid_id", "method", "num_placements", "unique_edges", *r6(*cols))

view("v_q", """SELECT *, 0.4 * edge_coverage + 0.3 * spatial_diversity + 0.3 * grid_compliance AS placement_quality, least(1, CASE WHEN num_placements = 1 THEN 0.4 + 0.3 * edge_coverage + 0.3 * grid_compliance ELSE 0.5 * range_diversity + 0.3 * edge_distribution + 0.2 * grid_compliance END) AS engine_quality,
 CASE WHEN num_placements > 1 THEN (range_diversity + edge_distribution) / 2 ELSE 0 END AS engine_diversity, 0.30 * city_edge_coverage + 0.25 * spatial_diversity + 0.25 * grid_compliance + 0.10 * network_integration + 0.05 * edge_distribution + 0.05 * spatial_clustering AS fb FROM v_set""")


@query("agg48_placement_quality", f"SELECT {R}, {rs('placement_quality', 'engine_quality', 'engine_diversity')} FROM v_q")
def _(t):
    return pl.quality(sets(t)).select("grid_id", "method", *r6("placement_quality", "engine_quality", "engine_diversity"))


@query("agg50_fallback_reward", f"SELECT {R}, round(CASE WHEN city_edge_coverage > 0 AND fb < 0.1 THEN 0.05 + least(0.05, fb) ELSE least(1, fb) END, 6) AS fallback_reward FROM v_q")
def _(t):
    return pl.fallback_reward(sets(t)).select("grid_id", "method", *r6("fallback_reward"))


view("v_wide", "SELECT q.*, s.* EXCLUDE (grid_id, method) FROM v_q q JOIN v_sim s ON s.grid_id = q.grid_id AND s.method = q.method")


def wide(t):
    return pl.quality(sets(t)).join(simulated(t), runs.RUN)


view("v_res", f"""SELECT *, 0.40 * simulation_performance + 0.25 * placement_quality + 0.15 * charging_utilization + 0.10 * battery_score + 0.10 * network_score + CASE WHEN {_HY} THEN 0.15 * learning_capability + 0.10 * spatial_diversity ELSE 0 END AS overall_performance, spatial_diversity AS diversity_value FROM
 (SELECT *, CASE WHEN simulation_success AND simulation_reward > 0 THEN least(1, simulation_reward) WHEN simulation_success THEN 0.5 ELSE 0 END AS simulation_performance, CASE WHEN charging_events > 0 THEN least(1, charging_events / 10) ELSE 0 END AS charging_utilization,
 CASE WHEN battery_data_points > 0 THEN least(1, battery_data_points / 100 * mean_final_soc) ELSE 0 END AS battery_score, CASE WHEN network_utilization > 0 THEN least(1, network_utilization) ELSE edge_coverage END AS network_score,
 CASE WHEN simulation_success THEN 1 ELSE 0.5 END AS method_reliability, least(1, simulation_reward / total_episodes) AS computational_efficiency, CASE WHEN NOT {_HY} THEN 0 WHEN convergence_achieved AND total_episodes > 3 THEN least(1, simulation_reward)
 WHEN total_episodes > 5 AND late_average > early_average THEN least(0.5, 2 * (late_average - early_average)) ELSE 0 END AS learning_capability, 0.4 * CASE WHEN simulation_reward > 0 THEN least(1, simulation_reward) ELSE 0 END + 0.3 * CAST(simulation_success AS INT) + 0.1 * charging_efficiency
 + 0.1 * network_utilization + 0.05 * battery_management + 0.05 * greatest(0, 1 - traffic_impact) AS empirical_performance, 0.6 * CAST(simulation_success AS INT) + 0.4 * small_edge_coverage AS practical_applicability FROM v_wide) r""")


@query("agg51_research_set", f"SELECT {R}, {rs(*pl.RESEARCH)} FROM v_res")
def _(t):
    return pl.research_set(wide(t)).select("grid_id", "method", *r6(*pl.RESEARCH))


_EFF = ("placement_efficiency", "simulation_efficiency", "time_efficiency", "overall_efficiency", "placement_variance", "heuristic_reward_variance", "heuristic_confidence", "heuristic_p_value")


@query("agg52_efficiency_set", f"""SELECT {R}, {rs(*_EFF)} FROM (SELECT *, 0.3 * placement_efficiency + 0.5 * simulation_efficiency + 0.2 * time_efficiency AS overall_efficiency FROM (SELECT *, least(1, num_placements / 3) AS placement_efficiency, simulation_performance AS simulation_efficiency,
 least(1, simulation_reward / (execution_time / 60)) AS time_efficiency, simulation_reward * 0.1 AS heuristic_reward_variance, CASE WHEN num_placements < 5 THEN 0.9 WHEN num_placements > 20 THEN 0.99 ELSE 0.95 END AS heuristic_confidence,
 CASE WHEN placement_variance > 0.01 THEN 0.01 WHEN placement_variance < 0.001 THEN 0.1 ELSE 0.05 END AS heuristic_p_value FROM v_res) a) b""")
def _(t):
    return pl.efficiency_set(wide(t)).select("grid_id", "method", *r6(*_EFF))


@query("agg53_comparison_set", f"""SELECT {R}, {rs(*pl.COMPARISON)} FROM (SELECT {R}, 1e0 AS reliability, CASE WHEN {_HY} THEN best_reward ELSE edge_coverage END AS efficiency, c AS consistency, (spatial_diversity + c) / 2 AS robustness, least(1, total_episodes / num_placements / 10) AS scalability,
 least(1, 0.8 * spatial_diversity) AS adaptability, least(1, placement_quality * CASE WHEN {_HY} THEN 1.5 ELSE 0.7 END) AS innovation, CASE WHEN contains(method, 'ucb') THEN 0.9 WHEN contains(method, 'epsilon') THEN 0.8 WHEN contains(method, 'thompson') THEN 0.85 ELSE 0.6 END AS methodology,
 CASE WHEN {_HY} THEN 0.8 ELSE 0.4 END AS theoretical_contribution, least(1, total_episodes / num_placements / 5) AS load_efficiency, CAST(CAST(convergence_achieved AS INT) AS DOUBLE) AS stability FROM (SELECT *, least(1, average_reward / best_reward) AS c FROM v_wide) a) b""")
def _(t):
    return pl.comparison_set(wide(t)).select("grid_id", "method", *r6(*pl.COMPARISON))


_EXP = ("exploration_balance", "exploration_value", "overall_diversity")


@query("agg54_exploration", f"""SELECT {R}, {rs(*_EXP)} FROM (SELECT {R}, 0.4 * average_reward / best_reward + 0.3 * least(1, exploration_efficiency / 10) + 0.3 * least(1, action_diversity / 5) AS exploration_balance,
 least(1, 0.5 * (least(best_reward / average_reward, 1.5) - 1) / 0.5 + 0.3 * CASE WHEN convergence_achieved THEN 1 ELSE 0.3 END + 0.2 * engine_diversity) AS exploration_value, (2 * spatial_diversity + edge_distribution) / 3 AS overall_diversity FROM v_wide) q""")
def _(t):
    return pl.exploration(wide(t)).select("grid_id", "method", *r6(*_EXP))


_LRN = ("adaptability_score", "learning_curve_quality", "learning_rate")


@query("agg67_learning", f"""SELECT {R}, {rs(*_LRN)} FROM (SELECT {R}, (spatial_diversity + least(1, simulation_reward / 10)) / 2 AS adaptability_score, (CAST(convergence_achieved AS INT) + best_reward / total_episodes) / 2 AS learning_curve_quality,
 least(1, best_reward / total_episodes) AS learning_rate FROM v_wide) q""")
def _(t):
    return pl.learning(wide(t)).select("grid_id", "method", *r6(*_LRN))


@query("agg66_overall_performance", f"""SELECT {R}, round(least(1, 0.7 * CASE WHEN simulation_reward > 0 THEN simulation_reward ELSE best_reward END + 0.3 * placement_quality), 6) AS overall_performance, round(1 + 0.5 * edge_coverage, 6) AS simple_fallback,
 round(CASE WHEN simulation_reward <> 0 THEN simulation_reward WHEN charging_events > 0 OR battery_data_points > 0 THEN 0.1 ELSE 0.05 END, 6) AS floored_reward FROM v_wide""")
def _(t):
    w = pl.fallback_reward(pl.overall_performance(wide(t)))
    floor = pl.reward_floor(F.col("simulation_reward"), F.col("charging_events"), F.col("battery_data_points"), F.col("num_placements"))
    return w.select("grid_id", "method", *r6("overall_performance", "simple_fallback"), rnd(floor, 6).alias("floored_reward"))


@query("agg41_best_placements", """SELECT r.method, grids, round(100.0 * grids / (SELECT count(DISTINCT grid_id) FROM v_runs), 6) AS percentage, round(rm, 6) AS reward_mean, round(rs, 6) AS reward_std, total_placements, unique_edges, round(sd, 6) AS spatial_diversity,
 round(1 - rs / rm, 6) AS reward_consistency FROM (SELECT method, count(*) AS grids, avg(best_reward) AS rm, stddev_pop(best_reward) AS rs FROM v_runs GROUP BY 1) r LEFT JOIN (SELECT method, count(*) AS total_placements, count(DISTINCT edge_id) AS unique_edges,
 max(lat) - min(lat) + max(lon) - min(lon) AS sd FROM v_place GROUP BY 1) p ON p.method = r.method""")
def _(t):
    return pl.best_placement_summary(place(t), run_table(t)).select("method", "grids", *r6("percentage", "reward_mean", "reward_std"), "total_placements", "unique_edges",
                                                                    *r6("spatial_diversity", "reward_consistency"))


@query("rnk10_best_by_type", f"""SELECT * FROM (SELECT 'hybrid' AS kind, method, round(max(best_reward), 6) AS score FROM v_wide WHERE {_HY} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1) a UNION ALL
 SELECT * FROM (SELECT 'baseline' AS kind, method, round(avg(edge_coverage), 6) AS score FROM v_wide WHERE NOT {_HY} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1) b""")
def _(t):
    m = wide(t).groupBy("method").agg(rnd(F.max("best_reward"), 6).alias("best_reward"), rnd(F.avg("edge_coverage"), 6).alias("edge_coverage"))
    return runs.best_by_type(materialize(m))


@query("prj41_plot_bounds", """SELECT round(a - (b - a) * 0.1, 6) AS min_lat, round(b + (b - a) * 0.1, 6) AS max_lat, round(c - (d - c) * 0.1, 6) AS min_lon, round(d + (d - c) * 0.1, 6) AS max_lon FROM (SELECT least(min(lat), (SELECT min(min_lat) FROM fx_cells)) AS a,
 greatest(max(lat), (SELECT max(max_lat) FROM fx_cells)) AS b, least(min(lon), (SELECT min(min_lon) FROM fx_cells)) AS c, greatest(max(lon), (SELECT max(max_lon) FROM fx_cells)) AS d FROM fx_placements) q""")
def _(t):
    return pl.plot_bounds(t.fx("placements"), t.fx("cells")).select(*r6("min_lat", "max_lat", "min_lon", "max_lon"))


_BASE_NAMES = "CASE n % 4 WHEN 0 THEN 'Random' WHEN 1 THEN 'Uniform' WHEN 2 THEN 'K-Means' ELSE 'hybrid_ucb' END"
view("v_raw_place", f"""SELECT CAST(n AS VARCHAR) AS station_id, {_BASE_NAMES} AS method, CASE WHEN n % 7 = 0 THEN NULL ELSE 'e_' || (n % 60) END AS edge_id, CASE WHEN n % 11 = 0 THEN NULL ELSE lat END AS lat, lon, n FROM (SELECT site_no AS n, lat, lon FROM fx_sites) q""")


def raw_place(t):
    n = F.col("site_no")
    return t.fx("sites").withColumn("n", n).select(
        F.col("site_id").alias("station_id"), F.expr(_BASE_NAMES).alias("method"), F.when(n % 7 != 0, F.concat(F.lit("e_"), (n % 60).cast("string"))).alias("edge_id"),
        F.when(n % 5 != 0, F.concat(F.lit("e_"), (n % 60).cast("string"), F.lit("_0"))).alias("lane"), F.when(n % 11 != 0, F.col("lat")).alias("lat"), "lon")


_WIDE_BOX = "lat BETWEEN 42.22 AND 42.32 AND lon BETWEEN -83.80 AND -83.69"


@query("prj32_validate_placements", f"""SELECT station_id, method, CASE WHEN ib THEN coalesce(edge_id, 'fallback_' || CAST(trunc(lat * 1000) AS INT) || '_' || CAST(trunc(lon * 1000) AS INT)) ELSE near END AS edge_id, round(CASE WHEN ib THEN lat ELSE nlat END, 6) AS lat, round(CASE WHEN ib THEN lon ELSE nlon END, 6) AS lon FROM
 (SELECT p.*, {_WIDE_BOX.replace('lat', 'p.lat').replace('lon', 'p.lon')} AS ib, e.edge_id AS near, e.lat0 AS nlat, e.lon0 AS nlon, row_number() OVER (PARTITION BY station_id ORDER BY sqrt(pow(e.lat0 - p.lat, 2) + pow(e.lon0 - p.lon, 2)), e.edge_id) AS k FROM v_raw_place p, fx_edges e
 WHERE e.lat0 BETWEEN 42.23 AND 42.31 AND e.lon0 BETWEEN -83.79 AND -83.70 AND p.lat IS NOT NULL AND (p.method <> 'hybrid_ucb' OR (p.edge_id IS NOT NULL AND n % 5 <> 0 AND {_WIDE_BOX.replace('lat', 'p.lat').replace('lon', 'p.lon')}))) q WHERE k = 1""")
def _(t):
    mids = t.fx("edges").select("edge_id", F.col("lat0").alias("lat"), F.col("lon0").alias("lon"))
    return pl.validate(raw_place(t), BOX, mids).select("station_id", "method", "edge_id", *r6("lat", "lon"))
