"""Targets, feature selection, models and their evaluation."""

from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.functions.hashing import uniform_sql
from voltgrid.operators import grids, linear, models, observed, placements, selection as sel, spatial, targets
from voltgrid.operators.ordered import percentiles
from voltgrid.plans.catalog.demand import r6, rnd
from voltgrid.plans.catalog.features import rs
from voltgrid.plans.catalog.trajectories import pts
from voltgrid.plans.registry import query, view

# Training rows from customers: one informative, one derived, two weak and one constant column.
view("v_train", """SELECT c_custkey AS id, actual AS y, predicted AS f_signal, 2 * predicted + 0.001 * (c_custkey % 7) AS f_twin, CAST(c_nationkey AS DOUBLE) AS f_nation,
 CAST(c_custkey * 37 % 100 AS DOUBLE) AS f_noise, 1e0 AS f_flat FROM customer JOIN fx_predictions ON grid_id = 'grid_' || c_custkey""")
FEATURES = ["f_signal", "f_twin", "f_nation", "f_noise", "f_flat"]
KEPT = ["f_nation", "f_noise", "f_signal", "f_twin"]


def train_rows(t):
    k = F.col("c_custkey")
    pred = 0.7 * (F.col("c_acctbal") + 1000) / 11000 + (k * 37 % 100).cast("double") / 300
    return t.raw("customer").select(k.alias("id"), ((F.col("c_acctbal") + 1000) / 11000).alias("y"), pred.alias("f_signal"), (2 * pred + 0.001 * (k % 7)).alias("f_twin"),
                                    F.col("c_nationkey").cast("double").alias("f_nation"), (k * 37 % 100).cast("double").alias("f_noise"), F.lit(1.0).alias("f_flat"))


_T = [f"target_{k}" for k in targets.TRANSFORMS]
view("v_fit", """SELECT avg(y) AS mu, stddev_samp(y) AS sigma, quantile_cont(y, 0.5) AS med, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr FROM v_train WHERE id % 5 > 0""")
view("v_targets", """SELECT id, y AS target_original, ln(1 + y) AS target_log1p, sqrt(abs(y)) AS target_sqrt, (y - mu) / sigma AS target_zscore, (y - med) / iqr AS target_robust FROM v_train, v_fit""")


def fitted(t):
    return targets.fit(train_rows(t).filter("id % 5 > 0"), "y")


@query("prj26_target_transforms", f"SELECT id, {rs(*_T)} FROM v_targets")
def _(t):
    return targets.transform(train_rows(t), "y", fitted(t)).select("id", *r6(*_T))


@query("prj27_inverse_transforms", """SELECT kind, id, round(y, 5) AS y FROM v_train CROSS JOIN (VALUES ('original'), ('log1p'), ('sqrt'), ('zscore'), ('robust')) v(kind)""")
def _(t):
    f = fitted(t)
    w, out = targets.transform(train_rows(t), "y", f), None
    for k in targets.TRANSFORMS:
        p = targets.inverse(w.select("id", F.col(f"target_{k}").alias("p")), "p", k, f).select(F.lit(k).alias("kind"), "id", rnd("p", 5).alias("y"))
        out = p if out is None else out.unionByName(p)
    return out


view("v_xr", """SELECT *, rank() OVER (ORDER BY actual) + (count(*) OVER (PARTITION BY actual) - 1) / 2 AS ra, rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2 AS rp FROM fx_predictions""")
_RM = ("r2", "rmse", "mae", "pearson_r", "spearman_r", "actual_mean", "actual_std", "predicted_mean", "predicted_std")
_RM_SQL = """count(*) AS n_samples, 1 - sum(pow(actual - predicted, 2)) / (count(*) * var_pop(actual)) AS r2, sqrt(avg(pow(actual - predicted, 2))) AS rmse, avg(abs(actual - predicted)) AS mae,
 corr(actual, predicted) AS pearson_r, corr(ra, rp) AS spearman_r, avg(actual) AS actual_mean, stddev_pop(actual) AS actual_std, avg(predicted) AS predicted_mean, stddev_pop(predicted) AS predicted_std"""


@query("agg18_regression_metrics", f"SELECT n_samples, {rs(*_RM)}, false AS actual_constant FROM (SELECT {_RM_SQL} FROM v_xr) q")
def _(t):
    return targets.regression_metrics(t.fx("predictions"), [], "actual", "predicted").select("n_samples", *r6(*_RM), "actual_constant")


@query("agg18_regression_p_values")
def _(t):
    return targets.regression_metrics(t.fx("predictions"), [], "actual", "predicted", with_p=True)


@query("jon17_validation_join", "SELECT a.grid_id, round(actual, 6) AS actual, round(predicted, 6) AS predicted FROM fx_predictions a JOIN (SELECT 'grid_' || s_suppkey AS grid_id FROM supplier) b ON a.grid_id = b.grid_id")
def _(t):
    b = t.raw("supplier").select(F.concat(F.lit("grid_"), F.col("s_suppkey")).alias("grid_id"))
    return t.fx("predictions").join(b, "grid_id").select("grid_id", *r6("actual", "predicted"))


_MOMENTS = "avg(v) AS m, stddev_pop(v) AS s"
@query("agg19_distribution_profile", """SELECT count(*) AS count, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std, round(min(y), 6) AS min, round(max(y), 6) AS max, round(avg(pow((y - m) / s, 3)), 6) AS skewness,
 round(avg(pow((y - m) / s, 4)) - 3, 6) AS kurtosis, count(*) FILTER (y = 0) AS zeros_count, count(*) FILTER (y < 0.01) AS near_zeros_count, round(quantile_cont(y, 0.25), 6) AS q25, round(quantile_cont(y, 0.5), 6) AS q50,
 round(quantile_cont(y, 0.75), 6) AS q75, abs(avg(pow((y - m) / s, 3))) > 1 OR avg(pow((y - m) / s, 4)) - 3 > 3 AS needs_transformation FROM (SELECT *, avg(y) OVER () AS m, stddev_pop(y) OVER () AS s FROM v_train) q""")
def _(t):
    d = targets.distribution_profile(train_rows(t), "y")
    return d.select("count", *r6("mean", "std", "min", "max", "skewness", "kurtosis"), "zeros_count", "near_zeros_count", *r6("q25", "q50", "q75"), "needs_transformation")


_UNP = " UNION ALL ".join(f"SELECT '{c[7:]}' AS transformation, {c} AS v FROM v_targets" for c in _T)
view("v_quality", f"""SELECT transformation, avg(pow((v - m) / s, 3)) AS skewness, avg(pow((v - m) / s, 4)) - 3 AS kurtosis, var_samp(v) AS variance, (max(v) - min(v)) / (stddev_samp(v) + 1e-8) AS range_ratio FROM
 (SELECT *, avg(v) OVER (PARTITION BY transformation) AS m, stddev_pop(v) OVER (PARTITION BY transformation) AS s FROM ({_UNP}) u) q GROUP BY 1""")


@query("agg20_transform_quality", f"SELECT transformation, {rs('skewness', 'kurtosis', 'variance', 'range_ratio', d=5)}, round(1 / (1 + abs(skewness) + abs(kurtosis)), 5) AS quality_score FROM v_quality")
def _(t):
    w = targets.transform(train_rows(t), "y", fitted(t))
    return targets.transform_quality(w, _T).select("transformation", *[rnd(c, 5).alias(c) for c in ("skewness", "kurtosis", "variance", "range_ratio", "quality_score")])


# --- selection ----------------------------------------------------------------------------------------------
_MELT = " UNION ALL ".join(f"SELECT id, '{f}' AS feature, {f} AS v FROM v_train" for f in [*FEATURES, "y"])
view("v_melt", _MELT)


@query("ml01_variance_filter", "SELECT feature, round(var_pop(v), 6) AS variance, var_pop(v) > 1e-4 AS kept FROM v_melt WHERE feature <> 'y' GROUP BY 1")
def _(t):
    return sel.variances(train_rows(t), FEATURES).select("feature", *r6("variance"), "kept")


view("v_corr", " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS correlation FROM v_train" for i, a in enumerate(KEPT) for b in KEPT[i + 1:]))


@query("ml02_correlated_pairs", "SELECT f1, f2, round(correlation, 6) AS correlation, abs(correlation) > 0.95 AS redundant FROM v_corr")
def _(t):
    return sel.correlations(train_rows(t), KEPT).select("f1", "f2", *r6("correlation"), (F.abs("correlation") > 0.95).alias("redundant"))


view("v_bin", "SELECT id, feature, CAST(floor((row_number() OVER (PARTITION BY feature ORDER BY v, id) - 1) * 10 / count(*) OVER (PARTITION BY feature)) AS INT) AS bin FROM v_melt")
view("v_joint", "SELECT a.feature, a.bin, b.bin AS yb, count(*) AS c FROM v_bin a JOIN v_bin b ON a.id = b.id AND b.feature = 'y' WHERE a.feature <> 'y' AND a.feature <> 'f_flat' GROUP BY 1, 2, 3")
view("v_mi", """SELECT feature, sum(c / n * ln(c * n / (cx * cy))) AS mutual_information FROM (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS cx, sum(c) OVER (PARTITION BY feature, yb) AS cy FROM v_joint) q GROUP BY 1""")
view("v_drop", """SELECT DISTINCT CASE WHEN abs(a.mutual_information - b.mutual_information) < 1e-10 THEN greatest(f1, f2) WHEN a.mutual_information < b.mutual_information THEN f1 ELSE f2 END AS feature FROM v_corr
 JOIN v_mi a ON a.feature = f1 JOIN v_mi b ON b.feature = f2 WHERE abs(correlation) > 0.95""")


@query("ml04_mutual_information", f"SELECT feature, {rs('mutual_information')} FROM v_mi")
def _(t):
    return sel.mutual_information(train_rows(t), KEPT, "y", "id").select("feature", *r6("mutual_information"))


@query("ml03_redundant_features", "SELECT feature FROM v_drop")
def _(t):
    d = train_rows(t)
    return sel.redundant(sel.correlations(d, KEPT), sel.mutual_information(d, KEPT, "y", "id"))


@query("ml05_top_k_rule", """SELECT s_suppkey AS n, CAST(CASE WHEN s_suppkey <= 20 THEN s_suppkey WHEN s_suppkey <= 50 THEN greatest(15, least(25, floor(s_suppkey / 2))) ELSE greatest(20, least(35, floor(s_suppkey / 2))) END AS INT) AS k,
 CAST(CASE WHEN s_suppkey <= 20 THEN s_suppkey WHEN s_suppkey <= 50 THEN greatest(15, least(30, floor(s_suppkey / 2))) ELSE greatest(25, least(40, floor(s_suppkey / 2))) END AS INT) AS k_runner FROM supplier""")
def _(t):
    n = F.col("s_suppkey")
    return t.raw("supplier").select(n.alias("n"), sel.top_k(n).alias("k"), sel.top_k(n, True).alias("k_runner"))


@query("ml05_selected_features", "SELECT feature, round(mutual_information, 6) AS mutual_information, row_number() OVER (ORDER BY mutual_information DESC, feature) AS rank FROM v_mi WHERE feature NOT IN (SELECT feature FROM v_drop)")
def _(t):
    return sel.select_features(train_rows(t), FEATURES, "y", "id").select("feature", *r6("mutual_information"), "rank")


@query("ml06_selection_report", """SELECT m.feature, round(var_samp(v), 6) AS variance, round(CASE WHEN var_pop(v) > 0 THEN corr(v, y) END, 6) AS target_correlation, CASE WHEN var_samp(v) < 1e-10 THEN 'zero variance' ELSE 'ok' END AS issue
 FROM v_melt m JOIN v_train t ON t.id = m.id WHERE m.feature <> 'y' GROUP BY 1""")
def _(t):
    r = sel.selection_report(train_rows(t), FEATURES, "y")
    return r.select("feature", *r6("variance"), rnd("target_correlation", 6).alias("target_correlation"), "issue")


@query("ml06_target_statistics", "SELECT round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std, round(min(y), 6) AS min, round(max(y), 6) AS max, round(skewness(y), 6) AS skewness, round(kurtosis(y), 6) AS kurtosis FROM v_train")
def _(t):
    return sel.target_statistics(train_rows(t), "y").select(*r6("mean", "std", "min", "max", "skewness", "kurtosis"))


@query("ml07_selection_stability")
def _(t):
    d = materialize(train_rows(t))
    n = d.count()
    return models.stability(d, ["f_signal", "f_nation", "f_noise"], "y", "id", sizes=(n // 2, n * 3 // 4))


@query("prj28_feature_exclusion", "SELECT grid_id, round(road_density_total, 6) AS road_density_total FROM v_feat")
def _(t):
    from voltgrid.plans.catalog.features import cells, feat
    wide = feat(t).join(cells(t).select("grid_id", F.col("lat").alias("latitude_x"), F.col("lon").alias("longitude_y")), "grid_id").withColumn("demand_score_balanced", F.lit(0.5)).withColumn("num_stations", F.lit(1))
    kept = sel.feature_columns(wide.columns)
    if any(c.startswith(("latitude", "demand_score", "num_stations")) for c in kept):
        raise ValueError(f"leaky columns kept: {kept}")
    return wide.select("grid_id", *[c for c in kept if c == "road_density_total"]).withColumn("road_density_total", rnd("road_density_total", 6))


@query("prj42_prediction_schema", "SELECT round(f_signal, 6) AS f_signal, round(f_noise, 6) AS f_noise FROM v_train")
def _(t):
    return models.check_schema(train_rows(t), ["f_signal", "f_noise"]).select(*r6("f_signal", "f_noise"))


@query("gen28_row_sample", "SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500")
def _(t):
    return sel.hashed_sample(t.raw("orders"), "o_orderkey", 500).select("o_orderkey")


@query("ml23_split_by_strata", """SELECT part, count(*) AS n, count(DISTINCT e.week) AS weeks FROM fx_points e JOIN (SELECT week, CASE WHEN (k - 1) / n < 0.7 THEN 'train' WHEN (k - 1) / n < 0.85 THEN 'validation' ELSE 'test' END AS part
 FROM (SELECT week, row_number() OVER (ORDER BY md5('42|' || CAST(week AS VARCHAR))) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT week FROM fx_points) d) q) s ON s.week = e.week GROUP BY 1""")
def _(t):
    s = sel.split_by_strata(t.fx("points"), "week", {"train": 0.70, "validation": 0.15, "test": 0.15})
    return s.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("week").alias("weeks"))


# --- model tables (scores of configurations derived from customers) -----------------------------------------
_TR, _SC, _AL = list(targets.TRANSFORMS), list(models.SCALERS), list(models.ALGORITHMS)


def _pick(names, expr):
    return f"CASE CAST({expr} AS INT) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


_CFG = f"SELECT c_custkey AS id, {_pick(_TR, 'c_custkey % 5')} AS target, {_pick(_SC, 'c_custkey % 3')} AS scaler, {_pick(_AL, 'floor(c_custkey / 7) % 5')} AS algorithm, (c_acctbal + 1000e0) / 11000e0 AS r2, (c_custkey * 37 % 100) / 100e0 AS pearson, (c_custkey * 53 % 100) / 100e0 AS spearman, (c_custkey * 11 % 100) / 100e0 AS cv FROM customer"
view("v_cfg", f"SELECT *, 0.3 * greatest(r2, 0) + 0.4 * abs(pearson) + 0.2 * abs(spearman) + 0.1 * greatest(cv, 0) AS score, 0.4 * greatest(r2, 0) + 0.3 * abs(pearson) + 0.3 * abs(spearman) AS tuner FROM ({_CFG}) q")


def configs(t):
    c = t.spark.sql(_CFG.replace("FROM customer", "FROM {c}"), c=t.raw("customer"))
    return c.withColumn("score", targets.model_score(F.col("r2"), F.col("pearson"), F.col("spearman"), F.col("cv"))).withColumn(
        "tuner", targets.tuner_score(F.col("r2"), F.col("pearson"), F.col("spearman"))).withColumn("model", F.lpad(F.col("id").cast("string"), 8, "0"))


@query("prj39_model_score", "SELECT id, round(score, 6) AS score, round(tuner, 6) AS tuner FROM v_cfg")
def _(t):
    return configs(t).select("id", *r6("score", "tuner"))


@query("rnk04_leaderboard", "SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS overall_rank, row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, id) AS target_rank FROM v_cfg")
def _(t):
    return sel.leaderboard(configs(t).withColumn("score", rnd("score", 9))).select("id", "overall_rank", "target_rank")


@query("rnk05_best_by_metric", "SELECT * FROM (SELECT 'r2' AS metric, id FROM v_cfg ORDER BY r2 DESC, id LIMIT 1) a UNION ALL SELECT * FROM (SELECT 'cv', id FROM v_cfg WHERE target = 'log1p' ORDER BY cv, id LIMIT 1) b")
def _(t):
    c = configs(t)
    a = sel.best_by_metric(c, "r2").select(F.lit("r2").alias("metric"), "id")
    return a.unionByName(sel.best_by_metric(c.filter("target = 'log1p'"), "cv", higher=False).select(F.lit("cv").alias("metric"), "id"))


# A configuration has a model where its runs are as good as the mean run.
_HAVE = "SELECT target, scaler, algorithm FROM v_cfg GROUP BY 1, 2, 3 HAVING avg(score) >= (SELECT avg(score) FROM v_cfg) + 1e-12"


def have_models(t):
    per = configs(t).groupBy(F.col("target").alias("transform"), "scaler", "algorithm").agg(F.avg("score").alias("s"))
    mean = configs(t).agg(F.avg("score").alias("m"))
    return per.crossJoin(F.broadcast(mean)).filter("s >= m + 1e-12").select("transform", "scaler", "algorithm")


@query("set04_missing_configurations", f"""SELECT transform, scaler, algorithm FROM (SELECT unnest({_TR}) AS transform) a, (SELECT unnest({_SC}) AS scaler) b, (SELECT unnest({_AL}) AS algorithm) c EXCEPT {_HAVE}""")
def _(t):
    have = have_models(t)
    return sel.expected_missing(have, have, _TR, _SC, _AL)


@query("agg59_feature_importance", """SELECT algorithm, feature, round(importance, 6) AS importance, rank FROM (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY round(importance, 9) DESC, feature) AS rank FROM (SELECT algorithm, feature, avg(importance) AS importance FROM
 (SELECT *, row_number() OVER (PARTITION BY algorithm, model ORDER BY importance DESC, feature) AS k FROM (SELECT l_returnflag AS algorithm, l_suppkey AS model, 'f' || (l_partkey % 40) AS feature, max(l_extendedprice) AS importance FROM lineitem GROUP BY 1, 2, 3) m) a WHERE k <= 5 GROUP BY 1, 2) b) c WHERE rank <= 5""")
def _(t):
    m = t.raw("lineitem").groupBy(F.col("l_returnflag").alias("algorithm"), F.col("l_suppkey").alias("model"), F.concat(F.lit("f"), F.col("l_partkey") % 40).alias("feature")).agg(F.max("l_extendedprice").alias("importance"))
    return sel.importance_by_algorithm(m, 5).select("algorithm", "feature", *r6("importance"), "rank")


@query("ml25_metric_tables", "SELECT id, target, scaler, algorithm, round(score, 6) AS score, row_number() OVER (PARTITION BY algorithm ORDER BY round(score, 9) DESC, id) AS rank, row_number() OVER (PARTITION BY algorithm ORDER BY round(score, 9) DESC, id) <= 3 AS selected FROM v_cfg")
def _(t):
    from voltgrid.operators.ordered import row_numbers
    r = row_numbers(configs(t).withColumn("_s", rnd("score", 9)), ["algorithm"], [F.col("_s").desc(), "id"], "rank")
    return r.select("id", "target", "scaler", "algorithm", *r6("score"), "rank", (F.col("rank") <= 3).alias("selected"))


@query("set06_feature_overlap", """SELECT a.method AS m1, b.method AS m2, round(len(list_intersect(a.s, b.s)) / greatest(len(a.s), len(b.s)), 6) AS overlap FROM (SELECT method, list(DISTINCT grid_id || '/' || arm) AS s FROM fx_episodes WHERE reward > 0.9 GROUP BY 1) a
 JOIN (SELECT method, list(DISTINCT grid_id || '/' || arm) AS s FROM fx_episodes WHERE reward > 0.9 GROUP BY 1) b ON a.method < b.method""")
def _(t):
    # At most 12 grids x 7 arms names per method.
    s = materialize(t.fx("episodes").filter("reward > 0.9").groupBy("method").agg(F.collect_set(F.concat_ws("/", "grid_id", "arm")).alias("s")))
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, F.col("a.method") < F.col("b.method")).select(F.col("a.method").alias("m1"), F.col("b.method").alias("m2"), rnd(sel.overlap(F.col("a.s"), F.col("b.s")), 6).alias("overlap"))


# --- grid-size sensitivity ----------------------------------------------------------------------------------
view("v_scells", "SELECT *, 'scale_' || size_km || '_' || area_id || '_' || i || '_' || j AS grid_id FROM v_scale_c")
view("v_sens", """SELECT size_km AS grid_size, grid_id, (uv / max(uv) OVER (PARTITION BY size_km) + te / max(te) OVER (PARTITION BY size_km)) / 2 AS actual, coalesce(ne, 0) / area_km2 AS predicted FROM (SELECT c.size_km, c.grid_id, max(c.area_km2) AS area_km2,
 count(DISTINCT veh_id) AS uv, count(*) AS te FROM v_scells c JOIN fx_points p ON p.lat > c.min_lat AND p.lat < c.max_lat AND p.lon > c.min_lon AND p.lon < c.max_lon GROUP BY 1, 2) a LEFT JOIN (SELECT c.grid_id AS g, count(*) AS ne FROM v_scells c
 JOIN fx_elements e ON e.lat > c.min_lat AND e.lat < c.max_lat AND e.lon > c.min_lon AND e.lon < c.max_lon GROUP BY 1) b ON g = grid_id""")
_SENS_SQL = """SELECT grid_size, count(*) AS n_samples, round(1 - sum(pow(actual - predicted, 2)) / (count(*) * var_pop(actual)), 4) AS r2, round(avg(abs(actual - predicted)), 4) AS mae, round(corr(actual, predicted), 4) AS pearson_r, round(corr(ra, rp), 4) AS spearman_r FROM
 (SELECT grid_size, actual, predicted, rank() OVER (PARTITION BY grid_size ORDER BY actual) + (count(*) OVER (PARTITION BY grid_size, actual) - 1) / 2 AS ra,
 rank() OVER (PARTITION BY grid_size ORDER BY predicted) + (count(*) OVER (PARTITION BY grid_size, predicted) - 1) / 2 AS rp FROM (SELECT grid_size, round(actual, 9) AS actual, round(predicted, 6) AS predicted FROM v_sens) z) q GROUP BY 1"""


def sensitivity(t):
    c = materialize(grids.multiscale_grids(t.fx("areas")).select("grid_id", "grid_scale", "area_km2", "min_lat", "max_lat", "min_lon", "max_lon"))
    from voltgrid.plans.validation import grid_size_sensitivity
    return grid_size_sensitivity(t.fx("points"), t.fx("elements"), c, 0.01)


@query("ml18_grid_size_sensitivity", _SENS_SQL)
def _(t):
    return sensitivity(t).select("grid_size", "n_samples", *[rnd(c, 4).alias(c) for c in ("r2", "mae", "pearson_r", "spearman_r")])


@query("rnk06_best_grid_size", f"SELECT grid_size FROM ({_SENS_SQL}) s ORDER BY spearman_r DESC, grid_size LIMIT 1")
def _(t):
    return sel.best_grid_size(materialize(sensitivity(t))).select("grid_size")


# --- fitted models (rows-only checks) -----------------------------------------------------------------------
FX = ["f_signal", "f_nation", "f_noise"]
_SMALL = {"random_forest": {"numTrees": 20, "maxDepth": 6}, "gradient_boosting": {"maxIter": 15, "maxDepth": 4}}
_ROUND = ("r2", "rmse", "mae", "pearson_r", "spearman_r")


def _score(df):
    return df.select(*[c for c in df.columns if c not in _ROUND], *r6(*_ROUND))


@query("ml08_scalers", """SELECT id, round((f_signal - (SELECT avg(f_signal) FROM v_train)) / (SELECT stddev_samp(f_signal) FROM v_train), 5) AS standard,
 round((f_signal - (SELECT quantile_cont(f_signal, 0.5) FROM v_train)) / (SELECT quantile_cont(f_signal, 0.75) - quantile_cont(f_signal, 0.25) FROM v_train), 5) AS robust FROM v_train""")
def _(t):
    d = train_rows(t).select("id", F.col("f_signal").alias("y"))
    return targets.transform(d, "y", targets.fit(d, "y")).select("id", rnd("target_zscore", 5).alias("standard"), rnd("target_robust", 5).alias("robust"))


@query("ml08_quantile_scaler")
def _(t):
    return models.quantile_scale(train_rows(t).select("id", "f_signal"), ["f_signal"])


def _trained(t, algorithms, scaler="standard"):
    d = materialize(train_rows(t))
    return _score(models.train_grid(d.withColumn("target_original", F.col("y")), FX, ["target_original"], "id", [("target_original", scaler, a) for a in algorithms], overrides=_SMALL))


@query("ml09_linear_models")
def _(t):
    return _trained(t, ("ridge", "elastic_net", "lasso"))


# Ridge models in SQL: covariances of the standardised features, normal equations by Cramer's rule.
view("v_fold", f"SELECT v.id, f_signal AS x1, f_nation AS x2, f_noise AS x3, CAST(floor({uniform_sql(42, 'v.id')} * 5) AS INT) AS fold, {', '.join(_T)} FROM v_train v JOIN v_targets w ON w.id = v.id")
view("v_long", "UNPIVOT (SELECT * FROM v_fold) ON " + ", ".join(_T) + " INTO NAME target VALUE y")
_COV = ", ".join(f"covar_pop(x{i}, x{j}) / (stddev_samp(x{i}) * stddev_samp(x{j}))" + (" + 0.5" if i == j else "") + f" AS a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
view("v_normal", f"""SELECT target, held, avg(y) AS my, {', '.join(f'avg(x{i}) AS m{i}, stddev_samp(x{i}) AS s{i}, covar_pop(x{i}, y) / stddev_samp(x{i}) AS c{i}' for i in (1, 2, 3))}, {_COV}
 FROM v_long, generate_series(0, 4) h(held) WHERE fold <> held GROUP BY 1, 2""")


def _det(columns):
    (a, d, g), (b, e, h), (c, f, i) = columns
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_COLUMNS = [[f"a{i}{j}" for i in (1, 2, 3)] for j in (1, 2, 3)]
_RHS = ["c1", "c2", "c3"]
view("v_ridge", f"""SELECT *, my - w1 * m1 - w2 * m2 - w3 * m3 AS intercept FROM (SELECT target, held, my, m1, m2, m3,
 {', '.join(f'{_det([_RHS if k == j else _COLUMNS[k] for k in range(3)])} / {_det(_COLUMNS)} / s{j + 1} AS w{j + 1}' for j in range(3))} FROM v_normal) q""")


def _targets(t):
    return targets.transform(train_rows(t), "y", fitted(t))


@query("ml09_ridge_coefficients", f"SELECT target, held, {rs('intercept', 'w1', 'w2', 'w3')} FROM v_ridge")
def _(t):
    rows = linear.prepared(_targets(t), FX, _T, "id", 5, 42, False)
    m = linear.models(rows, FX, [(c, "standard", "ridge") for c in _T], 5)
    return m.select("target", "held", rnd("intercept", 6).alias("intercept"), *[rnd(F.col("weights")[i], 6).alias(f"w{i + 1}") for i in range(3)])


@query("ml12_ridge_cross_validation", f"""SELECT target, fold, count(*) AS n_samples, round(1 - sum(pow(y - p, 2)) / (count(*) * var_pop(y)), 6) AS r2, round(sqrt(avg(pow(y - p, 2))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
 round(corr(y, p), 6) AS pearson_r FROM (SELECT l.target, l.fold, l.y, intercept + w1 * x1 + w2 * x2 + w3 * x3 AS p FROM v_long l JOIN v_ridge r ON r.target = l.target AND r.held = l.fold) q GROUP BY 1, 2""")
def _(t):
    m = linear.cross_validated(_targets(t), FX, [(c, "standard", "ridge") for c in _T], "id")
    return m.select("target", "fold", "n_samples", *r6("r2", "rmse", "mae", "pearson_r"))


@query("ml16_ridge_predictions", "SELECT id, round(intercept + w1 * x1 + w2 * x2 + w3 * x3, 6) AS prediction FROM v_long l JOIN v_ridge r ON r.target = l.target AND r.held = l.fold WHERE l.target = 'target_original'")
def _(t):
    rows = linear.prepared(_targets(t), FX, ["target_original"], "id", 5, 42, False)
    fitted_ = linear.models(rows, FX, [("target_original", "standard", "ridge")], 5)
    return linear.predictions(rows, FX, fitted_, "id").select("id", *r6("prediction"))


@query("ml13_linear_configurations")
def _(t):
    """All linear members of the configuration grid, cross-validated from one scan."""
    grid = [(c, s, a) for c in _T for s in _SC for a in linear.PENALTIES]
    return linear.summary(linear.cross_validated(_targets(t), FX, grid, "id")).select("target", "scaler", "algorithm", *r6(*_ROUND))


@query("ml13_missing_configurations")
def _(t):
    """Only configurations without a model are trained."""
    have = have_models(t)
    missing = sel.expected_missing(have, have, _TR, _SC, _AL)
    return linear.train_missing(_targets(t), FX, missing, "id").select("target", "scaler", "algorithm", *r6(*_ROUND))


@query("ml15_penalty_search")
def _(t):
    return linear.search(train_rows(t).withColumn("target_original", F.col("y")), FX, "target_original", "id", "elastic_net").select(*r6("penalty", "share", *_ROUND))


@query("ml27_tuned_configuration")
def _(t):
    """The best linear configuration of the whole grid first, then its penalty and share over their whole ranges."""
    d = materialize(_targets(t))
    grid = [(c, s, a) for c in _T for s in _SC for a in linear.PENALTIES]
    best = linear.summary(linear.cross_validated(d, FX, grid, "id")).orderBy(F.round("r2", 9).desc(), "target", "scaler", "algorithm").first()
    return linear.search(d, FX, best["target"], "id", "elastic_net", best["scaler"]).limit(1).select("target", "scaler", "algorithm", *r6("penalty", "share", *_ROUND))


@query("ml10_tree_models")
def _(t):
    return _trained(t, ("random_forest", "gradient_boosting"))


@query("ml11_train_configuration")
def _(t):
    model, m = models.train(train_rows(t), FX, "y", "id", "ridge", "robust")
    imp = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("importance")) for f, v in models.importances(model, FX)])
    return _score(m).withColumn("i", F.explode(imp)).select("*", "i.*").drop("i")


@query("ml12_cross_validation")
def _(t):
    return models.cv_summary(models.cross_validate(train_rows(t), FX, "y", "id", "ridge"))


@query("ml13_configuration_grid")
def _(t):
    d = materialize(targets.transform(train_rows(t), "y", fitted(t)))
    todo = [("target_log1p", "standard", "ridge"), ("target_sqrt", "quantile", "ridge")]
    return _score(models.train_grid(d, FX, _T, "id", todo))


@query("ml14_ensemble")
def _(t):
    return _score(models.ensemble(train_rows(t), FEATURES, "y", "id", **_SMALL["gradient_boosting"]))


@query("ml15_hyperparameter_search")
def _(t):
    return models.search(train_rows(t), FX, "y", "id", "ridge", trials=2, folds=3)


@query("ml16_predict_demand")
def _(t):
    model, _m = models.train(train_rows(t), FX, "y", "id", "ridge")
    return models.predict(model, train_rows(t).withColumn("grid_id", F.concat(F.lit("grid_"), F.col("id"))), FX)


@query("ml17_validate_models")
def _(t):
    rows, out = materialize(train_rows(t).withColumn("grid_id", F.concat(F.lit("grid_"), F.col("id")))), None
    unseen = models.fold_of("id", 3, 17) == 0  # rows that no model is trained on
    for a in ("ridge", "lasso", "elastic_net", "random_forest", "gradient_boosting"):
        model, _m = models.train(rows.filter(~unseen), FX, "y", "id", a, **_SMALL.get(a, {}))
        v = models.validate(models.predict(model, rows.filter(unseen), FX), rows.filter(unseen).select("grid_id", F.col("y").alias("actual"))).withColumn("model", F.lit(a))
        out = v if out is None else out.unionByName(v)
    return _score(out)


@query("ml26_preselected_training")
def _(t):
    d = train_rows(t)
    chosen = [r["feature"] for r in sel.select_features(d, FEATURES, "y", "id").orderBy("rank").collect()]
    return models.cv_summary(models.cross_validate(d, chosen, "y", "id", "ridge", folds=3))


@query("ml27_tuned_best")
def _(t):
    return models.search(train_rows(t), FX, "y", "id", "elastic_net", trials=2, folds=3).limit(1)


@query("src21_model_readback")
def _(t):
    from voltgrid.functions.durable import scratch_path
    from voltgrid.sources import stores
    model, _m = models.train(train_rows(t), FX, "y", "id", "ridge")
    path = scratch_path(t.spark, "model")
    models.save_model(model, f"{path}/best")
    stores.save_feature_list(t.spark, FX, f"{path}/features")
    names = stores.load_feature_list(t.spark, f"{path}/features")
    return models.predict(models.load_model(f"{path}/best"), train_rows(t).withColumn("grid_id", F.col("id").cast("string")), names)


@query("ml19_cluster_placement")
def _(t):
    return models.cluster_placement(t.fx("points"), t.fx("sites"), 8)
