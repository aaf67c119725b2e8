"""Demand models on Spark ML: scaling, training, cross-validation, tuning, prediction, placement by clustering."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.functions.hashing import uniform
from voltgrid.operators import selection, targets
from voltgrid.operators.ordered import average_ranks

# Default settings per algorithm (fixed values): the boosted-tree libraries all map to Spark's boosted trees.
ALGORITHMS = ("ridge", "elastic_net", "lasso", "random_forest", "gradient_boosting")
SEARCH = {
    "ridge": {"regParam": (0.01, 0.1, 0.5, 1.0)},
    "elastic_net": {"regParam": (0.01, 0.05, 0.1), "elasticNetParam": (0.3, 0.5, 0.7)},
    "lasso": {"regParam": (0.01, 0.05, 0.1)},
    "random_forest": {"numTrees": (50, 100, 200), "maxDepth": (6, 9, 12)},
    "gradient_boosting": {"maxIter": (50, 100, 150), "maxDepth": (4, 6, 8), "stepSize": (0.05, 0.1), "subsamplingRate": (0.8, 0.9)},
}
SCALERS = ("standard", "robust", "quantile")


def estimator(algorithm: str, seed: int = 42, **overrides):
    common = {"featuresCol": "scaled", "labelCol": "label", "predictionCol": "prediction"}
    base = {
        "ridge": (LinearRegression, {"regParam": 0.5, "elasticNetParam": 0.0}),
        "elastic_net": (LinearRegression, {"regParam": 0.05, "elasticNetParam": 0.7}),
        "lasso": (LinearRegression, {"regParam": 0.05, "elasticNetParam": 1.0}),
        "random_forest": (RandomForestRegressor, {"numTrees": 200, "maxDepth": 12, "seed": seed}),
        "gradient_boosting": (GBTRegressor, {"maxIter": 150, "maxDepth": 8, "stepSize": 0.05, "subsamplingRate": 0.9, "seed": seed}),
    }[algorithm]
    return base[0](**common, **{**base[1], **overrides})


# Coefficients of algorithm AS 241 (Wichura 1988), highest power first (fixed values): middle, tail, far tail.
_MIDDLE = ((2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4, 4.5921953931549871457e+4, 1.3731693765509461125e+4, 1.9715909503065514427e+3, 1.3314166789178437745e+2, 3.3871328727963666080e+0),
           (5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4, 2.1213794301586595867e+4, 5.3941960214247511077e+3, 6.8718700749205790830e+2, 4.2313330701600911252e+1, 1.0))
_TAIL = ((7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e+0, 3.64784832476320460504e+0, 5.76949722146069140550e+0, 4.63033784615654529590e+0, 1.42343711074968357734e+0),
         (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e+0, 2.05319162663775882187e+0, 1.0))
_FAR = ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e+0, 5.46378491116411436990e+0, 6.65790464350110377720e+0),
        (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0))


def _ratio(terms: tuple[tuple[float, ...], tuple[float, ...]], r: Column) -> Column:
    def polynomial(c: tuple[float, ...]) -> Column:
        out = F.lit(c[0])
        for v in c[1:]:
            out = out * r + v
        return out
    return polynomial(terms[0]) / polynomial(terms[1])


def inverse_normal(p: Column) -> Column:
    """Normal quantile to double precision; null for null, infinite at 0 and 1."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.when(q <= 0, p).otherwise(1 - p)))
    tail = F.when(r <= 5, _ratio(_TAIL, r - 1.6)).otherwise(_ratio(_FAR, r - 5))
    ends = F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf")))
    return F.when(p.isNull(), None).when((p <= 0) | (p >= 1), ends).when(F.abs(q) <= 0.425, q * _ratio(_MIDDLE, 0.180625 - q * q)).otherwise(F.when(q < 0, -tail).otherwise(tail))


def quantile_scale(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Each feature to a normal shape by its average rank; nulls stay null."""
    out = df
    for f in features:
        ranks = average_ranks(df, [], f, "_rank")
        n = df.agg(F.count(f).alias("_n"))
        scaled = ranks.crossJoin(F.broadcast(n)).select(f, inverse_normal((F.col("_rank") - 0.5) / F.col("_n")).alias(f"_{f}"))
        out = out.join(scaled, f, "left").withColumn(f, F.col(f"_{f}")).drop(f"_{f}")
    return out


def pipeline(algorithm: str, scaler: str, features: Sequence[str], **overrides) -> Pipeline:
    assemble = VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="keep")
    if scaler == "robust":
        scale = RobustScaler(inputCol="raw", outputCol="scaled", withCentering=True)
    else:  # quantile scaling is applied to the columns beforehand
        scale = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)
    return Pipeline(stages=[assemble, scale, estimator(algorithm, **overrides)])


def prepare(df: DataFrame, features: Sequence[str], target: str, scaler: str, row_id: str) -> DataFrame:
    """Narrow, cleaned training table, written once and scanned by every fit."""
    clean = df.select(row_id, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], F.col(target).cast("double").alias("label"))
    clean = clean.filter(F.col("label").isNotNull() & ~F.isnan("label"))
    return materialize(quantile_scale(clean, features) if scaler == "quantile" else clean)  # no nulls are left here


def fold_of(row_id: str, folds: int, seed: int = 42) -> Column:
    """Fold of a row by a digest of its id, the same in check SQL."""
    return F.floor(uniform(seed, F.col(row_id)) * folds).cast("int")


def train(df: DataFrame, features: Sequence[str], target: str, row_id: str, algorithm: str = "ridge", scaler: str = "standard", seed: int = 42, **overrides):
    """Hash split 80 / 20: fitted model and its one-row metrics."""
    data = prepare(df, features, target, scaler, row_id).withColumn("_f", fold_of(row_id, 5, seed))
    model = pipeline(algorithm, scaler, features, **overrides).fit(data.filter("_f > 0"))
    scored = model.transform(data.filter("_f = 0")).select("label", "prediction")
    m = targets.regression_metrics(scored, [], "label", "prediction")
    return model, m.withColumn("algorithm", F.lit(algorithm)).withColumn("scaler", F.lit(scaler))


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    last = model.stages[-1]
    vector = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return [(f, abs(float(v))) for f, v in zip(features, vector.toArray())]


def cross_validate(df: DataFrame, features: Sequence[str], target: str, row_id: str, algorithm: str = "ridge", scaler: str = "standard", folds: int = 5, seed: int = 42, **overrides) -> DataFrame:
    """Out-of-fold metrics of every fold in one table (fold null = mean), with true rank correlation."""
    data = prepare(df, features, target, scaler, row_id).withColumn("fold", fold_of(row_id, folds, seed))
    scored = None
    for k in range(folds):
        m = pipeline(algorithm, scaler, features, **overrides).fit(data.filter(F.col("fold") != k))
        part = m.transform(data.filter(F.col("fold") == k)).select("fold", "label", "prediction")
        scored = part if scored is None else scored.unionByName(part)
    per_fold = targets.regression_metrics(materialize(scored), ["fold"], "label", "prediction")
    return per_fold.withColumn("algorithm", F.lit(algorithm)).withColumn("scaler", F.lit(scaler))


def cv_summary(per_fold: DataFrame) -> DataFrame:
    return per_fold.groupBy("algorithm", "scaler").agg(*[f(c).alias(f"{n}_{c}") for c in ("r2", "rmse", "mae", "pearson_r", "spearman_r") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def train_grid(df: DataFrame, features: Sequence[str], target_columns: Sequence[str], row_id: str, missing: Sequence[tuple[str, str, str]], seed: int = 42, overrides: Mapping[str, dict] | None = None) -> DataFrame:
    """Fit the missing (target, scaler, algorithm) configurations: one metric row each."""
    out = None
    for target, scaler, algorithm in missing:
        if target not in target_columns:
            raise ValueError(f"unknown target {target}")
        _, m = train(df, features, target, row_id, algorithm, scaler, seed, **(overrides or {}).get(algorithm, {}))
        m = m.withColumn("target", F.lit(target))
        out = m if out is None else out.unionByName(m)
    return out


def ensemble(df: DataFrame, features: Sequence[str], target: str, row_id: str, scaler: str = "standard", seed: int = 42, **settings) -> DataFrame:
    """One more boosted model, on all candidate features at once; metrics of its held-out fold in one row."""
    return train(df, features, target, row_id, "gradient_boosting", scaler, seed, **settings)[1]


def draw_settings(algorithm: str, trials: int, seed: int = 42) -> list[dict]:
    """Distinct random settings from the algorithm's search space."""
    rng, space, seen = np.random.RandomState(seed), SEARCH[algorithm], []
    most = int(np.prod([len(v) for v in space.values()]))
    while len(seen) < min(trials, most):
        pick = {k: v[rng.randint(len(v))] for k, v in space.items()}
        if pick not in seen:
            seen.append(pick)
    return seen


def search(df: DataFrame, features: Sequence[str], target: str, row_id: str, algorithm: str, trials: int = 10, folds: int = 5, seed: int = 42, scaler: str = "standard") -> DataFrame:
    """Cross-validated r2 of drawn settings, best first."""
    out = None
    for setting in draw_settings(algorithm, trials, seed):
        s = cv_summary(cross_validate(df, features, target, row_id, algorithm, scaler, folds, seed, **setting)).withColumn("settings", F.lit(json.dumps(setting, sort_keys=True)))
        out = s if out is None else out.unionByName(s)
    return out.orderBy(F.col("mean_r2").desc(), "settings")


def check_schema(df: DataFrame, features: Sequence[str]) -> DataFrame:
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.select(*features)


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], key: str = "grid_id", low: float | None = 0.0) -> DataFrame:
    check_schema(df, features)
    filled = df.select(key, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    p = F.col("prediction") if low is None else F.greatest(F.col("prediction"), F.lit(low))
    return model.transform(filled).select(key, p.alias("prediction"))


def validate(predictions: DataFrame, actual: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    j = actual.join(predictions, "grid_id")
    return targets.regression_metrics(j, keys, "actual", "prediction")


def stability(df: DataFrame, features: Sequence[str], target: str, row_id: str, sizes: Sequence[int], samples: int = 2, seed: int = 42) -> DataFrame:
    """Mean overlap of the features selected on repeated samples, per sample size."""
    picks = None
    for n in sizes:
        for s in range(samples):
            sub = materialize(selection.hashed_sample(df, row_id, n, seed + s))
            sel = selection.select_features(sub, features, target, row_id).agg(F.sort_array(F.collect_list("feature")).alias("chosen")).select(F.lit(n).alias("size"), F.lit(s).alias("run"), "chosen")
            picks = sel if picks is None else picks.unionByName(sel)
    picks = materialize(picks)
    a, b = picks.alias("a"), picks.alias("b")
    j = a.join(b, (F.col("a.size") == F.col("b.size")) & (F.col("a.run") < F.col("b.run")))
    return j.groupBy(F.col("a.size").alias("size")).agg(F.avg(selection.overlap(F.col("a.chosen"), F.col("b.chosen"))).alias("overlap"))


def cluster_placement(points: DataFrame, sites: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """K-means centres of demand points, each snapped to the nearest site, with cluster sizes."""
    from voltgrid.operators.tiles import nearest

    vec = materialize(VectorAssembler(inputCols=["lat", "lon"], outputCol="features").transform(points.select("lat", "lon").dropna()))
    model = KMeans(k=k, seed=seed).fit(vec)
    centres = points.sparkSession.createDataFrame([(str(i), float(c[0]), float(c[1])) for i, c in enumerate(model.clusterCenters())], "cluster string, lat double, lon double")
    size = model.transform(vec).groupBy(F.col("prediction").cast("string").alias("cluster")).agg(F.count(F.lit(1)).alias("cluster_size"))
    near = nearest(centres, sites, "cluster", "site_id")
    return centres.join(near, "cluster").join(size, "cluster", "left").join(
        sites.select("site_id", F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon")), "site_id")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
