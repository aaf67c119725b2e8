"""Target transforms and regression / distribution metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.functions.stats import correlation
from voltgrid.functions.special import t_p_value
from voltgrid.operators.ordered import percentiles, spearman

TRANSFORMS = ("original", "log1p", "sqrt", "zscore", "robust")


def fit(train: DataFrame, target: str) -> DataFrame:
    """One row: mean, sample std, median and interquartile range of the training target."""
    base = train.agg(F.avg(target).alias("mu"), F.stddev_samp(target).alias("sigma"))
    q = percentiles(train, [], target, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return materialize(base.crossJoin(F.broadcast(q.select(F.col("q50").alias("med"), (F.col("q75") - F.col("q25")).alias("iqr")))))


def transform(df: DataFrame, target: str, fitted: DataFrame) -> DataFrame:
    y = F.col(target)
    j = df.crossJoin(F.broadcast(fitted))
    safe = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0)
    return j.withColumns({"target_original": y, "target_log1p": F.log1p(F.greatest(y, F.lit(-0.999999))), "target_sqrt": F.sqrt(F.abs(y)),
                          "target_zscore": (y - F.col("mu")) / safe("sigma"), "target_robust": (y - F.col("med")) / safe("iqr")}).drop("mu", "sigma", "med", "iqr")


def inverse(df: DataFrame, prediction: str, kind: str, fitted: DataFrame) -> DataFrame:
    p = F.col(prediction)
    j = df.crossJoin(F.broadcast(fitted))
    back = {"original": p, "log1p": F.expm1(p), "sqrt": p * p, "zscore": p * F.col("sigma") + F.col("mu"), "robust": p * F.col("iqr") + F.col("med")}[kind]
    return j.withColumn(prediction, back).drop("mu", "sigma", "med", "iqr")


def regression_metrics(df: DataFrame, keys: Sequence[str], actual: str, predicted: str, with_p: bool = False,
                       rho: DataFrame | None = None) -> DataFrame:
    """r2, rmse, mae, Pearson, Spearman, n, means, population stds, constant flags; pairs with a null are left out.

    ``rho`` (keys, spearman_r) is taken where it is known already.
    """
    keys = list(keys)
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    d = df.filter(known(actual) & known(predicted))
    a, p = F.col(actual), F.col(predicted)
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum((a - p) * (a - p)).alias("_sse"), F.avg(F.abs(a - p)).alias("mae"), F.avg(a).alias("actual_mean"),
        F.stddev_pop(a).alias("actual_std"), F.avg(p).alias("predicted_mean"), F.stddev_pop(p).alias("predicted_std"), F.var_pop(a).alias("_va"),
        correlation(a, p).alias("pearson_r"), (F.min(a) == F.max(a)).alias("actual_constant"), (F.min(p) == F.max(p)).alias("predicted_constant"))
    rho = spearman(d, keys, actual, predicted) if rho is None else rho
    n = F.col("n_samples")
    flat = F.col("actual_constant") | F.col("predicted_constant")
    j = g.join(rho, keys) if keys else g.crossJoin(F.broadcast(rho))
    out = j.withColumns({"r2": F.when(F.col("_va") > 0, 1 - F.col("_sse") / (n * F.col("_va"))), "rmse": F.sqrt(F.col("_sse") / n),
                         "pearson_r": F.when(~flat, F.col("pearson_r")), "spearman_r": F.when(~flat, F.col("spearman_r"))}).drop("_sse", "_va")
    if with_p:
        for c in ("pearson", "spearman"):
            r = F.col(f"{c}_r")
            out = out.withColumn(f"{c}_p", t_p_value(r * F.sqrt((n - 2) / (1 - r * r)), n - 2))
    return out


def distribution_profile(df: DataFrame, target: str) -> DataFrame:
    y = F.col(target)
    g = df.agg(F.count(y).alias("count"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"), F.skewness(y).alias("skewness"),
               F.kurtosis(y).alias("kurtosis"), F.count_if(y == 0).alias("zeros_count"), F.count_if(y < 0.01).alias("near_zeros_count"))
    q = percentiles(df, [], target, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    need = (F.abs("skewness") > 1.0) | (F.col("kurtosis") > 3.0)
    return g.crossJoin(F.broadcast(q)).withColumn("needs_transformation", need)


def transform_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 / (1 + |skew| + |kurt|), variance and range ratio per ``target_*`` column, best first, one scan."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c.replace("target_", "")).alias("transformation"), F.col(c).cast("double").alias("v")) for c in columns])).alias("r")).select("r.*")
    g = long.filter(F.col("v").isNotNull()).groupBy("transformation").agg(
        F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"), F.var_samp("v").alias("variance"), ((F.max("v") - F.min("v")) / (F.stddev_samp("v") + 1e-8)).alias("range_ratio"))
    return g.withColumn("quality_score", 1 / (1 + F.abs("skewness") + F.abs("kurtosis"))).orderBy(F.col("quality_score").desc(), "transformation")


def model_score(r2: Column, pearson: Column, spearman_: Column, cv: Column) -> Column:
    zero = F.lit(0.0)
    return (0.30 * F.greatest(F.coalesce(r2, zero), zero) + 0.40 * F.abs(F.coalesce(pearson, zero)) + 0.20 * F.abs(F.coalesce(spearman_, zero))
            + 0.10 * F.greatest(F.coalesce(cv, zero), zero))


def tuner_score(r2: Column, pearson: Column, spearman_: Column) -> Column:
    return 0.4 * F.greatest(r2, F.lit(0.0)) + 0.3 * F.abs(pearson) + 0.3 * F.abs(spearman_)
