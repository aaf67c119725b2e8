"""Feature selection: variance, correlation, mutual information over quantile bins, top-k rules, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.functions.stats import correlation
from voltgrid.operators.ordered import row_numbers

# Columns that leak the target, and prefixes of descriptive columns (fixed values).
LEAKY = ("num_stations", "num_chargers", "total_kwh", "total_hours", "kwh_per_charger", "hours_per_charger", "kwh_normalized",
         "hours_normalized", "avg_occupancy")
METADATA = ("grid_type", "grid_variation", "grid_scale", "grid_scale_x", "grid_scale_y", "actual_size_km", "size_scale", "offset_x_km",
            "offset_y_km", "latitude", "longitude")
MIN_VARIANCE, MAX_CORRELATION = 1e-4, 0.95


def feature_columns(columns: Sequence[str]) -> list[str]:
    """Model columns: no id, no leaky or demand columns, no targets, no metadata prefixes."""
    return [c for c in columns if c != "grid_id" and c not in LEAKY and not c.startswith(("demand_score", "target_")) and not c.startswith(METADATA)]


def _melt(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    return df.select(*keep, F.explode(pairs).alias("_r")).select(*keep, "_r.feature", "_r.v")


def variances(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return _melt(df, features).groupBy("feature").agg(F.var_pop("v").alias("variance")).withColumn("kept", F.col("variance") > MIN_VARIANCE)


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All feature pairs from one aggregate; the pair list is bounded by the table's width."""
    pairs = list(combinations(sorted(features), 2))
    row = df.agg(*[correlation(F.col(a), F.col(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    structs = F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"_{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(structs).alias("r")).select("r.*")


def binned(df: DataFrame, features: Sequence[str], row_id: str, bins: int) -> DataFrame:
    """Equal-count bins per feature by (value, id): row_id, feature, bin."""
    long = _melt(df, features, row_id).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n = long.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"))
    ranked = row_numbers(long, ["feature"], ["v", row_id], "_rn").join(F.broadcast(n), "feature")
    return ranked.select(row_id, "feature", F.floor((F.col("_rn") - 1) * bins / F.col("_n")).cast("int").alias("bin"))


def mutual_information(df: DataFrame, features: Sequence[str], target: str, row_id: str, bins: int = 10) -> DataFrame:
    """Binned mutual information with the target per feature (nats). Ranking is what it is for."""
    b = materialize(binned(df, [*features, target], row_id, bins))
    y = b.filter(F.col("feature") == target).select(row_id, F.col("bin").alias("y"))
    joint = b.filter(F.col("feature") != target).join(y, row_id).groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).cast("double").alias("c"))
    # I = ln n + (Σ c ln c − Σ cx ln cx − Σ cy ln cy) / n : three small sums, no joins back.
    xlogx = lambda c: F.sum(F.col(c) * F.log(c))
    part = lambda col, name: joint.groupBy("feature", col).agg(F.sum("c").alias("m")).groupBy("feature").agg(xlogx("m").alias(name))
    total = joint.groupBy("feature").agg(F.sum("c").alias("n"), xlogx("c").alias("s"))
    j = total.join(part("bin", "sx"), "feature").join(part("y", "sy"), "feature")
    return j.select("feature", (F.log("n") + (F.col("s") - F.col("sx") - F.col("sy")) / F.col("n")).alias("mutual_information"))


def redundant(pairs: DataFrame, mi: DataFrame, limit: float = MAX_CORRELATION) -> DataFrame:
    """The weaker feature of every pair with |r| above the limit; equal scores drop the later name."""
    hot = pairs.filter(F.abs("correlation") > limit)
    m1, m2 = (mi.select(F.col("feature").alias(f), F.col("mutual_information").alias(f"{f}_mi")) for f in ("f1", "f2"))
    j = hot.join(m1, "f1").join(m2, "f2")
    tie = F.abs(F.col("f1_mi") - F.col("f2_mi")) < 1e-10
    drop = F.when(tie, F.greatest("f1", "f2")).when(F.col("f1_mi") < F.col("f2_mi"), F.col("f1")).otherwise(F.col("f2"))
    return j.select(drop.alias("feature")).distinct()


def top_k(n: Column, runner: bool = False) -> Column:
    """How many features to keep out of n; the command-line runner has its own limits."""
    lo, hi = ((15, 30), (25, 40)) if runner else ((15, 25), (20, 35))
    half = F.floor(n / 2)
    clamp = lambda a, b: F.greatest(F.lit(a), F.least(F.lit(b), half))
    return F.when(n <= 20, n).when(n <= 50, clamp(*lo)).otherwise(clamp(*hi)).cast("int")


def select_features(df: DataFrame, features: Sequence[str], target: str, row_id: str) -> DataFrame:
    """Variance filter, redundancy filter, then the best by mutual information: feature, score, rank."""
    kept = materialize(variances(df, features).filter("kept")).select("feature")
    names = sorted(r["feature"] for r in kept.collect())  # bounded by the table's width
    mi = materialize(mutual_information(df, names, target, row_id))
    left = mi.join(redundant(correlations(df, names), mi), "feature", "left_anti")
    ranked = row_numbers(left, [], [F.col("mutual_information").desc(), "feature"], "rank")
    n = left.agg(top_k(F.count(F.lit(1))).alias("_k"))
    return ranked.crossJoin(F.broadcast(n)).filter("rank <= _k").drop("_k")


def corrected_skew(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)


def corrected_kurtosis(c: Column) -> Column:
    n = F.count(c).cast("double")
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)


def selection_report(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Per feature: sample variance, correlation with the target, and rule hits."""
    g = _melt(df, features, target).groupBy("feature").agg(F.var_samp("v").alias("variance"), correlation(F.col("v"), F.col(target)).alias("target_correlation"), F.approx_count_distinct("v").alias("_d"))
    issue = (F.when(F.col("variance") < 1e-10, "zero variance").when(F.col("feature").rlike("_[xy]$"), "suffix name")
             .when(F.col("feature").contains("grid_position") & (F.col("_d") > 100), "position range").otherwise("ok"))
    return g.withColumn("issue", issue).drop("_d")


def target_statistics(df: DataFrame, target: str) -> DataFrame:
    y = F.col(target)
    return df.agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"), corrected_skew(y).alias("skewness"), corrected_kurtosis(y).alias("kurtosis"))


def overlap(a: Column, b: Column) -> Column:
    """Shared share of two feature sets."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))


def hashed_sample(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of n rows: smallest keyed hashes first."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))
    return row_numbers(df.withColumn("_h", key), [], ["_h", row_id], "_rn").filter(F.col("_rn") <= n).drop("_h", "_rn")


def split_by_strata(df: DataFrame, stratum: str, shares: Mapping[str, float], seed: int = 42) -> DataFrame:
    """Whole strata go to train / validation / test in hash order; adds ``part``."""
    s = df.select(stratum).distinct().withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(stratum).cast("string"))))
    ranked = row_numbers(s, [], ["_h"], "_rn").crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("_n"))))
    at, edge, part = (F.col("_rn") - 1) / F.col("_n"), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        edge += shares[name]
        cond = at < F.round(F.lit(edge), 9)
        part = F.when(cond, name) if part is None else part.when(cond, name)
    return df.join(ranked.select(stratum, part.otherwise(names[-1]).alias("part")), stratum)


def expected_missing(spark_frame: DataFrame, existing: DataFrame, transforms: Sequence[str], scalers: Sequence[str], algorithms: Sequence[str]) -> DataFrame:
    """Configurations of the (small) grid that are not in ``existing``."""
    one = spark_frame.sparkSession.range(1)
    grid = (one.select(F.explode(F.array(*map(F.lit, transforms))).alias("transform")).withColumn("scaler", F.explode(F.array(*map(F.lit, scalers))))
            .withColumn("algorithm", F.explode(F.array(*map(F.lit, algorithms)))))
    return grid.join(existing, ["transform", "scaler", "algorithm"], "left_anti")


def importance_by_algorithm(importances: DataFrame, top_n: int = 10) -> DataFrame:
    """Top-n of every model, averaged per algorithm, top-n again."""
    keys = ["algorithm", "model"]
    top = row_numbers(importances, keys, [F.col("importance").desc(), "feature"], "_rn").filter(F.col("_rn") <= top_n)
    avg = top.groupBy("algorithm", "feature").agg(F.avg("importance").alias("importance"))
    return row_numbers(avg, ["algorithm"], [F.col("importance").desc(), "feature"], "rank").filter(F.col("rank") <= top_n)


def leaderboard(models: DataFrame) -> DataFrame:
    """Overall rank and rank per target by score."""
    r = row_numbers(models, [], [F.col("score").desc(), "model"], "overall_rank")
    return row_numbers(r, ["target"], [F.col("score").desc(), "model"], "target_rank")


def best_by_metric(models: DataFrame, metric: str, higher: bool = True) -> DataFrame:
    sign = -F.col(metric) if higher else F.col(metric)
    return models.filter(F.col(metric).isNotNull()).agg(F.min_by(F.struct(*models.columns), F.struct(sign, F.col("model"))).alias("_b")).select("_b.*")


def best_grid_size(sizes: DataFrame) -> DataFrame:
    """By Spearman; without any by r2; without any the first row by size."""
    have = sizes.agg(F.count("spearman_r").alias("_s"), F.count("r2").alias("_r"))
    key = F.when(F.col("_s") > 0, F.col("spearman_r")).when(F.col("_r") > 0, F.col("r2")).otherwise(F.lit(0.0))
    j = sizes.crossJoin(F.broadcast(have)).withColumn("_k", key).filter("_k IS NOT NULL")
    return j.agg(F.min_by(F.struct(*sizes.columns), F.struct(-F.col("_k"), F.col("grid_size"))).alias("_b")).select("_b.*")
