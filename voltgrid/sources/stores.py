"""Sinks and read-backs: scores, training tables, episode logs, placements, metrics, checkpoints, models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPISODE_SCHEMA = "episode long, reward double, total_episodes long, confidence_lower double, confidence_upper double, confidence_width double"


def save_scores(scores: DataFrame, path: str, kwh_weight: float = 0.7, hours_weight: float = 0.3, fmt: str = "csv") -> None:
    """Scores plus a one-row JSON description beside them."""
    scores.write.mode("overwrite").option("header", True).format(fmt).save(f"{path}/scores")
    d = F.col("demand_score")
    meta = scores.agg(F.lit(kwh_weight).alias("kwh_weight"), F.lit(hours_weight).alias("hours_weight"), F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"),
                      F.stddev_samp(d).alias("std"), F.min(d).alias("min"), F.max(d).alias("max"))
    meta.write.mode("overwrite").json(f"{path}/metadata")


def load_scores(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    return spark.read.option("header", True).schema(schema).format(fmt).load(f"{path}/scores")


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/metadata")


def save_training(table: DataFrame, path: str, fmt: str = "parquet") -> None:
    table.write.mode("overwrite").option("header", True).format(fmt).save(path)


def save_episodes(runs: DataFrame, path: str) -> None:
    """Run rows with reward arrays -> one row per episode (1-based), partitioned by grid and method."""
    rows = runs.select("grid_id", "method", F.size("rewards").alias("total_episodes"), F.posexplode("rewards").alias("i", "reward"))
    rows.withColumn("episode", F.col("i") + 1).drop("i").write.mode("overwrite").partitionBy("grid_id", "method").parquet(path)


def station_coordinates(best_runs: DataFrame, placements: DataFrame) -> DataFrame:
    """Stations of the best method of each grid, numbered ``grid_<k>`` within the grid; no placements, no rows."""
    from voltgrid.operators.ordered import row_numbers

    p = placements.join(best_runs.select("grid_id", "method", "best_reward"), ["grid_id", "method"])
    numbered = row_numbers(p, ["grid_id"], ["lat", "lon", "edge_id"], "k")
    return numbered.select(F.concat_ws("_", "grid_id", F.col("k").cast("string")).alias("id"), "grid_id", "method", "lat", "lon", F.col("best_reward").alias("reward"))


def save_metrics(metrics: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Metric table as JSON and CSV."""
    metrics.write.mode("overwrite").partitionBy(*by).json(f"{path}/json")
    metrics.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def report_tables(runs: DataFrame) -> dict[str, DataFrame]:
    """Flat report tables of nested run rows: raw, convergence and bandit statistics."""
    return {"raw": runs.select("grid_id", "method", "stats.best_reward", "stats.average_reward"),
            "convergence": runs.select("grid_id", "method", "stats.convergence_achieved", "stats.convergence_episode"),
            "bandit": runs.select("grid_id", "method", "stats.total_episodes", "stats.action_diversity", "stats.cumulative_regret")}


def save_checkpoints(results: DataFrame, path: str, config: Sequence[str]) -> None:
    """Append results with the fingerprint of their configuration."""
    key = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in config]), 256)
    results.withColumn("config_hash", key).write.mode("append").parquet(path)


def append_summary(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def save_feature_list(spark: SparkSession, features: Sequence[str], path: str) -> None:
    spark.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, position int").coalesce(1).write.mode("overwrite").json(path)


def load_feature_list(spark: SparkSession, path: str) -> list[str]:
    """Selected features in order; a list of model columns, bounded by the feature table's width."""
    return [r["feature"] for r in spark.read.schema("feature string, position int").json(path).orderBy("position").collect()]
