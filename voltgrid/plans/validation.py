"""Demand validation: observed demand per cell against a prediction, for several grid sizes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.functions.onerow import with_group_stats
from voltgrid.operators.spatial import points_in_cells
from voltgrid.operators.targets import regression_metrics


def observed_and_predicted(points: DataFrame, elements: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Per cell of every grid size: observed demand score, and element density as the stand-in prediction.

    A caller with a trained model joins its predictions instead of the density.
    """
    box = cells.select("grid_id", "grid_scale", "area_km2", "min_lat", "max_lat", "min_lon", "max_lon")
    seen = points_in_cells(points, box, size).groupBy("grid_scale", "grid_id").agg(
        F.max("area_km2").alias("area_km2"), F.count_distinct("veh_id").alias("uv"), F.count(F.lit(1)).alias("te"))
    score = with_group_stats(materialize(seen), ["grid_scale"], F.max("uv").alias("_mv"), F.max("te").alias("_me"))
    n = points_in_cells(elements, box, size).groupBy("grid_id").agg(F.count(F.lit(1)).alias("ne"))
    return score.join(n, "grid_id", "left").select(
        F.col("grid_scale").alias("grid_size"), "grid_id", F.round((F.col("uv") / F.col("_mv") + F.col("te") / F.col("_me")) / 2, 9).alias("actual"),
        F.round(F.coalesce("ne", F.lit(0)) / F.col("area_km2"), 6).alias("predicted"))


def grid_size_sensitivity(points: DataFrame, elements: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    pairs = materialize(observed_and_predicted(points, elements, cells, size))
    return regression_metrics(pairs, ["grid_size"], "actual", "predicted")
