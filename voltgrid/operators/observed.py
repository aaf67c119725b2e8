"""What the observed trajectory points say per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.onerow import with_globals, with_group_stats


def demand_by_cell(located: DataFrame) -> DataFrame:
    """Distinct vehicles and events per cell; the score is the mean of both relative to their maxima."""
    g = located.groupBy("grid_id").agg(F.count_distinct("veh_id").alias("unique_vehicles"),
                                       F.count(F.lit(1)).alias("total_events"))
    out = with_globals(g, F.max("unique_vehicles").alias("_mv"), F.max("total_events").alias("_me"))
    score = (F.col("unique_vehicles") / F.col("_mv") + F.col("total_events") / F.col("_me")) / 2
    return out.withColumn("actual_demand", score).drop("_mv", "_me")


def weekly_coverage(located: DataFrame, cells: DataFrame) -> DataFrame:
    n = cells.agg(F.count(F.lit(1)).alias("_n"))
    weeks = located.groupBy("week").agg(F.count_distinct("grid_id").alias("cells"))
    return weeks.crossJoin(F.broadcast(n)).withColumn("coverage_pct", 100 * F.col("cells") / F.col("_n")).drop("_n")


def activity(located: DataFrame) -> DataFrame:
    return located.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"))


def composition(cells: DataFrame, column: str) -> DataFrame:
    counts = cells.groupBy(column).agg(F.count(F.lit(1)).alias("cells"))
    out = with_globals(counts, F.sum("cells").alias("_all"))
    return out.withColumn("pct", 100 * F.col("cells") / F.col("_all")).drop("_all")


def grid_trajectories(located: DataFrame, min_points: int = 2) -> DataFrame:
    """Points of vehicles with at least ``min_points`` points in the cell."""
    n = with_group_stats(located, ["grid_id", "veh_id"], F.count(F.lit(1)).alias("_n"))
    return n.filter(F.col("_n") >= min_points).drop("_n")


def busiest_grid(located: DataFrame, wanted: str | None = None) -> DataFrame:
    counts = activity(located)
    if wanted is not None:
        return counts.filter(F.col("grid_id") == wanted)
    return counts.orderBy(F.col("n").desc(), "grid_id").limit(1)


def grids_by_count(located: DataFrame) -> DataFrame:
    n = F.col("n")
    level = F.when(n > 100, "high").when(n > 10, "medium").otherwise("low")
    return activity(located).withColumn("data_level", level).orderBy(n.desc(), "grid_id")
