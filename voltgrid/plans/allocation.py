"""End to end: charging readings -> demand per cell -> stations per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.operators import allocation, demand, spatial


def stations_in_cells(scored: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """One cell per station; where cells overlap the last one in cell order wins."""
    pts = scored.withColumn("lat", F.col("latitude")).withColumn("lon", F.col("longitude"))
    hits = spatial.points_in_cells(pts, cells.select("grid_id", "cell_order", "min_lat", "max_lat",
                                                     "min_lon", "max_lon"), size)
    return spatial.one_cell_per_point(hits, "station_id", "last")


def station_allocation(readings: DataFrame, stations: DataFrame, cells: DataFrame, size: float,
                       budget: int, period: str = "W") -> DataFrame:
    # The readings are scanned once: everything after the station totals works on the small written result.
    scored = demand.score_stations(materialize(demand.station_metrics(readings, stations, period)))
    grid = materialize(demand.grid_demand(stations_in_cells(scored, cells, size)))
    return allocation.largest_remainder(grid, budget).select(
        "grid_id", "num_stations", "demand_score", "share", "stations")
