"""Training table: features, demand and cell centres joined once, one coordinate pair per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def training_table(features: DataFrame, demand: DataFrame, cells: DataFrame) -> DataFrame:
    centres = cells.select("grid_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    joined = features.join(demand, "grid_id").join(centres, "grid_id", "left")
    lat = [F.col("latitude")] if "latitude" in joined.columns else []
    lon = [F.col("longitude")] if "longitude" in joined.columns else []
    return (joined.withColumn("latitude", F.coalesce(*lat, F.col("_lat")))
            .withColumn("longitude", F.coalesce(*lon, F.col("_lon"))).drop("_lat", "_lon"))
