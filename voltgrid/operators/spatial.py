"""Points in cells as a bucketed equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions import geo
from voltgrid.operators.tiles import bucket

SALTS = 8


def _cell_buckets(cells: DataFrame, size: float, salts: int) -> DataFrame:
    """A cell row per bucket it touches and per salt."""
    span = lambda lo, hi: F.explode(F.sequence(bucket(F.col(lo), size), bucket(F.col(hi), size)))
    return (cells.withColumn("_bx", span("min_lat", "max_lat")).withColumn("_by", span("min_lon", "max_lon"))
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))


def points_in_cells(points: DataFrame, cells: DataFrame, size: float, how: str = "inner",
                    predicate: str = "within", salts: int = SALTS) -> DataFrame:
    """Join points (lat, lon) to cells (grid_id, bounds).

    ``within`` is strict, ``intersects`` includes the border, ``ring`` tests the corner polygon strictly.
    Busy buckets are spread by a salt on the point side; the cell side, the small one, is repeated per salt.
    ``size`` is the bucket edge in degrees, best near the cell edge.
    """
    extra = [c for c in cells.columns if c in points.columns]
    tiles = _cell_buckets(cells.drop(*extra), size, salts)
    keyed = (points.withColumn("_bx", bucket(F.col("lat"), size)).withColumn("_by", bucket(F.col("lon"), size))
             .withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int")))
    lat, lon = F.col("lat"), F.col("lon")
    box = [F.col(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")]
    if predicate == "within":
        test = geo.strictly_inside_box(lat, lon, *box)
    elif predicate == "intersects":
        test = geo.touches_box(lat, lon, *box)
    else:
        test = geo.strictly_inside_ring(lat, lon, F.col("corners"))
    a, b = keyed.alias("a"), tiles.alias("b")
    on = (F.col("a._bx") == F.col("b._bx")) & (F.col("a._by") == F.col("b._by")) & (
        F.col("a._salt") == F.col("b._salt")) & test
    return a.join(b, on, how).drop("_bx", "_by", "_salt")


def one_cell_per_point(matches: DataFrame, point_id: str, pick: str = "lowest") -> DataFrame:
    """Keep one match per point: lowest grid_id, or the last cell in ``cell_order`` (overwriting map)."""
    key = F.struct(*[F.col(c) for c in matches.columns])
    chosen = F.min_by(key, F.col("grid_id")) if pick == "lowest" else F.max_by(key, F.col("cell_order"))
    return matches.groupBy(point_id).agg(chosen.alias("_r")).select("_r.*")
