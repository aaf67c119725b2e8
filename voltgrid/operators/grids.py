"""City grids: squares in UTM over boundary boxes, variations, coverage filters, quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions import geo
from voltgrid.operators.tiles import bucket

# Default coverage limits and grid options (fixed values).
WATER_LIMIT, URBAN_LIMIT = 0.7, 0.3
SCALES = (0.5, 0.75, 1.0, 1.5, 2.0)
TOUCH = 1e-6


def _settle(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column behind a one-element explode, so that the optimizer does not inline it repeatedly."""
    return df.withColumn(name, F.explode(F.array(value)))


def _project(areas: DataFrame) -> DataFrame:
    """Boundary boxes -> UTM quad in the zone of the box centre, with its bounds."""
    mid_lat, mid_lon = (F.col("min_lat") + F.col("max_lat")) / 2, (F.col("min_lon") + F.col("max_lon")) / 2
    base = areas.withColumn("zone", geo.utm_zone(mid_lon)).withColumn("south", mid_lat < 0)
    corners = F.array(*[F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")) for lat, lon in (
        ("min_lat", "min_lon"), ("min_lat", "max_lon"), ("max_lat", "max_lon"), ("max_lat", "min_lon"))])
    base = _settle(base, "_q", geo.to_utm_points(corners, F.col("zone"), F.col("south")))
    base = base.select("*", *[F.col("_q")[k][c].alias(f"{c}{k}") for k in range(4) for c in "xy"]).drop("_q")
    xs, ys = [f"x{k}" for k in range(4)], [f"y{k}" for k in range(4)]
    return (base.withColumn("bx0", F.least(*xs)).withColumn("bx1", F.greatest(*xs))
            .withColumn("by0", F.least(*ys)).withColumn("by1", F.greatest(*ys)))


def _meets_quad(cx0: Column, cy0: Column, cx1: Column, cy1: Column) -> Column:
    """Cell square meets the boundary quad: no side of the quad has the whole square on its outer side."""
    meets = F.lit(True)
    for a, b in ((0, 1), (1, 2), (2, 3), (3, 0)):
        ax, ay = F.col(f"x{a}"), F.col(f"y{a}")
        dx, dy = F.col(f"x{b}") - ax, F.col(f"y{b}") - ay
        sides = [dx * (cy - ay) - dy * (cx - ax) for cx in (cx0, cx1) for cy in (cy0, cy1)]
        meets = meets & (F.greatest(*sides) >= 0)
    return meets


def _to_geographic(cells: DataFrame) -> DataFrame:
    """Corners, bounds and centre of UTM squares (cx0, cy0, cx1, cy1) in degrees."""
    xy = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("cx0", "cy0", "cx1", "cy1"))
    points = F.array(xy(x0, y0), xy(x1, y0), xy(x1, y1), xy(x0, y1), xy((x0 + x1) / 2, (y0 + y1) / 2))
    out = _settle(cells, "_g", geo.from_utm_points(points, F.col("zone"), F.col("south")))
    ring = F.slice("_g", 1, 4)
    pick = lambda c: F.transform(ring, lambda p: p[c])
    return (out.withColumn("corners", ring)
            .withColumn("min_lat", F.array_min(pick("lat"))).withColumn("max_lat", F.array_max(pick("lat")))
            .withColumn("min_lon", F.array_min(pick("lon"))).withColumn("max_lon", F.array_max(pick("lon")))
            .withColumn("center_lat", F.col("_g")[4]["lat"]).withColumn("center_lon", F.col("_g")[4]["lon"]).drop("_g"))


def utm_cells(areas: DataFrame, pad: float) -> DataFrame:
    """Squares of edge ``size_km`` that meet the boundary; bounds padded by ``pad`` cells on every side.

    ``areas`` has area_id, bounds in degrees and size_km. Rows are spread by (area, column) between the two
    explodes, so that one huge boundary is generated by many tasks.
    """
    size = F.col("size_km") * 1000
    base = _project(areas).withColumn("size_m", size)
    base = (base.withColumn("ox", F.col("bx0") - F.col("size_m") * pad)
            .withColumn("oy", F.col("by0") - F.col("size_m") * pad)
            .withColumn("nx", F.ceil((F.col("bx1") - F.col("bx0") + 2 * pad * F.col("size_m")) / F.col("size_m")))
            .withColumn("ny", F.ceil((F.col("by1") - F.col("by0") + 2 * pad * F.col("size_m")) / F.col("size_m"))))
    columns = base.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)))
    cells = (columns.repartition("area_id", "i")
             .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)))
             .withColumn("cx0", F.col("ox") + F.col("i") * F.col("size_m"))
             .withColumn("cy0", F.col("oy") + F.col("j") * F.col("size_m"))
             .withColumn("cx1", F.col("cx0") + F.col("size_m")).withColumn("cy1", F.col("cy0") + F.col("size_m")))
    keep = _meets_quad(F.col("cx0"), F.col("cy0"), F.col("cx1"), F.col("cy1"))
    return cells.filter(keep).withColumn("area_km2", F.col("size_m") * F.col("size_m") / 1e6)


_WORK = ["zone", "south", *[f"x{k}" for k in range(4)], *[f"y{k}" for k in range(4)], "bx0", "bx1", "by0", "by1",
         "size_m", "ox", "oy", "nx", "ny"]


def _finish(cells: DataFrame, layer: str, keep_utm: bool) -> DataFrame:
    geo_cells = _to_geographic(cells.drop("min_lat", "max_lat", "min_lon", "max_lon"))
    named = geo_cells.withColumn("grid_id", F.concat_ws("_", F.lit(layer), "area_id", "i", "j"))
    return named if keep_utm else named.drop(*_WORK, "cx0", "cy0", "cx1", "cy1")


def primary_grid(areas: DataFrame, size_km: float = 1.0, keep_utm: bool = False) -> DataFrame:
    """Padded, unclipped squares (pad of a quarter cell)."""
    return _finish(utm_cells(areas.withColumn("size_km", F.lit(size_km)), 0.25), "primary", keep_utm)


def polygon_grid(areas: DataFrame, layer: str = "base", size_km: float | None = 1.0) -> DataFrame:
    """Unpadded squares clipped to the boundary box; the area is the clipped one."""
    sized = areas if size_km is None else areas.withColumn("size_km", F.lit(size_km))
    boxed = sized
    for c in ("min_lat", "max_lat", "min_lon", "max_lon"):
        boxed = boxed.withColumn(f"_b_{c}", F.col(c))
    out = _finish(utm_cells(boxed, 0.0), layer, False)
    for lo, hi in (("min_lat", "max_lat"), ("min_lon", "max_lon")):
        out = (out.withColumn(lo, F.greatest(lo, f"_b_{lo}")).withColumn(hi, F.least(hi, f"_b_{hi}")))
    out = (out.filter("min_lat < max_lat AND min_lon < max_lon")
           .withColumn("center_lat", (F.col("min_lat") + F.col("max_lat")) / 2)
           .withColumn("center_lon", (F.col("min_lon") + F.col("max_lon")) / 2)
           .withColumn("area_km2", geo.cell_area_km2(F.col("min_lat"), F.col("max_lat"),
                                                     F.col("min_lon"), F.col("max_lon"))))
    return out.drop("_b_min_lat", "_b_max_lat", "_b_min_lon", "_b_max_lon", "corners").withColumn(
        "corners", F.array(*[F.struct(F.col(x).alias("lon"), F.col(y).alias("lat")) for x, y in (
            ("min_lon", "min_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"), ("min_lon", "max_lat"))]))


def shift_areas(areas: DataFrame, x_km: Column, y_km: Column) -> DataFrame:
    mid = (F.col("min_lat") + F.col("max_lat")) / 2
    return areas.withColumns({
        "min_lon": geo.shift_lon(F.col("min_lon"), x_km, mid), "max_lon": geo.shift_lon(F.col("max_lon"), x_km, mid),
        "min_lat": geo.shift_lat(F.col("min_lat"), y_km), "max_lat": geo.shift_lat(F.col("max_lat"), y_km)})


def variation_parameters(n: int, seed: int = 42, sizes: tuple[float, float] = (0.5, 2.0),
                         offset_km: float = 0.5) -> list[tuple[int, float, float, float]]:
    """(variation, size scale, x offset, y offset): a handful of numbers, drawn on the driver."""
    rng = np.random.RandomState(seed)
    return [(i, float(rng.uniform(*sizes)), float(rng.uniform(-offset_km, offset_km)),
             float(rng.uniform(-offset_km, offset_km))) for i in range(n)]


def _with_parameters(areas: DataFrame, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    structs = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])
    return areas.withColumn("_p", F.explode(structs)).select("*", "_p.*").drop("_p")


def random_grids(areas: DataFrame, n: int = 3, size_km: float = 1.0) -> DataFrame:
    """Seeded size and offset variations, each a clipped polygon grid."""
    p = _with_parameters(areas, variation_parameters(n),
                         ("grid_variation", "size_scale", "offset_x_km", "offset_y_km"))
    shifted = shift_areas(p, F.col("offset_x_km"), F.col("offset_y_km")).withColumn(
        "size_km", F.lit(size_km) * F.col("size_scale"))
    cells = polygon_grid(shifted, "var", None)
    return cells.withColumn("grid_id", F.concat_ws("_", F.lit("var"), "grid_variation", "area_id", "i", "j"))


def multiscale_grids(areas: DataFrame, scales: Sequence[float] = SCALES, size_km: float = 1.0) -> DataFrame:
    p = _with_parameters(areas, [(float(s),) for s in scales], ("grid_scale",)).withColumn(
        "size_km", F.lit(size_km) * F.col("grid_scale")).withColumn("actual_size_km", F.col("size_km"))
    cells = polygon_grid(p, "scale", None)
    return cells.withColumn("grid_id", F.concat_ws("_", F.lit("scale"), "grid_scale", "area_id", "i", "j"))


def comprehensive_grids(areas: DataFrame, n_random: int = 3, scales: Sequence[float] = SCALES,
                        size_km: float = 1.0) -> DataFrame:
    """Base, random and multi-scale layers in one table tagged grid_type; ids carry the layer."""
    base = polygon_grid(areas, "base", size_km).withColumn("grid_type", F.lit("base"))
    var = random_grids(areas, n_random, size_km).withColumn("grid_type", F.lit("random"))
    multi = multiscale_grids(areas, scales, size_km).withColumn("grid_type", F.lit("multiscale"))
    return (base.unionByName(var, allowMissingColumns=True).unionByName(multi, allowMissingColumns=True))


def coverage_filter(cells: DataFrame, shares: DataFrame, water: float = WATER_LIMIT,
                    urban: float = URBAN_LIMIT) -> DataFrame:
    """Keep cells with water share <= ``water`` and urban share >= ``urban``; unknown cells count as 0 / 0."""
    j = cells.join(shares, "grid_id", "left")
    return (j.filter((F.coalesce("water_share", F.lit(0.0)) <= water)
                     & (F.coalesce("urban_share", F.lit(0.0)) >= urban)).drop("water_share", "urban_share"))


def flexible_grid(primary: DataFrame, kept_ids: DataFrame) -> DataFrame:
    """Half-size squares over what the kept primary cells leave open (``primary`` with UTM columns)."""
    open_cells = primary.join(kept_ids.select("grid_id"), "grid_id", "left_anti")
    piece = (open_cells
             .withColumn("px0", F.greatest("cx0", "bx0")).withColumn("px1", F.least("cx1", "bx1"))
             .withColumn("py0", F.greatest("cy0", "by0")).withColumn("py1", F.least("cy1", "by1"))
             .filter("px0 < px1 AND py0 < py1"))
    box = piece.groupBy("area_id").agg(F.min("px0").alias("fx0"), F.max("px1").alias("fx1"),
                                       F.min("py0").alias("fy0"), F.max("py1").alias("fy1"))
    h = F.col("size_m") / 2
    p = piece.join(box, "area_id")

    def span(lo: str, hi: str, origin: str, end: str) -> Column:
        first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(lo) - F.col(origin)) / h - 1 - TOUCH))
        last = F.least(F.floor((F.col(hi) - F.col(origin)) / h + TOUCH),
                       F.ceil((F.col(end) - F.col(origin)) / h - TOUCH) - 1)
        return F.sequence(first, last)

    keys = (p.withColumn("i", F.explode(span("px0", "px1", "fx0", "fx1")))
            .withColumn("j", F.explode(span("py0", "py1", "fy0", "fy1")))
            .select("area_id", "i", "j", "fx0", "fy0", "size_m", "zone", "south").distinct())
    cells = (keys.withColumn("cx0", F.col("fx0") + F.col("i") * h).withColumn("cy0", F.col("fy0") + F.col("j") * h)
             .withColumn("cx1", F.col("cx0") + h).withColumn("cy1", F.col("cy0") + h)
             .withColumn("area_km2", h * h / 1e6))
    return _finish(cells.drop("fx0", "fy0"), "flex", True)


def grid_from_bounds(areas: DataFrame, size_km: float = 1.0, cover: DataFrame | None = None, bucket_size: float = 0.01) -> DataFrame:
    """Primary grid plus the flexible half-size grid over the rest, in the standard cell format.

    ``cover`` are points of known land cover; both layers are filtered by their own shares, the half-size cells more
    strictly. Without it all primary cells stay.
    """
    primary = primary_grid(areas, size_km, keep_utm=True)
    if cover is None:
        return standard_cells(primary)
    kept = coverage_filter(primary, coverage_shares(primary, cover, bucket_size))
    flexible = flexible_grid(primary, kept)
    rest = coverage_filter(flexible, coverage_shares(flexible, cover, bucket_size), WATER_LIMIT * 0.8, URBAN_LIMIT * 1.2)
    return standard_cells(kept).unionByName(standard_cells(rest))


def standard_cells(cells: DataFrame) -> DataFrame:
    """Fixed cell columns; id from grid_id, else cell_id, else the cell order; centre, corners, area filled in."""
    has = lambda c: F.col(c) if c in cells.columns else F.lit(None)
    order = F.format_string("grid_%04d", has("cell_order").cast("long"))
    lo_lat, hi_lat, lo_lon, hi_lon = (F.col(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon"))
    ring = F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in (
        (lo_lon, lo_lat), (hi_lon, lo_lat), (hi_lon, hi_lat), (lo_lon, hi_lat))])
    return cells.select(
        F.coalesce(has("grid_id").cast("string"), has("cell_id").cast("string"), order).alias("grid_id"),
        F.coalesce(has("cell_id").cast("string"), has("grid_id").cast("string"), order).alias("cell_id"),
        "min_lat", "max_lat", "min_lon", "max_lon",
        F.coalesce(has("center_lat").cast("double"), (lo_lat + hi_lat) / 2).alias("center_lat"),
        F.coalesce(has("center_lon").cast("double"), (lo_lon + hi_lon) / 2).alias("center_lon"),
        F.coalesce(has("area_km2").cast("double"), geo.cell_area_km2(lo_lat, hi_lat, lo_lon, hi_lon)).alias("area_km2"),
        (F.coalesce(F.col("corners"), ring) if "corners" in cells.columns else ring).alias("corners"))


def coverage_shares(cells: DataFrame, cover: DataFrame, size: float) -> DataFrame:
    """Water and urban share per cell from points of known land cover (columns lat, lon, cover)."""
    from voltgrid.operators.spatial import points_in_cells

    hits = points_in_cells(cover, cells.select("grid_id", "min_lat", "max_lat", "min_lon", "max_lon"), size)
    return hits.groupBy("grid_id").agg(
        F.avg((F.col("cover") == "water").cast("double")).alias("water_share"),
        F.avg((F.col("cover") == "urban").cast("double")).alias("urban_share"))


def quality_report(cells: DataFrame, areas: DataFrame, size: float, layer: str = "area_id") -> DataFrame:
    """Per layer: cells, overlapping pairs, coverage of the boundary in percent, area statistics.

    Overlaps are looked for only among cells that share a bucket of their extent; a pair is counted in the
    bucket of its overlap's lower corner, hence once.
    """
    span = lambda lo, hi: F.explode(F.sequence(bucket(F.col(lo), size), bucket(F.col(hi), size)))
    box = ["min_lat", "max_lat", "min_lon", "max_lon"]
    spread = (cells.select(layer, "grid_id", *box).withColumn("_bx", span("min_lat", "max_lat"))
              .withColumn("_by", span("min_lon", "max_lon")))
    a, b = spread.alias("a"), spread.alias("b")
    lat0, lat1 = F.greatest("a.min_lat", "b.min_lat"), F.least("a.max_lat", "b.max_lat")
    lon0, lon1 = F.greatest("a.min_lon", "b.min_lon"), F.least("a.max_lon", "b.max_lon")
    # Neighbours that only share a border differ by rounding: an overlap must be wider than a millionth degree.
    hit = (lat1 - lat0 > 1e-6) & (lon1 - lon0 > 1e-6)
    home = (F.col("a._bx") == bucket(lat0, size)) & (F.col("a._by") == bucket(lon0, size))
    pairs = (a.join(b, (F.col(f"a.{layer}") == F.col(f"b.{layer}")) & (F.col("a._bx") == F.col("b._bx"))
                    & (F.col("a._by") == F.col("b._by")) & (F.col("a.grid_id") < F.col("b.grid_id")) & hit & home)
             .groupBy(F.col(f"a.{layer}").alias(layer)).agg(F.count(F.lit(1)).alias("overlapping_pairs")))
    stats = cells.groupBy(layer).agg(
        F.count(F.lit(1)).alias("total_cells"), F.min("area_km2").alias("min_area"), F.max("area_km2").alias("max_area"),
        F.avg("area_km2").alias("mean_area"), F.stddev_pop("area_km2").alias("std_area"),
        F.sum("area_km2").alias("_covered"))
    whole = areas.select(layer, geo.cell_area_km2(*[F.col(c) for c in box]).alias("_whole"))
    return (stats.join(pairs, layer, "left").join(whole, layer)
            .withColumn("overlapping_pairs", F.coalesce("overlapping_pairs", F.lit(0)))
            .withColumn("coverage_pct", 100 * F.col("_covered") / F.col("_whole")).drop("_covered", "_whole"))
