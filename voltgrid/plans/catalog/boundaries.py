"""Grids over boundaries of any shape. The check SQL measures areas by integrals along the sides, not by clipping."""

from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.operators import grids, polygons
from voltgrid.plans.catalog.demand import r6
from voltgrid.plans.catalog.grids import _ZONE, geo_sql, utm_sql
from voltgrid.plans.registry import query, view

_X, _Y = utm_sql("lat", "lon", "zone")


def _sides(name: str, source: str, key: str, zone: str) -> None:
    """View of ring sides in metres: (key, ring, xa, ya, xb, yb)."""
    view(name, f"""SELECT {key}, ring, xa, ya, coalesce(lead(xa) OVER w, first_value(xa) OVER w) AS xb, coalesce(lead(ya) OVER w, first_value(ya) OVER w) AS yb
 FROM (SELECT c.*, {_X} AS xa, {_Y} AS ya FROM (SELECT c.*, z.zone FROM {source} c JOIN {zone} z ON z.area_id = c.area_id) c) q
 WINDOW w AS (PARTITION BY {key}, ring ORDER BY pos)""")


view("v_ring_zone", f"""SELECT area_id, {_ZONE.format('(min(lon) + max(lon)) / 2')} AS zone FROM fx_ring_corners WHERE ring = 0 GROUP BY 1""")
_sides("v_ring_side", "fx_ring_corners", "area_id", "v_ring_zone")
view("v_ring_box", """SELECT s.area_id, z.zone, min(xa) AS bx0, max(xa) AS bx1, min(ya) AS by0, max(ya) AS by1 FROM v_ring_side s
 JOIN v_ring_zone z ON z.area_id = s.area_id WHERE ring = 0 GROUP BY 1, 2""")


def _integral(rect: str) -> str:
    """Area under the side (xa, ya, xb, yb) inside the rectangle x0, x1, y0, y1: signed by the direction of the side."""
    clamp = lambda v, a, b: f"least(greatest({v}, {a}), {b})"
    upto = lambda t: f"(pow({clamp(t, 'y0', 'y1')} - y0, 2) / 2 + greatest({t} - y1, 0) * (y1 - y0))"
    return f"""SELECT *, CASE WHEN abs(yv - yu) < 1e-9 THEN (v - u) * ({clamp('yu', 'y0', 'y1')} - y0) ELSE (v - u) / (yv - yu) * ({upto('yv')} - {upto('yu')}) END AS part
 FROM (SELECT *, CASE WHEN xa = xb THEN ya ELSE ya + (u - xa) * (yb - ya) / (xb - xa) END AS yu, CASE WHEN xa = xb THEN ya ELSE ya + (v - xa) * (yb - ya) / (xb - xa) END AS yv
 FROM (SELECT *, {clamp('xa', 'x0', 'x1')} AS u, {clamp('xb', 'x0', 'x1')} AS v FROM {rect}) a) b"""


def _grid(name: str, pad: float) -> None:
    """Views of a grid over the boundaries: cells with their area inside, and the points that span what is inside."""
    view(f"{name}_all", f"""SELECT b.*, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, bx0 - {pad} * 1000 + i * 1000 AS x0, bx0 - {pad} * 1000 + i * 1000 + 1000 AS x1,
 by0 - {pad} * 1000 + j * 1000 AS y0, by0 - {pad} * 1000 + j * 1000 + 1000 AS y1 FROM v_ring_box b,
 generate_series(0, CAST(ceil((bx1 - bx0 + 2 * {pad} * 1000) / 1000) AS BIGINT) - 1) gi(i), generate_series(0, CAST(ceil((by1 - by0 + 2 * {pad} * 1000) / 1000) AS BIGINT) - 1) gj(j)""")
    cells = f"(SELECT c.area_id, c.i, c.j, c.zone, c.x0, c.x1, c.y0, c.y1, s.ring, s.xa, s.ya, s.xb, s.yb FROM {name}_all c JOIN v_ring_side s ON s.area_id = c.area_id) r"
    view(f"{name}_in", f"""SELECT area_id, i, j, zone, x0, x1, y0, y1, sum(CASE WHEN ring = 0 THEN m2 ELSE -m2 END) AS m2 FROM
 (SELECT area_id, i, j, zone, x0, x1, y0, y1, ring, abs(sum(part)) AS m2 FROM ({_integral(cells)}) q GROUP BY ALL) p GROUP BY ALL HAVING sum(CASE WHEN ring = 0 THEN m2 ELSE -m2 END) > 1e-3""")
    view(f"{name}_cut", f"""SELECT *, greatest(0, CASE WHEN xb > xa THEN (x0 - xa) / (xb - xa) WHEN xb < xa THEN (x1 - xa) / (xb - xa) ELSE 0 END,
 CASE WHEN yb > ya THEN (y0 - ya) / (yb - ya) WHEN yb < ya THEN (y1 - ya) / (yb - ya) ELSE 0 END) AS t0, least(1, CASE WHEN xb > xa THEN (x1 - xa) / (xb - xa) WHEN xb < xa THEN (x0 - xa) / (xb - xa) ELSE 1 END,
 CASE WHEN yb > ya THEN (y1 - ya) / (yb - ya) WHEN yb < ya THEN (y0 - ya) / (yb - ya) ELSE 1 END) AS t1
 FROM (SELECT c.*, s.xa, s.ya, s.xb, s.yb FROM {name}_in c JOIN v_ring_side s ON s.area_id = c.area_id AND s.ring = 0) q""")
    view(f"{name}_pt", f"""SELECT area_id, i, j, zone, xa + t * (xb - xa) AS x, ya + t * (yb - ya) AS y FROM (SELECT *, unnest([t0, t1]) AS t FROM {name}_cut WHERE t0 <= t1) q
 UNION ALL SELECT area_id, i, j, zone, x, y FROM (SELECT c.area_id, c.i, c.j, c.zone, k.x, k.y, count_if((s.ya > k.y) <> (s.yb > k.y) AND k.x < (s.xb - s.xa) * (k.y - s.ya) / (s.yb - s.ya) + s.xa) AS n
 FROM {name}_in c, LATERAL (VALUES (x0, y0), (x1, y0), (x1, y1), (x0, y1)) k(x, y), v_ring_side s WHERE s.area_id = c.area_id AND s.ring = 0 GROUP BY ALL) q WHERE n % 2 = 1""")


_grid("v_pring", 0.25)
_grid("v_ring", 0)
_ID = "'{}_' || area_id || '_' || i || '_' || j AS grid_id"
_LAT, _LON = geo_sql("x", "y", "zone")


def _box(points: str) -> str:
    return f"SELECT area_id, i, j, round(min({_LAT}), 6) AS min_lat, round(max({_LAT}), 6) AS max_lat, round(min({_LON}), 6) AS min_lon, round(max({_LON}), 6) AS max_lon FROM {points} GROUP BY 1, 2, 3"


def boundaries(t):
    return polygons.boundary_rings(t.fx("ring_corners"))


def land_cover(t):
    return polygons.boundary_rings(t.fx("cover_corners"), "shape_id", "area_id", "cover").drop("shape_id")


@query("prj10_offset_rings", """SELECT c.area_id, ring, pos, round(lat + (-0.5) / 111.32, 6) AS lat, round(lon + 0.3 / (111.32 * cos(radians(mid))), 6) AS lon FROM fx_ring_corners c
 JOIN (SELECT area_id, (min(lat) + max(lat)) / 2 AS mid FROM fx_ring_corners WHERE ring = 0 GROUP BY 1) m ON m.area_id = c.area_id""")
def _(t):
    rings = polygons.shift_rings(boundaries(t), F.lit(0.3), F.lit(-0.5)).select("area_id", F.posexplode("rings").alias("ring", "r"))
    return rings.select("area_id", "ring", F.posexplode("r").alias("pos", "c")).select("area_id", "ring", "pos", "c.*").select("area_id", "ring", "pos", *r6("lat", "lon"))


@query("gen01_primary_rings", f"SELECT {_ID.format('primary')}, min_lat, max_lat, min_lon, max_lon, 1e0 AS area_km2 FROM ("
       + _box("(SELECT area_id, i, j, zone, k.x, k.y FROM v_pring_in, LATERAL (VALUES (x0, y0), (x1, y0), (x1, y1), (x0, y1)) k(x, y)) q") + ") b")
def _(t):
    return polygons.primary_grid(boundaries(t)).select("grid_id", *r6("min_lat", "max_lat", "min_lon", "max_lon"), "area_km2")


@query("gen29_clipped_rings", f"""SELECT {_ID.format('base').replace('area_id', 'b.area_id').replace(' i ', ' b.i ').replace(' j ', ' b.j ')}, min_lat, max_lat, min_lon, max_lon, round(m2 / 1e6, 6) AS area_km2
 FROM ({_box('v_ring_pt')}) b JOIN v_ring_in c ON c.area_id = b.area_id AND c.i = b.i AND c.j = b.j""")
def _(t):
    return polygons.polygon_grid(boundaries(t)).select("grid_id", *r6("min_lat", "max_lat", "min_lon", "max_lon", "area_km2"))


@query("gen29_ring_totals", """SELECT r.area_id, count(*) AS cells, round(max(r.m2) / 1e6, 5) AS ring_km2, round(sum(c.m2) / 1e6, 5) AS cells_km2 FROM (SELECT area_id,
 sum(CASE WHEN ring = 0 THEN a ELSE -a END) AS m2 FROM (SELECT area_id, ring, abs(sum(xa * yb - xb * ya)) / 2 AS a FROM v_ring_side GROUP BY 1, 2) q GROUP BY 1) r JOIN v_ring_in c ON c.area_id = r.area_id GROUP BY 1""")
def _(t):
    areas = boundaries(t)
    cells = polygons.polygon_grid(areas).groupBy("area_id").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("area_km2") + 1e-9, 5).alias("cells_km2"))
    return cells.join(polygons.ring_totals(areas), "area_id").select("area_id", "cells", F.round(F.col("area_km2") + 1e-9, 5).alias("ring_km2"), "cells_km2")


# --- land cover by area -------------------------------------------------------------------------------------
_sides("v_cover_side", "fx_cover_corners", "area_id, shape_id, cover", "v_ring_zone")
_PAIR = """(SELECT c.area_id, c.i, c.j, c.x0, c.x1, c.y0, c.y1, s.shape_id, s.cover, s.xa, s.ya, s.xb, s.yb FROM (SELECT *, min(xa) OVER s AS sx0, max(xa) OVER s AS sx1 FROM v_cover_side
 WINDOW s AS (PARTITION BY area_id, shape_id)) s JOIN v_pring_in c ON c.area_id = s.area_id AND c.x0 < s.sx1 AND c.x1 > s.sx0) r"""
view("v_cover_part", f"SELECT area_id, i, j, shape_id, cover, abs(sum(part)) AS m2 FROM ({_integral(_PAIR)}) q GROUP BY ALL")
view("v_cover_share", """SELECT area_id, i, j, least(1, sum(CASE WHEN cover = 'water' THEN m2 ELSE 0 END) / 1e6) AS water_share, least(1, sum(CASE WHEN cover = 'urban' THEN m2 ELSE 0 END) / 1e6) AS urban_share
 FROM v_cover_part WHERE m2 > 1e-8 GROUP BY 1, 2, 3""")
_WATER, _URBAN = 0.1, 0.03
view("v_ring_kept", f"""SELECT c.* FROM v_pring_in c LEFT JOIN v_cover_share s ON s.area_id = c.area_id AND s.i = c.i AND s.j = c.j
 WHERE coalesce(water_share, 0) <= {_WATER} AND coalesce(urban_share, 0) >= {_URBAN}""")


@query("gen02_cover_by_area", f"SELECT {_ID.format('primary')}, round(water_share, 6) AS water_share, round(urban_share, 6) AS urban_share FROM v_cover_share")
def _(t):
    cells = materialize(polygons.primary_grid(boundaries(t), keep_utm=True).drop("piece"))
    return polygons.cover_shares(cells, land_cover(t)).select("grid_id", *r6("water_share", "urban_share"))


view("v_ring_open", """SELECT c.* FROM v_pring_in c LEFT JOIN v_ring_kept k ON k.area_id = c.area_id AND k.i = c.i AND k.j = c.j WHERE k.area_id IS NULL""")
view("v_open_ends", """SELECT p.area_id, min(x) AS ox, max(x) AS ex, min(y) AS oy, max(y) AS ey FROM v_pring_pt p JOIN v_ring_open o ON o.area_id = p.area_id AND o.i = p.i AND o.j = p.j GROUP BY 1""")
view("v_half", """SELECT e.area_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, ox + i * 500 - 5e-4 AS hx0, ox + i * 500 + 500 + 5e-4 AS hx1, oy + j * 500 - 5e-4 AS hy0, oy + j * 500 + 500 + 5e-4 AS hy1
 FROM v_open_ends e, generate_series(0, CAST(ceil((ex - ox) / 500 - 1e-6) AS BIGINT) - 1) gi(i), generate_series(0, CAST(ceil((ey - oy) / 500 - 1e-6) AS BIGINT) - 1) gj(j)""")
_MET = """(SELECT h.area_id, h.i, h.j, o.i AS oi, o.j AS oj, greatest(hx0, o.x0) AS x0, least(hx1, o.x1) AS x1, greatest(hy0, o.y0) AS y0, least(hy1, o.y1) AS y1, s.ring, s.xa, s.ya, s.xb, s.yb
 FROM v_half h JOIN v_ring_open o ON o.area_id = h.area_id AND hx0 <= o.x1 AND hx1 >= o.x0 AND hy0 <= o.y1 AND hy1 >= o.y0 JOIN v_ring_side s ON s.area_id = h.area_id) r"""
view("v_half_in", f"""SELECT DISTINCT area_id, i, j FROM (SELECT area_id, i, j, oi, oj, sum(CASE WHEN ring = 0 THEN m2 ELSE -m2 END) AS m2 FROM
 (SELECT area_id, i, j, oi, oj, ring, abs(sum(part)) AS m2 FROM ({_integral(_MET)}) q GROUP BY ALL) p GROUP BY ALL) d WHERE m2 > 1e-8""")


@query("gen03_flexible_rings", f"SELECT {_ID.format('flex')}, 0.25e0 AS area_km2 FROM v_half_in")
def _(t):
    cells = materialize(polygons.primary_grid(boundaries(t), keep_utm=True))
    kept = grids.coverage_filter(cells, polygons.cover_shares(cells, land_cover(t)), _WATER, _URBAN)
    return polygons.flexible_grid(cells, kept).select("grid_id", "area_km2")
