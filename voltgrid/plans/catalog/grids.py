"""Grids, spatial joins and cell counts."""

from pyspark.sql import functions as F

from voltgrid.functions import geo
from voltgrid.operators import grids, observed, spatial
from voltgrid.plans.catalog.demand import r6, rnd
from voltgrid.plans.registry import query, view

# --- UTM in SQL text for the checks --------------------------------------------------------------------------
_A, _F = "6378137e0", "(1e0 / 298.257223563e0)"
_N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
_R = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64) * 0.9996
_AL = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BE = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_E = 2 * _N**0.5 / (1 + _N)


def utm_sql(lat, lon, zone):
    """(x, y) SQL text; northern hemisphere."""
    s = f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {_E!r} * atanh({_E!r} * {s}))"
    lam = f"(radians({lon}) - radians({zone} * 6e0 - 183))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + pow({t}, 2)))"
    x = " + ".join([eta] + [f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(_AL, 1)])
    y = " + ".join([xi] + [f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(_AL, 1)])
    return f"(500000 + {_R!r} * ({x}))", f"({_R!r} * ({y}))"


def geo_sql(x, y, zone):
    """(lat, lon) SQL text; northern hemisphere."""
    xi0, eta0 = f"(({y}) / {_R!r})", f"((({x}) - 500000) / {_R!r})"
    xi = "(" + xi0 + "".join(f" - {b!r} * sin({2 * j} * {xi0}) * cosh({2 * j} * {eta0})" for j, b in enumerate(_BE, 1)) + ")"
    eta = "(" + eta0 + "".join(f" - {b!r} * cos({2 * j} * {xi0}) * sinh({2 * j} * {eta0})" for j, b in enumerate(_BE, 1)) + ")"
    chi = f"asin(sin({xi}) / cosh({eta}))"
    lat = f"degrees({chi}" + "".join(f" + {d!r} * sin({2 * j} * {chi})" for j, d in enumerate(_DE, 1)) + ")"
    lon = f"degrees(radians({zone} * 6e0 - 183) + atan2(sinh({eta}), cos({xi})))"
    return lat, lon


_ZONE = "CAST(floor((({}) + 180) / 6) + 1 AS INT)"
_X, _Y = utm_sql("latitude", "longitude", "zone")


@query("prj11_utm_projection", f"""SELECT station_id, zone, 32600 + zone AS epsg, round({_X}, 3) AS x,
 round({_Y}, 3) AS y, round(latitude, 6) AS back_lat, round(longitude, 6) AS back_lon FROM
 (SELECT *, {_ZONE.format('longitude')} AS zone FROM fx_stations) q""")
def _(t):
    lat, lon = F.col("latitude"), F.col("longitude")
    s = t.fx("stations").withColumn("zone", geo.utm_zone(lon)).withColumn("epsg", geo.utm_epsg(lat, lon))
    south = F.col("latitude") < 0
    s = s.withColumn("p", geo.to_utm_points(F.array(F.struct(lat.alias("lat"), lon.alias("lon"))), F.col("zone"), south))
    s = s.withColumn("b", geo.from_utm_points(F.col("p"), F.col("zone"), south)[0]).withColumn("p", F.col("p")[0])
    return s.select("station_id", "zone", "epsg", rnd("p.x", 3).alias("x"), rnd("p.y", 3).alias("y"),
                    rnd("b.lat", 6).alias("back_lat"), rnd("b.lon", 6).alias("back_lon"))


@query("prj12_haversine", """SELECT osmid, round(2 * 6371 * asin(sqrt(h)), 6) AS km_asin,
 round(6371 * 2 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km_atan2 FROM (SELECT osmid,
 pow(sin(radians(42.28 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(42.28))
 * pow(sin(radians(-83.74 - lon) / 2), 2) AS h FROM fx_elements) q""")
def _(t):
    args = (F.col("lat"), F.col("lon"), F.lit(42.28), F.lit(-83.74))
    return t.fx("elements").select("osmid", rnd(geo.haversine_km(*args), 6).alias("km_asin"),
                                   rnd(geo.haversine_km_atan2(*args), 6).alias("km_atan2"))


_AREA = "((max_lat - min_lat) * 111.32 * (max_lon - min_lon) * 111.32 * cos(radians((min_lat + max_lat) / 2)))"


@query("prj08_cell_area", f"""SELECT area_id, round({_AREA}, 6) AS area_km2,
 round(greatest({_AREA} / 2500, 0.01), 6) AS floored_km2 FROM fx_areas""")
def _(t):
    b = [F.col(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")]
    return t.fx("areas").select("area_id", rnd(geo.cell_area_km2(*b), 6).alias("area_km2"),
                                rnd(F.greatest(geo.cell_area_km2(*b) / 2500, F.lit(0.01)), 6).alias("floored_km2"))


@query("prj09_standard_cells", f"""SELECT CASE WHEN n % 3 = 0 THEN 'g' || n WHEN n % 3 = 1 THEN 'c' || n ELSE
 'grid_' || lpad(CAST(n AS VARCHAR), 4, '0') END AS grid_id, round((min_lat + max_lat) / 2, 6) AS center_lat,
 round((min_lon + max_lon) / 2, 6) AS center_lon, round({_AREA}, 6) AS area_km2, 4 AS n_corners FROM
 (SELECT *, CAST(area_id AS INT) AS n FROM fx_areas) q""")
def _(t):
    n = F.col("area_id").cast("int")
    a = t.fx("areas").select("min_lat", "max_lat", "min_lon", "max_lon", n.alias("cell_order"),
                             F.when(n % 3 == 0, F.concat(F.lit("g"), n)).alias("grid_id"),
                             F.when(n % 3 == 1, F.concat(F.lit("c"), n)).alias("cell_id"))
    return grids.standard_cells(a).select("grid_id", *r6("center_lat", "center_lon", "area_km2"),
                                          F.size("corners").alias("n_corners"))


@query("prj10_offset_boundary", """SELECT area_id, round(min_lat + (-0.5) / 111.32, 6) AS min_lat, round(max_lat + (-0.5) / 111.32, 6) AS max_lat,
 round(min_lon + 0.3 / (111.32 * cos(radians((min_lat + max_lat) / 2))), 6) AS min_lon,
 round(max_lon + 0.3 / (111.32 * cos(radians((min_lat + max_lat) / 2))), 6) AS max_lon FROM fx_areas""")
def _(t):
    return grids.shift_areas(t.fx("areas"), F.lit(0.3), F.lit(-0.5)).select(
        "area_id", *r6("min_lat", "max_lat", "min_lon", "max_lon"))


# --- grids over areas ---------------------------------------------------------------------------------------
def _project_view(name, source, pad):
    corners = (("min_lat", "min_lon"), ("min_lat", "max_lon"), ("max_lat", "max_lon"), ("max_lat", "min_lon"))
    cols = ", ".join(f"{utm_sql(la, lo, 'zone')[i]} AS {'xy'[i]}{k}" for k, (la, lo) in enumerate(corners) for i in (0, 1))
    view(f"{name}_p", f"""SELECT *, least(x0, x1, x2, x3) AS bx0, greatest(x0, x1, x2, x3) AS bx1,
 least(y0, y1, y2, y3) AS by0, greatest(y0, y1, y2, y3) AS by1 FROM (SELECT *, {cols} FROM
 (SELECT *, {_ZONE.format('(min_lon + max_lon) / 2')} AS zone, size_km * 1000 AS size_m FROM {source}) a) b""")
    sides = []
    for a, b in ((0, 1), (1, 2), (2, 3), (3, 0)):
        vals = ", ".join(f"(x{b} - x{a}) * ({cy} - y{a}) - (y{b} - y{a}) * ({cx} - x{a})"
                         for cx in ("cx0", "cx1") for cy in ("cy0", "cy1"))
        sides.append(f"greatest({vals}) >= 0")
    lat, lon = {}, {}
    for k, (x, y) in enumerate((("cx0", "cy0"), ("cx1", "cy0"), ("cx1", "cy1"), ("cx0", "cy1"))):
        lat[k], lon[k] = geo_sql(x, y, "zone")
    view(f"{name}_u", f"""SELECT * FROM (SELECT *, cx0 + size_m AS cx1, cy0 + size_m AS cy1 FROM
 (SELECT p.*, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, bx0 - size_m * {pad} + i * size_m AS cx0, by0 - size_m * {pad} + j * size_m AS cy0
 FROM {name}_p p, generate_series(0, CAST(ceil((bx1 - bx0 + 2 * {pad} * size_m) / size_m) AS BIGINT) - 1) gi(i),
 generate_series(0, CAST(ceil((by1 - by0 + 2 * {pad} * size_m) / size_m) AS BIGINT) - 1) gj(j)) a) b WHERE {' AND '.join(sides)}""")
    la = ", ".join(f"{lat[k]} AS la{k}, {lon[k]} AS lo{k}" for k in range(4))
    view(f"{name}_g", f"""SELECT u.* EXCLUDE (min_lat, max_lat, min_lon, max_lon),
 u.min_lat AS b0, u.max_lat AS b1, u.min_lon AS b2, u.max_lon AS b3,
 least(la0, la1, la2, la3) AS min_lat, greatest(la0, la1, la2, la3) AS max_lat,
 least(lo0, lo1, lo2, lo3) AS min_lon, greatest(lo0, lo1, lo2, lo3) AS max_lon
 FROM (SELECT *, {la} FROM {name}_u) u""")
    view(f"{name}_c", f"""SELECT *, {_AREA} AS area_km2 FROM (SELECT * EXCLUDE (min_lat, max_lat, min_lon, max_lon),
 greatest(min_lat, b0) AS min_lat, least(max_lat, b1) AS max_lat, greatest(min_lon, b2) AS min_lon,
 least(max_lon, b3) AS max_lon FROM {name}_g) q WHERE min_lat < max_lat AND min_lon < max_lon""")


view("v_area1", "SELECT *, 1e0 AS size_km FROM fx_areas")
_project_view("v_pri", "v_area1", 0.25)
_project_view("v_base", "v_area1", 0)
_PAR = grids.variation_parameters(3)
view("v_area_var", "SELECT area_id, min_lat + oy / 111.32 AS min_lat, max_lat + oy / 111.32 AS max_lat, "
     "min_lon + ox / (111.32 * cos(radians((min_lat + max_lat) / 2))) AS min_lon, "
     "max_lon + ox / (111.32 * cos(radians((min_lat + max_lat) / 2))) AS max_lon, sc AS size_km, var "
     "FROM fx_areas CROSS JOIN (VALUES "
     + ", ".join(f"({i}, {s!r}::DOUBLE, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, s, x, y in _PAR) + ") p(var, sc, ox, oy)")
_project_view("v_var", "v_area_var", 0)
view("v_area_scale", "SELECT fx_areas.*, sc AS size_km FROM fx_areas CROSS JOIN (VALUES "
     + ", ".join(f"({s}::DOUBLE)" for s in grids.SCALES) + ") p(sc)")
_project_view("v_scale", "v_area_scale", 0)
_BOX6 = ", ".join(f"round({c}, 6) AS {c}" for c in ("min_lat", "max_lat", "min_lon", "max_lon", "area_km2"))
_BOX = ("min_lat", "max_lat", "min_lon", "max_lon", "area_km2")


@query("gen01_primary_grid", f"SELECT 'primary_' || area_id || '_' || i || '_' || j AS grid_id, {_BOX6} FROM "
       "(SELECT *, size_km * size_km AS area_km2 FROM v_pri_g) q")
def _(t):
    return grids.primary_grid(t.fx("areas")).select("grid_id", *r6(*_BOX))


@query("gen29_polygon_grid", f"SELECT 'base_' || area_id || '_' || i || '_' || j AS grid_id, {_BOX6} FROM v_base_c")
def _(t):
    return grids.polygon_grid(t.fx("areas")).select("grid_id", *r6(*_BOX))


@query("gen05_random_grids", f"SELECT 'var_' || var || '_' || area_id || '_' || i || '_' || j AS grid_id, {_BOX6} FROM v_var_c")
def _(t):
    return grids.random_grids(t.fx("areas")).select("grid_id", *r6(*_BOX))


@query("gen06_multiscale_grids", f"SELECT 'scale_' || size_km || '_' || area_id || '_' || i || '_' || j AS grid_id, {_BOX6} FROM v_scale_c")
def _(t):
    return grids.multiscale_grids(t.fx("areas")).select("grid_id", *r6(*_BOX))


view("v_all_layers", """SELECT 'base' AS grid_type, area_id, area_km2, NULL AS grid_scale FROM v_base_c UNION ALL
 SELECT 'random', area_id, area_km2, NULL FROM v_var_c UNION ALL SELECT 'multiscale', area_id, area_km2, size_km FROM v_scale_c""")


@query("gen07_comprehensive_grids", """SELECT grid_type, area_id, count(*) AS cells, count(*) AS ids, round(sum(area_km2), 6) AS area_km2
 FROM v_all_layers GROUP BY 1, 2""")
def _(t):
    return grids.comprehensive_grids(t.fx("areas")).groupBy("grid_type", "area_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count_distinct("grid_id").alias("ids"),
        rnd(F.sum("area_km2"), 6).alias("area_km2"))


@query("agg17_grid_composition", """SELECT grid_type, count(*) AS cells, round(100.0 * count(*) / (SELECT count(*) FROM v_all_layers), 6)
 AS pct FROM v_all_layers GROUP BY 1""")
def _(t):
    return observed.composition(grids.comprehensive_grids(t.fx("areas")), "grid_type").select("grid_type", "cells", *r6("pct"))


_COVER = "CASE WHEN tag_key = 'leisure' THEN 'water' WHEN tag_key IN ('building', 'shop') THEN 'urban' ELSE 'other' END"
view("v_cover", f"SELECT lat, lon, {_COVER} AS cover FROM fx_elements")
view("v_share", """SELECT grid_id, avg(CASE WHEN cover = 'water' THEN 1e0 ELSE 0e0 END) AS water_share,
 avg(CASE WHEN cover = 'urban' THEN 1e0 ELSE 0e0 END) AS urban_share FROM v_cover e JOIN
 (SELECT 'primary_' || area_id || '_' || i || '_' || j AS grid_id, * FROM v_pri_g) c
 ON lat > min_lat AND lat < max_lat AND lon > min_lon AND lon < max_lon GROUP BY 1""")
view("v_kept", """SELECT g.* FROM (SELECT 'primary_' || area_id || '_' || i || '_' || j AS grid_id, * FROM v_pri_g) g
 LEFT JOIN v_share s ON g.grid_id = s.grid_id WHERE coalesce(water_share, 0) <= 0.7 AND coalesce(urban_share, 0) >= 0.3""")


def _cover(t):
    return t.fx("elements").select("lat", "lon", F.expr(_COVER).alias("cover"))


@query("gen02_coverage_filter", "SELECT grid_id FROM v_kept")
def _(t):
    cells = grids.primary_grid(t.fx("areas"))
    return grids.coverage_filter(cells, grids.coverage_shares(cells, _cover(t), 0.01)).select("grid_id")


view("v_piece", """SELECT *, least(cx1, bx1) AS px1, greatest(cx0, bx0) AS px0, least(cy1, by1) AS py1, greatest(cy0, by0) AS py0
 FROM v_pri_g WHERE 'primary_' || area_id || '_' || i || '_' || j NOT IN (SELECT grid_id FROM v_kept)""")
view("v_piece2", """SELECT *, min(px0) OVER w AS fx0, max(px1) OVER w AS fx1, min(py0) OVER w AS fy0, max(py1) OVER w AS fy1,
 size_m / 2 AS h FROM v_piece WHERE px0 < px1 AND py0 < py1 WINDOW w AS (PARTITION BY area_id)""")
view("v_flex", """SELECT DISTINCT area_id, i2 AS i, j2 AS j, fx0, fy0, h, zone FROM (SELECT area_id, fx0, fy0, h, zone,
 unnest(generate_series(greatest(0, CAST(ceil((px0 - fx0) / h - 1 - 1e-6) AS BIGINT)),
 least(CAST(floor((px1 - fx0) / h + 1e-6) AS BIGINT), CAST(ceil((fx1 - fx0) / h - 1e-6) AS BIGINT) - 1))) AS i2, py0, py1, fy1 FROM v_piece2) a,
 LATERAL (SELECT unnest(generate_series(greatest(0, CAST(ceil((py0 - fy0) / h - 1 - 1e-6) AS BIGINT)),
 least(CAST(floor((py1 - fy0) / h + 1e-6) AS BIGINT), CAST(ceil((fy1 - fy0) / h - 1e-6) AS BIGINT) - 1))) AS j2) b""")


@query("gen03_flexible_grid", "SELECT 'flex_' || area_id || '_' || i || '_' || j AS grid_id, round(h * h / 1e6, 6) AS area_km2 FROM v_flex")
def _(t):
    cells = grids.primary_grid(t.fx("areas"), keep_utm=True)
    kept = grids.coverage_filter(cells, grids.coverage_shares(cells, _cover(t), 0.01))
    return grids.flexible_grid(cells, kept).select("grid_id", *r6("area_km2"))


@query("gen04_grid_from_bounds", f"""SELECT 'primary_' || area_id || '_' || i || '_' || j AS grid_id, round(c.lat, 6) AS center_lat,
 round(c.lon, 6) AS center_lon, 4 AS n_corners FROM v_pri_g, LATERAL (SELECT {geo_sql('(cx0 + cx1) / 2', '(cy0 + cy1) / 2', 'zone')[0]} AS lat,
 {geo_sql('(cx0 + cx1) / 2', '(cy0 + cy1) / 2', 'zone')[1]} AS lon) c""")
def _(t):
    return grids.grid_from_bounds(t.fx("areas")).select("grid_id", *r6("center_lat", "center_lon"),
                                                        F.size("corners").alias("n_corners"))


_FLEX_CORNERS = [geo_sql(x, y, "zone") for x, y in (("cx0", "cy0"), ("cx1", "cy0"), ("cx1", "cy1"), ("cx0", "cy1"))]
view("v_flex_g", f"""SELECT grid_id, h * h / 1e6 AS area_km2, least({', '.join(c[0] for c in _FLEX_CORNERS)}) AS min_lat, greatest({', '.join(c[0] for c in _FLEX_CORNERS)}) AS max_lat,
 least({', '.join(c[1] for c in _FLEX_CORNERS)}) AS min_lon, greatest({', '.join(c[1] for c in _FLEX_CORNERS)}) AS max_lon FROM
 (SELECT *, 'flex_' || area_id || '_' || i || '_' || j AS grid_id, fx0 + i * h AS cx0, fx0 + i * h + h AS cx1, fy0 + j * h AS cy0, fy0 + j * h + h AS cy1 FROM v_flex) q""")


@query("gen04_bounds_with_cover", """SELECT grid_id, round(size_km * size_km, 6) AS area_km2 FROM v_kept UNION ALL SELECT c.grid_id, round(max(c.area_km2), 6) FROM v_flex_g c
 JOIN v_cover ON lat > min_lat AND lat < max_lat AND lon > min_lon AND lon < max_lon GROUP BY 1
 HAVING avg(CASE WHEN cover = 'water' THEN 1e0 ELSE 0e0 END) <= 0.7 * 0.8 AND avg(CASE WHEN cover = 'urban' THEN 1e0 ELSE 0e0 END) >= 0.3 * 1.2""")
def _(t):
    return grids.grid_from_bounds(t.fx("areas"), cover=_cover(t)).select("grid_id", *r6("area_km2"))


@query("gen08_grid_quality", f"""SELECT a.area_id, count(*) AS total_cells, round(min(c.area_km2), 6) AS min_area, round(max(c.area_km2), 6) AS max_area,
 round(avg(c.area_km2), 6) AS mean_area, round(stddev_pop(c.area_km2), 6) AS std_area,
 round(100 * sum(c.area_km2) / max(a.whole), 4) AS coverage_pct, max(coalesce(o.n, 0)) AS overlapping_pairs FROM v_base_c c JOIN (SELECT area_id,
 {_AREA} AS whole FROM fx_areas) a ON a.area_id = c.area_id LEFT JOIN (SELECT x.area_id, count(*) AS n FROM v_base_c x JOIN v_base_c y
 ON x.area_id = y.area_id AND (x.i, x.j) < (y.i, y.j) AND least(x.max_lat, y.max_lat) - greatest(x.min_lat, y.min_lat) > 1e-6
 AND least(x.max_lon, y.max_lon) - greatest(x.min_lon, y.min_lon) > 1e-6 GROUP BY 1) o ON o.area_id = a.area_id GROUP BY 1""")
def _(t):
    areas = t.fx("areas")
    return grids.quality_report(grids.polygon_grid(areas), areas, 0.02).select(
        "area_id", "total_cells", *r6("min_area", "max_area", "mean_area", "std_area"),
        rnd("coverage_pct", 4).alias("coverage_pct"), "overlapping_pairs")


# --- points in cells ----------------------------------------------------------------------------------------
view("v_point_cell", """SELECT p.*, grid_id FROM fx_points p JOIN fx_cells c ON lat > min_lat AND lat < max_lat
 AND lon > min_lon AND lon < max_lon""")


def located(t):
    return spatial.points_in_cells(t.fx("points"), t.fx("cells"), 0.01)


@query("jon05_point_in_cell", "SELECT ord, veh_id, grid_id FROM v_point_cell")
def _(t):
    return located(t).select("ord", "veh_id", "grid_id")


@query("jon07_element_in_cell", """SELECT osmid, grid_id FROM fx_elements JOIN fx_cells ON lat >= min_lat AND lat <= max_lat
 AND lon >= min_lon AND lon <= max_lon""")
def _(t):
    return spatial.points_in_cells(t.fx("elements"), t.fx("cells"), 0.01, predicate="intersects").select("osmid", "grid_id")


@query("agg15_observed_demand", """SELECT grid_id, unique_vehicles, total_events, round((unique_vehicles / max(unique_vehicles) OVER ()
 + total_events / max(total_events) OVER ()) / 2, 6) AS actual_demand FROM (SELECT grid_id, count(DISTINCT veh_id) AS unique_vehicles,
 count(*) AS total_events FROM v_point_cell GROUP BY 1) q""")
def _(t):
    return observed.demand_by_cell(located(t)).select("grid_id", "unique_vehicles", "total_events", *r6("actual_demand"))


@query("agg16_weekly_coverage", """SELECT CAST(week AS VARCHAR) AS week, count(DISTINCT grid_id) AS cells, round(100.0 * count(DISTINCT grid_id)
 / (SELECT count(*) FROM fx_cells), 6) AS coverage_pct FROM v_point_cell GROUP BY 1""")
def _(t):
    return observed.weekly_coverage(located(t), t.fx("cells")).select(F.col("week").cast("string").alias("week"), "cells", *r6("coverage_pct"))


@query("agg17_cell_activity", "SELECT grid_id, count(*) AS n FROM v_point_cell GROUP BY 1")
def _(t):
    return observed.activity(located(t))


@query("win18_grid_trajectories", """SELECT ord, veh_id, grid_id FROM v_point_cell WHERE (veh_id, grid_id) IN
 (SELECT (veh_id, grid_id) FROM v_point_cell GROUP BY veh_id, grid_id HAVING count(*) >= 2)""")
def _(t):
    return observed.grid_trajectories(located(t)).select("ord", "veh_id", "grid_id")


@query("win19_busiest_grid", """SELECT grid_id, count(*) AS n FROM v_point_cell GROUP BY 1 ORDER BY n DESC, grid_id LIMIT 1""")
def _(t):
    return observed.busiest_grid(located(t))


@query("rnk09_grids_by_count", """SELECT grid_id, count(*) AS n, CASE WHEN count(*) > 100 THEN 'high' WHEN count(*) > 10 THEN 'medium' ELSE 'low' END
 AS data_level FROM v_point_cell GROUP BY 1""")
def _(t):
    return observed.grids_by_count(located(t))
