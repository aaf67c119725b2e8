"""Feature tables and interpolation."""

from pyspark.sql import functions as F

from voltgrid.functions import geo
from voltgrid.functions.tags import CATEGORIES, POI_COLUMNS, POI_WEIGHTS
from voltgrid.functions.durable import materialize, scratch_path
from voltgrid.operators import features, neighbours, spatial
from voltgrid.plans.catalog.demand import grid_demand, r6, rnd, varied
from voltgrid.plans.catalog.grids import _AREA
from voltgrid.plans.registry import query, view
from voltgrid.sources.tables import feature_lookup


def rs(*names, d=6):
    return ", ".join(f"round({n}, {d}) AS {n}" for n in names)


view("v_cells", f"SELECT *, {_AREA} AS area_km2, (min_lat + max_lat) / 2 AS lat, (min_lon + max_lon) / 2 AS lon FROM fx_cells")
view("v_tagged", """SELECT osmid, grid_id, tag_key, tag_value, length_m FROM fx_elements e JOIN fx_cells c
 ON e.lat >= min_lat AND e.lat <= max_lat AND e.lon >= min_lon AND e.lon <= max_lon""")


def cells(t):
    b = [F.col(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")]
    return (t.fx("cells").withColumn("area_km2", geo.cell_area_km2(*b)).withColumn("lat", (b[0] + b[1]) / 2)
            .withColumn("lon", (b[2] + b[3]) / 2))


def tagged(t):
    return spatial.points_in_cells(t.fx("elements"), t.fx("cells"), 0.01, predicate="intersects").select(
        "osmid", "grid_id", "tag_key", "tag_value", "length_m")


def _cat_sql(aeroway=False):
    whens = []
    for name, tags in CATEGORIES.items():
        rules = {**tags, "aeroway": ["aerodrome", "terminal"]} if aeroway and name == "transport_hub" else tags
        cond = " OR ".join("(tag_key = '%s' AND tag_value IN (%s))" % (k, ", ".join(f"'{x}'" for x in v)) for k, v in rules.items())
        whens.append(f"WHEN {cond} THEN '{name}'")
    return "CASE " + " ".join(whens) + " END"


_POI_SQL = ", ".join(f"coalesce(n_{c}, 0) / area_km2 AS poi_density_{c}" for c in CATEGORIES)
_POI_N = ", ".join(f"count(*) FILTER (cat = '{c}') AS n_{c}" for c in CATEGORIES)
for _name, _aero in (("v_poi", False), ("v_poi_aero", True)):
    view(_name, f"""SELECT c.grid_id, area_km2, {_POI_SQL} FROM v_cells c LEFT JOIN (SELECT grid_id, {_POI_N} FROM
 (SELECT *, {_cat_sql(_aero)} AS cat FROM v_tagged) q GROUP BY 1) n ON c.grid_id = n.grid_id""")
view("v_road", """SELECT c.grid_id, coalesce(p, 0) / area_km2 AS road_density_primary, coalesce(s, 0) / area_km2 AS road_density_secondary,
 coalesce(t, 0) / area_km2 AS road_density_tertiary, coalesce(a, 0) / area_km2 AS road_density_total FROM v_cells c LEFT JOIN
 (SELECT grid_id, sum(length_m) FILTER (contains(tag_value, 'primary')) / 1000 AS p, sum(length_m) FILTER (contains(tag_value, 'secondary')) / 1000 AS s,
 sum(length_m) FILTER (contains(tag_value, 'tertiary')) / 1000 AS t, sum(length_m) / 1000 AS a FROM v_tagged WHERE tag_key = 'highway' GROUP BY 1) n
 ON c.grid_id = n.grid_id""")
view("v_feat0", """SELECT p.*, road_density_primary, road_density_secondary, road_density_tertiary, road_density_total,
 greatest(0.1 * road_density_primary + 0.3 * road_density_secondary + 0.8 * road_density_tertiary, 0) AS intersection_density,
 greatest(road_density_total / (road_density_primary + 1e-6), 0) AS road_connectivity_index,
 least(poi_density_commercial + poi_density_residential, 1) AS mixed_use_index,
 least(poi_density_transport_hub + road_density_total, 1) AS urban_density_proxy,
 least(road_density_tertiary / (road_density_total + 1e-6), 1) AS pedestrian_infrastructure,
 least(poi_density_transport_hub / (road_density_total + 1e-6), 1) AS public_transport_access
 FROM v_poi p JOIN v_road r ON p.grid_id = r.grid_id""")
view("v_feat", """SELECT *, 0.25 * poi_density_commercial + 0.20 * road_density_total + 0.15 * public_transport_access
 + 0.10 * mixed_use_index + 0.10 * intersection_density AS charging_suitability_index,
 0.30 * poi_density_commercial + 0.25 * intersection_density + 0.25 * public_transport_access AS urban_centrality_score FROM v_feat0""")
_H = " - ".join(f"(CASE WHEN {c} / tot > 0 THEN {c} / tot ELSE 1e-8 END) * ln(CASE WHEN {c} / tot > 0 THEN {c} / tot ELSE 1e-8 END)" for c in POI_COLUMNS)
view("v_eng", f"""SELECT *, urban_intensity_index * multimodal_accessibility AS urban_accessibility_synergy,
 economic_activity_index * transport_hub_effectiveness AS economic_transport_synergy,
 land_use_diversity * infrastructure_service_level AS service_diversity_interaction FROM (SELECT *,
 {' + '.join(f'{w} * {c}' for c, w in POI_WEIGHTS.items())} AS urban_intensity_index,
 CASE WHEN tot > 0 THEN 0 - {_H} ELSE 0 END AS land_use_diversity,
 (poi_density_healthcare + poi_density_education + poi_density_government) / 3 AS infrastructure_service_level,
 0.6 * CASE WHEN max(road_density_total) OVER () > 0 THEN road_density_total / max(road_density_total) OVER () ELSE 0 END
 + 0.4 * CASE WHEN max(public_transport_access) OVER () > 0 THEN public_transport_access / max(public_transport_access) OVER () ELSE 0 END AS multimodal_accessibility,
 0.4 * CASE WHEN max(poi_density_transport_hub) OVER () > 0 THEN poi_density_transport_hub / max(poi_density_transport_hub) OVER () ELSE 0 END
 + 0.6 * CASE WHEN max(intersection_density) OVER () > 0 THEN intersection_density / max(intersection_density) OVER () ELSE 0 END AS transport_hub_effectiveness,
 0.7 * poi_density_commercial + 0.3 * poi_density_industrial AS economic_activity_index,
 poi_density_commercial / (poi_density_residential + 1e-6) AS commercial_residential_ratio,
 gn % 100 AS grid_position_x, floor(gn / 100) AS grid_position_y, sqrt(pow(gn % 100 - avg(gn % 100) OVER (), 2)
 + pow(floor(gn / 100) - avg(floor(gn / 100)) OVER (), 2)) AS distance_from_center
 FROM (SELECT *, {' + '.join(POI_COLUMNS)} AS tot, CAST(regexp_extract(grid_id, '([0-9]+)', 1) AS DOUBLE) AS gn FROM v_feat) q) e""")


def feat(t):
    return features.portable_features(materialize(tagged(t)), cells(t))


def engineered(t):
    return features.engineer(materialize(feat(t)))


@query("agg07_poi_density", f"SELECT grid_id, {rs(*POI_COLUMNS)} FROM v_poi")
def _(t):
    return features.poi_densities(tagged(t), cells(t)).select("grid_id", *r6(*POI_COLUMNS))


@query("agg11_poi_density_aeroway", f"SELECT grid_id, {rs(*POI_COLUMNS)} FROM v_poi_aero")
def _(t):
    return features.poi_densities(tagged(t), cells(t), True).select("grid_id", *r6(*POI_COLUMNS))


_ROADS = ("road_density_primary", "road_density_secondary", "road_density_tertiary", "road_density_total")


@query("agg08_road_density", f"SELECT grid_id, {rs(*_ROADS)} FROM v_road")
def _(t):
    return features.road_densities(tagged(t), cells(t)).select("grid_id", *r6(*_ROADS))


_IDX = ("intersection_density", "road_connectivity_index", "mixed_use_index", "urban_density_proxy", "pedestrian_infrastructure",
        "public_transport_access")


@query("prj14_road_indices", f"SELECT grid_id, {rs(*_IDX, d=4)} FROM v_feat")
def _(t):
    return feat(t).select("grid_id", *[rnd(c, 4).alias(c) for c in _IDX])


@query("prj13_composite_indices", f"SELECT grid_id, {rs('charging_suitability_index', 'urban_centrality_score')} FROM v_feat")
def _(t):
    return feat(t).select("grid_id", *r6("charging_suitability_index", "urban_centrality_score"))


for _q, _cols in (
        ("prj15_urban_intensity", ("urban_intensity_index",)), ("prj16_land_use_diversity", ("land_use_diversity",)),
        ("prj17_infrastructure_level", ("infrastructure_service_level",)),
        ("prj18_multimodal_accessibility", ("multimodal_accessibility",)),
        ("prj19_hub_effectiveness", ("transport_hub_effectiveness",)),
        ("prj20_economic_activity", ("economic_activity_index", "commercial_residential_ratio")),
        ("prj21_grid_position", ("grid_position_x", "grid_position_y", "distance_from_center")),
        ("prj22_interactions", ("urban_accessibility_synergy", "economic_transport_synergy", "service_diversity_interaction"))):
    @query(_q, f"SELECT grid_id, {rs(*_cols, d=5)} FROM v_eng")
    def _(t, cols=_cols):
        return engineered(t).select("grid_id", *[rnd(c, 5).alias(c) for c in cols])

_NORM = ("poi_density_commercial", "road_density_total", "intersection_density")


@query("prj23_minmax_columns", "SELECT grid_id, " + ", ".join(
    f"round(CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0 END, 6) AS {c}_normalized"
    for c in _NORM) + " FROM v_feat")
def _(t):
    return features.normalize_columns(materialize(feat(t)), _NORM).select("grid_id", *r6(*[f"{c}_normalized" for c in _NORM]))


@query("prj25_centroid_distance", """SELECT osmid, round(d, 6) AS distance_to_center, round(1 / (1 + d), 6) AS inverse_distance_center FROM
 (SELECT osmid, sqrt(pow(lat - (SELECT avg(lat) FROM fx_elements), 2) + pow(lon - (SELECT avg(lon) FROM fx_elements), 2)) AS d FROM fx_elements) q""")
def _(t):
    return features.centroid_distance(t.fx("elements")).select("osmid", *r6("distance_to_center", "inverse_distance_center"))


@query("prj43_default_features", "SELECT c.grid_id, round(coalesce(poi_density_commercial, 0), 6) AS poi_density_commercial, "
       "round(coalesce(road_density_total, 0), 6) AS road_density_total, CAST(0 AS DOUBLE) AS degree_centrality_avg FROM fx_cells c LEFT JOIN "
       "(SELECT * FROM v_feat WHERE poi_density_residential > 0) f ON c.grid_id = f.grid_id")
def _(t):
    return features.default_features(t.fx("cells"), feat(t).filter("poi_density_residential > 0")).select(
        "grid_id", *r6("poi_density_commercial", "road_density_total", "degree_centrality_avg"))


@query("src06_feature_lookup", "SELECT grid_id, round(road_density_total, 6) AS road_density_total FROM v_feat WHERE grid_id IN (SELECT DISTINCT grid_id FROM fx_points "
       "JOIN fx_cells ON lat > min_lat AND lat < max_lat AND lon > min_lon AND lon < max_lon)")
def _(t):
    path = scratch_path(t.spark, "features")
    feat(t).write.parquet(path)
    wanted = spatial.points_in_cells(t.fx("points"), t.fx("cells"), 0.01)
    return feature_lookup(t.spark, path, wanted).select("grid_id", *r6("road_density_total"))


@query("set02_dedup_elements", "SELECT osmid, element_type FROM (SELECT DISTINCT l_partkey AS osmid, l_returnflag AS element_type FROM lineitem) q")
def _(t):
    e = t.raw("lineitem").select(F.col("l_partkey").alias("osmid"), F.col("l_returnflag").alias("element_type"),
                                 F.col("l_quantity").alias("lat"), F.col("l_tax").alias("lon"))
    return features.dedup_elements(e).select("osmid", "element_type")


_CNT = ("poi_density_commercial", "road_density_primary", "road_density_total", "road_connectivity_index", "mixed_use_index",
        "urban_density_proxy", "pedestrian_infrastructure", "public_transport_access")
view("v_cnt", f"""SELECT grid_id, n_commercial / area_km2 AS poi_density_commercial, 0.1 * np / area_km2 AS road_density_primary,
 0.1 * (np + ns + nt) / area_km2 AS road_density_total, 0.1 * (np + ns + nt) / greatest(0.1 * np + 1e-6, 1) AS road_connectivity_index,
 least(1, (n_commercial + n_residential) / greatest(area_km2, 1)) AS mixed_use_index,
 least(1, (n_transport_hub + 0.1 * (np + ns + nt)) / greatest(area_km2, 1)) AS urban_density_proxy,
 least(1, 0.1 * nt / greatest(0.1 * (np + ns + nt), 1e-6)) AS pedestrian_infrastructure,
 least(1, n_transport_hub / greatest(area_km2, 1)) AS public_transport_access FROM (SELECT c.grid_id, max(area_km2) AS area_km2, {_POI_N},
 count(*) FILTER (tag_value = 'primary') AS np, count(*) FILTER (tag_value = 'secondary') AS ns, count(*) FILTER (tag_value = 'tertiary') AS nt
 FROM v_cells c LEFT JOIN (SELECT *, {_cat_sql()} AS cat FROM v_tagged) x ON c.grid_id = x.grid_id GROUP BY 1) q""")


@query("agg09_count_features", f"SELECT grid_id, {rs(*_CNT)} FROM v_cnt")
def _(t):
    return features.count_features(tagged(t), cells(t)).select("grid_id", *r6(*_CNT))


view("v_edge_cell", """SELECT e.*, grid_id, area_km2 FROM (SELECT *, lat0 AS elat, lon0 AS elon FROM fx_edges) e JOIN v_cells c
 ON elat >= min_lat AND elat <= max_lat AND elon >= min_lon AND elon <= max_lon""")
view("v_degree", """SELECT grid_id, node, count(*) AS deg FROM (SELECT grid_id, from_node AS node FROM v_edge_cell UNION ALL
 SELECT grid_id, to_node FROM v_edge_cell) q GROUP BY 1, 2""")


def edges_in_cells(t):
    e = t.fx("edges").withColumn("lat", F.col("lat0")).withColumn("lon", F.col("lon0"))
    return spatial.points_in_cells(e, t.fx("cells"), 0.01, predicate="intersects")


_GRAPH = ("road_density_primary", "road_density_secondary", "road_density_tertiary", "road_density_total", "intersection_density",
          "road_connectivity_index", "mixed_use_index", "urban_density_proxy", "pedestrian_infrastructure", "public_transport_access")


@query("agg10_road_graph", f"""SELECT grid_id, {rs(*_GRAPH)} FROM (SELECT e.grid_id, p / 1000 / area_km2 AS road_density_primary,
 s / 1000 / area_km2 AS road_density_secondary, t / 1000 / area_km2 AS road_density_tertiary, a / 1000 / area_km2 AS road_density_total,
 crossings / area_km2 AS intersection_density, edges / nodes AS road_connectivity_index, least(1, (p + s) / greatest(a, 1)) AS mixed_use_index,
 crossings * a / 1000 / (area_km2 * area_km2) AS urban_density_proxy, least(1, t / greatest(a, 1)) AS pedestrian_infrastructure,
 least(1, (p + s) / greatest(a, 1)) AS public_transport_access FROM (SELECT grid_id, max(area_km2) AS area_km2, count(*) AS edges, sum(length_m) AS a,
 sum(CASE highway WHEN 'primary' THEN length_m ELSE 0 END) AS p, sum(CASE highway WHEN 'secondary' THEN length_m ELSE 0 END) AS s,
 sum(CASE highway WHEN 'tertiary' THEN length_m ELSE 0 END) AS t FROM v_edge_cell GROUP BY 1) e JOIN (SELECT grid_id, count(*) AS nodes,
 count(*) FILTER (deg > 2) AS crossings FROM v_degree GROUP BY 1) n ON e.grid_id = n.grid_id) q""")
def _(t):
    return features.road_graph_stats(edges_in_cells(t), cells(t)).select("grid_id", *r6(*_GRAPH))


@query("agg13_degree_centrality", """SELECT grid_id, round(CASE WHEN count(*) > 1 THEN avg(deg) / (count(*) - 1) ELSE 0 END, 6)
 AS degree_centrality_avg FROM v_degree GROUP BY 1""")
def _(t):
    return features.degree_centrality(edges_in_cells(t)).select("grid_id", *r6("degree_centrality_avg"))


@query("agg12_land_use_entropy", """SELECT grid_id, round(CASE WHEN count(*) > 1 THEN -sum(a / tot * ln(a / tot)) / ln(count(*)) ELSE 0 END, 6)
 AS land_use_entropy FROM (SELECT grid_id, tag_value, sum(length_m) AS a, sum(sum(length_m)) OVER (PARTITION BY grid_id) AS tot FROM v_tagged
 WHERE tag_key = 'building' GROUP BY 1, 2) q GROUP BY 1""")
def _(t):
    a = tagged(t).filter("tag_key = 'building'").select("grid_id", F.col("tag_value").alias("land_class"), F.col("length_m").alias("area"))
    return features.land_use_entropy(a).select("grid_id", *r6("land_use_entropy"))


view("v_tagged_svc", """SELECT grid_id, CASE tag_key WHEN 'leisure' THEN 'landuse' WHEN 'building' THEN 'landuse' WHEN 'shop' THEN 'amenity' ELSE tag_key END AS tag_key,
 CASE WHEN tag_key = 'shop' THEN CASE osmid % 3 WHEN 0 THEN 'bank' WHEN 1 THEN 'fuel' ELSE 'bus_station' END
 WHEN tag_value = 'secondary' THEN 'footway' ELSE tag_value END AS tag_value FROM v_tagged""")


def tagged_svc(t):
    k, v = F.col("tag_key"), F.col("tag_value")
    alt = F.element_at(F.array(F.lit("bank"), F.lit("fuel"), F.lit("bus_station")), (F.col("osmid") % 3 + 1).cast("int"))
    return tagged(t).select("grid_id", F.when(k.isin("leisure", "building"), "landuse").when(k == "shop", "amenity").otherwise(k).alias("tag_key"),
                            F.when(k == "shop", alt).when(v == "secondary", "footway").otherwise(v).alias("tag_value"))


_ACC = ("accessibility_score", "service_area_coverage", "activity_density_score")


@query("agg14_accessibility", f"""SELECT grid_id, {rs(*_ACC)} FROM (SELECT grid_id, (least(1, t / a) + least(1, s / a)) / 2 AS accessibility_score,
 least(1, s / a) AS service_area_coverage, (t + s) / a AS activity_density_score FROM (SELECT c.grid_id, greatest(max(area_km2), 0.1) AS a,
 count(*) FILTER (tag_value IN ('bus_station', 'bus_stop')) AS t, count(*) FILTER (tag_value IN ('bank', 'fuel')) AS s
 FROM v_cells c LEFT JOIN v_tagged_svc x ON c.grid_id = x.grid_id GROUP BY 1) q) z""")
def _(t):
    return features.accessibility(tagged_svc(t), cells(t)).select("grid_id", *r6(*_ACC))


_PED = ("mixed_use_index", "pedestrian_infrastructure", "urban_density_proxy")


@query("agg70_pedestrian_mix", f"""SELECT grid_id, {rs(*_PED)} FROM (SELECT grid_id, lu / 10.0 AS mixed_use_index, p / a AS pedestrian_infrastructure,
 least((lu + p) / a, 100) / 100 AS urban_density_proxy FROM (SELECT c.grid_id, max(area_km2) AS a, least(count(DISTINCT tag_value) FILTER (tag_key = 'landuse'), 10) AS lu,
 count(*) FILTER (tag_value = 'footway') AS p FROM v_cells c LEFT JOIN v_tagged_svc x ON c.grid_id = x.grid_id GROUP BY 1) q) z""")
def _(t):
    return features.pedestrian_mix(tagged_svc(t), cells(t)).select("grid_id", *r6(*_PED))


# --- neighbourhoods and interpolation -----------------------------------------------------------------------
view("v_pair", "SELECT a.osmid, sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) AS d FROM fx_elements a JOIN fx_elements b ON a.osmid <> b.osmid")


@query("jon10_radius_counts", """SELECT osmid, count(*) FILTER (d <= 0.01) AS neighbors_within_1km, count(*) FILTER (d <= 0.02) AS neighbors_within_2km,
 count(*) FILTER (d <= 0.05) AS neighbors_within_5km FROM v_pair GROUP BY 1""")
def _(t):
    return neighbours.radius_counts(t.fx("elements"), "osmid", "long")


@query("jon11_decay_density", """SELECT osmid, round(sum(exp(-d / 0.01)), 5) AS weighted_density_1km, round(sum(exp(-d / 0.02)), 5) AS weighted_density_2km,
 round(sum(exp(-d / 0.05)), 5) AS weighted_density_5km FROM v_pair GROUP BY 1""")
def _(t):
    d = neighbours.decay_density(t.fx("elements"), "osmid", "long")
    return d.select("osmid", *[rnd(c, 5).alias(c) for c in d.columns if c != "osmid"])


@query("jon12_histogram_density", "SELECT osmid, " + ", ".join(
    f"count(*) OVER (PARTITION BY floor((lat - lat0) / ({r} / 2)), floor((lon - lon0) / ({r} / 2))) AS density_{k}km"
    for r, k in (("0.01e0", 1), ("0.02e0", 2), ("0.05e0", 5))) + " FROM fx_elements CROSS JOIN (SELECT min(lat) AS lat0, min(lon) AS lon0 FROM fx_elements) m")
def _(t):
    return neighbours.histogram_density(t.fx("elements")).select("osmid", *[f"density_{k}km" for k in (1, 2, 5)])


_TARGETS = [f"demand_score_{n}" for n in ("hours_only", "kwh25_hrs75", "balanced", "kwh75_hrs25", "kwh_only")]
view("v_scell", "SELECT *, (min_lat + max_lat) / 2 AS lat, (min_lon + max_lon) / 2 AS lon FROM fx_station_cells")
view("v_idw", "SELECT grid_id, " + ", ".join(f"sum(w * {y}) / (sum(w) + 1e-10) AS {y}" for y in _TARGETS) + """ FROM (SELECT c.grid_id, s.*,
 pow(1 / (sqrt(pow(c.lat - s.latitude, 2) + pow(c.lon - s.longitude, 2)) + 1e-10), 2) AS w FROM v_scell c CROSS JOIN v_varied s) q GROUP BY 1""")


def scells(t):
    return t.fx("station_cells").withColumn("lat", F.expr("(min_lat + max_lat) / 2")).withColumn("lon", F.expr("(min_lon + max_lon) / 2"))


def stations(t):
    return materialize(varied(t).withColumn("lat", F.col("latitude")).withColumn("lon", F.col("longitude")))


@query("jon13_idw_all_variations", f"SELECT grid_id, {rs(*_TARGETS)} FROM v_idw")
def _(t):
    return neighbours.idw(scells(t), stations(t), _TARGETS).select("grid_id", *r6(*_TARGETS))


view("v_cs", """SELECT c.grid_id, s.demand_score AS y, sqrt(pow(c.lat - s.latitude, 2) + pow(c.lon - s.longitude, 2)) * 111.32 AS d,
 2 * 6371 * asin(sqrt(pow(sin(radians(s.latitude - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.latitude))
 * pow(sin(radians(s.longitude - c.lon) / 2), 2))) AS h FROM v_scell c CROSS JOIN v_scored s""")
view("v_local", """SELECT grid_id, least(greatest(sum(w * y) / sum(w) * exp(-min(d) / 2.0), 0), 1) AS demand_score FROM (SELECT *, pow(d + 0.1, -1.5) AS w,
 row_number() OVER (PARTITION BY grid_id ORDER BY d, y) AS rn, min(d) OVER (PARTITION BY grid_id) AS dm FROM v_cs) q
 WHERE CASE WHEN dm <= 3 THEN d <= 3 ELSE rn <= 3 END GROUP BY 1""")
view("v_decay", """SELECT grid_id, coalesce(least(greatest(avg(exp(-h / 2.0) * y) FILTER (h <= 5) / 1.2, 0), 1), 0) AS demand_score FROM v_cs GROUP BY 1""")


def scored_points(t):
    from voltgrid.plans.catalog.demand import scored
    return scored(t).select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "demand_score")


@query("jon14_local_interpolation", "SELECT grid_id, round(demand_score, 6) AS demand_score FROM v_local")
def _(t):
    return neighbours.local_interpolation(scells(t), scored_points(t), "demand_score").select("grid_id", *r6("demand_score"))


@query("jon15_decayed_demand", "SELECT grid_id, round(demand_score, 6) AS demand_score FROM v_decay")
def _(t):
    return neighbours.decayed_demand(scells(t), scored_points(t), "demand_score").select("grid_id", *r6("demand_score"))


@query("jon16_fill_all_cells", """SELECT mode, grid_id, round(demand_score, 6) AS demand_score, estimated, round(kwh_normalized, 6) AS kwh_normalized,
 round(avg_occupancy, 6) AS avg_occupancy FROM (SELECT 'synthetic' AS mode, c.grid_id, coalesce(g.demand_score, e.demand_score) AS demand_score, g.grid_id IS NULL AS estimated,
 coalesce(g.kwh_normalized, e.demand_score * 0.7) AS kwh_normalized, coalesce(g.avg_occupancy, e.demand_score * 0.5) AS avg_occupancy FROM fx_station_cells c
 LEFT JOIN v_grid_demand g ON c.grid_id = g.grid_id JOIN v_decay e ON c.grid_id = e.grid_id UNION ALL
 SELECT 'interpolated', c.grid_id, coalesce(g.demand_score, e.demand_score), g.grid_id IS NULL, coalesce(g.kwh_normalized, e.demand_score),
 coalesce(g.avg_occupancy, e.demand_score * 0.6) FROM fx_station_cells c LEFT JOIN v_grid_demand g ON c.grid_id = g.grid_id JOIN v_local e ON c.grid_id = e.grid_id) q""")
def _(t):
    g, c, p = grid_demand(t), scells(t), materialize(scored_points(t))
    out = None
    for mode, est in (("synthetic", neighbours.decayed_demand(c, p, "demand_score")), ("interpolated", neighbours.local_interpolation(c, p, "demand_score"))):
        part = neighbours.fill_cells(c, g, est, mode).select(F.lit(mode).alias("mode"), "grid_id", *r6("demand_score"), F.col(f"is_{mode}").alias("estimated"),
                                                             *r6("kwh_normalized", "avg_occupancy"))
        out = part if out is None else out.unionByName(part)
    return out


@query("jon04_training_table", """SELECT f.grid_id, round(f.lat, 6) AS latitude, round(f.lon, 6) AS longitude, round(road_density_total, 6) AS road_density_total,
 CAST(d.unique_vehicles AS BIGINT) AS unique_vehicles FROM (SELECT v.*, c.lat, c.lon FROM v_feat v JOIN v_cells c ON v.grid_id = c.grid_id) f JOIN
 (SELECT grid_id, count(DISTINCT veh_id) AS unique_vehicles FROM v_point_cell GROUP BY 1) d ON f.grid_id = d.grid_id""")
def _(t):
    from voltgrid.operators.observed import demand_by_cell
    from voltgrid.plans.catalog.grids import located
    from voltgrid.plans.training import training_table
    return training_table(feat(t), demand_by_cell(located(t)), cells(t)).select(
        "grid_id", *r6("latitude", "longitude", "road_density_total"), "unique_vehicles")
