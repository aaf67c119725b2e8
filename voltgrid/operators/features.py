"""Cell features from map elements and road edges, and the features derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.onerow import with_globals
from voltgrid.functions.tags import (AEROWAY, CATEGORIES, PEDESTRIAN_HIGHWAYS, POI_COLUMNS, POI_WEIGHTS,
                                     PORTABLE_FEATURES, ROAD_LEVELS, SERVICE_AMENITIES)


def dedup_elements(elements: DataFrame) -> DataFrame:
    """One row per (osmid, element_type), rows without a position dropped."""
    return (elements.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
            .dropDuplicates(["osmid", "element_type"]))


def category_of(key: Column, value: Column, with_aeroway: bool = False) -> Column:
    out = None
    for name, tags in CATEGORIES.items():
        rules = {**tags, **AEROWAY} if with_aeroway and name == "transport_hub" else tags
        hit = F.lit(False)
        for k, values in rules.items():
            hit = hit | ((key == k) & value.isin(values))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def _per_area(count: Column) -> Column:
    return F.when(F.col("area_km2") > 0, count / F.col("area_km2")).otherwise(F.lit(0.0))


def poi_densities(tagged: DataFrame, cells: DataFrame, with_aeroway: bool = False) -> DataFrame:
    """Tags located in cells (grid_id, tag_key, tag_value) -> category counts per km2 for every cell."""
    cat = category_of(F.col("tag_key"), F.col("tag_value"), with_aeroway)
    counts = tagged.groupBy("grid_id").agg(*[F.count_if(cat == c).alias(f"_n_{c}") for c in CATEGORIES])
    out = cells.select("grid_id", "area_km2").join(counts, "grid_id", "left")
    return out.select("grid_id", "area_km2", *[
        _per_area(F.coalesce(f"_n_{c}", F.lit(0))).alias(f"poi_density_{c}") for c in CATEGORIES])


def road_densities(tagged: DataFrame, cells: DataFrame) -> DataFrame:
    """Kilometres of road per km2 by level (name contains the level) and in total; length is not clipped."""
    road = F.col("tag_key") == "highway"
    km = F.col("length_m") / 1000
    sums = tagged.filter(road).groupBy("grid_id").agg(
        *[F.sum(F.when(F.col("tag_value").contains(lv), km)).alias(f"_l_{lv}") for lv in ROAD_LEVELS],
        F.sum(km).alias("_l_total"))
    out = cells.select("grid_id", "area_km2").join(sums, "grid_id", "left")
    return out.select("grid_id", *[_per_area(F.coalesce(f"_l_{lv}", F.lit(0.0))).alias(f"road_density_{lv}")
                                   for lv in (*ROAD_LEVELS, "total")])


def road_indices(df: DataFrame) -> DataFrame:
    p, s, t, total = (F.col(f"road_density_{x}") for x in (*ROAD_LEVELS, "total"))
    com, res, hub = (F.col(f"poi_density_{x}") for x in ("commercial", "residential", "transport_hub"))
    one = F.lit(1.0)
    return df.withColumns({
        "intersection_density": F.greatest(0.1 * p + 0.3 * s + 0.8 * t, F.lit(0.0)),
        "road_connectivity_index": F.greatest(total / (p + 1e-6), F.lit(0.0)),
        "mixed_use_index": F.least(com + res, one),
        "urban_density_proxy": F.least(hub + total, one),
        "pedestrian_infrastructure": F.least(t / (total + 1e-6), one),
        "public_transport_access": F.least(hub / (total + 1e-6), one)})


def composite_indices(df: DataFrame) -> DataFrame:
    """Charging suitability and urban centrality; an absent input counts as 0."""
    def c(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0)) if name in df.columns else F.lit(0.0)

    com, road, acc = c("poi_density_commercial"), c("road_density_total"), c("accessibility_score")
    transit, mixed, inter = c("public_transport_access"), c("mixed_use_index"), c("intersection_density")
    return df.withColumns({
        "charging_suitability_index": 0.25 * com + 0.20 * road + 0.20 * acc + 0.15 * transit + 0.10 * mixed + 0.10 * inter,
        "urban_centrality_score": 0.30 * com + 0.25 * inter + 0.25 * transit + 0.20 * acc})


def portable_features(tagged: DataFrame, cells: DataFrame) -> DataFrame:
    """The length-based feature table: one row per cell."""
    df = poi_densities(tagged, cells).join(road_densities(tagged, cells), "grid_id")
    return composite_indices(road_indices(df))


def default_features(cells: DataFrame, features: DataFrame, columns: Sequence[str] = tuple(PORTABLE_FEATURES)) -> DataFrame:
    """Every requested cell gets a row; missing cells and columns are 0."""
    present = [c for c in columns if c in features.columns]
    out = cells.select("grid_id").join(features.select("grid_id", *present), "grid_id", "left")
    return out.select("grid_id", *[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in present else F.lit(0.0).alias(c)
        for c in columns])


def count_features(tagged: DataFrame, cells: DataFrame) -> DataFrame:
    """The count-based feature variant: 0.1 km per road, first matching level only, no intersections."""
    key, val = F.col("tag_key"), F.col("tag_value")
    cat = category_of(key, val)
    road = (key == "highway") & (val != "bus_stop")
    level = (F.when(road & val.contains("primary"), "primary").when(road & val.contains("secondary"), "secondary")
             .when(road & val.contains("tertiary"), "tertiary"))
    n = tagged.groupBy("grid_id").agg(
        *[F.count_if(cat == c).alias(f"_n_{c}") for c in CATEGORIES],
        *[(F.count_if(level == lv) * 0.1).alias(f"_r_{lv}") for lv in ROAD_LEVELS],
        F.count_if(key == "landuse").alias("_landuse"))
    names = [f"_n_{c}" for c in CATEGORIES] + [f"_r_{lv}" for lv in ROAD_LEVELS] + ["_landuse"]
    df = cells.select("grid_id", "area_km2").join(n, "grid_id", "left").fillna(0, names)
    p, s, t = (F.col(f"_r_{lv}") for lv in ROAD_LEVELS)
    total, area = p + s + t, F.col("area_km2")
    one, safe = F.lit(1.0), F.greatest(F.col("area_km2"), F.lit(1.0))
    return df.select(
        "grid_id", *[_per_area(F.col(f"_n_{c}")).alias(f"poi_density_{c}") for c in CATEGORIES],
        *[_per_area(F.col(f"_r_{lv}")).alias(f"road_density_{lv}") for lv in ROAD_LEVELS],
        _per_area(total).alias("road_density_total"), F.lit(0.0).alias("intersection_density"),
        (total / F.greatest(p + 1e-6, one)).alias("road_connectivity_index"),
        F.least(one, (F.col("_n_commercial") + F.col("_n_residential")) / safe).alias("mixed_use_index"),
        F.least(one, (F.col("_n_transport_hub") + total) / safe).alias("urban_density_proxy"),
        F.least(one, t / F.greatest(total, F.lit(1e-6))).alias("pedestrian_infrastructure"),
        F.least(one, F.col("_n_transport_hub") / safe).alias("public_transport_access"),
        F.when(F.col("_landuse") > 0, 0.1).otherwise(0.0).alias("land_use_entropy"))


def road_graph_stats(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Edges located in cells (grid_id, from_node, to_node, length_m, highway) -> graph statistics per cell."""
    hw = F.col("highway")
    level = (F.when(hw.contains("primary"), "primary").when(hw.contains("secondary"), "secondary")
             .when(hw.contains("tertiary"), "tertiary"))
    ends = edges.select("grid_id", F.explode(F.array("from_node", "to_node")).alias("node"))
    nodes = (ends.groupBy("grid_id", "node").agg(F.count(F.lit(1)).alias("deg")).groupBy("grid_id")
             .agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("deg") > 2).alias("crossings")))
    sums = edges.groupBy("grid_id").agg(
        *[F.sum(F.when(level == lv, F.col("length_m")).otherwise(0.0)).alias(lv) for lv in ROAD_LEVELS],
        F.sum("length_m").alias("total"), F.count(F.lit(1)).alias("edges"))
    df = sums.join(nodes, "grid_id").join(cells.select("grid_id", "area_km2"), "grid_id")
    p, s, t, total, area = (F.col(c) for c in (*ROAD_LEVELS, "total", "area_km2"))
    one = F.lit(1.0)
    main = F.least(one, (p + s) / F.greatest(total, one))
    return df.select(
        "grid_id", *[_per_area(F.col(lv) / 1000).alias(f"road_density_{lv}") for lv in (*ROAD_LEVELS, "total")],
        _per_area(F.col("crossings")).alias("intersection_density"),
        (F.col("edges") / F.col("nodes")).alias("road_connectivity_index"), main.alias("mixed_use_index"),
        F.when(area > 0, F.col("crossings") * total / 1000 / (area * area)).otherwise(0.0).alias("urban_density_proxy"),
        F.least(one, t / F.greatest(total, one)).alias("pedestrian_infrastructure"),
        main.alias("public_transport_access"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Mean of degree / (n - 1) over the nodes of a cell."""
    ends = edges.select("grid_id", F.explode(F.array("from_node", "to_node")).alias("node"))
    deg = ends.groupBy("grid_id", "node").agg(F.count(F.lit(1)).alias("deg"))
    g = deg.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"), F.avg("deg").alias("mean_deg"))
    return g.select("grid_id", F.when(F.col("n") > 1, F.col("mean_deg") / (F.col("n") - 1)).otherwise(0.0)
                    .alias("degree_centrality_avg"))


def land_use_entropy(areas: DataFrame) -> DataFrame:
    """(grid_id, land_class, area) -> Shannon entropy of area shares over ln k; 0 for a single class."""
    cls = areas.groupBy("grid_id", "land_class").agg(F.sum("area").alias("a"))
    # -sum(p ln p) = ln A - sum(a ln a) / A, so that one pass over the classes is enough.
    g = cls.filter("a > 0").groupBy("grid_id").agg(
        F.count(F.lit(1)).alias("k"), F.sum("a").alias("A"), F.sum(F.col("a") * F.log("a")).alias("L"))
    h = (F.log("A") - F.col("L") / F.col("A")) / F.log(F.col("k").cast("double"))
    return g.select("grid_id", F.when(F.col("k") > 1, h).otherwise(0.0).alias("land_use_entropy"))


def accessibility(tagged: DataFrame, cells: DataFrame) -> DataFrame:
    """Transit and service counts per cell, their coverage and mean."""
    key, val = F.col("tag_key"), F.col("tag_value")
    transit = ((key == "public_transport") | ((key == "railway") & val.isin("station", "halt"))
               | ((key == "amenity") & (val == "bus_station")) | ((key == "highway") & (val == "bus_stop")))
    service = (key == "amenity") & val.rlike("|".join(SERVICE_AMENITIES))
    n = tagged.groupBy("grid_id").agg(F.count_if(transit).alias("_t"), F.count_if(service).alias("_s"))
    df = cells.select("grid_id", "area_km2").join(n, "grid_id", "left").fillna(0, ["_t", "_s"])
    area = F.greatest(F.col("area_km2"), F.lit(0.1))
    t, s = F.least(F.lit(1.0), F.col("_t") / area), F.least(F.lit(1.0), F.col("_s") / area)
    return df.select("grid_id", ((t + s) / 2).alias("accessibility_score"), s.alias("service_area_coverage"),
                     ((F.col("_t") + F.col("_s")) / area).alias("activity_density_score"))


def pedestrian_mix(tagged: DataFrame, cells: DataFrame) -> DataFrame:
    """Distinct land uses (at most 10) over 10, pedestrian elements per km2, and their density proxy."""
    key, val = F.col("tag_key"), F.col("tag_value")
    ped = ((key == "highway") & val.isin(PEDESTRIAN_HIGHWAYS)) | (key == "barrier")
    n = tagged.groupBy("grid_id").agg(F.count_distinct(F.when(key == "landuse", val)).alias("_lu"), F.count_if(ped).alias("_p"))
    df = cells.select("grid_id", "area_km2").join(n, "grid_id", "left").fillna(0, ["_lu", "_p"])
    lu = F.least(F.col("_lu"), F.lit(10))
    return df.select("grid_id", (lu / 10.0).alias("mixed_use_index"), _per_area(F.col("_p")).alias("pedestrian_infrastructure"),
                     F.least(_per_area(lu + F.col("_p")), F.lit(100.0)).alias("_x")).withColumn(
        "urban_density_proxy", F.col("_x") / 100).drop("_x")


# --- derived features ---------------------------------------------------------------------------------------

def _z(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def urban_context(df: DataFrame) -> DataFrame:
    present = [c for c in POI_WEIGHTS if c in df.columns]
    intensity = sum((_z(c) * POI_WEIGHTS[c] for c in present), F.lit(0.0))
    infra = [c for c in ("poi_density_healthcare", "poi_density_education", "poi_density_government") if c in df.columns]
    level = sum((_z(c) for c in infra), F.lit(0.0)) / max(len(infra), 1)
    return df.withColumns({"urban_intensity_index": intensity,
                           "land_use_diversity": land_use_diversity([c for c in POI_COLUMNS if c in df.columns]),
                           "infrastructure_service_level": level})


def land_use_diversity(columns: Sequence[str]) -> Column:
    """Shannon entropy of POI shares; zero shares become 1e-8; a row of zeros gives 0."""
    values = F.array(*[_z(c) for c in columns])
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    h = F.aggregate(values, F.lit(0.0), lambda a, v: a - F.when(v / total > 0, v / total).otherwise(1e-8)
                    * F.log(F.when(v / total > 0, v / total).otherwise(F.lit(1e-8))))
    return F.when(total > 0, h).otherwise(F.lit(0.0))


def accessibility_scores(df: DataFrame) -> DataFrame:
    """Multimodal accessibility (.6 road, .4 transit) and hub effectiveness (.4 hub, .6 crossings), each over its max."""
    cols = {"road": F.col("road_density_total"), "transit": F.col("public_transport_access"),
            "hub": _z("poi_density_transport_hub"), "cross": _z("intersection_density")}
    out = with_globals(df, *[F.max(c).alias(f"_m_{k}") for k, c in cols.items()])
    norm = {k: F.when(F.col(f"_m_{k}") > 0, c / F.col(f"_m_{k}")).otherwise(0.0) for k, c in cols.items()}
    return out.withColumns({
        "multimodal_accessibility": 0.6 * norm["road"] + 0.4 * norm["transit"],
        "transport_hub_effectiveness": 0.4 * norm["hub"] + 0.6 * norm["cross"]}).drop(*[f"_m_{k}" for k in cols])


def economic_activity(df: DataFrame) -> DataFrame:
    com = _z("poi_density_commercial")
    return df.withColumns({"economic_activity_index": 0.7 * com + 0.3 * _z("poi_density_industrial"),
                           "commercial_residential_ratio": com / (_z("poi_density_residential") + 1e-6)})


def grid_position(df: DataFrame) -> DataFrame:
    """x, y from the first digits of grid_id, and the distance to the mean position."""
    digits = F.regexp_extract("grid_id", r"(\d+)", 1)
    n = F.when(digits == "", 0.0).otherwise(digits.cast("double"))
    pos = df.withColumn("grid_position_x", n % 100).withColumn("grid_position_y", F.floor(n / 100).cast("double"))
    out = with_globals(pos, F.avg("grid_position_x").alias("_cx"), F.avg("grid_position_y").alias("_cy"))
    return out.withColumn("distance_from_center", F.hypot(F.col("grid_position_x") - F.col("_cx"),
                                                          F.col("grid_position_y") - F.col("_cy"))).drop("_cx", "_cy")


def interactions(df: DataFrame) -> DataFrame:
    pairs = {"urban_accessibility_synergy": ("urban_intensity_index", "multimodal_accessibility"),
             "economic_transport_synergy": ("economic_activity_index", "transport_hub_effectiveness"),
             "service_diversity_interaction": ("land_use_diversity", "infrastructure_service_level")}
    return df.withColumns({n: _z(a) * _z(b) for n, (a, b) in pairs.items() if a in df.columns and b in df.columns})


def engineer(df: DataFrame) -> DataFrame:
    return interactions(grid_position(economic_activity(accessibility_scores(urban_context(df)))))


def normalize_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min-max to ``<name>_normalized``; a constant column gives 0."""
    out = with_globals(df, *[f(c).alias(f"_{t}_{c}") for c in columns for t, f in (("lo", F.min), ("hi", F.max))])
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(f"{c}_normalized", F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0))
    return out.drop(*[f"_{t}_{c}" for c in columns for t in ("lo", "hi")])


def centroid_distance(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    out = with_globals(df, F.avg(lat).alias("_clat"), F.avg(lon).alias("_clon"))
    d = F.sqrt((F.col(lat) - F.col("_clat")) * (F.col(lat) - F.col("_clat"))
               + (F.col(lon) - F.col("_clon")) * (F.col(lon) - F.col("_clon")))
    return (out.withColumn("distance_to_center", d)
            .withColumn("inverse_distance_center", 1 / (1 + F.col("distance_to_center"))).drop("_clat", "_clon"))
