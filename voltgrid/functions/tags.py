"""Map-element tag categories. Results depend on these lists."""

# (tag key, tag values) per category
CATEGORIES: dict[str, dict[str, list[str]]] = {
    "commercial": {
        "shop": ["supermarket", "convenience", "mall", "department_store", "clothes", "electronics"],
        "amenity": ["restaurant", "cafe", "pub", "bar", "fast_food"],
        "building": ["commercial"],
        "landuse": ["commercial"],
    },
    "residential": {"building": ["apartments", "residential", "house"], "landuse": ["residential"]},
    "industrial": {"building": ["industrial", "warehouse"], "landuse": ["industrial"]},
    "recreational": {"leisure": ["park", "stadium", "playground", "sports_centre"]},
    "healthcare": {"amenity": ["hospital", "clinic", "doctors", "pharmacy"]},
    "education": {"amenity": ["school", "university", "college", "kindergarten"]},
    "government": {"amenity": ["townhall", "courthouse", "police", "fire_station"]},
    "transport_hub": {"railway": ["station", "halt"], "amenity": ["bus_station"], "highway": ["bus_stop"]},
}
AEROWAY = {"aeroway": ["aerodrome", "terminal"]}
SERVICE_AMENITIES = ["bank", "post_office", "pharmacy", "fuel", "parking"]
PEDESTRIAN_HIGHWAYS = ["footway", "path", "pedestrian", "steps"]
ROAD_LEVELS = ("primary", "secondary", "tertiary")

POI_COLUMNS = [f"poi_density_{c}" for c in CATEGORIES]
PORTABLE_FEATURES = POI_COLUMNS + [
    "road_density_primary", "road_density_secondary", "road_density_tertiary", "road_density_total",
    "intersection_density", "road_connectivity_index", "mixed_use_index", "urban_density_proxy",
    "pedestrian_infrastructure", "public_transport_access", "charging_suitability_index", "urban_centrality_score",
    "betweenness_centrality_avg", "closeness_centrality_avg", "degree_centrality_avg", "land_use_entropy",
]

# Weights of the urban intensity index, in the order of these columns.
POI_WEIGHTS = {
    "poi_density_commercial": 0.30, "poi_density_residential": 0.20, "poi_density_transport_hub": 0.25,
    "poi_density_healthcare": 0.10, "poi_density_education": 0.10, "poi_density_government": 0.05,
}
