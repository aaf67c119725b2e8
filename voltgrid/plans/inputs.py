"""Engine input tables as projections of the given parquet tables.

Every projection is plain SQL text with the same meaning in Spark and in the checking database, so that a query
and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_RAW = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
        "labels conversations").split()

# Corners (x, y) of a boundary's outer ring and of its hole, in shares of its radius.
_BOUNDARY = (((1.0, 0.05), (0.55, 0.4), (0.6, 0.9), (0.1, 0.6), (-0.4, 1.0), (-0.5, 0.3), (-1.0, 0.1), (-0.6, -0.5), (-0.2, -1.0), (0.45, -0.55)),
             ((0.2, 0.1), (0.05, 0.3), (-0.2, 0.05), (0.0, -0.25)))

FX: dict[str, tuple[str, dict[str, str], str | None]] = {
    "fx_stations": ("supplier", {
        "station_id": "CAST(s_suppkey AS STRING)",
        "latitude": "CASE WHEN s_suppkey % 41 = 0 THEN 0e0 "
                    "ELSE 22.45e0 + CAST(s_suppkey * 37 % 400 AS DOUBLE) / 1000e0 END",
        "longitude": "113.75e0 + CAST(s_suppkey * 53 % 900 AS DOUBLE) / 1000e0",
        "charge_count": "CAST(s_suppkey % 40 AS INT)",
    }, None),
    "fx_charging": ("lineitem", {
        "station_id": "CAST(l_suppkey AS STRING)", "ts": "l_shipdate", "kwh": "l_quantity",
        "hours": "l_discount * 100e0", "occupancy": "l_tax * 10e0",
    }, None),
    "fx_points": ("events", {
        "veh_id": "CAST(user_id AS STRING)",
        "lat": "42.217e0 + CAST((user_id * 31 + length(event_type) * 97) % 1309 AS DOUBLE) / 10000e0",
        "lon": "-83.8084e0 + CAST((user_id * 57 + length(event_type) * 211) % 1337 AS DOUBLE) / 10000e0",
        "ts": "ts", "week": "CAST(date_trunc('week', ts) AS DATE)", "ord": "event_id",
    }, None),
    "fx_elements": ("part", {
        "osmid": "p_partkey",
        "tag_key": "CASE p_type WHEN 'ECONOMY' THEN 'amenity' WHEN 'STANDARD' THEN 'building' "
                   "WHEN 'PROMO' THEN 'shop' WHEN 'LARGE' THEN 'leisure' ELSE 'highway' END",
        "tag_value": "CASE p_type WHEN 'ECONOMY' THEN CASE p_size % 4 WHEN 0 THEN 'restaurant' WHEN 1 THEN "
                     "'hospital' WHEN 2 THEN 'school' ELSE 'police' END WHEN 'STANDARD' THEN CASE p_size % 3 "
                     "WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' ELSE 'industrial' END "
                     "WHEN 'PROMO' THEN 'supermarket' WHEN 'LARGE' THEN 'park' WHEN 'SMALL' THEN 'primary' "
                     "ELSE CASE p_size % 3 WHEN 0 THEN 'secondary' WHEN 1 THEN 'tertiary' ELSE 'bus_stop' END END",
        "lat": "42.217e0 + CAST(p_partkey * 41 % 1309 AS DOUBLE) / 10000e0",
        "lon": "-83.8084e0 + CAST(p_partkey * 67 % 1337 AS DOUBLE) / 10000e0",
        "length_m": "CAST(p_size AS DOUBLE) * 10e0",
    }, None),
    "fx_battery": ("lineitem", {
        "episode": "CAST(l_suppkey % 20 AS INT)", "id": "CAST(l_orderkey AS STRING)",
        "time": "CAST(l_linenumber * 60 + l_partkey % 60 AS DOUBLE)",
        "energy_consumed": "l_extendedprice / 100e0",
        "actual_battery_capacity": "64000e0 * (0.1e0 + 0.8e0 * l_quantity / 50e0)",
        "maximum_battery_capacity": "64000e0",
    }, None),
    "fx_charge_events": ("lineitem", {
        "episode": "CAST(l_suppkey % 20 AS INT)", "station_id": "CAST(l_suppkey AS STRING)",
        "vehicle_id": "CAST(l_orderkey AS STRING)", "total_energy_charged": "l_extendedprice / 100e0",
        "charging_begin": "CAST(l_partkey * 13 % 3600 AS DOUBLE)",
        "charging_end": "CAST(l_partkey * 13 % 3600 AS DOUBLE) + l_quantity * 10e0",
    }, None),
    "fx_summary": ("orders", {
        "episode": "CAST(o_custkey % 20 AS INT)", "time": "CAST(o_orderkey AS DOUBLE)",
        "loaded": "CAST(o_orderkey % 97 + 3 AS INT)", "running": "CAST(o_orderkey % 40 AS INT)",
        "mean_speed": "CAST(o_orderkey * 7 % 200 AS DOUBLE) / 10e0",
        "arrived": "CAST(floor((o_orderkey % 97 + 3) / 2e0) AS INT)",
    }, None),
    "fx_edge_flow": ("part", {
        "episode": "CAST(p_partkey % 20 AS INT)", "edge_id": "concat('e_', CAST(p_partkey AS STRING))",
        "entered": "CAST(p_size - 1 AS DOUBLE)", "speed": "CAST(p_partkey * 11 % 250 AS DOUBLE) / 10e0",
    }, None),
    "fx_episodes": ("events", {
        "grid_id": "concat('grid_', CAST(user_id % 12 AS STRING))",
        "method": "CASE event_type WHEN 'view' THEN 'hybrid_ucb' WHEN 'click' THEN 'hybrid_epsilon' "
                  "WHEN 'signup' THEN 'hybrid_thompson' WHEN 'purchase' THEN 'kmeans' ELSE 'uniform' END",
        "episode": "event_id", "arm": "CAST(event_id % 7 AS INT)", "reward": "least(1e0, value / 100e0)",
    }, None),
    "fx_placements": ("supplier", {
        "grid_id": "concat('grid_', CAST(s_suppkey % 12 AS STRING))",
        "method": "concat('m', CAST(s_nationkey % 5 AS STRING))",
        "edge_id": "concat('e_', CAST(s_suppkey % 60 AS STRING))",
        "lat": "42.217e0 + CAST(s_suppkey * 29 % 1309 AS DOUBLE) / 10000e0",
        "lon": "-83.8084e0 + CAST(s_suppkey * 83 % 1337 AS DOUBLE) / 10000e0",
    }, None),
    "fx_predictions": ("customer", {
        "grid_id": "concat('grid_', CAST(c_custkey AS STRING))",
        "actual": "(c_acctbal + 1000e0) / 11000e0",
        "predicted": "0.7e0 * (c_acctbal + 1000e0) / 11000e0 + CAST(c_custkey * 37 % 100 AS DOUBLE) / 300e0",
    }, None),
    "fx_route_edges": ("lineitem", {
        "trip_id": "CAST(l_orderkey AS STRING)", "pos": "l_linenumber",
        "edge_id": "concat('e_', CAST(l_partkey % 200 AS STRING))",
    }, None),
    # Charging sites: one per supplier and placement index, with the id kept for ordered choices.
    "fx_sites": ("supplier", {
        "site_id": "CAST(s_suppkey AS STRING)", "site_no": "s_suppkey",
        "lat": "42.217e0 + CAST(s_suppkey * 29 % 1309 AS DOUBLE) / 10000e0",
        "lon": "-83.8084e0 + CAST(s_suppkey * 83 % 1337 AS DOUBLE) / 10000e0",
    }, None),
    # Straight road edges, one lane each; shape runs between two points near the part's position.
    "fx_edges": ("part", {
        "edge_id": "concat('e_', CAST(p_partkey AS STRING))", "edge_no": "p_partkey",
        "from_node": "CAST(p_partkey % 500 AS STRING)", "to_node": "CAST(p_partkey * 7 % 500 AS STRING)",
        "length_m": "CAST(p_size AS DOUBLE) * 10e0",
        "highway": "CASE p_size % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' ELSE 'tertiary' END",
        "passenger": "p_partkey % 5 <> 0",
        "lat0": "42.217e0 + CAST(p_partkey * 41 % 1309 AS DOUBLE) / 10000e0",
        "lon0": "-83.8084e0 + CAST(p_partkey * 67 % 1337 AS DOUBLE) / 10000e0",
        "lat1": "42.217e0 + CAST(p_partkey * 41 % 1309 AS DOUBLE) / 10000e0 + CAST(p_size AS DOUBLE) / 20000e0",
        "lon1": "-83.8084e0 + CAST(p_partkey * 67 % 1337 AS DOUBLE) / 10000e0 + CAST(p_size % 7 AS DOUBLE) / 9000e0",
    }, None),
    # One boundary per supplier: an outer ring that is not convex (ring 0) and a hole (ring 1), corner by corner.
    "fx_ring_corners": ("supplier CROSS JOIN (VALUES " + ", ".join(
        f"({ring}, {pos}, {x}e0, {y}e0)" for ring, corners in enumerate(_BOUNDARY) for pos, (x, y) in enumerate(corners)) + ") AS c(ring, pos, ux, uy)", {
        "area_id": "CAST(s_suppkey AS STRING)", "ring": "ring", "pos": "pos",
        "lat": "42.2e0 + CAST(s_suppkey * 37 % 400 AS DOUBLE) / 1000e0 + uy * (0.01e0 + CAST(s_suppkey % 5 AS DOUBLE) * 0.004e0)",
        "lon": "-83.8e0 + CAST(s_suppkey * 53 % 900 AS DOUBLE) / 1000e0 + 1.35e0 * ux * (0.01e0 + CAST(s_suppkey % 5 AS DOUBLE) * 0.004e0)",
    }, None),
    # Land cover of these boundaries: a small triangle per line item.
    "fx_cover_corners": ("lineitem CROSS JOIN (VALUES (0, 0e0, 0e0), (1, 1e0, 0.3e0), (2, 0.2e0, 1e0)) AS c(pos, ux, uy)", {
        "area_id": "CAST(l_suppkey AS STRING)", "shape_id": "concat_ws('_', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_suppkey AS STRING), CAST(l_partkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING))", "ring": "0", "pos": "pos",
        "cover": "CASE WHEN l_partkey % 3 = 0 THEN 'water' WHEN l_partkey % 3 = 1 THEN 'urban' ELSE 'other' END",
        "lat": "42.2e0 + CAST(l_suppkey * 37 % 400 AS DOUBLE) / 1000e0 + CAST(l_orderkey * 71 % 500 - 250 AS DOUBLE) / 10000e0 + uy * l_quantity / 20000e0",
        "lon": "-83.8e0 + CAST(l_suppkey * 53 % 900 AS DOUBLE) / 1000e0 + CAST(l_orderkey * 29 % 700 - 350 AS DOUBLE) / 10000e0 + ux * l_quantity / 15000e0",
    }, None),
    # One rectangular planning area per nation.
    "fx_areas": ("nation", {
        "area_id": "CAST(n_nationkey AS STRING)",
        "min_lat": "42.2e0 + CAST(n_nationkey * 7 % 25 AS DOUBLE) / 100e0",
        "max_lat": "42.2e0 + CAST(n_nationkey * 7 % 25 AS DOUBLE) / 100e0 + 0.04e0 + "
                   "CAST(n_nationkey % 3 AS DOUBLE) / 100e0",
        "min_lon": "-83.9e0 + CAST(n_nationkey * 11 % 25 AS DOUBLE) / 100e0",
        "max_lon": "-83.9e0 + CAST(n_nationkey * 11 % 25 AS DOUBLE) / 100e0 + 0.05e0 + "
                   "CAST(n_nationkey % 4 AS DOUBLE) / 100e0",
    }, None),
}

# Lattices used as cells: (rows, columns, first lat, first lon, edge); offsets keep points off the edges.
LATTICES = {"fx_cells": (14, 14, 42.21695, -83.80845, 0.01), "fx_station_cells": (9, 19, 22.44995, 113.74995, 0.05)}


def fx_sql(name: str) -> str:
    """Body of the input view ``name`` (without WITH), valid in Spark SQL and in the checking database."""
    if name in LATTICES:
        rows, cols, lat0, lon0, step = LATTICES[name]
        span = "SELECT {a} AS {a} FROM (SELECT DISTINCT n_nationkey AS {a} FROM nation) q WHERE {a} < {n}"
        return (
            f"SELECT concat('grid_', CAST(i AS STRING), '_', CAST(j AS STRING)) AS grid_id, i * {cols} + j AS cell_order, "
            f"{lat0}e0 + i * {step}e0 AS min_lat, {lat0}e0 + (i + 1) * {step}e0 AS max_lat, "
            f"{lon0}e0 + j * {step}e0 AS min_lon, {lon0}e0 + (j + 1) * {step}e0 AS max_lon "
            f"FROM ({span.format(a='i', n=rows)}) ti CROSS JOIN ({span.format(a='j', n=cols)}) tj")
    table, cols, where = FX[name]
    body = ", ".join(f"{expr} AS {c}" for c, expr in cols.items())
    return f"SELECT {body} FROM {table}" + (f" WHERE {where}" if where else "")


class Tables:
    """The given tables under one folder and the input views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def fx(self, name: str) -> DataFrame:
        name = name if name.startswith("fx_") else f"fx_{name}"
        source = "nation" if name in LATTICES else FX[name][0].split()[0]
        sql = fx_sql(name)
        if name in LATTICES:
            sql = sql.replace("FROM nation", "FROM {src}")
        else:
            sql = sql.replace(f" FROM {source}", " FROM {src}", 1) if f" FROM {source}" in sql else sql
        return self.spark.sql(sql, src=self.raw(source))
