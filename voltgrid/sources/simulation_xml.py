"""Simulator outputs in XML, read by row tag; attributes arrive as columns with an underscore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Attributes are read as text: a number that does not parse becomes its default and never stops the read.
BATTERY = "_time string, vehicle array<struct<_id:string,_energyConsumed:string,_actualBatteryCapacity:string,_maximumBatteryCapacity:string>>"
CHARGING = "_id string, vehicle array<struct<_id:string,_totalEnergyChargedIntoVehicle:string,_chargingBegin:string,_chargingEnd:string>>"
SUMMARY = "_time string, _loaded string, _running string, _meanSpeed string, _collisions string, _arrived string, _ended string"
FLOW = "_begin string, edge array<struct<_id:string,_entered:string,_left:string,_speed:string>>"
STATIONS = "_id string, _lane string, _startPos string, _power string"
BAD = "_corrupt_record"


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return (spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
            .schema(f"{schema}, {BAD} string").load(path))


def _or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def _number(value: Column) -> Column:
    return _or(value.try_cast("double"), 0.0)


def _count(value: Column) -> Column:
    return value.try_cast("int")


def battery(spark: SparkSession, path: str) -> DataFrame:
    v = F.col("v")
    rows = _read(spark, path, "timestep", BATTERY).filter(F.col(BAD).isNull()).select("_time", F.explode("vehicle").alias("v"))
    return rows.select(_number(F.col("_time")).alias("time"), _or(v["_id"], "unknown").alias("id"), _number(v["_energyConsumed"]).alias("energy_consumed"),
                       _number(v["_actualBatteryCapacity"]).alias("actual_battery_capacity"), _number(v["_maximumBatteryCapacity"]).alias("maximum_battery_capacity"))


def charging_events(spark: SparkSession, path: str) -> DataFrame:
    v = F.col("v")
    rows = _read(spark, path, "chargingStation", CHARGING).filter(F.col(BAD).isNull()).select("_id", F.explode("vehicle").alias("v"))
    return rows.select(_or(F.col("_id"), "unknown").alias("station_id"), _or(v["_id"], "unknown").alias("vehicle_id"), _number(v["_totalEnergyChargedIntoVehicle"]).alias("total_energy_charged"),
                       _number(v["_chargingBegin"]).alias("charging_begin"), _number(v["_chargingEnd"]).alias("charging_end"))


def summary(spark: SparkSession, path: str) -> DataFrame:
    s = _read(spark, path, "step", SUMMARY).filter(F.col(BAD).isNull())
    return s.select(_number(F.col("_time")).alias("time"), _or(_count(F.col("_loaded")), 0).alias("loaded"), _or(_count(F.col("_running")), 0).alias("running"), _number(F.col("_meanSpeed")).alias("mean_speed"),
                    _or(_count(F.col("_collisions")), 0).alias("collisions"), F.coalesce(_count(F.col("_arrived")), _count(F.col("_ended")), F.lit(0)).alias("arrived"))


def edge_flow(spark: SparkSession, path: str) -> DataFrame:
    """Flow per edge; the latest interval of an edge overwrites earlier ones."""
    e = F.col("e")
    rows = _read(spark, path, "interval", FLOW).filter(F.col(BAD).isNull()).select("_begin", F.explode("edge").alias("e"))
    last = rows.groupBy(e["_id"].alias("edge_id")).agg(F.max_by(F.struct(_number(e["_entered"]).alias("entered"), _number(e["_left"]).alias("left"), _number(e["_speed"]).alias("speed")), F.col("_begin").try_cast("double")).alias("r"))
    return last.select("edge_id", "r.*", F.col("r.entered").alias("flow"))


def _found(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Elements found by pattern in text lines (``s``), for files whose markup is broken; an element's tag must not span lines."""
    return spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(rf"(<{tag}\b[^>]*>)"), F.lit(1))).alias("s"))


def rejected(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Elements (``s``) whose markup is broken, for a quarantine table: the reader gives up on a file at the first of them."""
    good = rf"""^<{tag}(\s+[\w:.-]+\s*=\s*("[^"<]*"|'[^'<]*'))*\s*/?>$"""
    return _found(spark, path, tag).filter(~F.col("s").rlike(good))


def _attribute(name: str, kind: str) -> Column:
    return F.regexp_extract("s", rf'\b{name}="([^"]*)"', 1).try_cast(kind)


def _named(default: str = "unknown") -> Column:
    return F.coalesce(F.nullif(_attribute("id", "string"), F.lit("")), F.lit(default))


def battery_by_pattern(spark: SparkSession, path: str) -> DataFrame:
    """Vehicle states of a broken battery file; the time of a state is lost with the markup around it."""
    number = lambda name: _or(_attribute(name, "double"), 0.0)
    return _found(spark, path, "vehicle").select(_named().alias("id"), number("energyConsumed").alias("energy_consumed"),
                                                 number("actualBatteryCapacity").alias("actual_battery_capacity"), number("maximumBatteryCapacity").alias("maximum_battery_capacity"))


def charging_by_pattern(spark: SparkSession, path: str) -> DataFrame:
    """Charging events of a broken file; the station of an event is lost with the markup around it."""
    number = lambda name: _or(_attribute(name, "double"), 0.0)
    return _found(spark, path, "vehicle").select(_named().alias("vehicle_id"), number("totalEnergyChargedIntoVehicle").alias("total_energy_charged"),
                                                 number("chargingBegin").alias("charging_begin"), number("chargingEnd").alias("charging_end"))


def flow_by_pattern(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a broken flow file; without intervals to order them, all their values stay."""
    number = lambda name: _or(_attribute(name, "double"), 0.0)
    return _found(spark, path, "edge").select(_named().alias("edge_id"), number("entered").alias("entered"), number("left").alias("left"), number("speed").alias("speed"))


def summary_by_pattern(spark: SparkSession, path: str) -> DataFrame:
    s, attr = _found(spark, path, "step"), _attribute
    return s.select(_or(attr("time", "double"), 0.0).alias("time"), _or(attr("loaded", "int"), 0).alias("loaded"), _or(attr("running", "int"), 0).alias("running"),
                    _or(attr("meanSpeed", "double"), 0.0).alias("mean_speed"), F.coalesce(attr("arrived", "int"), attr("ended", "int"), F.lit(0)).alias("arrived"))


def station_sites(spark: SparkSession, path: str, edges: DataFrame) -> DataFrame:
    """Stations with coordinates by lane position and power in kW."""
    from voltgrid.operators.roads import point_at, to_lat_lon

    s = _read(spark, path, "chargingStation", STATIONS).filter(F.col(BAD).isNull())
    j = s.withColumn("edge_id", F.regexp_replace("_lane", r"_\d+$", "")).join(edges.select("edge_id", "shape"), "edge_id")
    j = j.withColumn("_p", F.explode(F.array(point_at(F.col("shape"), F.col("_startPos").try_cast("double")))))
    lat, lon = to_lat_lon(F.col("_p.x"), F.col("_p.y"))
    return j.select(F.col("_id").alias("station_id"), F.col("_lane").alias("lane"), lat.alias("lat"), lon.alias("lon"), (F.col("_power").try_cast("double") / 1000).alias("power_kw"))
