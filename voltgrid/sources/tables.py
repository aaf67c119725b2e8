"""CSV and parquet sources with fixed schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltgrid.operators.demand import unpivot_arrays, widen

TRIP_COLUMNS = {"VehId": "veh_id", "Timestamp(ms)": "timestamp", "Latitude[deg]": "lat", "Longitude[deg]": "lon"}
SESSION_SCHEMAS = {
    "occupancy": "station_id string, duration_hours double, sessions long",
    "volume": "station_id string, kwh_dispensed double, num_chargers int, row_order long",
    "mapping": "station_id string, grid_id string",
}
STATION_RENAMES = {  # names of the two station-table layouts
    "first": {"TAZID": "station_id", "longitude": "longitude", "latitude": "latitude", "charge_count": "charge_count"},
    "second": {"grid": "station_id", "lon": "longitude", "la": "latitude", "count": "charge_count",
               "fast_count": "fast_count", "slow_count": "slow_count"},
}


def trip_csv(spark: SparkSession, folder: str) -> DataFrame:
    """All ``VED_yymmdd…`` trip files (or ``VED=yymmdd`` folders): four columns, week from the file name, valid coordinates, seconds."""
    raw = spark.read.option("header", True).csv(f"{folder}/VED[_=]*")
    picked = raw.select(*[F.col(f"`{old}`").alias(new) for old, new in TRIP_COLUMNS.items()],
                        F.to_date(F.regexp_extract(F.input_file_name(), r"VED[_=](\d{6})", 1), "yyMMdd").alias("week"))
    num = lambda c: F.col(c).try_cast("double")
    typed = picked.select(F.col("veh_id").cast("string").alias("veh_id"), num("lat").alias("lat"), num("lon").alias("lon"),
                          (num("timestamp") / 1000).alias("t"), "week")
    return typed.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def station_csv(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Station or zone table under common names; the station key is text."""
    names = STATION_RENAMES[layout]
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in names if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return raw.select(*[F.col(o).alias(n) if n == "station_id" else F.col(o).try_cast("int" if n.endswith("count") else "double").alias(n)
                        for o, n in names.items()])


#: Fields of a CSV line that has quotes.
_FIELD = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'


def wide_lines(spark: SparkSession, path: str, time_col: str, measure: str) -> DataFrame:
    """A wide file or folder of files (time plus one field per station) -> (time, station_id, value as text).

    Lines are split into arrays and met with the header line on the position, so that stations are rows and never
    columns or names on the driver: a line may have a million fields. Header lines of one path must be the same.
    """
    text = F.regexp_replace("value", "\\r$", "")
    plain = F.split(text, ",", -1)
    quoted = F.transform(F.regexp_extract_all(text, F.lit(_FIELD), F.lit(1)), lambda f: F.regexp_replace(F.regexp_replace(f, '^"|"$', ""), '""', '"'))
    lines = spark.read.text(path).filter("value <> ''").select(F.when(F.contains(F.col("value"), F.lit('"')), quoted).otherwise(plain).alias("f"))
    named = F.get("f", F.lit(0)) == time_col
    rest = F.slice("f", F.lit(2), F.greatest(F.size("f") - 1, F.lit(0)))
    header = lines.filter(named).select(F.posexplode(rest).alias("pos", "station_id")).distinct().withColumn("pos", F.col("pos").cast("long") + 1)
    rows = lines.filter(~named).select(F.get("f", F.lit(0)).alias(time_col), F.transform(rest, lambda v: F.when(v != "", v)).alias("values"))
    return unpivot_arrays(rows, header, time_col, measure)


def write_wide_csv(long: DataFrame, path: str, time_col: str, station_col: str, value: str) -> None:
    """Write (time, station, value) rows as a wide CSV folder: a header line, then one line per time."""
    wide, header = widen(long, time_col, station_col, value)
    quote = lambda c: F.when(c.rlike('[",]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "station_id"))), lambda h: quote(h["station_id"])), ",")
    first = header.agg(F.concat_ws(",", F.lit(time_col), names).alias("value"))
    lines = wide.select(F.concat_ws(",", F.col(time_col).cast("string"), F.array_join(F.transform("values", lambda v: v.cast("string")), ",", "")).alias("value"))
    first.unionByName(lines).write.text(path)


def wide_series_csv(spark: SparkSession, paths: Mapping[str, Sequence[str]], time_col: str = "time") -> DataFrame:
    """Wide files (time plus one column per station) for kwh, hours and occupancy -> one long table.

    A measure may come in several files, each with a block of the stations or of the times.
    A missing file fails on read. Series are joined on (ts, station_id); gaps stay null.
    """
    out = None
    for measure, files in paths.items():
        long = reduce(DataFrame.unionByName, [wide_lines(spark, f, time_col, measure) for f in files])
        part = long.select(F.col(time_col).try_cast("timestamp").alias("ts"), "station_id", F.col(measure).try_cast("double").alias(measure))
        out = part if out is None else out.join(part, ["ts", "station_id"], "full_outer")
    return out


def session_csv(spark: SparkSession, occupancy: str, volume: str, mapping: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occupancy, volume and the mandatory station to grid mapping."""
    read = lambda kind, path: spark.read.option("header", True).schema(SESSION_SCHEMAS[kind]).csv(path)
    return read("occupancy", occupancy), read("volume", volume), read("mapping", mapping)


def custom_trajectories(spark: SparkSession, path: str, required: Sequence[str] = ("lat", "lon", "kwh", "hours")) -> DataFrame:
    """Parquet or CSV by suffix; the required columns must be there."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif path.endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
        df = df.withColumns({c: F.col(c).try_cast("double") for c in required if c in df.columns})
    else:
        raise ValueError(f"unknown trajectory format: {path}")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"custom trajectories lack {missing}")
    return df


def feature_lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    return spark.read.parquet(path).join(wanted.select("grid_id").distinct(), "grid_id", "left_semi")
