"""Charging demand scores: cleanup, resampling, station totals, normalisation, weighting, grid aggregates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.functions.onerow import with_globals
from voltgrid.operators.ordered import row_numbers

# Weight pairs (kWh share, hours share) of the score variations: fixed values.
VARIATIONS = {
    "hours_only": (0.0, 1.0),
    "kwh25_hrs75": (0.25, 0.75),
    "balanced": (0.5, 0.5),
    "kwh75_hrs25": (0.75, 0.25),
    "kwh_only": (1.0, 0.0),
}
PERIODS = {"D": "day", "W": "week", "M": "month"}
EPS = 1e-8


def unpivot_wide(wide: DataFrame, time_col: str, value_name: str) -> DataFrame:
    """One column per station -> (time, station_id, value)."""
    stations = [c for c in wide.columns if c != time_col]
    return wide.unpivot([time_col], stations, "station_id", value_name)


def widen(long: DataFrame, time_col: str, station_col: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Wide rows (time, values by position) and their header (pos, station_id): one array a row, no column per station.

    A station has a position by its rank; gaps are null. The cells are as many as the wide table has.
    """
    header = materialize(row_numbers(long.select(F.col(station_col).alias("station_id")).distinct(), [], ["station_id"], "pos"))
    times = long.select(time_col).distinct()
    cells = times.crossJoin(header).join(long.select(time_col, F.col(station_col).alias("station_id"), value), [time_col, "station_id"], "left")
    rows = cells.groupBy(time_col).agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("values"))
    return rows.select(time_col, F.transform("values", lambda v: v[value]).alias("values")), header


def unpivot_arrays(wide: DataFrame, header: DataFrame, time_col: str, value_name: str) -> DataFrame:
    """Wide rows (time, values) and a header (pos from 1, station_id) -> (time, station_id, value), joined on the position."""
    cells = wide.select(time_col, F.posexplode("values").alias("pos", value_name)).withColumn("pos", F.col("pos").cast("long") + 1)
    return cells.join(header.select("pos", "station_id"), "pos").select(time_col, "station_id", value_name)


def clean_number(c: Column) -> Column:
    """Null, NaN and infinities count as 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def valid_stations(stations: DataFrame, rule: str = "nonzero") -> DataFrame:
    lat, lon = F.col("latitude"), F.col("longitude")
    known = lat.isNotNull() & lon.isNotNull()
    rules = {"known": known, "nonzero": known & (lat != 0) & (lon != 0),
             "extent": known & (F.abs(lat) > 0.1) & (F.abs(lon) > 0.1)}
    return stations.filter(rules[rule])


def per_charger(total: Column, chargers: Column, mode: str = "at_least_one") -> Column:
    if mode == "at_least_one":
        return total / F.greatest(chargers, F.lit(1))
    return total / F.when(chargers == 0, F.lit(1)).otherwise(chargers)


def non_negative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull() & (F.col(c) >= 0)
    return df.filter(keep)


def resample(readings: DataFrame, period: str) -> DataFrame:
    """Per station and period: sums of kWh and hours, mean occupancy. Periods without rows do not appear."""
    bucket = F.date_trunc(PERIODS[period], F.col("ts")).alias("period")
    return readings.groupBy("station_id", bucket).agg(
        F.sum("kwh").alias("kwh"), F.sum("hours").alias("hours"), F.avg("occupancy").alias("occupancy"))


def station_totals(readings: DataFrame, period: str) -> DataFrame:
    """Totals over the periods and the mean of the period means of occupancy."""
    return resample(readings, period).groupBy("station_id").agg(
        F.sum("kwh").alias("total_kwh"), F.sum("hours").alias("total_hours"),
        F.avg("occupancy").alias("avg_occupancy"))


def station_metrics(readings: DataFrame, stations: DataFrame, period: str = "D",
                    rule: str = "nonzero") -> DataFrame:
    """Station totals with location and per-charger values."""
    chargers = F.greatest(F.col("charge_count"), F.lit(1))
    joined = station_totals(readings, period).join(valid_stations(stations, rule), "station_id")
    out = joined.select(
        "station_id", "latitude", "longitude", chargers.alias("num_chargers"), "total_kwh", "total_hours",
        (F.col("total_kwh") / chargers).alias("kwh_per_charger"),
        (F.col("total_hours") / chargers).alias("hours_per_charger"), "avg_occupancy")
    return non_negative(out, ["kwh_per_charger", "hours_per_charger"])


def normalize_eps(df: DataFrame, columns: Mapping[str, str], eps: float = EPS) -> DataFrame:
    """Min-max columns ``{source: target}`` with range at least ``eps`` and a clip to [0, 1]."""
    stats = [f(c).alias(f"_{t}_{c}") for c in columns for t, f in (("lo", F.min), ("hi", F.max))]
    out = with_globals(df, *stats)
    for c, target in columns.items():
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        scaled = (F.col(c) - lo) / F.greatest(hi - lo, F.lit(eps))
        out = out.withColumn(target, F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))
    return out.drop(*[f"_{t}_{c}" for c in columns for t in ("lo", "hi")])


def check_weights(kwh_weight: float, hours_weight: float) -> None:
    if not math.isclose(kwh_weight + hours_weight, 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError(f"weights must sum to 1, got {kwh_weight} and {hours_weight}")


def weighted_score(kwh_weight: float = 0.7, hours_weight: float = 0.3) -> Column:
    check_weights(kwh_weight, hours_weight)
    return kwh_weight * F.col("kwh_normalized") + hours_weight * F.col("hours_normalized")


def score_stations(metrics: DataFrame, kwh_weight: float = 0.7, hours_weight: float = 0.3) -> DataFrame:
    norm = normalize_eps(metrics, {"kwh_per_charger": "kwh_normalized", "hours_per_charger": "hours_normalized"})
    return norm.withColumn("demand_score", weighted_score(kwh_weight, hours_weight))


def score_variations(metrics: DataFrame) -> DataFrame:
    """All weight variations in one projection."""
    norm = normalize_eps(metrics, {"kwh_per_charger": "kwh_normalized", "hours_per_charger": "hours_normalized"})
    return norm.select("*", *[weighted_score(*w).alias(f"demand_score_{n}") for n, w in VARIATIONS.items()])


def merge_variations(frames: Mapping[str, DataFrame], key: str = "station_id") -> DataFrame:
    """Full outer merge of single-variation scores; each frame has (key, demand_score)."""
    merged = None
    for name, df in frames.items():
        part = df.select(key, F.col("demand_score").alias(f"demand_score_{name}"))
        merged = part if merged is None else merged.join(part, key, "full_outer")
    return merged


def charging_by_grid(sessions: DataFrame, order: Sequence[str]) -> DataFrame:
    """Raw sessions (grid_id, kwh, hours, chargers): sums, and the charger count of the first row in order."""
    return sessions.groupBy("grid_id").agg(
        F.sum("kwh").alias("total_kwh"), F.sum("hours").alias("total_hours"),
        F.min_by("chargers", F.struct(*order)).alias("num_chargers"))


def session_merge(occupancy: DataFrame, volume: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per station: duration and session sums joined to energy sums and the first charger count."""
    occ = occupancy.groupBy("station_id").agg(
        F.sum("duration_hours").alias("total_hours"), F.sum("sessions").alias("sessions"))
    vol = volume.groupBy("station_id").agg(
        F.sum("kwh_dispensed").alias("total_kwh"),
        F.min_by("num_chargers", F.struct(*order)).alias("num_chargers"))
    return occ.join(vol, "station_id")


def sessions_by_grid(merged: DataFrame, mapping: DataFrame) -> DataFrame:
    """Left join of the station to grid mapping, unmapped stations dropped, sums per grid."""
    mapped = merged.join(mapping, "station_id", "left").filter(F.col("grid_id").isNotNull())
    return mapped.groupBy("grid_id").agg(
        F.sum("total_kwh").alias("total_kwh"), F.sum("total_hours").alias("total_hours"),
        F.sum("sessions").alias("sessions"), F.sum("num_chargers").alias("num_chargers"))


def common_stations(readings: DataFrame, durations: DataFrame, info: DataFrame) -> DataFrame:
    """Readings of stations known to all three tables."""
    return (readings.join(durations.select("station_id").distinct(), "station_id", "left_semi")
            .join(info.select("station_id").distinct(), "station_id", "left_semi"))


def grid_demand(scored_in_cells: DataFrame, kwh_weight: float = 0.7, hours_weight: float = 0.3) -> DataFrame:
    """Stations with grid_id -> per-grid sums and means, per-charger values and score at grid level."""
    g = scored_in_cells.groupBy("grid_id").agg(
        F.count("station_id").alias("num_stations"), F.sum("num_chargers").alias("num_chargers"),
        F.sum("total_kwh").alias("total_kwh"), F.sum("total_hours").alias("total_hours"),
        F.avg("avg_occupancy").alias("avg_occupancy"), F.avg("latitude").alias("latitude"),
        F.avg("longitude").alias("longitude"))
    ratios = (g.withColumn("kwh_per_charger", F.col("total_kwh") / F.col("num_chargers"))
              .withColumn("hours_per_charger", F.col("total_hours") / F.col("num_chargers")))
    return score_stations(ratios, kwh_weight, hours_weight)


def quality_report(scores: DataFrame, column: str = "demand_score") -> DataFrame:
    from voltgrid.operators.ordered import percentiles

    v = F.col(column)
    known = v.isNotNull() & ~F.isnan(v)
    ok = F.when(known, v)
    base = scores.agg(
        F.count(F.lit(1)).alias("n_grids"), F.count_if(~known).alias("n_nan"),
        F.count_if(ok < 0).alias("n_negative"), F.count_if(ok > 1).alias("n_above_one"),
        F.avg(ok).alias("mean"), F.stddev_samp(ok).alias("std"), F.min(ok).alias("min"), F.max(ok).alias("max"))
    q = percentiles(scores, [], column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return base.crossJoin(F.broadcast(q))
