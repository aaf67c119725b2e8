"""Global statistics as a one-row table joined to every row (never an un-partitioned window)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_globals(df: DataFrame, *aggs: Column) -> DataFrame:
    """Append grand aggregates to every row; the broadcast side is a single row by construction."""
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def with_group_stats(df: DataFrame, keys: list[str], *aggs: Column, salts: int = 32) -> DataFrame:
    """Append per-group aggregates: aggregate (combined before its shuffle), then join back on key and salt.

    Rows of a group are dealt over ``salts`` join keys by a hash of the row, and the aggregate row is repeated for each,
    so that a group with a third of all rows is shared by many tasks whatever way the planner joins.
    """
    stats = df.groupBy(*keys).agg(*aggs).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")]), F.lit(salts)).cast("int"))
    return dealt.join(stats, [*keys, "_salt"]).drop("_salt")
