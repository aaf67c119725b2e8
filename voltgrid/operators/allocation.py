"""Sharing a station budget over cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.onerow import with_globals
from voltgrid.operators.ordered import row_numbers


def demand_share(cells: DataFrame, demand: str = "demand_score") -> DataFrame:
    """demand / total; equal shares when the total is not positive."""
    out = with_globals(cells, F.sum(demand).alias("_total"), F.count(F.lit(1)).alias("_cells"))
    share = F.when(F.col("_total") > 0, F.col(demand) / F.col("_total")).otherwise(1.0 / F.col("_cells"))
    return out.withColumn("share", share).drop("_total", "_cells")


def _quota(budget: int) -> Column:
    # Rounded so that summation order cannot move an exact quota across an integer.
    return F.round(F.col("share") * budget, 9)


def largest_remainder(cells: DataFrame, budget: int, demand: str = "demand_score",
                      tie_order: str = "grid_id") -> DataFrame:
    """Floor of the quota, then one more for the largest fractions; ties by ``tie_order``; sums to the budget."""
    shared = (demand_share(cells, demand).withColumn("_quota", _quota(budget))
              .withColumn("base", F.floor("_quota")).withColumn("priority", F.col("_quota") - F.floor("_quota")))
    # The remainder is smaller than the number of cells; its cells are a top-n by id, so no row needs a rank.
    remaining = shared.agg(F.lit(budget) - F.sum("base")).first()[0] or 0
    more = shared.orderBy(F.col("priority").desc(), F.col(tie_order)).limit(max(0, int(remaining))).select(F.col(tie_order).alias("_more"))
    joined = shared.join(more, F.col(tie_order) == F.col("_more"), "left")
    return joined.withColumn("stations", F.col("base") + F.col("_more").isNotNull().cast("long")).drop("_quota", "base", "_more")


def zero_demand_split(cells: DataFrame, budget: int) -> DataFrame:
    """All demand zero: budget // cells each, remainder not given."""
    out = with_globals(cells, F.count(F.lit(1)).alias("_cells"))
    return out.withColumn("stations", F.floor(F.lit(budget) / F.col("_cells"))).drop("_cells")


def no_prediction_split(cells: DataFrame, budget: int, order: str) -> DataFrame:
    """No predictions: at least one each, the positive remainder to the first cells in order."""
    out = with_globals(cells, F.count(F.lit(1)).alias("_cells"))
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("_cells")))
    ranked = row_numbers(out, [], [order], "_rn")
    extra = (F.col("_rn") <= F.lit(budget) - each * F.col("_cells")).cast("long")
    return ranked.withColumn("stations", each + extra).drop("_cells", "_rn")


def robust_split(cells: DataFrame, budget: int, order: str, demand: str = "demand_score") -> DataFrame:
    """Proportional split with ties in input order.

    Flooring leaves fewer open stations than there are cells, so the remainder pass always meets the budget
    and no correction pass can be left to run.
    """
    return largest_remainder(cells, budget, demand, order)


def fixed_split(cells: DataFrame, per_grid: int = 2) -> DataFrame:
    return cells.withColumn("stations", F.lit(per_grid))


def with_default_demand(cells: DataFrame, predictions: DataFrame, default: float = 1.0) -> DataFrame:
    return (cells.join(predictions, "grid_id", "left")
            .withColumn("demand", F.coalesce("prediction", F.lit(default))).drop("prediction"))
