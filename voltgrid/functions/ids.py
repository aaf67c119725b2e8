"""Ids under several possible column names."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """First non-null of the listed columns that exist, as text."""
    have = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")
