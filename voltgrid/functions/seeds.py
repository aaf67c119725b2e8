"""Per-run seeds from the base seed, the grid id and the episode."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltgrid.functions.hashing import ord_sum


def deterministic_seed(base: int, grid_id: Column, episode: Column) -> Column:
    return (F.lit(base) + ord_sum(grid_id) % 100000 + 10000 * episode) % (2**31 - 1)
