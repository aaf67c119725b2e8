"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize

#: Rows that one local permutation holds, about; the matrix has rows / BLOCK lines.
BLOCK = 100_000
LEAST_PARTS = 64


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` of ``good + bad``: inversion outwards from the mode, for counts of any size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    at = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(choose(good, at) + choose(bad, draws - at) - choose(good + bad, draws))
    u, left, right, pl, pr = rng.random() - p, at, at, p, p
    while u >= 0 and (left > low or right < high):
        step_r = pr * (good - right) / (right + 1) * (draws - right) / (bad - draws + right + 1) if right < high else 0.0
        step_l = pl * left / (good - left + 1) * (bad - draws + left) / (draws - left + 1) if left > low else 0.0
        if step_r == 0.0 and step_l == 0.0:
            break
        if step_r >= step_l:
            right, pr, at = right + 1, step_r, right + 1
        else:
            left, pl, at = left - 1, step_l, left - 1
        u -= step_r if step_r >= step_l else step_l
    return at


def matrix(counts: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard, drawn as a uniform shuffle of all rows would send them.

    Line sums are the partitions' counts and column sums the shards' sizes, exactly.
    """
    rng, left, out = np.random.default_rng(seed), list(shards), np.zeros((len(counts), len(shards)), np.int64)
    for p, n in enumerate(counts):
        rest = sum(left)
        for s in range(len(shards)):
            rest -= left[s]
            out[p, s] = hypergeometric(rng, left[s], rest, n) if n else 0
            n -= int(out[p, s])
        for s in range(len(shards)):
            left[s] -= int(out[p, s])
    return out


def shard(docs: DataFrame, shards: int = 16, seed: int = 20, block: int = BLOCK) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` and ``slot``, a uniform random permutation of the rows.

    Shard counts differ by one row at most; slots count from 0 without gaps. Rows are dealt into partitions by a keyed
    hash. A first narrow pass counts them, the communication matrix is drawn (one line of ``shards`` numbers for about
    ``block`` rows), each partition permutes its rows by a second hash and cuts them at its matrix line; after the
    exchange each shard permutes again by a third hash, in cells of about ``block`` rows whose offsets are prefix sums.
    Draws depend on doc_id, text and seed only, so a lost executor's partitions come out the same. Rows alike in both,
    null ids and null texts among them, are interchangeable and stay in one partition. Long texts are moved, never read. An empty table gives an empty table; columns named ``shard`` or ``slot`` are replaced.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    row = [F.col("doc_id"), F.col("text")]
    keyed = docs.select(F.struct(*names).alias("_row"), F.xxhash64(*row, F.lit(seed)).alias("_one"), F.xxhash64(*row, F.lit(seed + 1)).alias("_two"))
    narrow = materialize(keyed.select("_one", "_two"))
    total = narrow.count()
    parts = max(LEAST_PARTS, math.ceil(total / block))
    part = F.pmod(F.xxhash64("_one"), F.lit(parts)).cast("int")
    counts = {r["p"]: r["n"] for r in narrow.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per partition
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    lines = matrix([counts.get(p, 0) for p in range(parts)], sizes, seed)
    spark = docs.sparkSession
    cuts = F.broadcast(spark.createDataFrame([(p, np.cumsum(line).tolist()) for p, line in enumerate(lines)], "_part int, _cuts array<long>"))
    local = Window.partitionBy("_part").orderBy("_one", "_two")
    cells = max(1, parts // 4)

    def sent(rows: DataFrame) -> DataFrame:
        ranked = rows.withColumn("_part", part).withColumn("_rank", F.row_number().over(local)).join(cuts, "_part")
        to = F.size(F.filter("_cuts", lambda c: c < F.col("_rank")))
        return ranked.withColumn("shard", to).withColumn("_cell", F.pmod(F.col("_two"), F.lit(cells)).cast("int"))

    filled = sent(narrow).groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per shard and cell
    before, offsets = dict.fromkeys(range(shards), 0), []
    for r in sorted(filled, key=lambda r: (r["shard"], r["_cell"])):
        offsets.append((r["shard"], r["_cell"], before[r["shard"]]))
        before[r["shard"]] += r["n"]
    offset = F.broadcast(spark.createDataFrame(offsets, "shard int, _cell int, _from long"))
    within = Window.partitionBy("shard", "_cell").orderBy("_two", "_one")
    placed = sent(keyed).drop("_cuts", "_rank", "_part").withColumn("_at", F.row_number().over(within)).join(offset, ["shard", "_cell"])
    return placed.select("_row.*", "shard", (F.col("_from") + F.col("_at") - 1).alias("slot"))
