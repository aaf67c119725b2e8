"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.llm.tables import words_of
from voltgrid.operators.ordered import row_numbers

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 7


def offset(seed: int = SEED) -> float:
    return random.Random(seed).random()


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) rows: the mix has ``share`` times all sizes, dealt by weight.

    Weights repeat over the sources in code-point order, null last. A target stops at ``most`` times its source; the
    excess is dealt again by weight until none is above. In closed form, with sources in order of size / weight: those
    before the first that stays under its limit are full, the others share what is left by weight. One row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weighed = per.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    everything = Window.partitionBy(F.lit(0))
    by_fill = everything.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rate = ((F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
            / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    rated = weighed.withColumn("limit", F.col("source_size") * most).withColumn("rate", rate)
    under = F.when(F.col("rate") * F.col("w") <= F.col("limit"), F.struct(F.row_number().over(by_fill).alias("k"), "rate"))
    level = F.min(under).over(everything)["rate"]
    full = level.isNull() | (level * F.col("w") > F.col("limit"))
    return rated.withColumn("target", F.when(full, F.col("limit").cast("double")).otherwise(level * F.col("w"))).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, copies) for every row of ``docs`` (doc_id, text, source).

    Within a source every document is expected target / source_size times. Documents stand in order of size (then of a
    hash of the id), expected copies are summed up along that order, one random offset is added, and a document is taken
    once for each whole number that the sum crosses at it: at most ``most`` times, and the words taken stay near the
    target, as neighbours have like sizes. The order is cut into slices over the whole cluster, so a source with a third
    of all rows is no single task. A null text has size 0, null sources are one source, an empty source gets target 0.
    Repeated rows are sampled each for itself. Key is a hash of the text. An empty table gives an empty table.
    """
    rows = materialize(docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), F.xxhash64("text").alias("key"), F.md5(F.col("doc_id").cast("string")).alias("draw")))
    ranked = row_numbers(rows, ["source"], ["size", "draw", "doc_id", "key"], "rank")
    goal = targets(rows, weights, share, most).withColumnRenamed("source", "_source")
    joined = ranked.join(goal, ranked["source"].eqNullSafe(goal["_source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda rank: F.floor(rank * rate + F.lit(offset(seed)))
    return joined.select("doc_id", "key", "source", "size", "source_size", "target", (upto(F.col("rank")) - upto(F.col("rank") - 1)).cast("int").alias("copies"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as the mix takes it. Repeated rows pool their copies, dealt evenly.

    Rows without id or text are rows like others; only repeated rows are numbered, in slices, so that a row repeated very
    often is no single task. Columns keep their values whatever their names; an empty table gives an empty table."""
    taken = mix(docs, weights, share, most, seed).groupBy("doc_id", "key", "source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), F.col("source").alias("_source"))
    joined = keyed.join(taken, keyed["_id"].eqNullSafe(taken["doc_id"]) & (keyed["_key"] == taken["key"]) & keyed["_source"].eqNullSafe(taken["source"]))
    single = joined.filter("rows = 1").withColumn("_n", F.lit(1).cast("long"))
    alike = row_numbers(joined.filter("rows > 1").withColumn("_place", F.monotonically_increasing_id()), ["_id", "_key", "_source"], ["_place"], "_n").drop("_place")
    share_of = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("_n") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    return single.unionByName(alike).withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(most)))).filter(F.col("_c") <= share_of).select("_row.*")
