"""Pieces that the document operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize


#: Rows whose texts are Python objects at once.
ROWS = 512


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def words_of(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def per_row(df: DataFrame, columns: str, schema: str, fn: Callable[..., tuple]) -> DataFrame:
    """Map rows in Arrow batches: ``fn(*values)`` of the named columns gives one output row as a tuple."""
    names = columns.split()
    out = df.sparkSession.createDataFrame([], schema).schema
    fields = pa_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                rows = [fn(*r) for r in zip(*[some.column(n).to_pylist() for n in names], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return df.select(*names).mapInArrow(run, out)


def pa_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def signature(df: DataFrame, *columns: str) -> tuple:
    """Row count and an order-free sum of row hashes: equal for equal multisets of rows."""
    h = F.xxhash64(*columns)
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): one row (node, root) per node, root the smallest node.

    Alternating large-star and small-star rounds: every round is a minimum per node (combined before the shuffle) and an
    equi-join, so a node with very many neighbours is split by the skew join. No component is ever in one task.
    Self-links and repeated links are allowed; an empty table gives an empty table.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = signature(now, "a", "b")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = materialize(small.select("e.*").filter("a <> b").distinct())
        last, mark = mark, signature(now, "a", "b")
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def append(df: DataFrame, keep: list[str], added: str, fn: Callable[[list[str | None]], list[list]]) -> DataFrame:
    """Columns ``keep`` of every row and new columns that ``fn`` computes from the texts of an Arrow batch.

    Columns of ``keep`` named like a new one give way to it.
    """
    new = df.sparkSession.createDataFrame([], added).schema
    keep = [c for c in keep if c not in new.names]
    out = df.select(*keep).schema
    for f in new:
        out = out.add(f)
    fields, asked = pa_schema(out), [*keep, *["text"] * ("text" not in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = fn(b.column("text").to_pylist())
            columns = [b.column(c) for c in keep] + [pa.array(v, f.type) for v, f in zip(made, list(fields)[len(keep):], strict=True)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return df.select(*asked).mapInArrow(run, out)
