"""Hard negatives of embeddings: angles to reference directions bound scores, and only overlapping windows are scored."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize

POSITIVES, NEGATIVES = 5, 10
#: Share of a positive's score that a negative's has, in hundredths: at least and at most.
LEAST, MOST = 30, 90
SCALE = 256
#: Reference directions, and rows that they are chosen from: those with the smallest hash. Results don't depend on them.
DIRECTIONS, SAMPLE = 16, 4096
#: Rows of a pack (as a power of two); anchors that meet a pack in one group; packs whose bounds are tested in one group.
PACK_BITS, BLOCK, BOUNDS = 12, 16_384, 1024
#: Anchors that are scored together.
TOGETHER = 32
#: Stored angles are good to 5e-7, so a cosine bound from two of them is good to 1e-6.
SLACK = 1e-6
LOWEST, HIGHEST = -(1 << 63) + 1, (1 << 63) - 1


def quantised(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors.astype(np.float64))


def lists(column: pa.Array, width: int) -> np.ndarray:
    """Lines of an Arrow list column."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def references(sample: np.ndarray, count: int = DIRECTIONS) -> np.ndarray:
    """Unit directions, each the sampled line farthest in angle from those taken before; of fewer lines, some again."""
    lines = sample[np.linalg.norm(sample, axis=1) > 0]
    if not len(lines):
        return np.empty((0, sample.shape[1]))
    unit = lines / np.linalg.norm(lines, axis=1, keepdims=True)
    taken = [0]
    nearest = unit @ unit[0]
    while len(taken) < min(count, len(unit)):
        taken.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[taken[-1]])
    return unit[np.resize(taken, count)]


def angles(q: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of each line to the directions, or to axes where the directions have another width; at right angles for zero."""
    if len(directions) and directions.shape[1] == q.shape[1]:
        dots = q @ directions.T
    else:
        dots = q[:, np.arange(DIRECTIONS) % q.shape[1]] if q.shape[1] else np.zeros((len(q), DIRECTIONS))
    return np.arccos(np.clip(dots / np.where(norms > 0, norms, 1)[:, None], -1, 1)).astype(np.float32)


def index(rows: DataFrame, sample: int = SAMPLE, pack_bits: int = PACK_BITS) -> DataFrame:
    """(vec_id, label, vec, dim, norm, angles, key, pack) of every row (vec_id, label, vec), written.

    Rows are sorted over the whole cluster by nearest direction and angle to it, and cut into packs of 2^``pack_bits``
    rows; key numbers the rows. Directions come from at most ``sample`` rows of the commonest width among them.
    """
    some = rows.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(sample).select("vec").toPandas()["vec"]
    widths = [len(v) for v in some]
    width = max(set(widths), key=lambda w: (widths.count(w), w), default=0)
    sampled = [v for v in some if len(v) == width]
    directions = references(quantised(np.array(sampled).reshape(len(sampled), width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                q = quantised(lists(part.column("vec"), d))
                norms = np.linalg.norm(q, axis=1)
                to = angles(q, norms, directions)
                home = to.argmin(axis=1)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * to.shape[1]), pa.array(to.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(norms), listed, pa.array(home.astype(np.int32)), pa.array(to[np.arange(len(q)), home])],
                                                 names=[*part.schema.names, "norm", "angles", "home", "angle"])

    wide = rows.select("vec_id", "label", "vec", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("_n"))
    made = {f.name: f.dataType.simpleString() for f in wide.schema} | {"norm": "double", "angles": "array<float>", "home": "int", "angle": "float"}
    placed = wide.mapInArrow(run, ", ".join(f"{a} {b}" for a, b in made.items()))
    keyed = placed.sort("dim", "home", "angle", "vec_id", "_n").select("vec_id", "label", "vec", "dim", "norm", "angles", F.monotonically_increasing_id().alias("key"))
    return materialize(keyed.withColumn("pack", F.shiftright("key", pack_bits)))


def meet(left: DataFrame, asked: DataFrame, on: list[str], schema: str, prepare: Callable[[pa.Table], object], answer: Callable[[object, pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``answer(prepare(rows of left with a key), rows of asked with that key)``, streamed: rows of ``left`` come first.

    One key holds few rows of ``left`` by construction, and those of ``asked`` come in batches.
    """
    both = left.withColumn("_tag", F.lit(0)).unionByName(asked.withColumn("_tag", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, ready = None, [], None
        for b in batches:
            at = np.array([b.column(c).to_numpy() for c in (*on, "_tag")]).reshape(len(on) + 1, -1)
            first = np.flatnonzero(np.concatenate(([True], (at[:, 1:] != at[:, :-1]).any(axis=0)))) if b.num_rows else []
            for s, e in zip(first, [*first[1:], b.num_rows], strict=True):
                here, part = tuple(at[:-1, s].tolist()), b.slice(s, e - s)
                if not at[-1, s]:
                    if here != key:
                        key, parts = here, []
                    parts.append(part)
                    ready = None
                elif here == key:
                    ready = prepare(pa.Table.from_batches(parts)) if ready is None else ready
                    yield answer(ready, part)

    return both.repartition(*on).sortWithinPartitions(*on, "_tag").mapInArrow(run, schema)


def thresholds(norms: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray | float, most: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest angle at which a row of norm ``least`` to ``most`` can score between ``lo`` and ``hi``, rounded safely."""
    def bound(score: np.ndarray, sign: int) -> np.ndarray:
        score = score - sign * (1 + SLACK * norms * most)
        scale = norms * np.where((score > 0) == (sign > 0), most, least)
        return np.arccos(np.clip(np.divide(score, scale, out=np.full(np.broadcast(score, scale).shape, -float(sign)), where=scale > 0), -1, 1))

    return bound(lo, 1) + SLACK, bound(hi, -1) - SLACK


def span(windows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Smallest ``lo`` and largest ``hi`` of each line of windows."""
    ranges = windows.to_pylist()
    return np.array([min(w["lo"] for w in x) for x in ranges], float), np.array([max(w["hi"] for w in x) for x in ranges], float)


def surviving(packs: DataFrame, asked: DataFrame, blocks: int, chunks: int) -> DataFrame:
    """``asked`` once for each pack that may hold rows inside its windows."""
    def prepare(t: pa.Table) -> tuple:
        t = t.combine_chunks()
        return t["pack"].to_numpy(), *(np.array(t[c].to_pylist(), np.float64).reshape(t.num_rows, -1) for c in ("low", "high")), t["least"].to_numpy(), t["most"].to_numpy()

    keep = [c for c in asked.columns if c != "pack"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.select(*keep).schema) + ", packs array<long>"

    def answer(ready: tuple, b: pa.RecordBatch) -> pa.RecordBatch:
        pack, low, high, least, most = ready
        norms, (lo, hi) = b.column("norm").to_numpy(), span(b.column("windows"))
        found = []
        for theta, norm, a, z in zip(np.array(b.column("angles").to_pylist(), np.float64).reshape(b.num_rows, -1), norms, lo, hi, strict=True):
            far, near = thresholds(norm, np.full(len(pack), a), np.full(len(pack), z), least, most)
            gap = np.maximum(np.maximum(low - theta, theta - high), 0).max(axis=1)
            ends = np.stack([low + theta, high + theta])
            reach = np.where((ends[0] <= math.pi) & (ends[1] >= math.pi), math.pi, np.minimum(ends, 2 * math.pi - ends).max(axis=0)).min(axis=1)
            found.append(pack[(gap <= far) & (reach >= near)].tolist())
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(found, pa.list_(pa.int64()))], names=[*keep, "packs"])

    left = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("chunk", F.pmod(F.xxhash64("pack"), F.lit(chunks)).cast("int"))
    dealt = asked.drop("pack").withColumn("block", _block(blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    out = meet(left, dealt, ["chunk", "block", "dim"], schema, prepare, answer)
    return out.withColumn("pack", F.explode("packs")).drop("packs")


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")


def scores(q: np.ndarray, norms: np.ndarray, a: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Integer inner products of lines, exact: sums of doubles while all stay under 2^52, whole numbers of any size beyond."""
    if not len(q) or norms.max(initial=0) * sizes.max(initial=0) < 1 << 52:
        return (q @ a.T).astype(np.int64)
    left, right = ([[int(x) for x in line] for line in m] for m in (q, a))
    return np.array([[max(LOWEST, min(HIGHEST, sum(x * y for x, y in zip(u, v, strict=True)))) for v in right] for u in left], np.int64)


ANSWER = "anchor long, slot int, key long, vec_id long, score long"


def answered(rows: DataFrame, asked: DataFrame, same: bool, limit: int, blocks: int) -> DataFrame:
    """The first ``limit`` rows of a pack inside each window of each anchor that asks for it: label alike, or not alike."""
    def prepare(t: pa.Table) -> tuple:
        t = t.combine_chunks()
        n = t.num_rows
        q = quantised(lists(t["vec"].chunk(0), t["dim"][0].as_py()))
        ids = t["vec_id"].to_numpy()
        none = t["vec_id"].is_null().to_numpy()
        return q, t["norm"].to_numpy(), np.array(t["angles"].to_pylist(), np.float32).reshape(n, -1), t["label"].to_numpy(), t["key"].to_numpy(), np.where(none, 0, ids).astype(np.int64), none

    def answer(ready: tuple, b: pa.RecordBatch) -> pa.RecordBatch:
        q, norms, theirs, labels, keys, ids, none = ready
        out: list[tuple] = []
        a_all = quantised(lists(b.column("vec"), b.column("dim")[0].as_py()))
        mine = np.array(b.column("angles").to_pylist(), np.float32).reshape(b.num_rows, -1)
        sizes, own, label, windows = b.column("norm").to_numpy(), b.column("anchor").to_numpy(), b.column("label").to_numpy(), b.column("windows").to_pylist()
        far, near = thresholds(sizes, *span(b.column("windows")), norms.min(), norms.max())
        common = int(np.bincount(theirs.argmin(axis=1)).argmax())
        for s in range(0, b.num_rows, TOGETHER):
            some = np.arange(s, min(b.num_rows, s + TOGETHER))
            may = np.ones((len(some), len(q)), bool)
            for r in {common, int(mine[s].argmin())}:  # cosine intervals from the pack's direction and the anchor's
                x, y = theirs[None, :, r], mine[some, r][:, None]
                may &= (np.abs(x - y) <= far[some, None]) & (np.minimum(x + y, 2 * np.pi - x - y) >= near[some, None])
            hit = np.flatnonzero(may.any(axis=0))
            table = scores(q[hit], norms[hit], a_all[some], sizes[some])
            for j, i in enumerate(some.tolist()):
                fits = (labels[hit] == label[i]) == same
                fits &= keys[hit] != own[i]
                for w in windows[i]:
                    at = np.flatnonzero(fits & (table[:, j] >= w["lo"]) & (table[:, j] <= w["hi"]))
                    v = table[at, j]
                    if len(at) > limit:
                        good = v >= np.partition(v, len(v) - limit)[len(v) - limit]
                        at, v = at[good], v[good]
                    rows_at = hit[at]
                    for k in np.lexsort((keys[rows_at], ids[rows_at], none[rows_at], -v))[:limit].tolist():
                        g = rows_at[k]
                        out.append((int(own[i]), w["slot"], int(keys[g]), None if none[g] else int(ids[g]), int(v[k])))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["anchor", "slot", "key", "vec_id", "score"])

    left = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return meet(left, asked.withColumn("block", _block(blocks)), ["pack", "block", "dim"], ANSWER, prepare, answer)


def first(rows: DataFrame, packs: DataFrame, asked: DataFrame, same: bool, limit: int, blocks: int, chunks: int) -> DataFrame:
    """(anchor, slot, key, vec_id, score, rank): the first ``limit`` rows over all packs inside each window.

    The anchor's own pack is asked first: where it holds ``limit`` rows, the last of them raises the window's lower end
    before packs are chosen and rows are scored.
    """
    seed = answered(rows, asked, same, limit, blocks).groupBy("anchor", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("tau")).filter(F.col("n") >= limit)
    known = seed.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "tau"))).alias("known"))
    raised = F.transform("windows", lambda w: F.struct(w["slot"].alias("slot"), F.greatest(w["lo"], F.element_at("known", w["slot"])).alias("lo"), w["hi"].alias("hi")))
    narrowed = asked.join(known, "anchor", "left").withColumn("windows", F.when(F.col("known").isNull(), F.col("windows")).otherwise(raised)).drop("known")
    found = answered(rows, surviving(packs, narrowed, blocks, chunks), same, limit, blocks)
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
                   sample: int = SAMPLE, pack_bits: int = PACK_BITS, block: int = BLOCK, bounds: int = BOUNDS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, label, vec).

    Components become floor(256 x); a score is the integer inner product with the anchor, exact, and cut to 64 bits.
    Positives of an anchor (``is_anchor``) are its first ``positives`` other rows with its label; their negatives are the
    first ``negatives`` rows with another label whose score has ``least`` to ``most`` hundredths of the positive's.
    Higher scores come first, ties by smaller vec_id, rows without one last, repeated rows in any order.

    Each row keeps its norm and its angles to reference directions. By the triangle inequality the angle between two rows
    lies between the difference and the sum of their angles to any direction; times the norms that bounds their score,
    with room for rounding. Packs, then rows, whose bounds miss an anchor's window are not scored. Anchors meet packs in
    blocks of bounded size; a meeting yields a few rows per anchor, never pairs.

    Rows with a null label or vector, or a component that is null, NaN or infinite, take no part. Vectors meet only
    vectors of their width. An anchor without positives, or a positive without negatives, yields nothing; an empty table
    gives an empty table; other columns are ignored.
    """
    whole = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    table = index(rows.select("vec_id", F.col("label").cast("long").alias("label"), "vec").filter(whole), sample, pack_bits)
    at = range(DIRECTIONS)
    packs = materialize(table.groupBy("pack", "dim").agg(
        F.array(*[F.coalesce(F.min(F.get("angles", F.lit(r))), F.lit(0.0)) for r in at]).alias("low"), F.array(*[F.coalesce(F.max(F.get("angles", F.lit(r))), F.lit(0.0)) for r in at]).alias("high"),
        F.min("norm").alias("least"), F.max("norm").alias("most")))
    anchors = table.filter(is_anchor).withColumnRenamed("key", "anchor")
    blocks, chunks = (max(1, math.ceil(df.count() / size)) for df, size in ((anchors, block), (packs, bounds)))
    any_score = F.array(F.struct(F.lit(0).alias("slot"), F.lit(LOWEST).cast("long").alias("lo"), F.lit(HIGHEST).cast("long").alias("hi")))
    best = materialize(first(table, packs, anchors.drop("vec_id").withColumn("windows", any_score), True, positives, blocks, chunks))

    def share(hundredths: int, up: int) -> Column:
        """A hundredth share of the positive's score, rounded up or down."""
        product = F.col("score").cast("decimal(20,0)") * F.lit(hundredths).cast("decimal(10,0)")
        whole = F.when(F.lit(bool(up)), F.ceil(product / 100)).otherwise(F.floor(product / 100))
        return F.least(F.greatest(whole, F.lit(LOWEST).cast("decimal(20,0)")), F.lit(HIGHEST).cast("decimal(20,0)")).cast("long")

    windows = best.withColumn("lo", share(least, 1)).withColumn("hi", share(most, 0)).filter("lo <= hi").groupBy("anchor").agg(
        F.collect_list(F.struct(F.col("rank").alias("slot"), "lo", "hi")).alias("windows"))
    found = first(table, packs, anchors.drop("vec_id").join(windows, "anchor"), False, negatives, blocks, chunks)
    named = best.select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(named, ["anchor", "slot"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
