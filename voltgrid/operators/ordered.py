"""Ordered operators that survive hot keys.

A plain ``Window.partitionBy(key)`` sends one key to one task. Here the rows are range-partitioned by
(keys, order), so a key that holds a third of the table is spread over many slices, and each slice works
alone. What has to cross a slice border is a *carry*: in sorted order only the first (or last) key of a
slice can continue in a neighbour, so the carry table never has more rows than there are slices and is
safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize

SLICE = "_slice"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slices(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Sort over the whole cluster and number the sorted slices (written to the checkpoint folder)."""
    ordered = df.sort(*[F.col(k) for k in keys], *[_col(o) for o in order])
    return materialize(ordered.withColumn(SLICE, F.spark_partition_id()))


def _by_key(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys] or [F.lit(0)]


def _attach(sliced: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a carry table (at most one row per slice) to the rows of its slice and key."""
    renamed = carry.select(
        F.col(SLICE).alias("_cs"), *[F.col(k).alias(f"_ck_{k}") for k in keys], F.col("_carry"))
    cond = F.col(SLICE) == F.col("_cs")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_ck_{k}"))
    return sliced.join(F.broadcast(renamed), cond, "left").drop("_cs", *[f"_ck_{k}" for k in keys])


def _end_rows(base: DataFrame, keys: Sequence[str], last: bool) -> tuple[DataFrame, DataFrame]:
    """Keys at the (last or first) end of every slice, and the rows that hold them.

    Only such a key can go on in a neighbouring slice, so carries are built from these rows alone: one small
    aggregate per slice instead of a shuffle by key.
    """
    if not keys:
        return base.select(SLICE).distinct(), base
    pick = F.max if last else F.min
    ends = base.groupBy(SLICE).agg(pick(F.struct(*keys)).alias("_e")).select(SLICE, *[F.col(f"_e.{k}").alias(k) for k in keys])
    small = F.broadcast(ends.select(F.col(SLICE).alias("_es"), *[F.col(k).alias(f"_ek_{k}") for k in keys]))
    cond = F.col(SLICE) == F.col("_es")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_ek_{k}"))
    return ends, base.join(small, cond).drop("_es", *[f"_ek_{k}" for k in keys])


def _chained(ends: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slices where a key may continue, beside the facts of the slices before or after; at most two rows per slice."""
    a = ends.withColumn("_wanted", F.lit(True)).alias("a")
    b = facts.alias("b")
    cond = F.col(f"a.{SLICE}") == F.col(f"b.{SLICE}")
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    extra = [c for c in facts.columns if c not in (SLICE, *keys)]
    return a.join(b, cond, "full_outer").select(
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in (SLICE, *keys)], *[F.col(f"b.{c}").alias(c) for c in extra],
        F.coalesce("_wanted", F.lit(False)).alias("_wanted"), F.col(f"b.{SLICE}").isNotNull().alias("_fact"))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
            measures: Mapping[str, tuple[str, str | Column]], sliced: bool = False) -> DataFrame:
    """Running sum / count / max / min from the first row of the key to the current one."""
    base = df if sliced else slices(df, keys, order)
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    first = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
    _, rows = _end_rows(base, keys, last=True)
    heads, _ = _end_rows(base, keys, last=False)
    totals = rows.groupBy(SLICE, *keys).agg(*[first[kind](_col(c)).alias(name) for name, (kind, c) in measures.items()])
    before = Window.partitionBy(*_by_key(keys)).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (_chained(heads, totals, keys)
             .withColumn("_seen", F.count_if("_fact").over(before))
             .withColumn("_carry", F.struct(*[merge[kind](name).over(before).alias(name) for name, (kind, _) in measures.items()]))
             .filter("_wanted AND _seen > 0"))
    local = Window.partitionBy(*keys, SLICE).orderBy(*[_col(o) for o in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    here = base
    for name, (kind, c) in measures.items():
        here = here.withColumn(f"_in_{name}", first[kind](_col(c)).over(local))
    out = _attach(here, carry, keys)
    for name, (kind, _) in measures.items():
        mine, prev = F.col(f"_in_{name}"), F.col(f"_carry.{name}")
        if kind in ("sum", "count"):
            value = F.when(prev.isNull(), mine).when(mine.isNull(), prev).otherwise(mine + prev)
        elif kind == "max":
            value = F.greatest(mine, prev)
        else:
            value = F.least(mine, prev)
        out = out.withColumn(name, value)
    out = out.drop("_carry", *[f"_in_{n}" for n in measures])
    return out if sliced else out.drop(SLICE)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rn",
                sliced: bool = False) -> DataFrame:
    """``row_number`` per key; with no keys a global one, still in parallel."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, sliced)


def _neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
               columns: Mapping[str, str], forward: bool, sliced: bool) -> DataFrame:
    base = df if sliced else slices(df, keys, order)
    cols = [_col(o) for o in order]
    payload = F.struct(*[F.col(src).alias(dst) for dst, src in columns.items()])
    local = Window.partitionBy(*keys, SLICE).orderBy(*cols)
    # The row next to the border: by position, so that descending orders work too.
    _, rows = _end_rows(base, keys, last=not forward)
    near_end = rows.withColumn("_pos", F.row_number().over(local))
    edges = near_end.groupBy(SLICE, *keys).agg((F.min_by if forward else F.max_by)(payload, F.col("_pos")).alias("_edge"))
    wanted, _ = _end_rows(base, keys, last=forward)
    across = Window.partitionBy(*_by_key(keys)).orderBy(SLICE)
    step = F.lead if forward else F.lag
    carry = (_chained(wanted, edges, keys).withColumn("_carry", step("_edge").over(across))
             .filter(F.col("_wanted") & F.col("_carry").isNotNull()))
    out = _attach(base.withColumn("_near", step(payload).over(local)), carry, keys)
    near = F.when(F.col("_near").isNotNull(), F.col("_near")).otherwise(F.col("_carry"))
    out = out.withColumn("_near", near)
    for dst in columns:
        out = out.withColumn(dst, F.col("_near").getField(dst))
    out = out.drop("_near", "_carry")
    return out if sliced else out.drop(SLICE)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
             columns: Mapping[str, str], sliced: bool = False) -> DataFrame:
    """``lag(1)``: new columns ``{new: source}`` from the row before within the key."""
    return _neighbour(df, keys, order, columns, False, sliced)


def following(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
              columns: Mapping[str, str], sliced: bool = False) -> DataFrame:
    """``lead(1)``: new columns ``{new: source}`` from the next row within the key."""
    return _neighbour(df, keys, order, columns, True, sliced)


def trailing(df: DataFrame, keys: Sequence[str], position: str, width: int,
             measures: Mapping[str, Column], chunk: int = 65536) -> DataFrame:
    """Aggregates over the last ``width`` rows, for rows numbered by ``position`` (1, 2, …) within the key.

    Rows are cut into fixed chunks of positions; each chunk also receives the ``width - 1`` rows before it,
    so that no window partition exceeds ``chunk + width`` rows. ``measures`` values are plain aggregates.
    """
    chunk = max(chunk, width)
    home = F.floor((F.col(position) - 1) / chunk)
    last = F.floor((F.col(position) - 1 + (width - 1)) / chunk)
    spread = df.withColumn("_home", home).withColumn("_chunk", F.explode(F.sequence(home, last)))
    w = Window.partitionBy(*keys, "_chunk").orderBy(position).rowsBetween(-(width - 1), 0)
    for name, agg in measures.items():
        spread = spread.withColumn(name, agg.over(w))
    return spread.filter("_chunk = _home").drop("_chunk", "_home")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their running counts: columns keys, value, n, below (rows with a smaller value)."""
    counts = (df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
              .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    return running(counts, keys, [value], {"_upto": ("sum", "n")}) \
        .withColumn("below", F.col("_upto") - F.col("n")).drop("_upto")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolation percentiles per key without holding a group in one task."""
    counts = value_counts(df, keys, value)
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_n"))
    sized = counts.join(sizes, list(keys)) if keys else counts.crossJoin(F.broadcast(sizes))
    picks = []
    for name, p in points.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for tag, idx in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("below") <= idx) & (idx < F.col("below") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{name}_{tag}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_{name}_w"))
    found = sized.groupBy(*keys).agg(*picks)
    return found.select(*keys, *[
        (F.col(f"_{n}_lo") + F.col(f"_{n}_w") * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))).alias(n)
        for n in points])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank table per distinct value (ties share the mean rank): columns keys, value, ``name``."""
    return value_counts(df, keys, value).select(
        *keys, value, (F.col("below") + (F.col("n") + 1) / 2.0).alias(name))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "spearman_r") -> DataFrame:
    """Rank correlation per key. Rows are pre-aggregated to distinct (x, y) pairs before the rank joins."""
    pairs = (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
             .groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_m")))
    ranked = (pairs.join(average_ranks(df.filter(F.col(y).isNotNull()), keys, x, "_rx"), [*keys, x])
              .join(average_ranks(df.filter(F.col(x).isNotNull()), keys, y, "_ry"), [*keys, y]))
    m, rx, ry = F.col("_m"), F.col("_rx"), F.col("_ry")
    s = ranked.groupBy(*keys).agg(
        F.sum(m).alias("_n"), F.sum(m * rx).alias("_sx"), F.sum(m * ry).alias("_sy"),
        F.sum(m * rx * rx).alias("_sxx"), F.sum(m * ry * ry).alias("_syy"), F.sum(m * rx * ry).alias("_sxy"))
    vx = F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    vy = F.col("_n") * F.col("_syy") - F.col("_sy") * F.col("_sy")
    cov = F.col("_n") * F.col("_sxy") - F.col("_sx") * F.col("_sy")
    return s.select(*keys, F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx) / F.sqrt(vy)).alias(name))


def correlation_with_ranks(df: DataFrame, group: str, value: str, rank: str, name: str = "spearman_r") -> DataFrame:
    """Rank correlation per ``group`` (int) of ``value`` with ``rank``, which is a mean rank already; neither is null.

    Rows are sorted once over the cluster and not written. Equal values lie in one slice, so each slice gives one row per
    group: sums with the ranks inside the slice, to which the rows of the slices before are added.
    """
    sums = ("n", "sx", "sxx", "sy", "syy", "sxy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        tie: tuple | None = None  # group, value, rows, sum of ranks of the last value seen, which may go on

        def close(g: np.ndarray, n: np.ndarray, y: np.ndarray) -> None:
            cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]) if len(g) else np.zeros(1, int)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                s, k = held.setdefault(int(g[lo]), np.zeros(len(sums))), n[lo:hi].astype(float)
                r = s[0] + np.cumsum(k) - k + (k + 1) / 2
                s += [k.sum(), k @ r, k @ (r * r), y[lo:hi].sum(), 0.0, r @ y[lo:hi]]

        for b in batches:
            if not b.num_rows:
                continue
            g, v, y = (b.column(c).to_numpy() for c in (group, value, rank))
            at = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
            new = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            for i, yy in zip(g[new].tolist(), np.add.reduceat(y * y, new).tolist(), strict=True):
                held.setdefault(i, np.zeros(len(sums)))[4] += yy
            gs, vs, ns, ys = g[at], v[at], np.diff(np.r_[at, len(g)]), np.add.reduceat(y, at)
            if tie is not None and (tie[0], tie[1]) == (gs[0], vs[0]):
                ns[0], ys[0] = ns[0] + tie[2], ys[0] + tie[3]
            elif tie is not None:
                gs, vs, ns, ys = np.r_[tie[0], gs], np.r_[tie[1], vs], np.r_[tie[2], ns], np.r_[tie[3], ys]
            close(gs[:-1], ns[:-1], ys[:-1])
            tie = (gs[-1], vs[-1], ns[-1], ys[-1])
        if tie is not None:
            close(*(np.array([tie[i]]) for i in (0, 2, 3)))
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([at] * len(held), pa.int32()), *(pa.array([float(s[i]) for s in held.values()], pa.float64()) for i in range(len(sums)))],
                                         names=["_g", SLICE, *(f"_{c}" for c in sums)])

    plain = df.select(F.col(group).cast("int").alias(group), (F.col(value) + 0.0).alias(value), F.col(rank).cast("double").alias(rank))  # -0.0 as 0.0
    parts = plain.sort(group, value).mapInArrow(run, f"_g int, {SLICE} int, " + ", ".join(f"_{c} double" for c in sums))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    n, sx, sxx, sy, syy, sxy, o = (F.col(c) for c in ("_n", "_sx", "_sxx", "_sy", "_syy", "_sxy", "_o"))
    s = parts.withColumn("_o", before).groupBy(F.col("_g").alias(group)).agg(
        F.sum(n).alias("_n"), F.sum(sx + o * n).alias("_sx"), F.sum(sxx + 2 * o * sx + o * o * n).alias("_sxx"), F.sum(sy).alias("_sy"), F.sum(syy).alias("_syy"), F.sum(sxy + o * sy).alias("_sxy"))
    vx, vy, cov = n * sxx - sx * sx, n * syy - sy * sy, n * sxy - sx * sy
    return s.select(group, F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx) / F.sqrt(vy)).alias(name))


def gini(df: DataFrame, keys: Sequence[str], value: str, name: str = "gini",
         population: DataFrame | None = None) -> DataFrame:
    """Gini coefficient per key in closed form over value counts; 0 when the total is 0.

    With ``population`` (one row per member, the same for all keys) members missing from ``df`` count as 0.
    """
    counts = value_counts(df, keys, value)
    v, n, below = F.col(value).cast("double"), F.col("n").cast("double"), F.col("below").cast("double")
    # Ranks below+1 … below+n share one value: their sum is n·below + n(n+1)/2.
    rank_sum = n * below + n * (n + 1) / 2
    s = counts.groupBy(*keys).agg(F.sum(n).alias("_n"), F.sum(n * v).alias("_s"),
                                  F.sum(rank_sum * v).alias("_rs"))
    if population is not None:
        size = population.agg(F.count(F.lit(1)).cast("double").alias("_all"))
        # Absent members take the lowest ranks, which moves every present rank up by their number.
        s = (s.crossJoin(F.broadcast(size)).withColumn("_rs", F.col("_rs") + (F.col("_all") - F.col("_n")) * F.col("_s"))
             .withColumn("_n", F.col("_all")))
    n_, s_ = F.col("_n"), F.col("_s")
    # Sum of cumulative sums = Σ (N + 1 − rank)·v.
    cum = (n_ + 1) * s_ - F.col("_rs")
    return s.select(*keys, F.when(s_ == 0, F.lit(0.0)).otherwise((n_ + 1 - 2 * cum / s_) / n_).alias(name))
