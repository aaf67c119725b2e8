"""Near-pair computations without emitting pairs.

Points are packed into arrays of bounded size. Packs that lie in neighbouring buckets meet in an equi-join on
the bucket, and a vectorised kernel reduces each pack pair to one partial result per left point. Row counts
stay at (points x packs met), a hot bucket becomes many packs, and its join keys grow with its packs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize, small_batches

PACK = 512
#: Left packs that one join key holds, about: the number of keys of a bucket grows with its packs.
TOGETHER = 4


def bucket(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("long")


def _packs(df: DataFrame, names: Sequence[str], size: int, by: Sequence[str] = ("_bx", "_by")) -> DataFrame:
    """Group the rows of a bucket into packs of about ``size`` by a hash of the row."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return (df.join(n, list(by))
            .withColumn("_pack", F.pmod(F.xxhash64(*names), F.ceil(F.col("_n") / size)))
            .groupBy(*by, "_pack")
            .agg(F.sort_array(F.collect_list(F.struct(*names))).alias("_pts"), F.max(_keys_of(size)).alias("_keys")))


def _keys_of(size: int) -> Column:
    """Join keys of a bucket of ``_n`` points."""
    return F.ceil(F.ceil(F.col("_n") / size) / TOGETHER).cast("long")


def _salted(left: DataFrame, right: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Left packs dealt over the keys of their bucket, right packs repeated for each key of the left bucket that they meet.

    The right side is merged and never broadcast: the planner takes packs for as small as the file that they come from,
    however often they are repeated.
    """
    keys = left.groupBy(*by).agg(F.max("_keys").alias("_most"))
    dealt = left.withColumn("_salt", F.pmod(F.col("_pack"), F.col("_keys")))
    met = right.hint("merge").join(keys, list(by)).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_most") - 1))).drop("_most")
    return dealt, met


def fold_near(left: DataFrame, right: DataFrame, left_cols: Sequence[str], right_cols: Sequence[str],
              kernel: Callable[..., dict[str, np.ndarray]], schema: str, reach: int, size: float | None,
              left_xy: tuple[str, str] = ("lat", "lon"), right_xy: tuple[str, str] = ("lat", "lon"),
              pack: int = PACK) -> DataFrame:
    """One row per (left point, right pack): the first of ``left_cols`` plus the kernel's outputs.

    ``kernel(left_arrays, right_arrays)`` gets dicts of arrays and returns one array per output column of
    ``schema`` (columns after the id). Buckets of edge ``size`` meet when they are at most ``reach`` apart;
    ``size=None`` makes every left pack meet every right pack, which only sums over *all* partners need.
    """
    def keyed(df: DataFrame, xy: tuple[str, str]) -> DataFrame:
        if "_bx" in df.columns:  # shapes that cover several buckets come with their buckets
            return df
        if size is None:
            return df.withColumn("_bx", F.lit(0).cast("long")).withColumn("_by", F.lit(0).cast("long"))
        return df.withColumn("_bx", bucket(F.col(xy[0]), size)).withColumn("_by", bucket(F.col(xy[1]), size))

    lp = _packs(keyed(left.select(*dict.fromkeys([*left_cols, *left_xy])), left_xy), left_cols, pack)
    wanted = [*right_cols, "_bx", "_by"] if "_bx" in right.columns else dict.fromkeys([*right_cols, *right_xy])
    rp = _packs(keyed(right.select(*wanted), right_xy), right_cols, pack)
    if size is not None and reach:
        steps = F.sequence(F.lit(-reach), F.lit(reach))
        rp = (rp.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
              .withColumn("_bx", F.col("_bx") + F.col("_dx")).withColumn("_by", F.col("_by") + F.col("_dy")))
    lp, rp = _salted(lp, rp, ("_bx", "_by"))
    pairs = (lp.select("_bx", "_by", "_salt", *[F.col(f"_pts.{c}").alias(f"l_{c}") for c in left_cols])
             .join(rp.select("_bx", "_by", "_salt", *[F.col(f"_pts.{c}").alias(f"r_{c}") for c in right_cols]).hint("merge"),
                   ["_bx", "_by", "_salt"])
             .drop("_bx", "_by", "_salt"))

    id_col = left_cols[0]

    def run(batches):
        for batch in batches:
            frames = []
            for row in batch.itertuples(index=False, name=None):
                rec = dict(zip(batch.columns, row))
                lv = {c: np.asarray(rec[f"l_{c}"]) for c in left_cols}
                rv = {c: np.asarray(rec[f"r_{c}"]) for c in right_cols}
                out = kernel(lv, rv)
                frames.append(pd.DataFrame({id_col: lv[id_col], **out}))
            if frames:
                yield pd.concat(frames, ignore_index=True)

    return pairs.mapInPandas(run, schema=schema)


def pairwise_mean_distance(points: DataFrame, keys: Sequence[str], point_id: str, name: str, pack: int = PACK) -> DataFrame:
    """Mean planar distance over all pairs of a group, pack against pack; groups of one point give no row.

    Each pair of packs meets once, and the join keys of a group grow with its packs.
    """
    cols = [point_id, "lat", "lon"]
    left, right = _salted(*[_packs(points.select(*keys, *cols), cols, pack, keys)] * 2, keys)
    left = left.select(*keys, "_salt", F.col("_pack").alias("_lp"), F.col("_pts.lat").alias("la"), F.col("_pts.lon").alias("lo"))
    right = right.select(*keys, "_salt", F.col("_pack").alias("_rp"), F.col("_pts.lat").alias("ra"), F.col("_pts.lon").alias("ro"))

    def run(batches):
        for b in batches:
            total = [(1 + (p != q)) * float(np.hypot(np.asarray(la)[:, None] - np.asarray(ra), np.asarray(lo)[:, None] - np.asarray(ro)).sum())
                     for p, q, la, lo, ra, ro in zip(b["_lp"], b["_rp"], b["la"], b["lo"], b["ra"], b["ro"])]
            yield b[list(keys)].assign(_sum=total)

    types = dict(points.dtypes)
    pairs = left.join(right.hint("merge"), [*keys, "_salt"]).filter("_lp <= _rp")
    sums = pairs.mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", _sum double")
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (sums.groupBy(*keys).agg(F.sum("_sum").alias("_sum")).join(n.filter("_n > 1"), list(keys))
            .select(*keys, (F.col("_sum") / (F.col("_n") * (F.col("_n") - 1))).alias(name)))


def nearest(points: DataFrame, sites: DataFrame, point_id: str, site_id: str, size: float | None = None,
            within: float | None = None, scale: float = 1.0,
            point_type: str = "string", site_type: str = "string") -> DataFrame:
    """Nearest site of every point in the plane: (point_id, site_id, dist); ties go to the lowest site id.

    With ``within`` one pass over neighbouring buckets is exact. Without it a hierarchy of tiles finds the nearest; its
    tiles follow the points, so that ``size`` (once the edge of the first buckets) is not needed and changes nothing.
    """
    from voltgrid.operators.hierarchy import nearest_k

    pid, sid = point_id, site_id
    schema = f"{pid} {point_type}, {sid} {site_type}, dist double"
    # Copies of a site change nothing, and would all hash into one pack.
    places = materialize(sites.select(sid, "lat", "lon").distinct())
    if within is None:
        return nearest_k(points.select(pid, "lat", "lon"), places, pid, [sid], 1).select(pid, sid, (F.col("dist") * scale).alias("dist"))

    def kernel(lv, rv):
        d = np.hypot((lv["lat"][:, None] - rv["lat"][None, :]) * scale,
                     (lv["lon"][:, None] - rv["lon"][None, :]) * scale)
        j = d.argmin(axis=1)
        return {sid: rv[sid][j], "dist": d[np.arange(len(j)), j]}

    part = fold_near(points, places, [pid, "lat", "lon"], [sid, "lat", "lon"], kernel, schema, 1, within / scale)
    best = part.groupBy(pid).agg(F.min(F.struct("dist", sid)).alias("_b")).select(pid, F.col(f"_b.{sid}").alias(sid), F.col("_b.dist").alias("dist"))
    with small_batches(points.sparkSession):  # pairs of packs are wide rows: by number, a batch would hold most of them
        return materialize(best.filter(F.col("dist") <= within))
