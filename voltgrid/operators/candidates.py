"""Placement candidates, baselines and combinations of sites.

Sites have grid_id, site_id, edge_id, lat, lon and (for pools) source_method. Draws are keyed hashes, so a
combination depends on the seed and its draw number only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltgrid.functions.durable import materialize
from voltgrid.functions.hashing import uniform
from voltgrid.operators.ordered import row_numbers
from voltgrid.operators.tiles import _packs, nearest

MOST = 2000
#: Draws that a kernel compares with a pack of sites at once.
DRAWS = 256


def _digest(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


# --- single placements --------------------------------------------------------------------------------------

def target_lattice(areas: DataFrame, n: int) -> DataFrame:
    """ceil(sqrt(n))^2 inner lattice points per area, the first n in row-major order."""
    side = math.ceil(math.sqrt(n))
    lat = areas.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    at = lambda axis, k: F.col(f"min_{axis}") + (F.col(k) + 1) * (F.col(f"max_{axis}") - F.col(f"min_{axis}")) / (side + 1)
    pos = F.col("i") * side + F.col("j")
    return lat.filter(pos < n).select("area_id", pos.alias("k"), at("lat", "i").alias("lat"), at("lon", "j").alias("lon"))


def uniform_spacing(areas: DataFrame, sites: DataFrame, n: int) -> DataFrame:
    """Lattice targets mapped to their nearest site."""
    t = target_lattice(areas, n).withColumn("target", F.concat_ws("/", "area_id", "k"))
    near = nearest(t, sites, "target", "site_id")
    return t.join(near, "target").select("area_id", "k", "site_id", F.lit("uniform_spacing").alias("method"))


def random_sites(sites: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n sites in keyed-hash order."""
    r = row_numbers(sites.withColumn("_h", _digest(seed, F.col("site_id"))), [], ["_h"], "_rn")
    return r.filter(F.col("_rn") <= n).select("site_id", "lat", "lon", F.lit("random").alias("method"))


def grid_centres(cells: DataFrame, sites: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Centres of n cells in keyed-hash order, with the nearest site."""
    c = cells.select("grid_id", ((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("lon"))
    c = row_numbers(c.withColumn("_h", _digest(seed, F.col("grid_id"))), [], ["_h"], "_rn").filter(F.col("_rn") <= n)
    near = nearest(c, sites, "grid_id", "site_id")
    return c.join(near, "grid_id").select("grid_id", "site_id", "lat", "lon", F.lit("grid_centre").alias("method"))


def uniform_random(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n usable edges (over 10 m, no junction, sink or source) with a random position on each."""
    from voltgrid.operators.roads import point_at, to_lat_lon

    e = F.col("edge_id")
    ok = edges.filter(~e.startswith(":") & ~e.endswith("-sink") & ~e.endswith("-source") & (F.col("length_m") > 10))
    r = row_numbers(ok.withColumn("_h", _digest(seed, e)), [], ["_h"], "_rn").filter(F.col("_rn") <= n)
    r = r.withColumn("position", uniform(seed, e) * F.col("length_m")).withColumn("_p", F.explode(F.array(point_at(F.col("shape"), F.col("position")))))
    lat, lon = to_lat_lon(F.col("_p.x"), F.col("_p.y"))
    return r.select("edge_id", "position", lat.alias("lat"), lon.alias("lon"), F.lit("uniform_random").alias("method"))


def diagonal(areas: DataFrame, n: int) -> DataFrame:
    """n points on the diagonal of each area's box."""
    k = areas.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    at = lambda a: F.col(f"min_{a}") + (F.col(f"max_{a}") - F.col(f"min_{a}")) * F.col("k") / (n + 1)
    return k.select("area_id", "k", at("lat").alias("lat"), at("lon").alias("lon"), F.lit("uniform").alias("method"))


def box_random(areas: DataFrame, n: int, seed: int = 42) -> DataFrame:
    k = areas.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    at = lambda a: F.col(f"min_{a}") + (F.col(f"max_{a}") - F.col(f"min_{a}")) * uniform(seed, F.col("area_id"), F.col("k"), F.lit(a))
    return k.select("area_id", "k", at("lat").alias("lat"), at("lon").alias("lon"), F.lit("random").alias("method"))


def with_nearest_edge(points: DataFrame, edges: DataFrame, within_m: float = 1000.0) -> DataFrame:
    """Edge id of the nearest edge, else a placeholder; coordinates stay."""
    from voltgrid.operators.roads import nearest_edge

    p = points.withColumn("_id", F.concat_ws("/", "method", "area_id", F.col("k").cast("string")))
    near = nearest_edge(p, edges, "_id", within_m)
    return p.join(near, "_id", "left").withColumn("edge_id", F.coalesce("edge_id", F.concat_ws("_", "method", F.col("k").cast("string")))).drop("_id", "dist_m")


def pool_size(chargers: int) -> int:
    """Candidates per method: chargers x clamp(100 // chargers, 15, 30)."""
    return chargers * max(15, min(30, 100 // chargers))


def stratified_sites(sites: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """Keep max(1, most // regions) sites of every 0.1° region, then fill up in hash order to ``most``."""
    region = [F.round("lat", 1).alias("_ra"), F.round("lon", 1).alias("_rb")]
    s = materialize(sites.select("*", *region).withColumn("_h", _digest(seed, F.col("site_id"))))
    ranked = row_numbers(s, ["_ra", "_rb"], ["_h", "site_id"], "_rn")
    regions = s.select("_ra", "_rb").distinct().agg(F.greatest(F.lit(1), F.floor(F.lit(most) / F.count(F.lit(1)))).alias("_q"))
    first = F.when(F.col("_rn") <= F.col("_q"), 0).otherwise(1)
    order = row_numbers(ranked.crossJoin(F.broadcast(regions)).withColumn("_late", first), [], ["_late", "_h", "site_id"], "_o")
    return order.filter(F.col("_o") <= most).drop("_ra", "_rb", "_h", "_rn", "_q", "_late", "_o")


# --- combinations -------------------------------------------------------------------------------------------

def _draws(sites: DataFrame, low: int, high: int) -> DataFrame:
    """Draw numbers low + 1 .. high of every grid."""
    grids = sites.groupBy("grid_id").agg(F.count(F.lit(1)).alias("_n"))
    return grids.withColumn("draw", F.explode(F.sequence(F.lit(low + 1), F.lit(high))))


def _collect(picks: DataFrame, k: int) -> DataFrame:
    """Picked rows -> one sorted combination per draw, k sites on k different edges, first draw of equal ones."""
    c = picks.groupBy("grid_id", "draw").agg(F.sort_array(F.collect_list(F.struct("site_id", "edge_id"))).alias("c"))
    ids, e = F.col("c.site_id"), F.col("c.edge_id")
    ok = c.filter((F.size("c") == k) & (F.size(F.array_distinct(ids)) == k) & (F.size(F.array_distinct(e)) == k)).select("grid_id", "draw", ids.alias("sites"))
    return first_of_equal(ok)


def first_of_equal(combos: DataFrame) -> DataFrame:
    """De-duplicate combinations by their sorted sites; the lowest draw stays."""
    return combos.groupBy("grid_id", F.array_sort("sites").alias("sites")).agg(F.min("draw").alias("draw"))


def _first(combos: DataFrame, count: int) -> DataFrame:
    return row_numbers(combos, ["grid_id"], ["draw"], "_rn").filter(F.col("_rn") <= count).drop("_rn")


def _distinct_draws(sites: DataFrame, count: int, draw: Callable[[DataFrame, int, int], DataFrame]) -> DataFrame:
    """The first ``count`` different combinations that the draws 1, 2, ... of each grid give.

    ``draw(sites, low, high)`` gives the valid combinations of draws low + 1 .. high. Draws that fall out or repeat are
    drawn again: grids that lack combinations go on with twice as many draws, until they have enough or a whole round
    finds nothing new, when all that can be drawn are found.
    """
    low, high = 0, 2 * count
    found = materialize(draw(sites, low, high))
    have = materialize(found.groupBy("grid_id").agg(F.count(F.lit(1)).alias("_have")))
    while True:
        short = sites.join(have.filter(F.col("_have") >= count), "grid_id", "left_anti") if low == 0 else sites.join(have.filter((F.col("_have") < count) & F.col("_new")), "grid_id", "left_semi")
        if short.isEmpty():
            return _first(found, count)
        low, high = high, 2 * high
        found = materialize(first_of_equal(found.unionByName(draw(short, low, high))))
        now = found.groupBy("grid_id").agg(F.count(F.lit(1)).alias("_now"))
        have = materialize(now.join(have.select("grid_id", "_have"), "grid_id", "left").select("grid_id", F.col("_now").alias("_have"), (F.col("_now") > F.coalesce("_have", F.lit(0))).alias("_new")))


def random_combinations(sites: DataFrame, k: int, count: int, seed: int = 42) -> DataFrame:
    """``count`` different combinations of k sites on k edges, by k independent draws each; all there are, if fewer."""
    rows = materialize(row_numbers(sites, ["grid_id"], ["site_id"], "_rn"))
    n = _space(sites, k)
    few = sites.join(n.filter(F.col("_c") <= count), "grid_id", "left_semi")
    many = sites.join(n.filter(F.col("_c") > count), "grid_id", "left_semi")

    def draw(some: DataFrame, low: int, high: int) -> DataFrame:
        d = _draws(some, low, high).withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(k))))
        d = d.withColumn("_rn", F.floor(uniform(seed, F.col("grid_id"), F.col("draw"), F.col("slot")) * F.col("_n")) + 1)
        return _collect(d.join(rows, ["grid_id", "_rn"]), k)

    every = row_numbers(all_combinations(few, k), ["grid_id"], ["sites"], "draw")
    return _distinct_draws(many, count, draw).unionByName(every.select("grid_id", "sites", F.col("draw").cast("int").alias("draw")))


def diverse_combinations(sites: DataFrame, stratum: str, k: int, count: int, seed: int = 42) -> DataFrame:
    """``count`` different combinations of sites of k different strata (random strata, one random site each).

    Where a grid has fewer strata, the missing slots are filled with random sites. With ``source_method`` this is the
    method-diverse form, with an edge prefix the network form.
    """
    ranked = materialize(row_numbers(sites, ["grid_id", stratum], ["site_id"], "_rn"))
    sizes = materialize(ranked.groupBy("grid_id", stratum).agg(F.count(F.lit(1)).alias("_m")))
    rows = materialize(row_numbers(sites, ["grid_id"], ["site_id"], "_rn"))

    def draw(some: DataFrame, low: int, high: int) -> DataFrame:
        d = _draws(some, low, high).join(sizes, "grid_id")
        key = [F.col("grid_id"), F.col("draw"), F.col(stratum)]
        d = d.withColumn("_rn", F.floor(uniform(seed, *key) * F.col("_m")) + 1).withColumn("_u", uniform(seed + 1, *key))
        one = row_numbers(d.join(ranked, ["grid_id", stratum, "_rn"]), ["grid_id", "draw"], ["_u"], "_s").filter(F.col("_s") <= k)
        have = materialize(one.select("grid_id", "draw", "site_id", "edge_id", "_n"))
        short = have.groupBy("grid_id", "draw").agg(F.count(F.lit(1)).alias("_k"), F.max("_n").alias("_n")).filter(F.col("_k") < k)
        fill = short.withColumn("slot", F.explode(F.sequence(F.col("_k") + 1, F.lit(k).cast("long")))).withColumn(
            "_rn", F.floor(uniform(seed + 2, F.col("grid_id"), F.col("draw"), F.col("slot")) * F.col("_n")) + 1).join(rows, ["grid_id", "_rn"])
        picks = ["grid_id", "draw", "site_id", "edge_id"]
        return _collect(have.select(*picks).unionByName(fill.select(*picks)), k)

    return _distinct_draws(sites, count, draw)


def stratified_combinations(sites: DataFrame, stratum: str, k: int, count: int, seed: int = 42) -> DataFrame:
    """``count`` different combinations; slots go round the strata in turn, starting at one that moves with the draw."""
    s = materialize(row_numbers(sites.select("grid_id", stratum).distinct(), ["grid_id"], [stratum], "_s"))
    rows = materialize(row_numbers(sites, ["grid_id", stratum], ["site_id"], "_rn"))
    m = rows.groupBy("grid_id", stratum).agg(F.count(F.lit(1)).alias("_m"))
    ns = s.groupBy("grid_id").agg(F.max("_s").alias("_ns"))

    def draw(some: DataFrame, low: int, high: int) -> DataFrame:
        d = _draws(some, low, high).join(ns, "grid_id").withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(k))))
        d = d.withColumn("_s", F.pmod(F.col("draw") + F.col("slot"), F.col("_ns")) + 1).join(s, ["grid_id", "_s"]).join(m, ["grid_id", stratum])
        d = d.withColumn("_rn", F.floor(uniform(seed, F.col("grid_id"), F.col("draw"), F.col("slot")) * F.col("_m")) + 1)
        return _collect(d.join(rows, ["grid_id", stratum, "_rn"]), k)

    return _distinct_draws(sites, count, draw)


def _far(chosen: DataFrame, packs: DataFrame) -> DataFrame:
    """(grid_id, draw, p): of every pack, the sites farthest from those chosen, and those that rounding may make so.

    ``chosen`` has draws with as many sites ``sel`` each. Of sites at one place only the last by id stays; sites chosen
    already are left out. Each pack of draws meets each pack of sites of its grid, dealt evenly over the tasks.
    """
    draws = chosen.groupBy("grid_id", F.floor(F.col("draw") / DRAWS).alias("_d")).agg(F.collect_list(F.struct("draw", "sel")).alias("_draws"))
    met = draws.join(packs, "grid_id").select("grid_id", "_draws", "_pts").repartition(int(chosen.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def numbers(points: pa.StructArray, name: str) -> np.ndarray:
        return points.field(name).cast(pa.float64()).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grid, some, sites in zip(batch.column("grid_id"), batch.column("_draws"), batch.column("_pts"), strict=True):
                some, sites = some.values, sites.values
                ids, edges = sites.field("site_id").to_pylist(), sites.field("edge_id").to_pylist()
                order = sorted(range(len(sites)), key=lambda i: tuple((v is not None, v) for v in (ids[i], edges[i])))
                sites = sites.take(pa.array(order, pa.int64()))
                lat, lon, names = numbers(sites, "lat"), numbers(sites, "lon"), np.array(sites.field("site_id").to_pylist(), object)
                sel = some.field("sel").flatten()
                shape = (len(some), -1)
                s_lat, s_lon, s_names = numbers(sel, "lat").reshape(shape), numbers(sel, "lon").reshape(shape), np.array(sel.field("site_id").to_pylist(), object).reshape(shape)
                gap, taken = np.full((len(some), len(sites)), np.nan), np.zeros((len(some), len(sites)), bool)
                number = {v: n for n, v in enumerate({*names.tolist(), *s_names.ravel().tolist()})}
                mine, theirs = np.array([number[v] for v in names]), np.array([number[v] for v in s_names.ravel()]).reshape(shape)
                for j in range(theirs.shape[1]):
                    gap = np.fmin(gap, np.hypot(lat - s_lat[:, j, None], lon - s_lon[:, j, None]))
                    taken |= mine == theirs[:, j, None]
                best = np.where(taken, -1.0, np.nan_to_num(gap, nan=-1.0, posinf=np.inf)).max(axis=1)
                draw, at = np.nonzero(~taken & ((gap >= best[:, None] * (1 - 1e-12)) | np.isnan(gap)))
                place = np.unique(np.stack((lat, lon), axis=1), axis=0, return_inverse=True)[1].ravel()
                last = np.array(sorted(dict(zip(zip(draw.tolist(), place[at].tolist(), strict=True), range(len(at)), strict=True)).values()), np.int64)
                numbers_ = some.field("draw").take(pa.array(draw[last]))
                yield pa.RecordBatch.from_arrays([pa.array([grid.as_py()] * len(last), batch.schema.field("grid_id").type), numbers_, sites.take(pa.array(at[last]))], names=["grid_id", "draw", "p"])

    point = packs.schema["_pts"].dataType.elementType
    return met.mapInArrow(run, f"grid_id {packs.schema['grid_id'].dataType.simpleString()}, draw int, p {point.simpleString()}")


def spread_combinations(sites: DataFrame, k: int, count: int, seed: int = 42) -> DataFrame:
    """Farthest-point combinations: a first site, then k - 1 rounds of the site farthest from those chosen.

    First sites are the first ``count`` in a keyed random order, so none comes twice. Each round meets packs of draws with packs of a grid's sites in a kernel, which the best sites of a pack leave (``_far``); the exact
    distances of these decide.
    """
    ranked = row_numbers(sites.withColumn("_h", _digest(seed, F.col("site_id"))), ["grid_id"], ["_h", "site_id"], "draw")
    chosen = materialize(ranked.filter(F.col("draw") <= count).select("grid_id", F.col("draw").cast("int").alias("draw"), F.array(F.struct("site_id", "edge_id", "lat", "lon")).alias("sel")))
    packs = materialize(_packs(sites.select("grid_id", "site_id", "edge_id", "lat", "lon"), ["site_id", "edge_id", "lat", "lon"], 512, ["grid_id"]).select("grid_id", "_pts"))
    for _ in range(k - 1):
        p = F.col("p")
        gap = F.array_min(F.transform("sel", lambda s: F.hypot(p["lat"] - s["lat"], p["lon"] - s["lon"])))
        each = _far(chosen, packs).join(chosen, ["grid_id", "draw"]).select("grid_id", "draw", F.struct(gap.alias("gap"), "p.*").alias("b"))
        top = each.groupBy("grid_id", "draw").agg(F.max("b").alias("b")).filter("b.gap >= 0")
        add = F.array(F.struct("b.site_id", "b.edge_id", "b.lat", "b.lon"))
        chosen = materialize(chosen.join(top, ["grid_id", "draw"]).select("grid_id", "draw", F.concat("sel", add).alias("sel")))
    return _collect(chosen.select("grid_id", "draw", F.explode("sel").alias("s")).select("grid_id", "draw", "s.site_id", "s.edge_id"), k)


def all_combinations(sites: DataFrame, k: int) -> DataFrame:
    """Every k-subset of a grid's sites on distinct edges. Only for grids whose count of subsets is known to be small."""
    base = sites.select("grid_id", "site_id", "edge_id")
    out = base.select("grid_id", F.array("site_id").alias("sites"), F.array("edge_id").alias("_e"), F.col("site_id").alias("_last"))
    for _ in range(k - 1):
        nxt = base.select("grid_id", F.col("site_id").alias("_s"), F.col("edge_id").alias("_x"))
        out = out.join(nxt, "grid_id").filter((F.col("_s") > F.col("_last")) & ~F.array_contains("_e", F.col("_x"))).select(
            "grid_id", F.array_append("sites", F.col("_s")).alias("sites"), F.array_append("_e", F.col("_x")).alias("_e"), F.col("_s").alias("_last"))
    return out.select("grid_id", "sites")


def _space(sites: DataFrame, k: int) -> DataFrame:
    """(grid_id, _c): how many sets of k sites on k different edges a grid has.

    The k-th elementary symmetric sum of the numbers of sites per edge, from their power sums (Newton's identities).
    """
    per = sites.groupBy("grid_id", "edge_id").agg(F.count(F.lit(1)).cast("double").alias("_m"))
    sums = per.groupBy("grid_id").agg(*[F.sum(F.pow("_m", F.lit(i))).alias(f"_p{i}") for i in range(1, k + 1)])
    e = [F.lit(1.0)]
    for n in range(1, k + 1):
        e.append(sum(((-1) ** (i - 1) * e[n - i] * F.col(f"_p{i}") for i in range(1, n + 1)), F.lit(0.0)) / n)
    return sums.select("grid_id", F.round(F.greatest(e[k], F.lit(0.0))).alias("_c"))


def placement_configurations(sites: DataFrame, k: int, seed: int = 42, most: int = MOST) -> DataFrame:
    """``most`` different configurations of every grid, all there are if fewer.

    At every size 40 % are spread, 40 % random and 20 % of different edge prefixes; what repeats among them is made up by
    further random ones.
    """
    named = sites.withColumn("prefix", F.when(F.col("edge_id").contains("_"), F.split("edge_id", "_")[0]).otherwise("default"))
    share = int(0.4 * most)
    kinds = [spread_combinations(named, k, share, seed), random_combinations(named, k, share, seed), diverse_combinations(named, "prefix", k, most - 2 * share, seed), random_combinations(named, k, most, seed + 7)]
    mixed = None
    for i, c in enumerate(kinds):
        p = c.withColumn("draw", F.col("draw") + i * (1 << 30))
        mixed = p if mixed is None else mixed.unionByName(p)
    return _first(first_of_equal(mixed), most).select("grid_id", "sites")
