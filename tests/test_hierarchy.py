"""Sums and nearest partners over the tile hierarchy against plain NumPy, with half of the points in one spot."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltgrid.operators import hierarchy, neighbours, tiles

RNG = np.random.default_rng(11)


def crowd(n, spot=1e-5):
    """Half of the points within ``spot`` of one place, one of them there exactly."""
    out = np.vstack([RNG.random((n // 2, 2)), [0.3, 0.7] + spot * RNG.random((n - n // 2, 2))])
    out[-1] = [0.3, 0.7]
    return out


def table(spark, xy, **more):
    rows = [(i, float(a), float(b), *(float(v[i]) for v in more.values())) for i, (a, b) in enumerate(xy)]
    return spark.createDataFrame(rows, "id long, lat double, lon double" + "".join(f", {c} double" for c in more))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(hierarchy, "FEW", 0)


def test_inverse_distance_sums(spark, small):
    t, s, y = crowd(300), crowd(500), RNG.random(500)
    got = hierarchy.kernel_sums(table(spark, t), table(spark, s, k=np.ones(500), y=y), "id", ["k", "y"], lambda d: {"w": (1 / (d + 1e-10)) ** 2}, leaf=16).orderBy("id").toPandas()
    w = (1 / (np.hypot(*(t[:, None] - s[None]).transpose(2, 0, 1)) + 1e-10)) ** 2
    assert len(got) == 300 and np.abs(got.w_k / w.sum(1) - 1).max() < 1e-6 and np.abs(got.w_y / got.w_k - w @ y / w.sum(1)).max() < 1e-6


def test_decay_density_without_a_cut(spark, small, monkeypatch):
    monkeypatch.setattr(hierarchy, "LEAF", 16)
    xy = np.vstack([crowd(240, 1e-3), [[5.0, 5.0], [30.0, 2.0]]])
    got = neighbours.decay_density(table(spark, xy), "id", "long").orderBy("id").toPandas()
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    for r, label in ((0.01, "1km"), (0.02, "2km"), (0.05, "5km")):
        want = np.exp(-d / r).sum(1) - 1
        assert np.abs(got[f"weighted_density_{label}"] - want).max() < 1e-6


def test_pairs_cover_each_pair_once(spark, small):
    t, s = crowd(150), crowd(200)
    ones = hierarchy.kernel_sums(table(spark, t), table(spark, s, k=np.ones(200)), "id", ["k"], lambda d: {"n": np.ones_like(d)}, leaf=8).collect()
    assert len(ones) == 150 and all(abs(r.n_k - 200) < 1e-6 for r in ones)


def test_tiles_share_a_hot_spot(spark, small):
    """Half of all points lie in one tile of the third level; no tile of the pairs holds more than the leaf asks for."""
    xy = table(spark, crowd(2000))
    frame = hierarchy.Frame(xy)
    cells = frame.tiled(xy).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    far, near = hierarchy.pairs(cells, cells, frame, leaf=32)
    per_tile = far.groupBy("level", "x", "y").count().agg(F.max("count")).first()[0]
    assert per_tile <= 27 and near.count() < 9 * 2000 and near.agg(F.max("level")).first()[0] > 12


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_k(spark, small, k):
    t, s = crowd(200), crowd(300)
    s[10] = s[20] = s[30]  # copies: ties go by id
    got = hierarchy.nearest_k(table(spark, t), table(spark, s).withColumnRenamed("id", "site"), "id", ["site"], k, leaf=8, few=0).collect()
    d = np.hypot(*(t[:, None] - s[None]).transpose(2, 0, 1))
    want = {(i, rank, int(j)) for i in range(200) for rank, j in enumerate(np.lexsort((np.arange(300), d[i]))[:k], 1)}
    assert {(r.id, r["rank"], r.site) for r in got} == want


def test_nearest_of_few_and_none(spark):
    t, s = table(spark, crowd(20)), table(spark, crowd(2)).withColumnRenamed("id", "site")
    assert hierarchy.nearest_k(t, s, "id", ["site"], 3).count() == 40
    assert hierarchy.nearest_k(t, s.filter("site < 0"), "id", ["site"], 3).count() == 0
    assert tiles.nearest(t, s, "id", "site", point_type="long", site_type="long").count() == 20


def test_local_interpolation_counts_copies(spark):
    xy = np.array([[0.0, 0.0], [0.0, 0.0], [0.0, 2.0], [0.0, 3.0], [0.0, 4.0]])
    y = np.array([0.2, 0.2, 0.6, 1.0, 0.1])
    cells = spark.createDataFrame([("far", 0.0, 1.0), ("near", 0.0, 0.001)], "grid_id string, lat double, lon double")
    got = {r.grid_id: r.y for r in neighbours.local_interpolation(cells, table(spark, xy, y=y), "y").collect()}
    d = np.abs(xy[:, 1] - 1.0) * 111.32
    w = (d[:3] + 0.1) ** -1.5
    assert abs(got["far"] - min(1, max(0, (w @ y[:3]) / w.sum() * np.exp(-d[0] / 2)))) < 1e-9
    assert abs(got["near"] - 0.2 * np.exp(-0.11132 / 2)) < 1e-9
