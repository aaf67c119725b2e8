"""Spatial operators against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltgrid.functions import geo
from voltgrid.operators import neighbours, roads, spatial, tiles


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.RandomState(5)
    lat, lon = rng.rand(300) * 0.1, rng.rand(300) * 0.1
    lat[:120], lon[:120] = 0.05, 0.05  # a hot spot
    pdf = pd.DataFrame({"pid": [f"p{i:04d}" for i in range(300)], "lat": lat, "lon": lon})
    return spark.createDataFrame(pdf), pdf


@pytest.fixture(scope="module")
def sites(spark):
    rng = np.random.RandomState(6)
    pdf = pd.DataFrame({"sid": [f"s{i:02d}" for i in range(20)], "lat": rng.rand(20) * 0.1, "lon": rng.rand(20) * 0.1})
    far = pd.DataFrame({"sid": ["s99"], "lat": [5.0], "lon": [5.0]})
    pdf = pd.concat([pdf, far])
    return spark.createDataFrame(pdf), pdf


def dist(a, b):
    return np.hypot(a["lat"].to_numpy()[:, None] - b["lat"].to_numpy(), a["lon"].to_numpy()[:, None] - b["lon"].to_numpy())


def test_nearest(points, sites):
    d = dist(points[1], sites[1])
    for size in (None, 0.001):
        got = tiles.nearest(points[0], sites[0], "pid", "sid", size).toPandas().sort_values("pid")
        assert (got["sid"].to_numpy() == sites[1]["sid"].to_numpy()[d.argmin(1)]).all()
        assert np.allclose(got["dist"], d.min(1))


def test_nearest_within_radius(points, sites):
    d = dist(points[1], sites[1])
    got = tiles.nearest(points[0], sites[0], "pid", "sid", within=0.015).toPandas()
    assert len(got) == (d.min(1) <= 0.015).sum()


def test_radius_counts_and_density(points):
    d = dist(points[1], points[1])
    got = neighbours.radius_counts(points[0], "pid").toPandas().sort_values("pid")
    assert (got["neighbors_within_2km"].to_numpy() == (d <= 0.02).sum(1) - 1).all()
    got = neighbours.decay_density(points[0], "pid", radii=(0.02,)).toPandas().sort_values("pid")
    assert np.allclose(got["weighted_density_2km"], np.exp(-d / 0.02).sum(1) - 1)


def test_interpolation_counts_copies(spark, points, sites):
    st = sites[0].withColumn("y", F.lit(0.5)).unionByName(sites[0].limit(1).withColumn("y", F.lit(0.5)))
    cells = points[0].select(F.col("pid").alias("grid_id"), "lat", "lon").limit(20)
    got = neighbours.idw(cells, st, ["y"]).toPandas()
    assert np.allclose(got["y"], 0.5)
    c, s = cells.toPandas(), st.toPandas()
    got = neighbours.local_interpolation(cells, st, "y").toPandas().set_index("grid_id")
    for _, r in c.iterrows():
        d = np.hypot(s["lat"] - r["lat"], s["lon"] - r["lon"]).to_numpy() * 111.32
        near = d <= 3 if (d <= 3).any() else np.argsort(d)[:3]
        assert np.isclose(got.loc[r["grid_id"], "y"], 0.5 * np.exp(-d[near].min() / 2))


def test_cell_borders_and_overlap(spark):
    cells = spark.createDataFrame([("a", 0, 0.0, 1.0, 0.0, 1.0), ("b", 1, 0.5, 1.5, 0.0, 1.0)], "grid_id string, cell_order int, min_lat double, max_lat double, min_lon double, max_lon double")
    pts = spark.createDataFrame([("edge", 0.0, 0.5), ("both", 0.7, 0.5), ("out", 3.0, 3.0)], "pid string, lat double, lon double")
    assert {r["pid"] for r in spatial.points_in_cells(pts, cells, 0.3).collect()} == {"both"}
    touching = spatial.points_in_cells(pts, cells, 0.3, predicate="intersects")
    assert {(r["pid"], r["grid_id"]) for r in touching.collect()} == {("edge", "a"), ("both", "a"), ("both", "b")}
    hits = spatial.points_in_cells(pts, cells, 0.3)
    assert [r["grid_id"] for r in spatial.one_cell_per_point(hits, "pid").collect()] == ["a"]
    assert [r["grid_id"] for r in spatial.one_cell_per_point(hits, "pid", "last").collect()] == ["b"]


def test_ring_test_is_strict(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))])
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (3.0, 1.0)], "lat double, lon double")
    assert [r[0] for r in df.select(geo.strictly_inside_ring(F.col("lat"), F.col("lon"), ring)).collect()] == [True, False, False]


def test_utm_known_point(spark):
    df = spark.createDataFrame([(43.642567, -79.387139)], "lat double, lon double").withColumn("zone", geo.utm_zone(F.col("lon")))
    p = geo.to_utm_points(F.array(F.struct("lat", "lon")), F.col("zone"), F.lit(False))
    r = df.select("zone", p[0].alias("p")).first()
    assert r["zone"] == 17 and abs(r["p"]["x"] - 630084) < 1 and abs(r["p"]["y"] - 4833439) < 1


def test_point_at_beyond_end(spark):
    df = spark.range(1).withColumn("shape", F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (3.0, 4.0), (3.0, 10.0))]))
    at = lambda d: tuple(df.select(roads.point_at(F.col("shape"), F.lit(d)).alias("p")).first()["p"])
    assert at(2.5) == (1.5, 2.0) and at(8.0) == (3.0, 7.0) and at(99.0) == (3.0, 10.0)
