"""One test per finding of round 4: each failed before its change."""

import numpy as np
from pyspark.sql import functions as F

from voltgrid.functions import geo
from voltgrid.llm import simhash
from voltgrid.operators import polygons
from voltgrid.plans import catalog
from voltgrid.plans.registry import QUERIES

catalog.load()


def test_rows_per_bucket_are_not_broadcast(spark, monkeypatch):
    """a table of fingerprints that looks small has a row per fingerprint and bucket, which no task and no driver holds whole."""
    plans, write = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    rng = np.random.default_rng(5)
    fps = [simhash._signed(int(x)) for x in rng.integers(0, 1 << 63, 300)]
    pairs = [(f, f ^ 5) for f in fps]
    found = simhash.links(write(spark.createDataFrame([(x,) for p in pairs for x in p], "fp long")))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {frozenset(r) for r in found.collect()} == {frozenset(p) for p in pairs}
    prints = write(spark.createDataFrame([(2 * i + k, bytearray(np.array([f, f, f, f ^ k], np.int64).tobytes())) for i, f in enumerate(fps) for k in (0, 1)], "key long, fp binary"))
    assert {(2 * i, 2 * i + 1) for i in range(300)} <= {tuple(r) for r in simhash.candidate_links(prints).collect()}
    assert all("BroadcastExchange" not in p for p in plans) and sum("SortMergeJoin" in p for p in plans) > 1


def _shapes(spark):
    """Rings in metres: a U, a square with a hole, triangles, a ring of 400 corners; over cells of 100 and 250 metres."""
    u = [(0, 0), (900, 0), (900, 800), (600, 800), (600, 300), (300, 300), (300, 800), (0, 800)]
    holed = [[(5, 5), (605, 5), (605, 605), (5, 605)], [(120, 120), (120, 480), (480, 480), (480, 120)]]
    t = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    star = [*zip((500 + (400 + 90 * np.sin(9 * t)) * np.cos(t)).tolist(), (450 + (400 + 90 * np.sin(9 * t)) * np.sin(t)).tolist(), strict=True)]
    rng = np.random.default_rng(3)
    rings = [[u], holed, [star], [[(0, 0), (100, 0), (100, 100), (0, 100)]], [[(0, 200), (900, 200 + 1e-7), (900, 300), (0, 300)]], *([rng.uniform(-50, 950, (3, 2)).tolist()] for _ in range(20)), [[]], []]
    rows = [(f"a{k}", "water", [[{"x": 500000.0 + x, "y": 4690000.0 + y, "real": True} for x, y in r] for r in shape], 500000.0, 4690000.0, e, 9 * 100 // int(e), 8 * 100 // int(e)) for e in (100.0, 250.0) for k, shape in enumerate(rings)]
    return spark.createDataFrame(rows, "area_id string, cover string, shape array<array<struct<x: double, y: double, real: boolean>>>, ox double, oy double, size_m double, most_x long, most_y long")


def test_cover_areas_along_sides(spark, monkeypatch):
    """areas summed along the sides of many shapes at once are those of the clipped pieces, however the sides are dealt out."""
    shapes = _shapes(spark)
    want = {(r["area_id"], r["i"], r["j"], r["size_m"]): r["piece_m2"] for r in polygons.cells_over(shapes).collect()}
    table = shapes.toPandas()
    rings = [r for s in table["shape"] for r in s]
    x, y = (np.array([p[c] for r in rings for p in r]) for c in "xy")
    given = x, y, np.array([len(r) for r in rings]), np.array([len(s) for s in table["shape"]]), *(table[c].to_numpy() for c in ("ox", "oy", "size_m", "most_x", "most_y"))
    for most in (1 << 18, 40, 3):
        monkeypatch.setattr(polygons, "AT_ONCE", most)
        got = {(table["area_id"][s], i, j, table["size_m"][s]): a for part in polygons.overlap_areas(*given) for s, i, j, a in zip(*(c.tolist() for c in part), strict=True)}
        assert got.keys() == want.keys() and len(got) > 300 and max(abs(got[k] - want[k]) for k in want) < 1e-6
    assert [len(p[0]) for p in polygons.overlap_areas(np.array([0, 1, np.nan]), np.zeros(3), np.array([3]), np.array([1]), *(np.array([v]) for v in (0.0, 0.0, 1.0, 9, 9)))] == []


def test_cover_is_not_clipped_shape_by_shape(spark, tmp_path, monkeypatch):
    """the shares of land cover take no clipping, cells are made once, and corners are shuffled once into rings in their order."""
    corners = spark.createDataFrame([("a", r, p, 7.5 + 0.01 * r + x, 45.0 + y) for r in (10, 2) for p, (x, y) in enumerate(((0, 0), (0.1, 0), (0.1, 0.1), (0, 0.1)))][::-1], "area_id string, ring int, pos int, lon double, lat double")
    rings = polygons.boundary_rings(corners)
    assert rings._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [[(round(p["lon"], 6), round(p["lat"], 6)) for p in r] for r in rings.first()["rings"]] == [[(round(7.5 + 0.01 * k + x, 6), round(45 + y, 6)) for x, y in ((0, 0), (0.1, 0), (0.1, 0.1), (0, 0.1))] for k in (2, 10)]
    write_tables(spark, tmp_path)
    cut, calls = polygons.cells_over, []
    monkeypatch.setattr(polygons, "cells_over", lambda *a, **b: calls.append(1) or cut(*a, **b))
    shares = QUERIES["gen02_cover_by_area"](spark, str(tmp_path))
    assert len(calls) == 1 and not any("supplier" in f for f in shares.inputFiles())
    assert shares.count() > 0


def write_tables(spark, folder):
    spark.range(3).selectExpr("id AS s_suppkey").write.parquet(f"{folder}/supplier.parquet")
    spark.range(60).selectExpr("id % 3 AS l_suppkey", "id AS l_orderkey", "id AS l_partkey", "1 AS l_linenumber", "id % 50 * 1D AS l_quantity").write.parquet(f"{folder}/lineitem.parquet")


def test_flexible_cells_start_from_cells_made_once(spark, tmp_path):
    """primary cells, that four steps read, are not made again for each."""
    write_tables(spark, tmp_path)
    half = QUERIES["gen03_flexible_rings"](spark, str(tmp_path))
    assert half.count() > 0 and not any("supplier" in f for f in half.inputFiles())


def test_projection_in_a_kernel(spark):
    """a kernel's metres are those of the Column expressions."""
    rows = [(lat, lon, zone, lat < 0) for lat in (-55.5, -0.001, 0.0, 42.217, 80.0) for lon, zone in ((-83.8, 17), (-80.9, 17), (3.0, 31), (7.5, 32))]
    df = spark.createDataFrame(rows, "lat double, lon double, zone int, south boolean")
    want = [r[0][0] for r in df.select(geo.to_utm_points(F.array(F.struct("lat", "lon")), F.col("zone"), F.col("south"))).collect()]
    x, y = geo.to_utm_arrays(*(np.array(c) for c in zip(*rows, strict=True)))
    assert np.abs(x - [p["x"] for p in want]).max() < 1e-8 and np.abs(y - [p["y"] for p in want]).max() < 1e-8
