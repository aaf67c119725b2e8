"""Ring geometry against plain sums, and wide series with awkward names."""

import pytest
from pyspark.sql import functions as F

from voltgrid.operators import demand, polygons
from voltgrid.sources import tables

KM_LAT = 1 / 111.32


def corners(area, rings, lat0=45.0, lon0=7.5):
    """Corner rows of rings given in kilometres east and north of a point."""
    scale = 1 / (111.32 * 0.70710678)
    return [(area, r, p, lat0 + y * KM_LAT, lon0 + x * scale) for r, ring in enumerate(rings) for p, (x, y) in enumerate(ring)]


@pytest.fixture(scope="module")
def areas(spark):
    u_shape = [(0, 0), (9, 0), (9, 8), (6, 8), (6, 3), (3, 3), (3, 8), (0, 8)]
    holed = [[(0, 0), (6, 0), (6, 6), (0, 6)], [(1.2, 1.2), (1.2, 4.8), (4.8, 4.8), (4.8, 1.2)]]
    rows = corners("u", [u_shape]) + corners("holed", holed, lat0=-30.0) + corners("dot", [[(0, 0), (0.1, 0), (0.05, 0.1)]], lat0=50.0)
    return polygons.boundary_rings(spark.createDataFrame(rows, "area_id string, ring int, pos int, lat double, lon double"))


def test_cells_add_up_to_the_boundary(areas):
    cells = polygons.polygon_grid(areas)
    got = {r.area_id: r.s for r in cells.groupBy("area_id").agg(F.sum("area_km2").alias("s")).collect()}
    want = {r.area_id: r.area_km2 for r in polygons.ring_totals(areas).collect()}
    assert set(got) == {"u", "holed", "dot"} and all(abs(got[a] - want[a]) < 1e-6 for a in want)
    assert abs(want["u"] - (72 - 15)) < 1.0 and want["dot"] < 0.02


def test_cells_inside_a_hole_are_left_out(areas):
    ids = {(r.i, r.j) for r in polygons.primary_grid(areas).filter("area_id = 'holed'").collect()}
    assert (3, 3) not in ids and (0, 0) in ids and len(ids) < 49


def test_bounds_of_parts_apart_follow_the_boundary(areas):
    """In a row above the notch of the U, a column of cells that only the clip line crosses does not count."""
    cells = polygons.polygon_grid(areas, size_km=5.0).filter("area_id = 'u'").collect()
    shape = {(r.i, r.j): r for r in cells}
    assert set(shape) == {(0, 0), (1, 0), (0, 1), (1, 1)}
    left, right = shape[0, 1], shape[1, 1]
    scale = 1 / (111.32 * 0.70710678)
    assert left.max_lon < 7.5 + 3.1 * scale and right.min_lon > 7.5 + 5.9 * scale  # not the clip line between the arms


def test_flexible_cells_cover_what_is_open(areas):
    primary = polygons.primary_grid(areas, keep_utm=True)
    kept = primary.filter("i < 3").select("grid_id")
    half = polygons.flexible_grid(primary, kept).filter("area_id = 'holed'").collect()
    assert half and all(abs(r.area_km2 - 0.25) < 1e-12 for r in half)
    assert polygons.flexible_grid(primary, primary.select("grid_id")).count() == 0


def test_cover_shares_by_area(spark, areas):
    shape = corners("holed", [[(0, 0), (3, 0), (3, 6), (0, 6)]], lat0=-30.0)
    lake = polygons.boundary_rings(spark.createDataFrame(shape, "area_id string, ring int, pos int, lat double, lon double")).withColumn("cover", F.lit("water"))
    cells = polygons.primary_grid(areas.filter("area_id = 'holed'"), keep_utm=True)
    shares = [r.water_share for r in polygons.cover_shares(cells, lake).collect()]
    assert max(shares) == pytest.approx(1.0, abs=1e-9) and all(0 < s <= 1 for s in shares)
    assert polygons.cover_shares(cells, lake.limit(0)).count() == 0


def test_no_areas(spark):
    none = polygons.boundary_rings(spark.createDataFrame([], "area_id string, ring int, pos int, lat double, lon double"))
    assert polygons.polygon_grid(none).count() == 0 and polygons.primary_grid(none).count() == 0


def test_wide_series_round_trip(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", s, v) for s, v in (("1001", 1.5), ('a,"b"', 2.0), ("1003", None))] + [("2024-02-01 00:00:00", "1001", 4.0)]
    long = spark.createDataFrame(rows, "time string, station string, kwh double")
    path = str(tmp_path / "wide")
    tables.write_wide_csv(long, path, "time", "station", "kwh")
    got = {(str(r.ts), r.station_id): r.kwh for r in tables.wide_series_csv(spark, {"kwh": [path]}).collect()}
    assert got == {("2024-01-01 00:00:00", "1001"): 1.5, ("2024-01-01 00:00:00", 'a,"b"'): 2.0, ("2024-01-01 00:00:00", "1003"): None,
                   ("2024-02-01 00:00:00", "1001"): 4.0, ("2024-02-01 00:00:00", 'a,"b"'): None, ("2024-02-01 00:00:00", "1003"): None}


def test_wide_lines_with_returns_and_blocks(spark, tmp_path):
    for i, text in enumerate(("time,s1,s2\r\n2024-01-01,1,\r\n2024-01-02,,x\r\n", 'time,"s,3"\n2024-01-01,7\n')):
        (tmp_path / f"{i}.csv").write_text(text)
    out = tables.wide_series_csv(spark, {"kwh": [str(tmp_path / "0.csv"), str(tmp_path / "1.csv")]}).collect()
    assert {(str(r.ts)[:10], r.station_id, r.kwh) for r in out} == {("2024-01-01", "s1", 1.0), ("2024-01-01", "s2", None), ("2024-01-02", "s1", None), ("2024-01-02", "s2", None), ("2024-01-01", "s,3", 7.0)}


def test_widened_rows_unpivot_to_the_same(spark):
    long = spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0), (2, "b", 3.0)], "t int, station_id string, v double")
    wide, header = demand.widen(long, "t", "station_id", "v")
    assert {r.t: list(r["values"]) for r in wide.collect()} == {1: [1.0, 2.0], 2: [None, 3.0]}
    assert {tuple(r) for r in demand.unpivot_arrays(wide, header, "t", "v").collect()} == {(1, "a", 1.0), (1, "b", 2.0), (2, "a", None), (2, "b", 3.0)}
