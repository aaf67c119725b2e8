"""Geodesy as Column expressions: distances, cell areas, UTM projection, planar predicates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.32

# WGS84 ellipsoid and UTM constants (fixed values).
_A = 6378137.0
_FLAT = 1 / 298.257223563
_K0 = 0.9996
_FALSE_EASTING = 500000.0
_FALSE_NORTHING = 10000000.0

# Third flattening and the Krüger series derived from it, to the third order (sub-millimetre inside a zone).
_N = _FLAT / (2 - _FLAT)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_ECC = 2 * math.sqrt(_N) / (1 + _N)


def _haversine_term(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    return (F.pow(F.sin(dlat / 2), F.lit(2.0))
            + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, arcsine form."""
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(_haversine_term(lat1, lon1, lat2, lon2)))


def haversine_km_atan2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, two-argument arctangent form."""
    a = _haversine_term(lat1, lon1, lat2, lon2)
    return EARTH_RADIUS_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def widened(box: dict[str, float], margin: float) -> dict[str, float]:
    """Bounds (min_lat, max_lat, min_lon, max_lon) moved out by ``margin``, as the decimals they stand for: -83.79 - 0.01 is -83.8."""
    return {c: round(v + (margin if c.startswith("max") else -margin), 12) for c, v in box.items()}


def cell_area_km2(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column,
                  floor: float | None = None) -> Column:
    mid = F.radians((min_lat + max_lat) / 2)
    area = (max_lat - min_lat) * KM_PER_DEGREE * (max_lon - min_lon) * KM_PER_DEGREE * F.cos(mid)
    return area if floor is None else F.greatest(area, F.lit(floor))


def shift_lat(lat: Column, km: Column) -> Column:
    return lat + km / KM_PER_DEGREE


def shift_lon(lon: Column, km: Column, mid_lat: Column) -> Column:
    return lon + km / (KM_PER_DEGREE * F.cos(F.radians(mid_lat)))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, 32600 + utm_zone(lon)).otherwise(32700 + utm_zone(lon))


def _central_meridian(zone: Column) -> Column:
    return F.radians(zone.cast("double") * 6 - 183)


def to_utm_points(points: Column, zone: Column, south: Column) -> Column:
    """array<struct<lat,lon>> -> array<struct<x,y>> in metres by the Krüger series.

    The steps are chained transforms, so that each intermediate is computed once and the generated code stays small.
    """
    def conformal(p):
        s = F.sin(F.radians(p["lat"]))
        return F.struct(F.sinh(F.atanh(s) - _ECC * F.atanh(_ECC * s)).alias("t"),
                        (F.radians(p["lon"]) - _central_meridian(zone)).alias("lam"))

    def sphere(p):
        return F.struct(F.atan2(p["t"], F.cos(p["lam"])).alias("xi"),
                        F.atanh(F.sin(p["lam"]) / F.sqrt(1 + p["t"] * p["t"])).alias("eta"))

    def plane(p):
        east, north = p["eta"], p["xi"]
        for j, a in enumerate(_ALPHA, start=1):
            east = east + a * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
            north = north + a * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
        false_north = F.when(south, F.lit(_FALSE_NORTHING)).otherwise(F.lit(0.0))
        return F.struct((_FALSE_EASTING + _K0 * _RECT * east).alias("x"),
                        (false_north + _K0 * _RECT * north).alias("y"))

    return F.transform(F.transform(F.transform(points, conformal), sphere), plane)


def to_utm_arrays(lat: np.ndarray, lon: np.ndarray, zone: np.ndarray, south: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``to_utm_points`` inside a kernel: metres of points, each in its zone."""
    s, lam = np.sin(np.radians(lat)), np.radians(lon) - np.radians(zone * 6.0 - 183)
    t = np.sinh(np.arctanh(s) - _ECC * np.arctanh(_ECC * s))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    east = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, start=1))
    north = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, start=1))
    return _FALSE_EASTING + _K0 * _RECT * east, np.where(south, _FALSE_NORTHING, 0.0) + _K0 * _RECT * north


def from_utm_points(points: Column, zone: Column, south: Column) -> Column:
    """array<struct<x,y>> -> array<struct<lon,lat>> in degrees."""
    def unit(p):
        false_north = F.when(south, F.lit(_FALSE_NORTHING)).otherwise(F.lit(0.0))
        return F.struct(((p["y"] - false_north) / (_K0 * _RECT)).alias("xi"),
                        ((p["x"] - _FALSE_EASTING) / (_K0 * _RECT)).alias("eta"))

    def sphere(p):
        xi, eta = p["xi"], p["eta"]
        for j, b in enumerate(_BETA, start=1):
            xi = xi - b * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
            eta = eta - b * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def angles(p):
        return F.struct(F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])).alias("chi"),
                        F.atan2(F.sinh(p["eta"]), F.cos(p["xi"])).alias("lam"))

    def degrees(p):
        phi = p["chi"]
        for j, d in enumerate(_DELTA, start=1):
            phi = phi + d * F.sin(2 * j * p["chi"])
        return F.struct(F.degrees(_central_meridian(zone) + p["lam"]).alias("lon"), F.degrees(phi).alias("lat"))

    return F.transform(F.transform(F.transform(F.transform(points, unit), sphere), angles), degrees)


def strictly_inside_box(lat: Column, lon: Column, min_lat: Column, max_lat: Column,
                        min_lon: Column, max_lon: Column) -> Column:
    return (lat > min_lat) & (lat < max_lat) & (lon > min_lon) & (lon < max_lon)


def touches_box(lat: Column, lon: Column, min_lat: Column, max_lat: Column,
                min_lon: Column, max_lon: Column) -> Column:
    return (lat >= min_lat) & (lat <= max_lat) & (lon >= min_lon) & (lon <= max_lon)


def strictly_inside_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Point strictly inside a convex ring (array of (lon, lat) corners, not closed): one turn sign on every side."""
    k = F.size(ring)
    nxt = F.concat(F.slice(ring, F.lit(2), k - 1), F.slice(ring, 1, 1))
    turns = F.zip_with(ring, nxt, lambda a, b: F.signum(
        (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])))
    return F.forall(turns, lambda t: t > 0) | F.forall(turns, lambda t: t < 0)
