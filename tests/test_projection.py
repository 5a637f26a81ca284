"""Projections against arcs, known points and themselves; a raster against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from equimap.functions import projection as R
from equimap.operators import spatial
from equimap.plans import region_queries

DATA = "/root/testdata/sf0.001"


def planes(spark, rows, zone):
    df = spark.createDataFrame(rows, "lon double, lat double")
    x, y = R.to_plane(F.col("lon"), F.col("lat"), zone)
    lon, lat = R.to_degrees(F.col("x"), F.col("y"), zone)
    return df.select("lon", "lat", x.alias("x"), y.alias("y")).select("*", lon.alias("lon2"), lat.alias("lat2")).collect()


@pytest.mark.parametrize("zone", [R.ZONE_38, R.utm(31), R.utm(56, south=True)])
def test_there_and_back(spark, zone):
    rows = [(zone.meridian + a, b) for a in (-3.0, -1.1, 0.0, 0.4, 3.0) for b in (-80.0, -33.9, 0.0, 22.5, 60.0)]
    for r in planes(spark, rows, zone):
        assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9


def test_arcs_of_the_meridian(spark):
    """On the central meridian y is the arc's length, here summed by Gauss-Legendre."""
    z = R.ZONE_38
    e2 = z.flattening * (2 - z.flattening)
    at, w = np.polynomial.legendre.leggauss(64)
    for r in planes(spark, [(114.0, b) for b in (10.0, 36.0, 70.0)], z):
        f = math.radians(r.lat) * (at + 1) / 2
        arc = math.radians(r.lat) / 2 * float((w * z.axis * (1 - e2) / (1 - e2 * np.sin(f) ** 2) ** 1.5).sum())
        assert r.x == pytest.approx(38_500_000, abs=1e-6) and r.y == pytest.approx(arc, abs=1e-3)


def test_scale_is_equal_in_all_directions(spark):
    z, h = R.utm(31), 1e-5
    rows = planes(spark, [(4.0, 50.0), (4.0 + h, 50.0), (4.0, 50.0 + h)], z)
    e2 = z.flattening * (2 - z.flattening)
    s = math.sin(math.radians(50.0))
    east = math.radians(h) * z.axis / math.sqrt(1 - e2 * s * s) * math.cos(math.radians(50.0))
    north = math.radians(h) * z.axis * (1 - e2) / (1 - e2 * s * s) ** 1.5
    o, a, b = [(r.x, r.y) for r in rows]
    assert math.dist(o, a) / east == pytest.approx(math.dist(o, b) / north, rel=1e-5)
    assert (a[0] - o[0]) * (b[0] - o[0]) + (a[1] - o[1]) * (b[1] - o[1]) == pytest.approx(0, abs=1e-4)


def test_nulls_and_poles(spark):
    got = planes(spark, [(None, 1.0), (114.0, None), (114.0, 90.0)], R.ZONE_38)
    assert all(r.x is None and r.y is None for r in got)


def test_raster_by_loops(spark):
    px = {(r["row"], r["col"]): r.value for r in region_queries._degrees_raster(spark, DATA).collect()}
    out, left, top = spatial.reprojected(region_queries._degrees_raster(spark, DATA), 113.6, 36.2, 0.01, R.ZONE_38, 1000.0)
    got = {(r["row"], r["col"]): r.value for r in out.collect()}
    h, w = max(r for r, _ in px) + 1, max(c for _, c in px) + 1
    corners = planes(spark, [(113.6 + c * 0.01, 36.2 - r * 0.01) for r in (0, h) for c in (0, w)], R.ZONE_38)
    nx, ny = int((max(r.x for r in corners) - left) // 1000) + 2, int((top - min(r.y for r in corners)) // 1000) + 2
    spots = [(r, c) for r in range(ny) for c in range(nx)]
    df = spark.createDataFrame([(r, c, left + (c + 0.5) * 1000, top - (r + 0.5) * 1000) for r, c in spots], "r int, c int, x double, y double")
    lon, lat = R.to_degrees(F.col("x"), F.col("y"), R.ZONE_38)
    want = {}
    for p in df.select("r", "c", lon.alias("lon"), lat.alias("lat")).collect():
        x, y = (p.lon - 113.6) / 0.01 - 0.5, (36.2 - p.lat) / 0.01 - 0.5
        if not (-0.5 <= x <= w - 0.5 and -0.5 <= y <= h - 0.5):
            continue
        near = [(i, j, (1 - abs(y - i)) * (1 - abs(x - j))) for i in (math.floor(y), math.floor(y) + 1) for j in (math.floor(x), math.floor(x) + 1) if (i, j) in px]
        near = [(i, j, k) for i, j, k in near if k > 0]
        if near:
            want[p.r, p.c] = sum(px[i, j] * k for i, j, k in near) / sum(k for *_, k in near)
    assert got.keys() == want.keys() and len(got) > 100
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    none, *_ = spatial.reprojected(region_queries._degrees_raster(spark, DATA).limit(0), 0.0, 0.0, 1.0, R.ZONE_38, 1.0)
    assert none.count() == 0
