"""Reprojection as column expressions: transverse Mercator of any zone and back, by series of the third flattening."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Zone(NamedTuple):
    """Central meridian in degrees, false easting and northing in metres, scale there, and the ellipsoid."""

    meridian: float
    easting: float
    northing: float = 0.0
    scale: float = 1.0
    axis: float = 6378137.0
    flattening: float = 1 / 298.257222101

    @property
    def n(self) -> float:
        return self.flattening / (2 - self.flattening)

    @property
    def radius(self) -> float:
        return self.axis / (1 + self.n) * (1 + self.n**2 / 4 + self.n**4 / 64)


#: Fixed value: the zone of the reference system 4526.
ZONE_38 = Zone(114.0, 38_500_000.0)


def utm(number: int, south: bool = False) -> Zone:
    return Zone(6.0 * number - 183, 500_000.0, 10_000_000.0 if south else 0.0, 0.9996, flattening=1 / 298.257223563)


def _forward(n: float) -> list[float]:
    return [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4]


def _back(n: float) -> list[float]:
    return [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4, 1 / 48 * n**2 + 1 / 15 * n**3 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4]


def _latitude(n: float) -> list[float]:
    return [2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4, 7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4, 56 / 15 * n**3 - 136 / 35 * n**4, 4279 / 630 * n**4]


def _series(terms: list[float], a: Column, b: Column) -> tuple[Column, Column]:
    """Sums of t sin(2ka) cosh(2kb) and t cos(2ka) sinh(2kb)."""
    one = sum((t * F.sin(2 * k * a) * F.cosh(2 * k * b) for k, t in enumerate(terms, 1)), F.lit(0.0))
    two = sum((t * F.cos(2 * k * a) * F.sinh(2 * k * b) for k, t in enumerate(terms, 1)), F.lit(0.0))
    return one, two


def to_plane(lon: Column, lat: Column, zone: Zone) -> tuple[Column, Column]:
    """x, y in metres of degrees. Null or a pole's latitude and beyond: null."""
    e = 2 * math.sqrt(zone.n) / (1 + zone.n)
    s = F.sin(F.radians(F.when(F.abs(lat) < 90, lat)))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    d = F.radians(lon - zone.meridian)
    a, b = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    one, two = _series(_forward(zone.n), a, b)
    return zone.easting + zone.scale * zone.radius * (b + two), zone.northing + zone.scale * zone.radius * (a + one)


def to_degrees(x: Column, y: Column, zone: Zone) -> tuple[Column, Column]:
    """lon, lat of metres in a zone."""
    a, b = (y - zone.northing) / (zone.scale * zone.radius), (x - zone.easting) / (zone.scale * zone.radius)
    one, two = _series(_back(zone.n), a, b)
    a, b = a - one, b - two
    c = F.asin(F.sin(a) / F.cosh(b))
    lat = c + sum((t * F.sin(2 * k * c) for k, t in enumerate(_latitude(zone.n), 1)), F.lit(0.0))
    return zone.meridian + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(lat)
