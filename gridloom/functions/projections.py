"""Transverse Mercator as column expressions: Krueger's series in the third flattening, forward and inverse (Karney 2011), to its fourth power."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid of WGS 84: equatorial radius in metres and flattening (fixed values).
RADIUS, FLATTENING = 6_378_137.0, 1 / 298.257223563
_N = FLATTENING / (2 - FLATTENING)
#: Coefficients of the series in n, n^2, n^3 and n^4: to the plane, back from it, and from conformal to geodetic latitude (fixed values).
_FORWARD = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
_BACK = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
_LATITUDE = ((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))


def series(table: tuple[tuple[float, ...], ...]) -> list[float]:
    """The coefficients of a table at the ellipsoid's third flattening."""
    return [sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in table]


@dataclass(frozen=True)
class TransverseMercator:
    """A zone: central meridian in degrees, scale on it, and false easting and northing in metres."""

    meridian: float
    scale: float = 0.9996
    easting: float = 500_000.0
    northing: float = 0.0

    @property
    def unit(self) -> float:
        """Metres on the plane of one radian of rectifying latitude."""
        return self.scale * RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Easting and northing in metres of degrees; below a millimetre off within 3,000 km of the meridian."""
        k = 2 * math.sqrt(_N) / (1 + _N)
        s, east = F.sin(F.radians(lat)), F.radians(lon - self.meridian)
        t = F.sinh(F.atanh(s) - F.atanh(s * k) * k)
        xi, eta = F.atan2(t, F.cos(east)), F.asinh(F.sin(east) / F.sqrt(t * t + F.cos(east) * F.cos(east)))
        x, y = eta, xi
        for j, a in enumerate(series(_FORWARD), 1):
            x = x + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
            y = y + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
        return x * self.unit + self.easting, y * self.unit + self.northing

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude in degrees of metres."""
        eta, xi = (x - self.easting) / self.unit, (y - self.northing) / self.unit
        u, v = eta, xi
        for j, b in enumerate(series(_BACK), 1):
            u = u - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b
            v = v - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b
        chi = F.asin(F.sin(v) / F.cosh(u))
        lat = chi
        for j, d in enumerate(series(_LATITUDE), 1):
            lat = lat + F.sin(chi * (2 * j)) * d
        return F.degrees(F.atan2(F.sinh(u), F.cos(v))) + self.meridian, F.degrees(lat)


def zone(number: int, north: bool = True) -> TransverseMercator:
    """The universal zone of a number from 1 to 60."""
    return TransverseMercator(number * 6 - 183.0, northing=0.0 if north else 10_000_000.0)


def projected_ring(ring: Column, plane: TransverseMercator) -> Column:
    """A lon/lat ring in metres of a plane."""

    def moved(p: Column) -> Column:
        x, y = plane.forward(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, moved)


def plane_area_km2(ring: Column, plane: TransverseMercator) -> Column:
    """Area of a lon/lat ring on the plane: the shoelace sum of its projected corners, taken from the first one so that no digits are lost."""
    own = projected_ring(ring, plane)
    first = F.get(own, F.lit(0))
    near = F.transform(own, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))
    closed = F.concat(F.slice(near, 2, F.size(near)), F.slice(near, 1, 1))
    return F.abs(F.aggregate(F.zip_with(near, closed, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)) / 2e6
