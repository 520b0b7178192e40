"""Distances, areas and geometry tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth's radius in metres, and kilometres in a degree along a parallel at the equator and along a meridian (fixed values).
EARTH_M, KM_LON, KM_LAT = 6_371_000.0, 111.32, 110.57


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_M)


def planar_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the plane that touches at the mean latitude."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)) * (KM_LON * 1000)
    dy = (lat2 - lat1) * (KM_LAT * 1000)
    return F.sqrt(dx * dx + dy * dy)


def cell_area_km2(row: Column, north: float, step_lon: float, step_lat: float) -> Column:
    """Area of a cell of the row whose centre latitude follows from the north edge."""
    return F.cos(F.radians(F.lit(north) - (row + 0.5) * step_lat)) * (step_lon * KM_LON * step_lat * KM_LAT)


def cell_centre(index: Column, origin: float, step: float) -> Column:
    """Coordinate of a cell's centre."""
    return F.lit(origin) + (index + 0.5) * step


def cell_index(coordinate: Column, origin: float, step: float) -> Column:
    """Index of the cell that holds a coordinate."""
    return F.floor((coordinate - F.lit(origin)) / step).cast("long")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring, by the parity of crossings of a ray along x."""
    crosses = F.zip_with(
        ring, F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1)), lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"])
    )
    return F.aggregate(crosses, F.lit(False), lambda odd, hit: odd != F.coalesce(hit, F.lit(False)))


def ring_area_km2(ring: Column) -> Column:
    """Area of a lon/lat ring: shoelace degrees scaled at the latitude of the ring's centroid (of its vertices' mean where it has no area)."""
    closed = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, closed, lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("w"), (a["y"] + b["y"]).alias("y")))
    twice = F.aggregate(crosses, F.lit(0.0), lambda s, v: s + v["w"])
    moment = F.aggregate(crosses, F.lit(0.0), lambda s, v: s + v["w"] * v["y"])
    mean = F.aggregate(F.transform(ring, lambda p: p["y"]), F.lit(0.0), lambda s, v: s + v) / F.size(ring)
    return F.abs(twice) / 2 * (KM_LON * KM_LON) * F.cos(F.radians(F.coalesce(F.try_divide(moment, twice * 3), mean)))


def points_between(points: Column, metres: bool = True) -> Column:
    """Lengths of a polyline's segments (array of struct x, y): metres on lon and lat, or plane units."""
    ahead = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))

    def one(a: Column, b: Column) -> Column:
        return planar_m(a["x"], a["y"], b["x"], b["y"]) if metres else F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))

    return F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), ahead, one)


def summed(values: Column) -> Column:
    """The sum of an array of doubles; 0 for none."""
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def point_along(points: Column, part: Column) -> Column:
    """The point (struct x, y) at a part (0 to 1) of a polyline's plane length, both ends included."""
    lengths = points_between(points, metres=False)
    goal = part * summed(lengths)
    start = F.struct(F.lit(0.0).alias("done"), F.lit(0).alias("i"), F.lit(True).alias("going"))
    last = F.size(lengths) - 1
    at = F.aggregate(lengths, start, lambda s, v: F.when(s["going"] & (s["i"] < last) & (s["done"] + v < goal), F.struct((s["done"] + v).alias("done"), (s["i"] + 1).alias("i"), F.lit(True).alias("going"))).otherwise(F.struct(s["done"], s["i"], F.lit(False).alias("going"))))
    a, b = F.get(points, at["i"]), F.get(points, at["i"] + 1)
    t = F.coalesce(F.least(F.try_divide(goal - at["done"], F.get(lengths, at["i"])), F.lit(1.0)), F.lit(0.0))
    return F.when(F.size(points) < 2, F.get(points, F.lit(0))).otherwise(F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y")))


def band(lat: Column, metres: float) -> Column:
    """Number of the latitude band, ``metres`` high, that holds a latitude."""
    return F.floor(lat * (KM_LAT * 1000) / metres).cast("long")


def band_width(row: Column, metres: float) -> Column:
    """Degrees of longitude that are at least ``metres`` wide anywhere in a band or in those beside it."""
    farthest = F.least(F.greatest(F.abs(row - 1), F.abs(row + 2)) * (metres / (KM_LAT * 1000)), F.lit(89.0))
    return F.lit(metres / 110_000) / F.cos(F.radians(farthest))  # a degree has more metres than that, on the plane and on the sphere


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Distance of a point to a segment, and the part of the segment (0 to 1) where it is nearest."""
    length2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.coalesce(F.greatest(F.least(F.try_divide((px - ax) * (bx - ax) + (py - ay) * (by - ay), length2), F.lit(1.0)), F.lit(0.0)), F.lit(0.0))
    dx, dy = px - (ax + t * (bx - ax)), py - (ay + t * (by - ay))
    return F.sqrt(dx * dx + dy * dy), t
