from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import projections


def placed(spark, rows, plane):
    x, y = plane.forward(F.col("lon"), F.col("lat"))
    moved = spark.createDataFrame(rows, "lon double, lat double").select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = plane.inverse(F.col("x"), F.col("y"))
    return moved.select("*", lon.alias("lon2"), lat.alias("lat2")).collect()


def test_published_places(spark):
    """On the central meridian northings are 0.9996 of the meridian's length: a quadrant has 10,001,965.7293 m, its half to 45 degrees 4,984,944.3780 m."""
    found = placed(spark, [(75.0, 0.0), (75.0, 45.0), (75.0, 89.999999999)], projections.zone(43))
    assert [(round(r.x, 4), round(r.y, 3)) for r in found] == [(500000.0, 0.0), (500000.0, round(4984944.3780 * 0.9996, 3)), (500000.0, round(10001965.7293 * 0.9996, 3))]
    tower = placed(spark, [(-79.387139, 43.642567)], projections.zone(17))[0]  # a tower in Toronto, published as 17N 630084 4833438 in whole metres
    assert abs(tower.x - 630084) < 1 and abs(tower.y - 4833438) < 1


@pytest.mark.parametrize("north", [True, False])
def test_there_and_back_is_below_a_millimetre(spark, north):
    rng = random.Random(1)
    rows = [(75 + rng.uniform(-3.5, 3.5), rng.uniform(0, 84) if north else rng.uniform(-80, 0)) for _ in range(300)]
    assert all(abs(r.lon - r.lon2) < 5e-9 and abs(r.lat - r.lat2) < 5e-9 for r in placed(spark, rows, projections.zone(43, north)))


def test_area_on_the_plane(spark):
    """A square of 0.01 degrees at the equator has 1.11319 km by 1.10574 km, on the meridian's scale twice 0.9996."""
    ring = F.array(*[F.struct(F.lit(75 + x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (0.01, 0.0), (0.01, 0.01), (0.0, 0.01))])
    area = spark.range(1).select(projections.plane_area_km2(ring, projections.zone(43)).alias("a")).first().a
    assert area == pytest.approx(1.1131949 * 1.1057427 * 0.9996**2, rel=1e-5)
