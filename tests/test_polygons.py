from __future__ import annotations

import math
import random

import pytest

from gridloom.operators import network, polygons, zones
from gridloom.operators.rasters import Grid


def inside(x, y, rings):
    """Parity of crossings of a ray along x over all rings."""
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def random_polygons(seed, n=25):
    """Round ones with holes, stars that cross themselves, slivers, and one that covers nearly everything."""
    rng, out = random.Random(seed), {}
    for k in range(n):
        x, y, size = rng.uniform(-5, 45), rng.uniform(-5, 35), rng.uniform(0.2, 9)
        turn = rng.choice((1, 2))
        ring = lambda s, m, t=1: [(x + s * rng.uniform(0.7, 1) * math.cos(2 * math.pi * t * i / m), y + s * rng.uniform(0.7, 1) * math.sin(2 * math.pi * t * i / m)) for i in range(m)]  # noqa: E731, B023
        out[k] = [ring(size, rng.choice((3, 5, 7, 40)), turn), *([ring(size / 3, 5)] if rng.random() < 0.5 else [])]
    out[n] = [[(1.0, 1.0), (2.0, 2.0)]]
    out[-1] = [[(-3.0, -3.0), (60.0, -3.0), (60.0, 60.0), (-3.0, 60.0), (-3.0, -3.0)], [(5.5, 5.5), (6.5, 5.5), (6.5, 6.5), (5.5, 6.5)]]
    return out


def frame(spark, shapes):
    rows = [(k, [{"x": x, "y": y} for x, y in ring]) for k, rings in shapes.items() for ring in rings]
    return spark.createDataFrame(rows, f"polygon long, points {network.POINTS}")


@pytest.mark.parametrize("seed", range(2))
def test_filled_cells_equal_a_test_of_each_centre(spark, seed):
    shapes = random_polygons(seed)
    found = {(r.r, r.c): r.polygon for r in polygons.rasterised(frame(spark, shapes), 30, 40).collect()}
    want = {}
    for k in sorted(shapes):
        want |= {(r, c): k for r in range(30) for c in range(40) if inside(c + 0.5, r + 0.5, shapes[k])}
    assert found == want


@pytest.mark.parametrize("slabs", [1, 64])
def test_points_in_polygons_equal_brute_force(spark, monkeypatch, slabs):
    monkeypatch.setattr(polygons, "SLABS", slabs)
    shapes, rng = random_polygons(7), random.Random(3)
    spots = [(i, rng.uniform(-6, 50), rng.uniform(-6, 40)) for i in range(300)] + [(900, shapes[0][0][0][0], shapes[0][0][0][1]), (901, 5.5, 5.5)]
    plan = polygons.in_polygons(spark.createDataFrame(spots, "id long, x double, y double"), frame(spark, shapes))
    assert {(r.id, r.polygon) for r in plan.collect()} == {(i, k) for i, x, y in spots for k, rings in shapes.items() if inside(x, y, rings)}


def test_nothing_to_fill_or_find(spark):
    none = frame(spark, {})
    assert polygons.rasterised(none, 5, 5).collect() == [] and polygons.in_polygons(spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double"), none).collect() == []


def test_hotspot_polygons(spark):
    grid = Grid(76.0, 11.8, 0.01, 0.01, 20, 30)
    blocks = {(r, c) for r in range(2, 9) for c in range(3, 12)} - {(5, 6)} | {(15, 20), (15, 21)}
    cells = spark.createDataFrame([(r, c, 5 if (r, c) in blocks else 2, r / 20 + c / 1000, 0.5, 1.2) for r in range(20) for c in range(30)], "r long, c long, class int, risk double, exposure double, area double")
    rings, spots = polygons.hotspot_polygons(cells, 5, grid, 0.0, 0.0)
    want = {r.component: r for r in zones.zonal_statistics(cells, zones.cell_components(cells.where("class = 5"), 30)).collect()}
    got = spots.collect()
    assert [r.hotspot_id for r in sorted(got, key=lambda r: -r.polygon_km2)] == [1, 2] and rings.count() == 3
    assert {r.component: (r.cells, round(r.mean_risk, 9), r.max_risk) for r in got} == {k: (r.cells, round(r.mean_risk, 9), r.max_risk) for k, r in want.items()}
    _, large = polygons.hotspot_polygons(cells, 5, grid, 3000.0, 5.0)
    assert [r.hotspot_id for r in large.collect()] == [1]
