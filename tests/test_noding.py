from __future__ import annotations

import math
import random

import pytest

from gridloom.operators import network, noding, roads


def brute(segments):
    """Pieces of segments (a, b) by looking at all pairs again and again until none meets another inside."""
    now = {(min(s), max(s)) for s in segments if s[0] != s[1]}
    while True:
        cuts = {s: {*s} for s in now}
        rows = sorted(now)
        for i, (a, b) in enumerate(rows):
            for c, d in rows[i + 1 :]:
                dx, dy, ex, ey, cx, cy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1], c[0] - a[0], c[1] - a[1]
                den, t, u = dx * ey - dy * ex, cx * ey - cy * ex, cx * dy - cy * dx
                if den == 0 and u == 0:
                    cuts[a, b] |= {p for p in (c, d) if a < p < b}
                    cuts[c, d] |= {p for p in (a, b) if c < p < d}
                elif den and 0 <= t / den <= 1 and 0 <= u / den <= 1:
                    p = a if t == 0 else b if t == den else c if u == 0 else d if u == den else (a[0] + math.floor(t / den * dx + 0.5), a[1] + math.floor(t / den * dy + 0.5))
                    cuts[a, b] |= {p} if a < p < b else set()
                    cuts[c, d] |= {p} if c < p < d else set()
        new = set()
        for (a, b), stops in cuts.items():
            way = sorted(stops, key=lambda p: ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]), p))
            new |= {(min(p, q), max(p, q)) for p, q in zip(way, way[1:]) if p != q}
        if new == now:
            return now
        now = new


def lines(spark, segments):
    rows = [([{"x": x / noding.SCALE, "y": y / noding.SCALE} for x, y in s],) for s in segments]
    return spark.createDataFrame(rows, f"points {network.POINTS}")


@pytest.mark.parametrize(("seed", "cell", "dense"), [(1, None, 2_000), (2, 7, 2_000), (3, 50, 3)])
def test_noding_equals_all_pairs(spark, monkeypatch, seed, cell, dense):
    monkeypatch.setattr(noding, "DENSE", dense)
    rng = random.Random(seed)
    spot = lambda: (rng.randint(-60, 60), rng.randint(-60, 60))
    segments = [(spot(), spot()) for _ in range(25)] + [((0, 0), (40, 0)), ((10, 0), (60, 0)), ((40, 0), (10, 0)), ((20, -5), (20, 5)), ((20, 5), (20, 30)), ((5, 5), (5, 5)), ((-9, -9), (-9, 50)), ((-9, 0), (-9, 20))]
    found = {((r.ax, r.ay), (r.bx, r.by)) for r in noding.noded(noding.segments(lines(spark, segments)), cell).collect()}
    assert found == brute(segments)


def test_crossing_roads_without_shared_nodes_are_merged_between_crossings(spark):
    way = lambda *xy: [{"x": 76 + x / 1000, "y": 11 + y / 1000} for x, y in xy]
    edges = spark.createDataFrame([(1, 2, way((0, 0), (10, 0))), (2, 1, way((10, 0), (0, 0))), (3, 4, way((5, -5), (5, 5))), (5, 6, way((8, 0), (20, 0))), (6, 7, way((20, 0), (30, 10)))], f"src long, dst long, points {network.POINTS}")
    found = sorted([(round((p.x - 76) * 1000), round((p.y - 11) * 1000)) for p in r.points] for r in roads.noded_lines(edges).collect())
    assert sorted(map(sorted, found)) == sorted(map(sorted, [[(0, 0), (5, 0)], [(5, -5), (5, 0)], [(5, 0), (5, 5)], [(5, 0), (8, 0), (10, 0), (20, 0), (30, 10)]]))


def test_no_lines(spark):
    assert noding.noded(noding.segments(spark.createDataFrame([], f"points {network.POINTS}"))).collect() == []
