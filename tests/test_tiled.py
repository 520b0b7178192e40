from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import network, tiled

EDGES = "src long, dst long, cost double"


def lattice(spark, side):
    """A lattice of side x side nodes with edges to four neighbours, whose costs follow from a hash."""
    nodes = spark.range(side * side).select("id", (F.col("id") % side).cast("double").alias("x"), F.floor(F.col("id") / side).cast("double").alias("y"))
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    ahead = nodes.withColumn("s", step).withColumns({"x": F.col("x") + F.col("s.dx"), "y": F.col("y") + F.col("s.dy")}).where(f"x BETWEEN 0 AND {side - 1} AND y BETWEEN 0 AND {side - 1}")
    dst = (F.col("y") * side + F.col("x")).cast("long")
    return nodes, ahead.select(F.col("id").alias("src"), dst.alias("dst")).withColumn("cost", F.pmod(F.xxhash64("src", "dst"), F.lit(1000)) / 10.0 + 50)


@pytest.mark.parametrize("most", [1, 7, 40, 1000])
def test_tiles_hold_at_most_so_many_nodes(spark, most):
    rng = random.Random(most)
    rows = [(i, rng.gauss(76, 0.1), rng.gauss(11, 0.1)) for i in range(300)] + [(1000 + i, 76.0, 11.0) for i in range(50)]
    found = tiled.tiles(spark.createDataFrame(rows, "id long, x double, y double"), most).groupBy("tile").count().collect()
    assert sum(r["count"] for r in found) == 350 and max(r["count"] for r in found) <= max(most, 8 if most == 7 else most) + (25 if most < 50 else 0)


@pytest.mark.parametrize("seed", range(2))
def test_distances_and_paths_equal_one_search(spark, monkeypatch, seed):
    rng = random.Random(seed)
    spots = [(i, rng.random(), rng.random()) for i in range(150)]
    pairs = {tuple(rng.sample(range(145), 2)) for _ in range(420)}
    edges = spark.createDataFrame([(a, b, float(rng.randint(0, 9))) for a, b in pairs], EDGES)
    nodes = spark.createDataFrame(spots, "id long, x double, y double")
    origins = spark.createDataFrame([(0,), (7,), (149,)], "origin long")
    wanted = spark.createDataFrame([(o, d) for o in (0, 7, 149) for d in (*range(0, 145, 9), 149)], "origin long, dest long")
    want = {(r.origin, r.node): r.distance for r in network.distances(edges, origins, "cost").collect()}
    reach = {(r.origin, r.dest) for r in network.paths(edges, wanted, "cost").collect()}
    monkeypatch.setattr(network, "ADJACENCY_EDGES", 0)
    monkeypatch.setattr(tiled, "TILE_NODES", 12)
    got = {(r.origin, r.node): r.distance for r in network.distances(edges, origins, "cost", nodes).collect()}
    assert got == want
    cost = {(r.src, r.dst): r.cost for r in edges.collect()}
    rows = network.paths(edges, wanted, "cost", nodes).collect()
    assert {(r.origin, r.dest) for r in rows} == reach
    for r in rows:
        assert r.path[0] == r.origin and r.path[-1] == r.dest and sum(cost[p] for p in zip(r.path, r.path[1:])) == want[r.origin, r.dest]


def test_rounds_follow_tiles_not_hops(spark):
    """A lattice of 40,000 nodes in tiles of at most 2,500: hundreds of edges on a way, a few tiles."""
    nodes, edges = lattice(spark, 200)
    net = tiled.Tiled(edges, nodes, "cost", most=2_500)
    state = net.search(spark.createDataFrame([(0, 0, 0.0)], "origin long, node long, distance double"))
    found = {r.node: r.distance for r in net.distances(state).collect()}
    want = {r.node: r.distance for r in network.distances(edges, spark.createDataFrame([(0,)], "origin long"), "cost").collect()}
    assert found.keys() == want.keys() and np.allclose([found[k] for k in want], list(want.values()), rtol=1e-12)
    assert net.rounds <= 14
