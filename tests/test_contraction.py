from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.operators import components, contraction, network

SCHEMA = f"a long, b long, length double, risk double, rank int, points {network.POINTS}"


def one_by_one(edges):
    """Nodes of two edges go one by one: those of a round by their id, then those that there are after it."""
    graph = defaultdict(dict)
    for a, b, length, risk, rank, points in edges:
        graph[a][b] = graph[b][a] = (length, risk, rank, 1, a, points)
    while todo := sorted(n for n in graph if len(graph[n]) == 2):
        for n in todo:
            if len(graph[n]) != 2:
                continue
            a, b = sorted(graph[n])
            x, y = graph[n][a], graph[n][b]
            length = x[0] + y[0]
            first, second = (e[5] if e[4] == start else e[5][::-1] for e, start in ((x, a), (y, n)))
            new = (length, (x[0] * x[1] + y[0] * y[1]) / length, min(x[2], y[2]), x[3] + y[3], a, first + second[1:])
            del graph[n], graph[a][n], graph[b][n]
            if b not in graph[a] or graph[a][b][0] > length:
                graph[a][b] = graph[b][a] = new
    return sorted((a, b, e[0], round(e[1], 9), e[2], e[3], e[5] if e[4] == a else e[5][::-1]) for a, row in graph.items() for b, e in row.items() if a < b)


def lined(pairs, rng):
    """Edges with lengths (many of them equal) and lines of two or three points."""
    out = []
    for a, b in sorted(pairs):
        middle = [(a + b / 1000, float(b))] if rng.random() < 0.5 else []
        out.append((a, b, float(rng.randint(1, 4)), rng.randint(0, 9) / 10, rng.randint(0, 4), [(float(a), 0.0), *middle, (float(b), 0.0)]))
    return out


def contracted(spark, edges):
    rows = spark.createDataFrame([(*e[:5], [{"x": x, "y": y} for x, y in e[5]]) for e in edges], SCHEMA)
    return sorted((r.a, r.b, r.length, round(r.risk, 9), r["rank"], r.segments, [(p.x, p.y) for p in r.points]) for r in contraction.contract(rows).collect())


def chains(rng):
    """Junctions joined by several chains of random nodes, chains that return, rings, and dead ends."""
    ids = list(range(300))
    rng.shuffle(ids)
    hubs, pairs = [ids.pop() for _ in range(8)], set()
    for _ in range(22):
        a, b = rng.choice(hubs), rng.choice(hubs)
        way = [a, *(ids.pop() for _ in range(rng.randint(2 if a == b else 0, 5))), b]
        pairs |= {(min(p), max(p)) for p in zip(way, way[1:]) if p[0] != p[1]}
    for size in (3, 4, 7):
        ring = [ids.pop() for _ in range(size)]
        pairs |= {(min(p), max(p)) for p in zip(ring, ring[1:] + ring[:1])}
    return pairs


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("star", [False, True])
def test_contraction_equals_one_by_one(spark, monkeypatch, seed, star):
    if star:
        monkeypatch.setattr(components, "ONE_TASK_EDGES", 0)
        if seed > 1:
            pytest.skip("star steps take long")
    rng = random.Random(seed)
    edges = lined(chains(rng) if seed % 2 else {(min(p), max(p)) for p in (rng.sample(range(60), 2) for _ in range(75))}, rng)
    assert contracted(spark, edges) == one_by_one(edges)


def test_parallel_chains_and_loops(spark):
    line = lambda a, b: [(float(a), 0.0), (float(b), 0.0)]
    edges = [(1, 2, 100.0), (1, 5, 100.0), (5, 6, 100.0), (2, 6, 100.0), (1, 4, 10.0), (4, 8, 5.0), (8, 9, 5.0), (4, 9, 5.0), (1, 7, 7.0), (2, 3, 7.0), (2, 10, 7.0)]
    found = contracted(spark, [(a, b, n, 0.5, 1, line(a, b)) for a, b, n in edges])
    assert [f[:3] for f in found] == [(1, 2, 100.0), (1, 7, 7.0), (1, 9, 15.0), (2, 3, 7.0), (2, 10, 7.0)]


def test_a_pure_chain_is_one_edge(spark):
    edges = [(i, i + 1, 100.0, 0.5 if i < 2 else 0.1, 2, [(float(i), 0.0), (float(i + 1), 0.0)]) for i in range(4)]
    assert contracted(spark, edges) == [(0, 4, 400.0, 0.3, 2, 4, [(float(i), 0.0) for i in range(5)])]


def test_no_edges(spark):
    assert contraction.contract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_web_graph_of_the_largest_component(spark):
    edges = [(10, 20, 40.4, 0.5, 0, [(76.0, 11.0), (76.1, 11.00001), (76.2, 11.0)]), (20, 30, 1.6, 2.0, 2, [(76.2, 11.0), (76.3, 11.5)]), (20, 40, 1.0, -1.0, 3, [(76.2, 11.0), (76.2, 11.1)]), (1, 2, 9.0, 0.0, 0, [(1.0, 1.0), (2.0, 2.0)])]
    rows = spark.createDataFrame([(*e[:5], [{"x": x, "y": y} for x, y in e[5]]) for e in edges], SCHEMA)
    nodes, found = contraction.web_graph(rows, 0.001)
    assert sorted(map(tuple, nodes.collect())) == [(0, 10), (1, 20), (2, 30), (3, 40)]
    got = [(r.edge, r.u, r.v, r.length, r.risk, r["class"], [tuple(p) for p in r.points]) for r in found.orderBy("edge").collect()]
    assert got == [(0, 0, 1, 40, 127, 0, [(7600000, 1100000), (7620000, 1100000)]), (1, 1, 2, 2, 254, 1, [(7620000, 1100000), (7630000, 1150000)]), (2, 1, 3, 1, 0, 2, [(7620000, 1100000), (7620000, 1110000)])]
