"""Work that follows what is different in the tables, not the product of their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import components, contraction, network, polygons, roads, search, skew


def test_equal_texts_and_frequent_letters_are_looked_up_once(spark):
    names = spark.createDataFrame([(i, f"Supplier#{i:09d}", i % 4 == 0, float(i), 11.0) for i in range(1000)], "id long, name string, is_place boolean, x double, y double")
    asked = [(i, "SUPPLIER  077") for i in range(300)] + [(1000 + i, f"supplier 000{i:03d}") for i in range(0, 1000, 25)] + [(5000, "no such"), (5001, "x"), (5002, None), (5003, "12, 75.5"), (5004, "Supplier\t#000000077")]
    texts = spark.createDataFrame(asked, "id long, text string")
    got = {r.id: (r.x, r.label) for r in search.resolved(texts, names).collect()}

    def best(words):
        fits = [((2 - 0.6 * (i % 4 == 0)), i) for i in range(1000) if all(w in f"supplier#{i:09d}" for w in words)]
        return (float(min(fits)[1]), f"Supplier#{min(fits)[1]:09d}") if fits else (None, None)

    assert len(got) == len(asked)
    assert all(got[i] == best((text or "?").lower().split()) for i, text in asked if i not in (5001, 5003)) and got[5001] == (None, None) and got[5003][0] == 75.5
    held = names.select(F.col("id").alias("name_id"), F.lower("name").alias("n")).withColumn("gram", F.explode(F.expr("transform(sequence(1, length(n)), i -> substr(n, i, 3))"))).distinct()
    assert search._candidates(spark.createDataFrame([("supplier 077",)] * 300, "q string"), held).count() < 20


def _crossing(spark):
    """Segments of a small cross, and queries of which most are repeated."""
    spots = {0: (76.0, 11.5), 1: (76.01, 11.5), 2: (76.02, 11.5), 3: (76.01, 11.51), 4: (76.01, 11.49)}
    links = [(0, 1), (1, 2), (1, 3), (1, 4)]
    rows = [(k, a, b, 1000.0 + k, 0.1 * k, [{"x": spots[n][0], "y": spots[n][1]} for n in (a, b)]) for k, (a, b) in enumerate(links)]
    segments = spark.createDataFrame(rows, f"edge long, a long, b long, length double, risk double, points {network.POINTS}")
    asked = [(76.0, 11.5, 76.02, 11.5), (76.0001, 11.5, 76.02, 11.5), (76.01, 11.51, 76.0, 11.5), (77.0, 12.0, 76.0, 11.5), (76.0, 11.5, 76.0, 11.5)]
    queries = spark.createDataFrame([(i, *asked[i % 5]) for i in range(100)], "id long, ax double, ay double, bx double, by double")
    return segments, queries


def test_categories_along_equal_ways(spark):
    segments, queries = _crossing(spark)
    places = spark.createDataFrame([(i, 76.0 + 0.004 * (i % 6), 11.5 + 0.003 * (i % 4), "ab"[i % 2]) for i in range(240)], "id long, x double, y double, category string")
    different = search.one_each(queries)
    assert {r.id for r in different.collect()} == {0, 1, 2, 3, 4}
    got = search.for_all(search.categories_along(search.search(different, segments, 3.0), segments, places, 1000.0), different, queries, "query").collect()
    want = search.category_hits(search.along(search.search(queries, segments, 3.0), segments, places, 1000.0)).collect()
    assert {(r.query, r.category, r.n) for r in got} == {(r.query, r.category, r.n) for r in want} and len(got) == len(want) > 100


def test_nearest_places_of_equal_spots(spark):
    places = spark.createDataFrame([(i, 76.0 + 0.01 * (i % 5), 11.5 + 0.01 * (i % 3)) for i in range(60)], "id long, x double, y double")
    points = spark.createDataFrame([(i, 76.003 + 0.01 * (i % 4), 11.5) for i in range(200)] + [(900, 80.0, 14.0), (901, None, 11.5)], "id long, x double, y double")
    spots = network.nearest_spots(points, places, 2000.0, "place").collect()
    assert len(spots) == 4
    got = {r.id: r for r in network.nearest(points, places, 2000.0, "place").collect()}
    assert len(got) == 202 and got[900].place is None and got[901].place is None
    assert all(got[i].place == min(p for p in range(60) if p % 5 == i % 4 and p % 3 == 0) for i in range(200))
    anywhere = {r.id: r for r in network.nearest_any(points, places, "place", 500.0).collect()}
    assert len(anywhere) == 202 and anywhere[900].place == min(p for p in range(60) if p % 5 == 4 and p % 3 == 2) and anywhere[901].place is None


def test_snapping_of_equal_spots(spark, monkeypatch):
    segments, queries = _crossing(spark)
    seen = []
    real = network.nearest_spots
    monkeypatch.setattr(network, "nearest_spots", lambda *a: seen.append(real(*a)) or seen[-1])
    points = queries.select("id", F.col("ax").alias("x"), F.col("ay").alias("y"))
    got = {r.id: r for r in search.snap(points, segments).collect()}
    assert seen[0].count() == 3 and len(got) == 100 and got[3].edge is None and got[98].edge is None
    assert all((got[i].edge, got[i].v, got[i].to_a) == (0, 0, 0.0) for i in range(100) if i % 5 in (0, 1, 4)) and all((got[i].edge, got[i].v) == (2, 1) for i in range(2, 100, 5))


def test_points_of_one_spot_in_equal_polygons(spark, monkeypatch):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rows = [(i, [{"x": x + 3.0 * (i % 2), "y": y} for x, y in square]) for i in range(40)] + [(i, [{"x": 1.0 + x / 4, "y": 1.0 + y / 4} for x, y in square]) for i in range(0, 40, 4)]
    rings = spark.createDataFrame(rows, f"polygon long, points {network.POINTS}")
    points = spark.createDataFrame([(i, (1.5, 3.5, 9.0)[i % 3], 1.5) for i in range(60)], "id long, x double, y double")
    seen = []
    real = polygons._spots_in
    monkeypatch.setattr(polygons, "_spots_in", lambda *a: seen.append(real(*a)) or seen[-1])
    got = polygons.in_polygons(points, rings).collect()
    want = {(i, p) for i in range(60) for p in range(40) if (i % 3 == 0 and p % 2 == 0 and p % 4) or i % 3 == 1}
    assert len(got) == len(want) and {(r.id, r.polygon) for r in got} == want and seen[0].count() == 4
    assert {(r.polygon, r["shape"]) for r in polygons.same_shapes(rings).collect()} == {(p, 1 if p % 2 else 0 if p % 4 == 0 else 2) for p in range(40)}


def test_roads_that_join_no_other_one_are_lines_as_they_are(spark, monkeypatch):
    """Only pieces that join others go through Python, and no line is a group of its own there."""
    at = lambda i: (float(i), 0.5 * (i % 3))
    star = [(0, i, 10.0 + i, 0.25) if i % 2 else (i, 0, 10.0 + i, 0.25) for i in range(1, 300)]
    others = [(1, 1, 7.0, 0.5), (400, 401, 3.0, 0.1), (402, 401, 1.0, 0.5), (402, 403, 2.0, None), (500, 500, 4.0, 0.5), (2, 600, None, 0.5), (602, 600, 6.0, 0.75), (2, 602, 2.0, 0.25), (700, 701, 0.0, 0.5)]
    edges = spark.createDataFrame([(a, b, n, r, [at(a), at(b)]) for a, b, n, r in star + others], f"src long, dst long, length double, risk double, points {network.POINTS}")
    got = {r.line: ([tuple(p) for p in r.points], r.length, None if r.risk is None else round(r.risk, 9), r.pieces) for r in roads.merged_lines(edges).collect()}
    want = {f"e-0-{i}": ([at(0), at(i)], 10.0 + i, 0.25, 1) for i in range(1, 300)}
    want |= {"e-1-1": ([at(1), at(1)], 7.0, 0.5, 1), "e-700-701": ([at(700), at(701)], 0.0, 0.0, 1), "c500": ([at(500), at(500)], 4.0, 0.5, 1)}
    want |= {"c401": ([at(400), at(401), at(402), at(403)], 6.0, round(0.8 / 6, 9), 3), "c600": ([at(2), at(600), at(602), at(2)], 8.0, 0.625, 3)}
    assert got == want
    monkeypatch.setattr(roads, "_joined", lambda batches: (b.slice(0, 0) for b in batches if False))
    assert {r.line for r in roads.merged_lines(edges).collect()} == {k for k in want if k.startswith("e")}


def test_tables_that_grow_are_not_sent_through_the_driver(spark, monkeypatch):
    """Of the joins of a web graph only the component's row and the offsets of ranges are broadcast, of those of merged roads none, however small the tables are."""
    plans = []
    real = contraction.written

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return real(df, name)

    for module in (components, contraction, roads, skew):
        monkeypatch.setattr(module, "written", seen)
    monkeypatch.setattr(components, "ONE_TASK_EDGES", 0)
    pairs = [(i, i + 1) for i in range(12)] + [(0, 20), (0, 21), (12, 22), (12, 23), (30, 31)]
    rows = [(a, b, 1.0 + a, 0.5, 1, [(float(a), 0.0), (float(b), 1.0)]) for a, b in pairs]
    edges = spark.createDataFrame(rows, f"a long, b long, length double, risk double, rank int, points {network.POINTS}")
    nodes, found = contraction.web_graph(contraction.contract(edges), 0.0)
    assert sorted((r.u, r.v, r.length) for r in found.collect()) == [(0, 1, 78), (0, 2, 1), (0, 3, 1), (1, 4, 13), (1, 5, 13)]
    merged = roads.merged_lines(edges.withColumnsRenamed({"a": "src", "b": "dst"}))
    plans.append(("lines", merged._jdf.queryExecution().sparkPlan().toString()))
    assert merged.count() == 6
    joins = [(name, plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")) for name, plan in plans]
    assert {(n, b) for n, b, _ in joins if b} == {("web-edges", 1), ("web-nodes", 1)}
    assert {n for n, _, m in joins if m} == {"components", "contract-marked", "contract", "road-marked", "lines", "web-edges", "numbered"}
