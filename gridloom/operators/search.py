"""Point-to-point search on an undirected road graph: snapping to vertices, partial first and last segments, both objectives, corridors.

Road segments are rows ``edge``, ``a``, ``b`` (end nodes), ``length`` (metres), ``risk`` (mean) and ``points`` (lon x, lat y, from a to b).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import constants as K
from gridloom.functions.geo import planar_m, points_between, summed
from gridloom.operators import network, tiled
from gridloom.operators.skew import join_to_unique
from gridloom.session import written

#: Queries that one search serves; an end of more has several searches.
SLICE_QUERIES = 500
_FOUND = "id long, length double, mean_risk double, max_risk double, nodes array<long>, edges array<long>"


def snap(points: DataFrame, roads: DataFrame, limit: float = K.SNAP_LIMIT_M) -> DataFrame:
    """``points`` (``id``, ``x``, ``y``) with the nearest road vertex within the limit: ``edge``, ``v`` (from 0), ``distance``, and the metres ``to_a`` and ``to_b`` from it to the segment's ends; nulls if none.

    Offsets are the polyline's own, scaled to the segment's length. Ties go to the smaller segment, then vertex.
    """
    spots = roads.select("edge", F.posexplode("points").alias("v", "p")).select(F.struct("edge", "v").alias("id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    found = network.nearest_spots(points, spots, limit, "spot").select("x", "y", "spot.edge", "spot.v", "distance")
    lengths = points_between(F.col("points"))
    whole, upto = summed(lengths), summed(F.slice(lengths, F.lit(1), F.col("v")))
    scale = F.when(whole > 0, F.col("length") / whole).otherwise(1.0)
    placed = found.join(roads, "edge").select("x", "y", "edge", "v", "distance", "a", "b", F.col("length").alias("edge_length"), F.col("risk").alias("edge_risk"), (upto * scale).alias("to_a"), ((whole - upto) * scale).alias("to_b"))
    return points.select("id", "x", "y").join(written(placed, "snapped"), ["x", "y"], "left").drop("x", "y")


def _ends(queries: DataFrame, roads: DataFrame, limit: float) -> DataFrame:
    """Queries (``id``, ``ax``, ``ay``, ``bx``, ``by``) with both ends snapped, as structs ``s`` and ``t``."""
    first = snap(queries.select("id", F.col("ax").alias("x"), F.col("ay").alias("y")), roads, limit)
    last = snap(queries.select("id", F.col("bx").alias("x"), F.col("by").alias("y")), roads, limit)
    columns = [c for c in first.columns if c != "id"]
    return first.select("id", F.struct(*columns).alias("s")).join(last.select("id", F.struct(*columns).alias("t")), "id")


def _summary(parts: list[tuple[float, float]]) -> tuple[float, float, float]:
    """Length, mean risk by length, and the greatest mean risk of an edge of which some length is used."""
    length = sum(n for n, _ in parts)
    return length, sum(n * r for n, r in parts) / length if length > 0 else 0.0, max((r for n, r in parts if n > 0), default=0.0)


def _dealt(far: DataFrame) -> DataFrame:
    """``far`` with ``slice``: the queries of one end are dealt to as many slices as hold about SLICE_QUERIES each, so an end that most queries share has many tasks."""
    keyed = written(far.withColumn("end", F.concat_ws(":", "t.edge", "t.v")), "search-far")
    slices = keyed.groupBy("end").agg(F.ceil(F.count("*") / SLICE_QUERIES).cast("int").alias("slices"))
    return join_to_unique(keyed, slices, "end").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices"))).drop("slices")


def _searched(far: DataFrame, roads: DataFrame, alpha: float) -> DataFrame:
    """Least-cost ways between snapped ends on different segments over the packed graph.

    The graph is the same in both directions: one search runs backwards from each different end until the starts of all its queries are settled, and each
    query takes the better of its two nodes from it.
    """
    both = roads.select(F.col("a").alias("src"), F.col("b").alias("dst"), "edge", "length", "risk").unionByName(roads.select(F.col("b").alias("src"), F.col("a").alias("dst"), "edge", "length", "risk"))
    links = both.withColumn("cost", F.col("length") * (1 + F.col("risk") * alpha))
    shared = roads.sparkSession.sparkContext.broadcast(network.Adjacency(links, ["cost", "length", "risk", "edge"]))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own, out = shared.value, []
        _, lengths, risks, numbers = own.weights
        cost = lambda risk, metres: metres * (1 + alpha * risk)
        t = next(frame.itertuples(index=False))
        ends: dict[int, float] = {}
        for node, metres in ((t.t_a, t.t_to_a), (t.t_b, t.t_to_b)):
            at = own.place(node)
            ends[at] = min(ends.get(at, float("inf")), cost(t.t_risk, metres))
        starts = [[(own.place(q.s_a), q.s_to_a), (own.place(q.s_b), q.s_to_b)] for q in frame.itertuples(index=False)]
        best = own.search(ends, goals={p for pair in starts for p, _ in pair})
        for q, pair in zip(frame.itertuples(index=False), starts, strict=True):
            reached = [(best[p][0] + cost(q.s_risk, metres), k) for k, (p, metres) in enumerate(pair) if p in best]
            if not reached:
                continue
            place, first = pair[min(reached)[1]]
            places, taken = own.walk(best, place)
            places, taken = places[::-1], taken[::-1]
            last = min(metres for node, metres in ((t.t_a, t.t_to_a), (t.t_b, t.t_to_b)) if own.place(node) == places[-1])
            parts = [(first, q.s_risk), *((float(lengths[e]), float(risks[e])) for e in taken), (last, t.t_risk)]
            out.append((q.id, *_summary(parts), own.ids[places].tolist(), [int(numbers[e]) for e in taken]))
        return pd.DataFrame(out, columns=["id", "length", "mean_risk", "max_risk", "nodes", "edges"])

    flat = _dealt(far).select("id", "end", "slice", *[F.col(f"{s}.{c}").alias(f"{s}_{n}") for s in "st" for c, n in (("a", "a"), ("b", "b"), ("to_a", "to_a"), ("to_b", "to_b"), ("edge_risk", "risk"))])
    return flat.groupBy("end", "slice").applyInPandas(run, _FOUND)


def _tiled(far: DataFrame, roads: DataFrame, alpha: float) -> DataFrame:
    """_searched() for graphs beyond the checked size, cut by tiles: one search from each different end, whose ways to the starts are walked back tile by tile."""
    both = roads.select(F.col("a").alias("src"), F.col("b").alias("dst"), "edge", "length", "risk").unionByName(roads.select(F.col("b").alias("src"), F.col("a").alias("dst"), "edge", "length", "risk"))
    links = written(network.best_edges(both.withColumn("cost", F.col("length") * (1 + F.col("risk") * alpha)), "cost"), "search-links")
    at = lambda node, k: F.struct(F.col(node).alias("id"), F.element_at("points", k)["x"].alias("x"), F.element_at("points", k)["y"].alias("y"))
    nodes = roads.select(F.inline(F.array(at("a", 1), at("b", -1)))).groupBy("id").agg(F.min(F.struct("x", "y")).alias("p")).select("id", "p.*")
    net = tiled.Tiled(links.select("src", "dst", "cost"), nodes, "cost")
    cost = lambda s, n: F.col(f"{s}.{n}") * (1 + F.col(f"{s}.edge_risk") * alpha)
    ends = lambda s: F.inline(F.array(*[F.struct(F.col(f"{s}.{n}").alias("node"), cost(s, f"to_{n}").alias("c"), F.col(f"{s}.to_{n}").alias("metres")) for n in "ab"]))
    keyed = written(far.withColumn("end", F.concat_ws(":", "t.edge", "t.v")), "search-far")
    last = keyed.groupBy("end").agg(F.first("t").alias("t")).select("end", ends("t"))
    state = net.search(last.select(F.col("end").alias("origin"), "node", F.col("c").alias("distance")))
    starts = keyed.select("id", F.col("end").alias("origin"), ends("s"))
    tree = net.distances(state).join(starts.select("origin", "node").distinct(), ["origin", "node"])
    exits = written(starts.join(tree, ["origin", "node"]).groupBy("id", "origin").agg(F.min(F.struct((F.col("distance") + F.col("c")).alias("d"), F.col("node"), F.col("metres"))).alias("m")), "search-exits")
    ways = net.paths(state, exits.select("origin", F.col("m.node").alias("dest")))
    walked = written(exits.select("id", "origin", F.col("m.node").alias("dest"), F.col("m.metres").alias("first")).join(ways, ["origin", "dest"]).withColumn("path", F.reverse("path")), "search-walked")
    lasts = last.groupBy("end", "node").agg(F.min("metres").alias("last")).select(F.col("end").alias("origin"), F.col("node").alias("goal"), "last")
    steps = network.path_steps(walked.select(F.col("id").alias("origin"), "dest", "path"), links, "cost").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("step", "edge", "length", "risk"))).alias("taken")).withColumnRenamed("origin", "id")
    whole = walked.withColumn("goal", F.element_at("path", -1)).join(lasts, ["origin", "goal"]).join(steps, "id", "left").join(far.select("id", "s", "t"), "id")
    part = lambda n, r: F.struct(n.alias("n"), r.alias("r"))
    middle = F.transform(F.coalesce("taken", F.array().cast("array<struct<step: int, edge: long, length: double, risk: double>>")), lambda x: part(x["length"], x["risk"]))
    parts = F.concat(F.array(part(F.col("first"), F.col("s.edge_risk"))), middle, F.array(part(F.col("last"), F.col("t.edge_risk"))))
    length = summed(F.transform(parts, lambda p: p["n"]))
    mean = F.coalesce(F.try_divide(summed(F.transform(parts, lambda p: p["n"] * p["r"])), length), F.lit(0.0))
    top = F.coalesce(F.array_max(F.transform(F.filter(parts, lambda p: p["n"] > 0), lambda p: p["r"])), F.lit(0.0))
    return whole.select("id", length.alias("length"), mean.alias("mean_risk"), top.alias("max_risk"), F.col("path").alias("nodes"), F.coalesce(F.transform("taken", lambda x: x["edge"]), F.array().cast("array<long>")).alias("edges"))


def snapped_ends(queries: DataFrame, roads: DataFrame, limit: float = K.SNAP_LIMIT_M) -> DataFrame:
    """The snapped ends ``s`` and ``t`` of queries, for several search() calls."""
    return written(_ends(queries, roads, limit), "search-ends")


def search(queries: DataFrame, roads: DataFrame, alpha: float, limit: float = K.SNAP_LIMIT_M, ends: DataFrame | None = None) -> DataFrame:
    """``queries`` (``id``, ``ax``, ``ay``, ``bx``, ``by``) with ``mode``, ``length`` (metres), ``mean_risk``, ``max_risk`` and the way taken (``s``, ``t``: snapped ends, ``nodes``, ``edges``).

    ``route`` where both ends snap and are connected, else ``straight`` with the straight distance and null risks. ``alpha`` weighs risk: 0 gives the shortest way.
    Queries between the same two vertices share one way. ``ends``: what snapped_ends() found for the same queries, roads and limit.
    """
    ends = snapped_ends(queries, roads, limit) if ends is None else ends
    near = ends.where("s.edge = t.edge")
    metres = F.abs(F.col("s.to_a") - F.col("t.to_a"))
    on_one = F.when(metres > 0, F.col("s.edge_risk")).otherwise(0.0)
    same = near.select("id", metres.alias("length"), on_one.alias("mean_risk"), on_one.alias("max_risk"), F.array().cast("array<long>").alias("nodes"), F.array().cast("array<long>").alias("edges"))
    vertices = [F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in "st" for c in ("edge", "v")]
    far = ends.where("s.edge <> t.edge")
    first = written(far.select("id", *vertices).groupBy("s_edge", "s_v", "t_edge", "t_v").agg(F.min("id").alias("id")), "search-first")
    one = far.join(first.select("id"), "id", "left_semi")
    ways = (_searched(one, roads, alpha) if roads.count() * 2 <= network.ADJACENCY_EDGES else _tiled(one, roads, alpha)).join(first, "id").drop("id")
    shared = far.select("id", *vertices).join(written(ways, "search-ways"), ["s_edge", "s_v", "t_edge", "t_v"])
    found = same.unionByName(shared.select(*same.columns))
    whole = queries.join(ends, "id").join(found, "id", "left")
    straight = planar_m(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return whole.select(*queries.columns, F.when(F.col("length").isNull(), "straight").otherwise("route").alias("mode"), F.coalesce("length", straight).alias("length"), "mean_risk", "max_risk", "s", "t", "nodes", "edges")


def _piece(points: Column, a: Column, b: Column) -> Column:
    """Vertices a to b of a polyline, in that direction."""
    return F.when(a <= b, F.slice(points, a + 1, b - a + 1)).otherwise(F.reverse(F.slice(points, b + 1, a - b + 1)))


def lines(found: DataFrame, roads: DataFrame) -> DataFrame:
    """``id`` and ``points`` of the ways of search(): from the first snapped vertex to the last, each shared vertex once; the straight line where there is no way."""
    on_road = found.where("mode = 'route'")
    last = F.size("points") - 1
    whole = F.transform(F.sequence(F.lit(1), F.size("edges")), lambda k: F.struct(k.alias("step"), F.get("edges", k - 1).alias("edge"), F.get("nodes", k - 1).alias("start")))
    first = F.struct(F.lit(0).alias("step"), F.col("s.edge").alias("edge"), F.get("nodes", F.lit(0)).alias("start"))
    final = F.struct((F.size("edges") + 1).alias("step"), F.col("t.edge").alias("edge"), F.element_at("nodes", -1).alias("start"))
    one = F.size("nodes") == 0
    steps = F.when(one, F.array(F.struct(F.lit(0).alias("step"), F.col("s.edge").alias("edge"), F.lit(None).cast("long").alias("start")))).otherwise(F.concat(F.array(first), F.when(F.size("edges") > 0, whole).otherwise(F.slice(whole, 1, 0)), F.array(final)))
    hops = on_road.select("id", "s", "t", one.alias("one"), (F.size("edges") + 1).alias("end"), F.inline(steps)).join(roads.select("edge", "a", "b", "points"), "edge")
    a_side = F.col("start") == F.col("a")
    piece = (
        F.when(F.col("one"), _piece(F.col("points"), F.col("s.v"), F.col("t.v")))
        .when(F.col("step") == 0, _piece(F.col("points"), F.col("s.v"), F.when(a_side, 0).otherwise(last)))
        .when(F.col("step") == F.col("end"), _piece(F.col("points"), F.when(a_side, 0).otherwise(last), F.col("t.v")))
        .otherwise(F.when(a_side, F.col("points")).otherwise(F.reverse("points")))
    )
    own = F.when(F.col("step") == 0, piece).otherwise(F.slice(piece, 2, F.size(piece)))
    drawn = hops.select("id", "step", own.alias("p")).groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("step", "p"))), lambda x: x["p"])).alias("points"))
    ends = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    return drawn.unionByName(found.where("mode = 'straight'").select("id", ends.alias("points")))


def along(found: DataFrame, roads: DataFrame, places: DataFrame, buffer: float) -> DataFrame:
    """Places (``id``, ``x``, ``y``, ``category``) in the corridor of each way of search(): ``query``, ``id``, ``category``, ``distance``, ``along`` and ``position``."""
    ways = lines(found, roads).select(F.col("id").alias("query"), "points")
    return network.corridor(ways, places.select("id", "x", "y"), buffer, key="query").join(places.select("id", "category"), "id").select("query", "id", "category", "distance", "along", "position")


def one_each(queries: DataFrame) -> DataFrame:
    """Of the queries (``id``, ``ax``, ``ay``, ``bx``, ``by``) between the same two places the one of least id."""
    return written(queries.groupBy("ax", "ay", "bx", "by").agg(F.min("id").alias("id")).select("id", "ax", "ay", "bx", "by"), "search-different")


def for_all(found: DataFrame, different: DataFrame, queries: DataFrame, key: str = "id") -> DataFrame:
    """Rows found for one_each() of the queries (their id in ``key``), for each query between the same places."""
    places = ["ax", "ay", "bx", "by"]
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"q.{c}")) for c in places]
    answered = different.withColumnRenamed("id", key).join(found, key).select(*places, *[F.col(c).alias(f"__{c}") for c in found.columns if c != key])
    return queries.select("id", *places).alias("q").join(answered.alias("o"), same).select(F.col("q.id").alias(key), *[F.col(f"o.__{c}").alias(c) for c in found.columns if c != key])


def categories_along(found: DataFrame, roads: DataFrame, places: DataFrame, buffer: float) -> DataFrame:
    """category_hits() of along(). Places of one spot are measured once for a way, and added up by category."""
    spots = written(places.groupBy("x", "y", "category").agg(F.count("*").alias("places")), "search-spots")
    one = written(spots.select("x", "y").distinct().withColumn("id", F.monotonically_increasing_id()), "search-places")
    ways = lines(found, roads).select(F.col("id").alias("query"), "points")
    near = network.corridor(ways, one.select("id", "x", "y"), buffer, key="query").select("query", "id").join(one, "id").join(spots, ["x", "y"])
    return near.groupBy("query", "category").agg(F.sum("places").alias("n"))


def category_hits(hits: DataFrame) -> DataFrame:
    """``query``, ``category`` and ``n`` of corridor hits."""
    return hits.groupBy("query", "category").agg(F.count("*").alias("n"))


def _candidates(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Each different ``q`` and its ``words`` beside the names (``gram`` and other columns of ``held``) that hold the first letters, three at most, of that word of it which the fewest names can answer."""
    begun = asked.distinct().select("q", F.explode(F.transform(F.split("q", r"\s+"), lambda w: F.substr(w, F.lit(1), F.lit(3)))).alias("gram")).where("gram <> ''")
    fewest = begun.join(held.groupBy("gram").agg(F.count("*").alias("names")), "gram").groupBy("q").agg(F.min(F.struct("names", "gram")).alias("m"))
    return fewest.select("q", F.split("q", r"\s+").alias("words"), "m.gram").join(held, "gram")


def resolved(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``texts`` (``id``, ``text``, optional chosen ``x`` and ``y``) with a place: the chosen point, else coordinates in the text, else the best name; ``x``, ``y`` and ``label`` null if none.

    ``names`` are ``id``, ``name``, ``is_place``, ``x``, ``y``. Texts that ask the same share one answer. All different ones are matched in one join on the first three
    letters of any word (words of one or two letters: by those) that the fewest names hold, so a name is only looked at for texts that it can answer.
    """
    from gridloom.operators import places

    chosen = [F.col(c) if c in texts.columns else F.lit(None).cast("double") for c in ("x", "y")]
    point = places.coordinates(F.col("text"))
    read = texts.select("id", "text", chosen[0].alias("cx"), chosen[1].alias("cy"), point.alias("p"), F.trim(places.plain(F.trim("text"))).alias("q"))
    rows = written(read.withColumn("q", F.when(F.col("cx").isNull() & F.col("p").isNull() & (F.length("q") >= 2), F.col("q"))), "search-texts")
    plain = names.withColumn("n", places.plain(F.col("name"))).where("length(n) > 0")
    starts = F.sequence(F.lit(1), F.length("n"))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.transform(starts, lambda i: F.substr(F.col("n"), i, k)))))
    held = written(plain.select(F.col("id").alias("name_id"), "name", "n", "is_place", "x", "y", F.explode(grams).alias("gram")), "search-grams")
    near = _candidates(rows.where("q IS NOT NULL").select("q"), held).where(F.forall("words", lambda w: F.contains(F.col("n"), w)))
    best = near.groupBy("q").agg(F.min(F.struct(places.name_score(F.col("n"), F.col("q"), F.col("is_place")).alias("score"), "name_id", "name", "x", "y")).alias("m"))
    found = rows.join(best, "q", "left")
    label = F.when(F.col("cx").isNotNull(), F.col("text")).when(F.col("p").isNotNull(), F.format_string("%.4f, %.4f", F.col("p.lat"), F.col("p.lon"))).otherwise(F.col("m.name"))
    return found.select("id", F.coalesce("cx", "p.lon", "m.x").alias("x"), F.coalesce("cy", "p.lat", "m.y").alias("y"), label.alias("label"))
