"""Road networks: edge tables, risk along edges, shortest paths, nearest nodes, routes and corridors."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import constants as K
from gridloom.functions.geo import KM_LAT, KM_LON, band, band_width, haversine_m, in_ring, planar_m, point_along, points_between, segment_distance, summed
from gridloom.operators import tiled
from gridloom.session import written

#: Edges up to which packed adjacency goes to the executors (4 bytes an edge and 8 for each weight, 72 MB at most); beyond, paths are relaxed by joins.
ADJACENCY_EDGES = 2_000_000
POINTS = "array<struct<x: double, y: double>>"


def directed_edges(ways: DataFrame) -> DataFrame:
    """``src`` and ``dst`` from ways (``a``, ``b``, ``highway``, ``oneway``, ``junction``), with other columns kept; loops dropped, repeats once.

    One-way values, roundabouts and motorways leave out the way back, reversed ones the way ahead; a way that is both has no edge.
    """
    others = [c for c in ways.columns if c not in ("a", "b", "highway", "oneway", "junction")]
    ahead, back = F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))
    forward_only = F.coalesce(F.col("oneway").isin(*K.ONEWAY_FORWARD), F.lit(False)) | F.coalesce(F.col("junction") == "roundabout", F.lit(False)) | F.coalesce(F.col("highway") == "motorway", F.lit(False))
    reverse_only = F.coalesce(F.col("oneway").isin(*K.ONEWAY_BACKWARD), F.lit(False))
    arcs = F.array_compact(F.array(F.when(~reverse_only, ahead), F.when(~forward_only, back)))
    return ways.select(F.explode(arcs).alias("e"), *others).select("e.src", "e.dst", *others).where("src <> dst").distinct()


def graph_edges(ways: DataFrame) -> DataFrame:
    """Ways (``highway``, ``oneway``, ``junction``, ``nodes``: array of struct id, lon, lat) cut at every node: directed ``src``, ``dst``, ``length`` (great-circle metres) and ``highway``."""
    steps = F.zip_with(F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(0))), F.slice("nodes", 2, F.greatest(F.size("nodes") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cut = ways.select("highway", "oneway", "junction", F.explode(steps).alias("s"))
    length = haversine_m(F.col("s.a.lon"), F.col("s.a.lat"), F.col("s.b.lon"), F.col("s.b.lat"))
    pieces = cut.select(F.col("s.a.id").alias("a"), F.col("s.b.id").alias("b"), "highway", "oneway", "junction", length.alias("length"), F.col("highway").alias("kind"))
    return directed_edges(pieces).withColumnRenamed("kind", "highway")


def near_ring(x: Column, y: Column, ring: Column, margin: float) -> Column:
    """Whether a point lies in a ring or within ``margin`` of its boundary, in the ring's own units."""
    closed = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    near = F.exists(F.zip_with(ring, closed, lambda a, b: segment_distance(x, y, a["x"], a["y"], b["x"], b["y"])[0] <= margin), lambda hit: hit)
    return in_ring(x, y, ring) | near


def build_graph(ways: DataFrame, ring: Column, margin: float = K.CLIP_MARGIN_DEG) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id``, ``x``, ``y``, ``street_count``) and directed edges of the largest strong component inside the widened study area.

    Of components of equal size the one with the least node stays. ``street_count`` is the number of edges that begin or end at a node.
    """
    places = ways.select(F.explode("nodes").alias("n")).groupBy(F.col("n.id").alias("id")).agg(F.first("n.lon").alias("x"), F.first("n.lat").alias("y"))
    inside = written(places.where(near_ring(F.col("x"), F.col("y"), ring, margin)), "graph-nodes")
    ids = inside.select("id")
    edges = written(graph_edges(ways).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "length", "highway"), "graph-edges")
    parts = written(strong_components(edges), "graph-parts")
    best = parts.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    kept = written(parts.join(F.broadcast(best), "component", "left_semi").select(F.col("node").alias("id")), "graph-kept")
    edges = edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")
    counts = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("street_count"))
    return inside.join(kept, "id", "left_semi").join(counts, "id", "left").fillna(0, ["street_count"]), edges


def edge_points(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with ``points``: their own polyline, else the straight line between their nodes (``id``, ``x``, ``y``)."""
    a, b = nodes.select(F.col("id").alias("src"), F.struct("x", "y").alias("__a")), nodes.select(F.col("id").alias("dst"), F.struct("x", "y").alias("__b"))
    straight = F.array("__a", "__b")
    own = F.coalesce("points", straight) if "points" in edges.columns else straight
    return edges.join(a, "src").join(b, "dst").withColumn("points", own).drop("__a", "__b")


def edge_samples(edges: DataFrame, nodes: DataFrame, step: float) -> DataFrame:
    """``src``, ``dst`` and the cells (``r``, ``c``) at equally spaced points of each edge's line, both ends included, at most ``step`` apart but two at least.

    ``nodes`` and lines are in cell units; a missing or zero length counts as 1.
    """
    length = F.coalesce(F.nullif("length", F.lit(0.0)), F.lit(1.0))
    n = F.greatest(F.lit(2), F.ceil(length / step).cast("int") + 1)
    points = edge_points(edges, nodes).withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    if "points" in edges.columns:
        spot = points.withColumn("p", point_along(F.col("points"), F.col("i") / (F.col("n") - 1)))
    else:
        a, b, t = F.col("points")[0], F.col("points")[1], F.col("i") / (F.col("n") - 1)
        spot = points.withColumn("p", F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y")))
    return spot.select("src", "dst", F.floor("p.y").cast("long").alias("r"), F.floor("p.x").cast("long").alias("c"))


def edge_risk(edges: DataFrame, nodes: DataFrame, cells: DataFrame, alpha: float = K.ALPHA, step: float = K.SAMPLE_STEP_M) -> DataFrame:
    """``edges`` with mean ``risk``, ``risk_max`` and ``cost``; an edge without any known cell has the mean of all cells."""
    seen = edge_samples(edges, nodes, step).join(cells.select("r", "c", "risk"), ["r", "c"], "left")
    found = seen.groupBy("src", "dst").agg(F.avg("risk").alias("risk"), F.max("risk").alias("risk_max"))
    mean = cells.agg(F.avg("risk").alias("mean"))
    filled = edges.join(found, ["src", "dst"]).join(F.broadcast(mean), how="cross").withColumns({"risk": F.coalesce("risk", "mean"), "risk_max": F.coalesce("risk_max", "mean")}).drop("mean")
    return filled.withColumn("cost", F.coalesce(F.nullif("length", F.lit(0.0)), F.lit(1.0)) * (1 + F.col("risk") * alpha))


def best_edges(edges: DataFrame, weight: str) -> DataFrame:
    """One edge for each (``src``, ``dst``): the least weight; a missing weight is the worst."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    found = edges.groupBy("src", "dst").agg(F.min_by(F.struct(*others), F.struct(F.coalesce(weight, F.lit(float("inf"))), *others)).alias("e"))
    return found.select("src", "dst", "e.*")


def undirected(edges: DataFrame) -> DataFrame:
    """``a`` < ``b`` and the columns of the shorter parallel edge; loops and lengths up to 0 dropped."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    rows = edges.where("src <> dst AND length > 0").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), *others)
    return rows.groupBy("a", "b").agg(F.min_by(F.struct(*others), F.struct("length", *[c for c in others if c != "length"])).alias("e")).select("a", "b", "e.*")


class Adjacency:
    """Edges packed by their start: sorted node ids, offsets, places of the ends, and weights."""

    def __init__(self, edges: DataFrame, columns: Sequence[str]):
        found = edges.select("src", "dst", *[F.col(c).cast("double").alias(c) for c in columns]).toArrow()
        src, dst = (found.column(c).to_numpy() for c in ("src", "dst"))
        self.ids = np.unique(np.concatenate([src, dst]))
        order = np.lexsort((dst, src))
        self.offsets = np.searchsorted(src[order], np.append(self.ids, self.ids[-1] + 1 if len(self.ids) else 0)).astype(np.int64)
        self.ends = np.searchsorted(self.ids, dst[order]).astype(np.int32)
        self.weights = [found.column(c).to_numpy()[order] for c in columns]

    def place(self, node: int) -> int | None:
        """Where a node stands; None if it is on no edge."""
        at = int(np.searchsorted(self.ids, node))
        return at if at < len(self.ids) and self.ids[at] == node else None

    def search(self, starts: dict[int, float], weight: int = 0, goals: set[int] | None = None) -> dict[int, tuple[float, int, int]]:
        """Place -> (least weight, place before or -1, edge taken or -1), from start places with their first costs; stops when all goals are settled. Ties keep the smaller place before."""
        best: dict[int, tuple[float, int, int]] = {}
        left = None if goals is None else set(goals)
        heap = [(d, -1, p, -1) for p, d in starts.items()]
        heapq.heapify(heap)
        costs = self.weights[weight]
        while heap:
            d, before, at, edge = heapq.heappop(heap)
            if at in best:
                continue
            best[at] = (d, before, edge)
            if left is not None:
                left.discard(at)
                if not left:
                    break
            a, b = int(self.offsets[at]), int(self.offsets[at + 1])
            for e, (end, cost) in enumerate(zip(self.ends[a:b].tolist(), costs[a:b].tolist(), strict=True), a):
                if end not in best:
                    heapq.heappush(heap, (d + cost, at, end, e))
        return best

    def walk(self, best: dict[int, tuple[float, int, int]], at: int) -> tuple[list[int], list[int]]:
        """Places and edges from a start to a settled place."""
        places, edges = [at], []
        while best[places[-1]][1] >= 0:
            edges.append(best[places[-1]][2])
            places.append(best[places[-1]][1])
        return places[::-1], edges[::-1]


def distances(edges: DataFrame, origins: DataFrame, weight: str, nodes: DataFrame | None = None) -> DataFrame:
    """``origin``, ``node`` and ``distance`` for every reachable node, the origin itself always.

    With a checked number of edges the packed adjacency goes to the executors and each origin is one heap search. Beyond, the network is cut by tiles where the
    places of its ``nodes`` (``id``, ``x``, ``y``) are given, and distances move from tile to tile; without them distances are relaxed by joins, a round for each edge of the longest way.
    """
    edges = written(best_edges(edges.select("src", "dst", weight), weight), "edges")
    if edges.count() > ADJACENCY_EDGES:
        if nodes is None:
            return relaxed(edges, origins, weight).select("origin", "node", "distance")
        starts = origins.select("origin").distinct()
        net = tiled.Tiled(edges, nodes, weight)
        found = net.distances(net.search(starts.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("distance")))).select("origin", "node", "distance")
        lost = starts.join(nodes.select(F.col("id").alias("origin")), "origin", "left_anti")
        return found.unionByName(lost.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("distance")))
    shared = edges.sparkSession.sparkContext.broadcast(Adjacency(edges, [weight]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links = shared.value
        for frame in frames:
            for origin in frame["origin"]:
                if (at := links.place(origin)) is None:
                    yield pd.DataFrame({"origin": [origin], "node": [origin], "distance": [0.0]})
                else:
                    found = links.search({at: 0.0})
                    yield pd.DataFrame({"origin": origin, "node": links.ids[list(found)], "distance": [v[0] for v in found.values()]})

    return origins.select("origin").distinct().repartition("origin").mapInPandas(run, "origin long, node long, distance double")


def relaxed(edges: DataFrame, origins: DataFrame, weight: str, max_rounds: int = 10_000) -> DataFrame:
    """distances() by relaxation, with ``before``, the node before on the path (null at the start; the smaller of equally near ones).

    Each round joins the nodes that got nearer to their edges, until none does. ``origins`` may hold ``node`` and ``distance`` of first nodes.
    """
    first = origins.select("origin", F.col("node") if "node" in origins.columns else F.col("origin").alias("node"), F.col("distance") if "distance" in origins.columns else F.lit(0.0).alias("distance"))
    known = written(first.groupBy("origin", "node").agg(F.min("distance").alias("distance")).withColumn("before", F.lit(None).cast("long")), "distances")
    moved = known
    for _ in range(max_rounds):
        offers = moved.join(edges, moved["node"] == edges["src"]).groupBy("origin", F.col("dst").alias("node")).agg(F.min(F.struct((F.col("distance") + F.col(weight)).alias("d"), F.col("src").alias("before"))).alias("offer"))
        both = known.join(offers, ["origin", "node"], "full")
        nearer = F.coalesce(F.col("offer.d") < F.coalesce("distance", F.lit(float("inf"))), F.lit(False))
        both = written(both.select("origin", "node", F.when(nearer, F.col("offer.d")).otherwise(F.col("distance")).alias("distance"), F.when(nearer, F.col("offer.before")).otherwise(F.col("before")).alias("before"), nearer.alias("nearer")), "distances")
        known, moved = both.drop("nearer"), both.where("nearer").drop("nearer", "before")
        if moved.isEmpty():
            return known
    raise RuntimeError("distances did not settle")


def relaxed_paths(edges: DataFrame, pairs: DataFrame, weight: str) -> DataFrame:
    """``origin``, ``dest`` and ``path`` (nodes) of reachable pairs: relaxed distances, then all paths walked back together, one step a round."""
    return walked_back(relaxed(edges, pairs.select("origin").distinct(), weight), pairs)


def walked_back(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """``origin``, ``dest`` and ``path`` (nodes) of the pairs that a tree of relaxed() reaches."""
    ahead = pairs.select("origin", "dest").distinct().join(tree.select("origin", F.col("node").alias("dest")), ["origin", "dest"]).select("origin", "dest", F.col("dest").alias("at"), F.array("dest").alias("path"))
    done = []
    while True:
        step = ahead.join(tree.select("origin", F.col("node").alias("at"), "before"), ["origin", "at"])
        step = written(step.select("origin", "dest", "before", F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat(F.array("before"), "path")).alias("path")), "paths")
        done.append(step.where("before IS NULL").select("origin", "dest", "path"))
        ahead = step.where("before IS NOT NULL").withColumnRenamed("before", "at")
        if ahead.isEmpty():
            break
        if len(done) >= 32:
            done = [written(functools.reduce(DataFrame.union, done), "paths-done")]
    return functools.reduce(DataFrame.union, done)


def paths(edges: DataFrame, pairs: DataFrame, weight: str, nodes: DataFrame | None = None) -> DataFrame:
    """``origin``, ``dest`` and ``path`` (nodes) of the least-weight path of each reachable pair; pairs of an origin share one search. ``nodes`` as in distances()."""
    links = written(best_edges(edges.select("src", "dst", weight), weight), "edges")
    if links.count() > ADJACENCY_EDGES:
        if nodes is None:
            return relaxed_paths(links, pairs, weight)
        net = tiled.Tiled(links, nodes, weight)
        state = net.search(pairs.select("origin").distinct().select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("distance")))
        return net.paths(state, pairs)
    shared = links.sparkSession.sparkContext.broadcast(Adjacency(links, [weight]))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own, out = shared.value, []
        origin = int(frame["origin"].iloc[0])
        at, goals = own.place(origin), {int(d): own.place(int(d)) for d in frame["dest"]}
        wanted = {p for p in goals.values() if p is not None}
        found = own.search({at: 0.0}, goals=wanted) if at is not None and wanted else {}
        for dest, p in goals.items():
            if dest == origin:
                out.append((origin, dest, [origin]))
            elif p in found:
                out.append((origin, dest, own.ids[own.walk(found, p)[0]].tolist()))
        return pd.DataFrame(out, columns=["origin", "dest", "path"])

    return pairs.select("origin", "dest").distinct().groupBy("origin").applyInPandas(run, "origin long, dest long, path array<long>")


def path_steps(routed: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """``origin``, ``dest``, ``step`` (from 0) and the columns of the edge taken (the best parallel one) for each step of ``path``."""
    hops = F.zip_with(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    return routed.select("origin", "dest", F.posexplode(hops).alias("step", "hop")).select("origin", "dest", "step", "hop.*").join(best_edges(edges, weight), ["src", "dst"])


def routes(edges: DataFrame, pairs: DataFrame, weight: str, nodes: DataFrame | None = None) -> DataFrame:
    """``pairs`` (``origin``, ``dest``, other columns) with ``km``, ``mean_risk`` (by length), ``max_risk``, ``exposure`` (risk kilometres) and ``path`` of the least-weight route; unreachable pairs are missing.

    ``edges`` have ``length``, ``risk``, ``risk_max`` and the weight. A route of one node has zeros.
    """
    routed = written(paths(edges, pairs, weight, nodes), "routes")
    steps = path_steps(routed, edges.select("src", "dst", "length", "risk", "risk_max", *([weight] if weight not in ("length", "risk", "risk_max") else [])), weight)
    exposure = F.sum(F.col("length") * F.col("risk"))
    sums = steps.groupBy("origin", "dest").agg((F.sum("length") / 1000).alias("km"), F.coalesce(F.try_divide(exposure, F.sum("length")), F.lit(0.0)).alias("mean_risk"), F.max("risk_max").alias("max_risk"), (exposure / 1000).alias("exposure"))
    found = routed.join(sums, ["origin", "dest"], "left").fillna(0.0, ["km", "mean_risk", "max_risk", "exposure"])
    return pairs.join(found, ["origin", "dest"]).select(*pairs.columns, "km", "mean_risk", "max_risk", "exposure", "path")


def path_lines(steps: DataFrame) -> DataFrame:
    """``origin``, ``dest`` and ``points`` of routes from path_steps() of edges with ``points`` and node places ``sx``, ``sy`` of their starts.

    Each edge's line is turned so that it begins at its nearer end, and the vertex that two edges share stands once.
    """
    first, last = F.get("points", F.lit(0)), F.element_at("points", -1)
    gap = lambda p: (p["x"] - F.col("sx")) * (p["x"] - F.col("sx")) + (p["y"] - F.col("sy")) * (p["y"] - F.col("sy"))
    turned = F.when(gap(first) > gap(last), F.reverse("points")).otherwise(F.col("points"))
    rest = F.when(F.col("step") == 0, turned).otherwise(F.slice(turned, 2, F.size("points")))
    ordered = steps.withColumn("p", rest).groupBy("origin", "dest").agg(F.array_sort(F.collect_list(F.struct("step", "p"))).alias("s"))
    return ordered.select("origin", "dest", F.flatten(F.col("s.p")).alias("points"))


def _around(places: DataFrame, limit: float, columns: Sequence[str | Column]) -> DataFrame:
    """Places (``x`` lon, ``y`` lat) copied to the buckets of three bands of latitude and three widths of longitude around theirs."""
    rows = places.withColumn("band", F.explode(F.sequence(band(F.col("y"), limit) - 1, band(F.col("y"), limit) + 1)))
    at = F.floor(F.col("x") / band_width(F.col("band"), limit)).cast("long")
    return rows.withColumn("slot", F.explode(F.sequence(at - 1, at + 1))).select("band", "slot", *columns)


def nearest_spots(points: DataFrame, places: DataFrame, limit: float, out: str, metres=planar_m) -> DataFrame:
    """``x``, ``y``, ``out`` and ``distance`` of nearest() for each different spot of the points that finds a place.

    The least distance is found first and the smaller id at it then: numbers that a hash table holds, so no task sorts pairs of points and places.
    """
    one = places.groupBy("x", "y").agg(F.min("id").alias("id"))
    there = _around(one, limit, [F.col("id").alias(out), F.col("x").alias("px"), F.col("y").alias("py")])

    def near(spots: DataFrame) -> DataFrame:
        here = spots.withColumn("band", band(F.col("y"), limit)).withColumn("slot", F.floor(F.col("x") / band_width(F.col("band"), limit)).cast("long"))
        return here.join(there, ["band", "slot"]).withColumn("d", metres(F.col("x"), F.col("y"), F.col("px"), F.col("py")))

    least = written(near(points.select("x", "y").distinct()).where(F.col("d") <= limit).groupBy("x", "y").agg(F.min("d").alias("distance")), "nearest-least")
    return written(near(least).where("d = distance").groupBy("x", "y", "distance").agg(F.min(out).alias(out)).select("x", "y", out, "distance"), "nearest-spots")


def nearest(points: DataFrame, places: DataFrame, limit: float, out: str, metres=planar_m) -> DataFrame:
    """``points`` (``id``, ``x`` lon, ``y`` lat) with the id ``out`` of the nearest place (``id``, ``x``, ``y``) within ``limit`` metres and its ``distance``; else null.

    A range join of different spots on buckets of the limit's height and, by latitude, its width. Ties go to the smaller id. ``metres`` measures: on the plane at the mean latitude, or haversine_m.
    """
    return points.select("id", "x", "y").join(nearest_spots(points, places, limit, out, metres), ["x", "y"], "left").select("id", out, "distance")


def nearest_any(points: DataFrame, places: DataFrame, out: str, first: float = 2_000.0, metres=haversine_m) -> DataFrame:
    """nearest() without a limit: spots that found no place look again within four times the distance, until all have one."""
    if places.isEmpty():
        return points.select("id", F.lit(None).cast(places.schema["id"].dataType).alias(out), F.lit(None).cast("double").alias("distance"))
    left, limit, done = written(points.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct(), "nearest"), first, []
    while True:
        found = nearest_spots(left, places, limit, out, metres)
        done.append(found)
        left = left.join(found, ["x", "y"], "left_anti")
        if limit > 21_000_000 or left.isEmpty():
            return points.select("id", "x", "y").join(functools.reduce(DataFrame.union, done), ["x", "y"], "left").select("id", out, "distance")
        limit *= 4


def line_segments(lines: DataFrame, key: str = "line") -> DataFrame:
    """Segments of polylines (``key``, array ``points`` of lon x and lat y): ``seg``, ends and ``before``, the metres before it; a line of one point is one segment without length."""
    points = F.when(F.size("points") == 1, F.concat("points", "points")).otherwise(F.col("points"))
    rows = lines.withColumn("points", points).withColumn("lengths", points_between(F.col("points")))
    cut = rows.select(key, "points", "lengths", F.posexplode("lengths").alias("seg", "length"))
    return cut.select(
        key, "seg", F.get("points", F.col("seg"))["x"].alias("ax"), F.get("points", F.col("seg"))["y"].alias("ay"), F.get("points", F.col("seg") + 1)["x"].alias("bx"), F.get("points", F.col("seg") + 1)["y"].alias("by"),
        summed(F.slice("lengths", F.lit(1), F.col("seg"))).alias("before"),
    )


def corridor(lines: DataFrame, points: DataFrame, buffer: float, key: str = "line") -> DataFrame:
    """``key``, ``id``, ``distance``, ``along`` (metres from the line's start) and ``position`` (from 1, by ``along``) of points (``id``, ``x`` lon, ``y`` lat) within ``buffer`` metres of a polyline.

    Distances are on the plane that touches at the point; the nearest place of the line counts (ties: first). A range join: a segment is
    copied to the buckets that its widened box touches.
    """
    degrees = buffer / (KM_LAT * 1000) * 1.01
    rows = F.sequence(band(F.least("ay", "by") - degrees, buffer), band(F.greatest("ay", "by") + degrees, buffer))
    wide = band_width(F.col("band"), buffer)
    slots = F.sequence(F.floor(F.least("ax", "bx") / wide).cast("long") - 1, F.floor(F.greatest("ax", "bx") / wide).cast("long") + 1)
    there = line_segments(lines, key).withColumn("band", F.explode(rows)).withColumn("slot", F.explode(slots))
    here = points.withColumn("band", band(F.col("y"), buffer)).withColumn("slot", F.floor(F.col("x") / band_width(F.col("band"), buffer)).cast("long"))
    kx, ky = F.cos(F.radians(F.col("y"))) * (KM_LON * 1000), F.lit(KM_LAT * 1000)
    ax, ay, bx, by = (F.col("ax") - F.col("x")) * kx, (F.col("ay") - F.col("y")) * ky, (F.col("bx") - F.col("x")) * kx, (F.col("by") - F.col("y")) * ky
    d, t = segment_distance(F.lit(0.0), F.lit(0.0), ax, ay, bx, by)
    span = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    near = here.join(there, ["band", "slot"]).withColumns({"d": d, "a": F.col("before") + t * span}).where(F.col("d") <= buffer)
    found = near.groupBy(key, "id").agg(F.min(F.struct("d", "seg", "a")).alias("m")).select(key, "id", F.col("m.d").alias("distance"), F.col("m.a").alias("along"))
    return found.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy("along", "id")))


def simplify_points(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: the points of a line that stay; both ends do."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        v, rel = points[b] - points[a], points[a + 1 : b] - points[a]
        t = np.clip(rel @ v / (v @ v), 0, 1) if v @ v else np.zeros(len(rel))
        d = np.hypot(*(rel - t[:, None] * v).T)
        if d.max() > tolerance:
            m = a + 1 + int(d.argmax())
            keep[m] = True
            stack += [(a, m), (m, b)]
    return points[keep]


def simplify(lines: DataFrame, tolerance: float) -> DataFrame:
    """Lines (``line``, ``points``) with points left out that lie within the tolerance; lines of up to two points stay."""
    kind = lines.schema["points"].dataType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for points in f["points"]:
                xy = np.array([(p["x"], p["y"]) for p in points]).reshape(-1, 2)
                out.append([{"x": x, "y": y} for x, y in (simplify_points(xy, tolerance) if len(xy) > 2 else xy)])
            yield pd.DataFrame({"line": f["line"], "points": out})

    return lines.select("line", "points").mapInPandas(run, T.StructType([lines.schema["line"], T.StructField("points", kind)]))


def _reach(edges: DataFrame, label: DataFrame, name: str) -> DataFrame:
    """``label`` (``node``, ``label``) with each label replaced by the least label that reaches the node along ``edges``; a round for each step of the longest way."""
    moved = label
    while True:
        offers = moved.join(edges, moved["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("offer"))
        both = written(label.join(offers, "node", "left").select("node", F.least("label", "offer").alias("label"), F.coalesce(F.col("offer") < F.col("label"), F.lit(False)).alias("less")), name)
        label, moved = both.drop("less"), both.where("less").drop("less")
        if moved.isEmpty():
            return label


def coloured_components(edges: DataFrame) -> DataFrame:
    """Strong components by colouring (Orzan 2004): each round settles one component for every colour.

    Nodes without an edge in or out are components of their own and go first. The least node that reaches a node is its colour; what
    a colour's least node is reached from, inside the colour, is that node's component. Edges between settled or differently coloured nodes go.
    """
    out = [edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.col("node").alias("component"))]
    left = edges.where("src <> dst")
    settled = []
    while True:
        while True:  # nodes at which no way can return
            starts, ends = left.select(F.col("src").alias("node")).distinct(), left.select(F.col("dst").alias("node")).distinct()
            inner = starts.join(ends, "node", "left_semi")
            both = written(left.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi"), "strong-left")
            same = both.count() == left.count()
            left = both
            if same:
                break
        if left.isEmpty():
            break
        nodes = left.select(F.col("src").alias("node")).distinct()
        colour = written(_reach(left, written(nodes.select("node", F.col("node").alias("label")), "strong-nodes"), "strong-colour"), "strong-colours")
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        back = written(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "strong-back")
        marks = written(colour.select("node", (F.col("node") != F.col("label")).cast("int").alias("label")), "strong-marks")
        reached = written(_reach(back, marks, "strong-reach"), "strong-reached").where("label = 0").select("node")
        found = written(colour.join(reached, "node", "left_semi").select("node", F.col("label").alias("component")), "strong-found")
        settled.append(found)
        gone = found.select("node")
        left = written(inside.select("src", "dst").join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), "strong-left")
        if len(settled) >= 16:
            settled = [written(functools.reduce(DataFrame.union, settled), "strong-settled")]
    return functools.reduce(DataFrame.union, out + settled).groupBy("node").agg(F.min("component").alias("component"))


def strong_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (least node) of strongly connected components of a directed edge table.

    With a checked number of edges one task runs Tarjan's search; beyond, components are found by colouring, all in parallel.
    """
    edges = written(edges.select("src", "dst").distinct(), "edges")
    if edges.count() > ADJACENCY_EDGES:
        return coloured_components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            found = tarjan(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()))], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def tarjan(src: Sequence[int], dst: Sequence[int]) -> dict[int, int]:
    """Node -> least node of its strongly connected component."""
    links: dict[int, list[int]] = {}
    for a, b in zip(src, dst, strict=True):
        links.setdefault(int(a), []).append(int(b))
        links.setdefault(int(b), [])
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    out: dict[int, int] = {}
    stack: list[int] = []
    for root in links:
        if root in number:
            continue
        work = [(root, iter(links[root]))]
        number[root] = low[root] = len(number)
        stack.append(root)
        while work:
            node, rest = work[-1]
            for b in rest:
                if b not in number:
                    number[b] = low[b] = len(number)
                    stack.append(b)
                    work.append((b, iter(links[b])))
                    break
                if b not in out:
                    low[node] = min(low[node], number[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                    out.update(dict.fromkeys(members, min(members)))
    return out
