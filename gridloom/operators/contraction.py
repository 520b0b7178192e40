"""Road graphs without chains: nodes of two edges are contracted until none is left, with the line of each new edge; the largest component; the compact web graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import places
from gridloom.operators.components import connected_components
from gridloom.operators.network import POINTS, simplify
from gridloom.operators.skew import numbered, shuffled
from gridloom.session import written

_PIECE = f"a long, b long, length double, risk double, rank int, segments long, points {POINTS}"


def _walk(links: dict[int, list[int]], pieces: list, start: int, first: int, stops: set[int]) -> list[tuple[int, int]]:
    """(piece, node after it) from ``start`` over the piece ``first`` to the next stop."""
    way, node, k = [], start, first
    while True:
        node = pieces[k]["b"] if pieces[k]["a"] == node else pieces[k]["a"]
        way.append((k, node))
        if node in stops:
            return way
        one, other = links[node]
        k = other if one == k else one


def _edge(start: int, way: list[tuple[int, int]], pieces: list, last: int) -> tuple:
    """One edge for a way, from its smaller end: sums, the mean of risk by length, and the line with each shared vertex once."""
    used, end = [pieces[k] for k, _ in way], way[-1][1]
    length = sum(p["length"] for p in used)
    line: list = []
    at = start
    for p, (_, after) in zip(used, way, strict=True):
        points = list(p["points"]) if p["points"] is not None else []
        points = points if p["a"] == at else points[::-1]
        line += points[1:] if line else points
        at = after
    if start > end:
        line.reverse()
    risk = sum(p["length"] * p["risk"] for p in used) / length
    return min(start, end), max(start, end), length, risk, min(p["rank"] for p in used), sum(p["segments"] for p in used), line, last


def collapsed(pieces: list) -> tuple:
    """The edge that a chain becomes when its inner nodes go one by one, least first.

    A chain between two junctions is one edge. From a chain that returns to its junction the greatest inner node stays (its edges become parallel
    when the node before goes), from a ring without a junction the two greatest; of the two ways between what stays the shorter one does, of equal ones the
    way without the node that went last.
    """
    links: dict[int, list[int]] = {}
    inner: set[int] = set()
    for k, p in enumerate(pieces):
        for node, own in ((p["a"], p["ia"]), (p["b"], p["ib"])):
            links.setdefault(node, []).append(k)
            if own:
                inner.add(node)
    by_size, ends = sorted(inner, reverse=True), [n for n, ks in links.items() if n not in inner for _ in ks]
    if ends and ends[0] != ends[1]:
        start = min(ends)
        return _edge(start, _walk(links, pieces, start, links[start][0], set(ends)), pieces, by_size[0])
    stays, gone = ({ends[0], by_size[0]}, by_size[1]) if ends else ({by_size[0], by_size[1]}, by_size[2])
    start = min(stays)
    ways = [_walk(links, pieces, start, k, stays) for k in links[start]]
    best = min(ways, key=lambda w: (sum(pieces[k]["length"] for k, _ in w), any(n == gone for _, n in w)))
    return _edge(start, best, pieces, by_size[0])


def _round(now: DataFrame, inner: DataFrame) -> DataFrame:
    """All chains of the nodes ``inner`` as edges, and of parallel edges the shortest; of equal ones the edge that stood there, then the chain that ends first."""
    marked = now.join(shuffled(inner.select(F.col("id").alias("a"), F.lit(True).alias("ia"))), "a", "left").join(shuffled(inner.select(F.col("id").alias("b"), F.lit(True).alias("ib"))), "b", "left")
    marked = written(marked.fillna(False, ["ia", "ib"]), "contract-marked")
    inside = marked.where("ia AND ib").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    chains = connected_components(inside.union(inner.select("id", "id")))
    keyed = marked.where("ia OR ib").withColumn("node", F.when(F.col("ia"), F.col("a")).otherwise(F.col("b"))).join(shuffled(chains), "node")
    gathered = keyed.groupBy("component").agg(F.collect_list(F.struct(*now.columns, "ia", "ib")).alias("pieces")).select("pieces")

    names = [*now.columns, "last"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([collapsed(list(p)) for p in frame["pieces"]], columns=names)

    merged = gathered.mapInPandas(run, f"{_PIECE}, last long")
    whole = marked.where("NOT ia AND NOT ib").select(*now.columns, F.lit(None).cast("long").alias("last")).unionByName(merged)
    rest = [c for c in now.columns if c not in ("a", "b")]
    return whole.groupBy("a", "b").agg(F.min_by(F.struct(*rest), F.struct("length", "last")).alias("e")).select("a", "b", *[F.col(f"e.{c}").alias(c) for c in rest])


def contract(edges: DataFrame) -> DataFrame:
    """A simple graph without nodes of two edges: ``a`` < ``b``, ``length``, ``risk`` by length, least ``rank``, ``segments`` and ``points`` from a to b.

    ``edges`` are undirected, one for each pair (``a`` < ``b``, ``length`` > 0, ``risk``, ``rank``, and ``points`` from a to b where there are lines; else ``points`` are empty).
    In each round the nodes that have two edges at its begin go one by one, least first, until no such node is left: the edges of a node become one, of parallel edges
    the shorter one stays (of equal ones the older), and nodes that lose an edge by this are counted again. All chains of a round are worked on at once; a
    chain is put together in one task, which holds that chain only, as does the row of its line. Rounds grow with how deep parallel ways are nested, not with the graph.
    """
    line = F.col("points").cast(POINTS) if "points" in edges.columns else F.array().cast(POINTS)
    now = written(edges.select("a", "b", F.col("length").cast("double"), F.col("risk").cast("double"), F.col("rank").cast("int"), F.lit(1).cast("long").alias("segments"), line.alias("points")), "contract")
    while True:
        ends = now.select(F.explode(F.array("a", "b")).alias("id"))
        inner = written(ends.groupBy("id").count().where("count = 2").select("id"), "contract-inner")
        if inner.isEmpty():
            return now
        now = written(_round(now, inner), "contract")


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges (``a``, ``b``) of the connected component of most nodes; of equal ones that of the least node."""
    parts = written(connected_components(edges, "a", "b"), "largest-parts")
    best = parts.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return edges.join(shuffled(parts.join(F.broadcast(best), "component", "left_semi").select(F.col("node").alias("a"))), "a", "left_semi")


def web_graph(edges: DataFrame, tolerance: float, scale: float = 1e5) -> tuple[DataFrame, DataFrame]:
    """The largest component of contracted edges as whole numbers: nodes (``node`` from 0 by id, ``id``) and edges (``edge`` from 0, ``u``, ``v``, ``length``, ``risk``, ``class``, ``points``).

    Lengths in metres, risk in 254ths, classes 0 to 2, lines simplified within the tolerance and in 1/scale degrees; edges lie in the order of their ends.
    """
    kept = written(largest_component(edges), "web-edges")
    ids = numbered(kept.select(F.explode(F.array("a", "b")).alias("id")).distinct(), ["id"], "place")
    nodes = written(ids.select((F.col("place") - 1).alias("node"), "id"), "web-nodes")
    lines = simplify(kept.select(F.struct("a", "b").alias("line"), "points"), tolerance)
    both = kept.drop("points").join(shuffled(lines), (F.col("line.a") == F.col("a")) & (F.col("line.b") == F.col("b")))
    ended = both.join(shuffled(nodes.select(F.col("id").alias("a"), F.col("node").alias("u"))), "a").join(shuffled(nodes.select(F.col("id").alias("b"), F.col("node").alias("v"))), "b")
    whole = lambda x: F.round(x * scale).cast("int")
    rows = ended.select(
        "u", "v", F.round("length").cast("long").alias("length"), F.greatest(F.lit(0), F.least(F.lit(254), F.round(F.col("risk") * 254).cast("int"))).alias("risk"), places.class_code(F.col("rank")).alias("class"),
        F.transform("points", lambda p: F.struct(whole(p["x"]).alias("x"), whole(p["y"]).alias("y"))).alias("points"),
    )
    return nodes, numbered(rows, ["u", "v"], "place").withColumn("edge", F.col("place") - 1).drop("place")
