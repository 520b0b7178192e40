"""Roads as lines: chains merged to polylines, simplification to a number of vertices, and what is displayed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import constants as K
from gridloom.functions.geo import KM_LAT, KM_LON
from gridloom.operators import network, noding, places
from gridloom.operators.components import connected_components
from gridloom.operators.skew import shuffled
from gridloom.session import written


def one_way_each(edges: DataFrame) -> DataFrame:
    """One edge for each pair of nodes whatever its direction: the one of least (``src``, ``dst``). ``edges`` have ``src``, ``dst`` and ``points``."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    return edges.groupBy(*pair).agg(F.min_by(F.struct("src", "dst", *others), F.struct("src", "dst", F.size("points"))).alias("e")).select("e.*")


def joined_line(pieces: list[dict]) -> list[dict]:
    """The polyline of a chain's pieces (``src``, ``dst``, ``points``; in the order of their ends): from its end of smaller node, or round from the least node of a ring."""
    at: dict[int, list[int]] = {}
    for k, p in enumerate(pieces):
        at.setdefault(p["src"], []).append(k)
        at.setdefault(p["dst"], []).append(k)
    ends = [n for n, ks in at.items() if len(ks) == 1]
    node, used, line = min(ends or at), set(), []
    while (todo := [k for k in at[node] if k not in used]):
        k = min(todo)
        used.add(k)
        p = pieces[k]
        node, points = (p["dst"], p["points"]) if node == p["src"] else (p["src"], p["points"][::-1])
        line += points[1:] if line else points
    return line


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the line of their ``pieces`` as ``points``."""
    for batch in batches:
        pieces = batch.column("pieces")
        lines = pa.array([joined_line(p) for p in pieces.to_pylist()], type=pieces.type.value_type.field("points").type)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("line", "length", "risk", "n")), lines], names=["line", "length", "risk", "n", "points"])


def merged_lines(edges: DataFrame) -> DataFrame:
    """``line`` (a key), ``points``, ``length``, length-weighted ``risk`` and number of ``pieces`` of the roads that edges (``src``, ``dst``, ``points``, ``length``, ``risk``) make.

    Pieces join where just two of them meet; a ring without a junction is one closed line. Loops at a junction stay lines of their own. A line is put together in
    one task, which holds that line's pieces only; a piece that joins no other one is a line as it is. Lengths and risks that are missing count as 0.
    """
    pieces = written(one_way_each(edges), "road-pieces")
    ends = pieces.select(F.explode(F.array("src", "dst")).alias("id"))
    inner = written(ends.groupBy("id").count().where("count = 2").select("id"), "road-joints")
    marked = pieces.join(shuffled(inner.select(F.col("id").alias("src"), F.lit(True).alias("ia"))), "src", "left").join(shuffled(inner.select(F.col("id").alias("dst"), F.lit(True).alias("ib"))), "dst", "left")
    points = F.transform("points", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("points")
    marked = written(marked.select("src", "dst", points, F.col("length").cast("double"), F.col("risk").cast("double"), F.coalesce("ia", F.lit(False)).alias("ia"), F.coalesce("ib", F.lit(False)).alias("ib")), "road-marked")
    inside = marked.where("ia AND ib").select("src", "dst")
    chains = connected_components(inside.union(inner.select("id", "id")))
    keyed = marked.where("ia OR ib").withColumn("node", F.when(F.col("ia"), F.col("src")).otherwise(F.col("dst"))).join(shuffled(chains), "node")
    gathered = keyed.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "points", "length", "risk"))).alias("pieces"))

    known = lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))
    total = lambda of: F.aggregate("pieces", F.lit(0.0), lambda s, p: s + known(of(p)))
    mean = lambda x: F.when(F.col("length") != 0, x / F.col("length")).otherwise(0.0)
    summed = gathered.withColumns({"length": total(lambda p: p["length"]), "risk": total(lambda p: p["length"] * p["risk"]), "n": F.size("pieces").cast("long")})
    way = F.transform("pieces", lambda p: F.struct(p["src"].alias("src"), p["dst"].alias("dst"), p["points"].alias("points")))
    chained = summed.select(F.concat(F.lit("c"), "component").alias("line"), way.alias("pieces"), "length", mean(F.col("risk")).alias("risk"), "n").mapInArrow(_joined, f"line string, length double, risk double, n long, points {network.POINTS}")

    own = marked.where("NOT ia AND NOT ib").withColumns({"length": known(F.col("length")), "risk": known(F.col("length") * F.col("risk"))})
    key = F.concat_ws("-", F.lit("e"), F.least("src", "dst"), F.greatest("src", "dst"))
    ahead = F.when(F.col("src") > F.col("dst"), F.reverse("points")).otherwise(F.col("points"))
    alone = own.select(key.alias("line"), "length", mean(F.col("risk")).alias("risk"), F.lit(1).cast("long").alias("n"), ahead.alias("points"))
    return chained.unionByName(alone).select("line", "points", "length", "risk", F.col("n").alias("pieces"))


def noded_lines(edges: DataFrame) -> DataFrame:
    """merged_lines() of roads that are first split wherever they cross, touch or overlap, with or without a shared node; lines have no risk of their own."""
    return merged_lines(noding.as_edges(noding.noded(noding.segments(one_way_each(edges))))).drop("risk")


def simplify_metres(lines: DataFrame, tolerance: float, latitude: float) -> DataFrame:
    """network.simplify() with a tolerance in metres: on the plane that touches at a latitude, and back to degrees."""
    kx, ky = KM_LON * 1000 * float(np.cos(np.radians(latitude))), KM_LAT * 1000
    plane = lines.withColumn("points", F.transform("points", lambda p: F.struct((p["x"] * kx).alias("x"), (p["y"] * ky).alias("y"))))
    return network.simplify(plane, tolerance).withColumn("points", F.transform("points", lambda p: F.struct((p["x"] / kx).alias("x"), (p["y"] / ky).alias("y"))))


def capped_lines(
    edges: DataFrame, latitude: float, classes: Sequence[str] = K.MERGE_CLASSES, tolerance: float = K.MERGE_SIMPLIFY_M, most: int = K.MERGE_VERTICES, doublings: int = K.MERGE_DOUBLINGS
) -> tuple[DataFrame, tuple[str, ...], float]:
    """Merged roads of the classes (most important first) with at most ``most`` vertices, the classes that stayed, and the tolerance in metres.

    The tolerance doubles up to ``doublings`` trials; then the least important class goes and the trials begin again. No class left is an error.
    """
    left = list(classes)
    while left:
        chosen = edges.where(places.shows(F.col("highway"), tuple(left)))
        lines = written(noded_lines(chosen), "road-lines")
        metres = float(tolerance)
        for _ in range(doublings):
            simple = written(simplify_metres(lines, metres, latitude).where(F.size("points") >= 2), "road-simple")
            vertices = simple.agg(F.coalesce(F.sum(F.size("points")), F.lit(0))).first()[0]
            if vertices <= most:
                break
            metres *= 2
        if 0 < vertices <= most:
            return simple, tuple(left), metres
        left.pop()
    raise ValueError("no road is of one of the classes")


def display_roads(edges: DataFrame, classes: Sequence[str] = K.DISPLAY_CLASSES, tolerance: float = K.DISPLAY_SIMPLIFY_DEG) -> DataFrame:
    """``highway`` (the first class by name), ``risk`` to three digits and simplified ``points`` of each edge of the displayed classes."""
    chosen = edges.where(places.shows(F.col("highway"), tuple(classes)))
    rows = chosen.select(F.struct("src", "dst", F.col("highway").alias("of")).alias("line"), F.array_min(places.highway_values(F.col("highway"))).alias("highway"), F.round("risk", 3).alias("risk"), "points")
    simple = network.simplify(rows.select("line", "points"), tolerance)
    return rows.drop("points").join(simple, "line").select("line.src", "line.dst", "highway", "risk", "points")

