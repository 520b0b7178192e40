"""Shortest ways on networks that no single task can hold: the network is cut by tiles, and distances move from tile to tile.

In each round every tile whose border got nearer runs one heap search of its own, from the nodes that got nearer, and offers distances to the tiles that its edges lead to.
The rounds are the tiles that a shortest way enters, not its edges; tiles grow with the network, so that there are at most about TILES of them whatever its size.
"""

from __future__ import annotations

import functools
import heapq
import pickle
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import written

#: Nodes that a tile holds at most, unless there would be more than TILES full ones.
TILE_NODES, TILES = 40_000, 2_048
#: Halvings of the bounding box; nodes that lie closer than its part are told apart by a hash.
DEPTH = 15
_OFFERS = "array<struct<tile: string, node: long, distance: double, before: long>>"


def tiles(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """``id`` and ``tile`` of nodes (``id``, ``x``, ``y``): squares of a quadtree that hold at most ``most`` nodes."""
    n, x0, x1, y0, y1 = nodes.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    most = most or max(TILE_NODES, -(-n // TILES))
    place = lambda c, low, high: F.least(F.lit((1 << DEPTH) - 1), F.floor((F.col(c) - F.lit(low)) / F.lit((high - low) or 1.0) * (1 << DEPTH))).cast("int")
    fine = nodes.select("id", place("x", x0, x1).alias("px"), place("y", y0, y1).alias("py")) if n else nodes.select("id", F.lit(0).alias("px"), F.lit(0).alias("py"))
    levels = F.explode(F.transform(F.sequence(F.lit(0), F.lit(DEPTH)), lambda d: F.struct(d.alias("depth"), F.floor(F.col("px") / F.pow(F.lit(2), DEPTH - d)).cast("int").alias("px"), F.floor(F.col("py") / F.pow(F.lit(2), DEPTH - d)).cast("int").alias("py"))))
    counted = fine.groupBy("px", "py").agg(F.count("*").alias("n")).select("n", levels.alias("c")).groupBy("c").agg(F.sum("n").alias("n"))
    full = written(counted.where(F.col("n") > most).select("c", "n"), "tiles-full")
    deepest = fine.select("id", "px", "py", levels.alias("c")).join(full, "c").groupBy("id").agg(F.max(F.struct(F.col("c.depth").alias("depth"), "n")).alias("m"))
    placed = fine.join(deepest, "id", "left").withColumn("depth", F.least(F.lit(DEPTH), F.coalesce(F.col("m.depth") + 1, F.lit(0))))
    crowded = F.coalesce(F.col("m.depth") == DEPTH, F.lit(False))
    part = F.when(crowded, F.pmod(F.xxhash64("id"), F.ceil(F.col("m.n") / most))).otherwise(F.lit(0))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2), DEPTH - F.col("depth"))).cast("int")
    return placed.select("id", F.concat_ws(":", "depth", at("px"), at("py"), part).alias("tile"))


class Tile:
    """The nodes of a tile, its inner edges packed by their start, and the edges that leave it."""

    def __init__(self, name: str, nodes: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, to: np.ndarray):
        self.ids = np.unique(nodes)
        inner = to == name
        start, end = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst[inner])
        order = np.argsort(start[inner], kind="stable")
        self.offsets = np.searchsorted(start[inner][order], np.arange(len(self.ids) + 1)).astype(np.int64)
        self.ends, self.weights = end[order].astype(np.int32), weight[inner][order]
        self.out = (start[~inner].astype(np.int32), dst[~inner], weight[~inner], to[~inner])

    def nearer(self, distance: np.ndarray, before: np.ndarray, offers: Iterable) -> np.ndarray:
        """Take the offers (``node``, ``distance``, ``before``) that are nearer and move on inside the tile; which nodes got nearer. Equal distances keep the node before."""
        moved = np.zeros(len(self.ids), bool)
        heap = []
        for o in offers:
            at = int(np.searchsorted(self.ids, o["node"]))
            if o["distance"] < distance[at]:
                distance[at], before[at], moved[at] = o["distance"], -1 if o["before"] is None else o["before"], True
                heap.append((o["distance"], at))
        if not heap:
            return moved
        heapq.heapify(heap)
        best, prior, changed = distance.tolist(), before.tolist(), set(np.flatnonzero(moved).tolist())
        offsets, ends, weights, ids = self.offsets.tolist(), self.ends.tolist(), self.weights.tolist(), self.ids.tolist()
        while heap:
            d, at = heapq.heappop(heap)
            if d > best[at]:
                continue
            for e in range(offsets[at], offsets[at + 1]):
                end = ends[e]
                if (far := d + weights[e]) < best[end]:
                    best[end], prior[end] = far, ids[at]
                    changed.add(end)
                    heapq.heappush(heap, (far, end))
        distance[:], before[:] = best, prior
        moved[list(changed)] = True
        return moved

    def offers(self, distance: np.ndarray, moved: np.ndarray) -> list[dict]:
        """What nodes that got nearer offer across the border: of several to a node the least."""
        start, node, weight, to = self.out
        found: dict[int, tuple] = {}
        for k in np.flatnonzero(moved[start]):
            offer = (float(distance[start[k]] + weight[k]), int(self.ids[start[k]]), to[k])
            if node[k] not in found or offer < found[node[k]]:
                found[node[k]] = offer
        return [{"tile": t, "node": int(n), "distance": d, "before": b} for n, (d, b, t) in found.items()]


class Tiled:
    """A network cut by tiles: ``edges`` (``src``, ``dst`` and a weight, one edge for each pair) and the places of its ``nodes`` (``id``, ``x``, ``y``)."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, weight: str, most: int | None = None):
        self.places = written(tiles(nodes, most), "tiled-places")
        own = self.places.withColumnRenamed("id", "src")
        ahead = edges.select("src", "dst", F.col(weight).cast("double").alias("weight")).join(own, "src").join(self.places.select(F.col("id").alias("dst"), F.col("tile").alias("to")), "dst")
        alone = self.places.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("weight"), "tile", F.lit("").alias("to"))

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            name, e = rows["tile"].iloc[0], rows[rows["dst"].notna()]
            tile = Tile(name, rows["src"].to_numpy(), e["src"].to_numpy(), e["dst"].to_numpy().astype(np.int64), e["weight"].to_numpy(), e["to"].to_numpy(dtype=object))
            return pd.DataFrame({"tile": [name], "pack": [pickle.dumps(tile, protocol=5)]})

        rows = ahead.select("src", "dst", "weight", "tile", "to").unionByName(alone)
        self.packs = written(rows.groupBy("tile").applyInPandas(pack, "tile string, pack binary"), "tiled-packs")
        self.rounds = 0

    def search(self, seeds: DataFrame, max_rounds: int = 100_000) -> DataFrame:
        """State of each (``origin``, ``tile``) that ``seeds`` (``origin``, ``node``, ``distance``) reach: packed distances and nodes before, in the order of the tile's nodes."""
        kind = seeds.schema["origin"].dataType.simpleString()
        start = seeds.join(self.places, seeds["node"] == self.places["id"]).select("origin", "tile", "node", F.col("distance").cast("double").alias("distance"), F.lit(None).cast("long").alias("before"))
        offers = written(start, "tiled-offers")
        state = written(offers.select("origin", "tile", F.lit(None).cast("binary").alias("distances"), F.lit(None).cast("binary").alias("befores")).limit(0), "tiled-state")

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            r = rows.iloc[0]
            tile: Tile = pickle.loads(r["pack"])
            new = r["distances"] is None
            distance = np.full(len(tile.ids), np.inf) if new else np.frombuffer(r["distances"]).copy()
            before = np.full(len(tile.ids), -1, np.int64) if new else np.frombuffer(r["befores"], np.int64).copy()
            moved = tile.nearer(distance, before, r["offers"])
            return pd.DataFrame({"origin": [r["origin"]], "tile": [r["tile"]], "distances": [distance.tobytes()], "befores": [before.tobytes()], "offers": [tile.offers(distance, moved)]})

        for _ in range(max_rounds):
            best = offers.groupBy("origin", "tile", "node").agg(F.min(F.struct("distance", "before")).alias("m"))
            asked = best.groupBy("origin", "tile").agg(F.collect_list(F.struct("node", F.col("m.distance").alias("distance"), F.col("m.before").alias("before"))).alias("offers"))
            active = written(asked, "tiled-asked")
            if active.isEmpty():
                return state
            self.rounds += 1
            ready = active.join(state, ["origin", "tile"], "left").join(self.packs, "tile")
            done = written(ready.groupBy("origin", "tile").applyInPandas(run, f"origin {kind}, tile string, distances binary, befores binary, offers {_OFFERS}"), "tiled-done")
            state = written(state.join(active, ["origin", "tile"], "left_anti").unionByName(done.drop("offers")), "tiled-state")
            offers = done.select("origin", F.explode("offers").alias("o")).select("origin", "o.*")
        raise RuntimeError("distances did not settle")

    def distances(self, state: DataFrame) -> DataFrame:
        """``origin``, ``node``, ``distance`` and ``before`` (null at the start) of all nodes that a search reached."""
        kind = state.schema["origin"].dataType.simpleString()

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            r = rows.iloc[0]
            ids, distance, before = pickle.loads(r["pack"]).ids, np.frombuffer(r["distances"]), np.frombuffer(r["befores"], np.int64)
            met = np.isfinite(distance)
            return pd.DataFrame({"origin": r["origin"], "node": ids[met], "distance": distance[met], "before": pd.array(np.where(before[met] < 0, None, before[met]), dtype="Int64")})

        return state.join(self.packs, "tile").groupBy("origin", "tile").applyInPandas(run, f"origin {kind}, node long, distance double, before long")

    def paths(self, state: DataFrame, pairs: DataFrame) -> DataFrame:
        """``origin``, ``dest`` and ``path`` (nodes) of reached pairs: all walk back together, through one tile in each round."""
        kind = state.schema["origin"].dataType.simpleString()
        ahead = pairs.select("origin", "dest").distinct().select("origin", "dest", F.col("dest").alias("at"), F.array().cast("array<long>").alias("path"))
        finished = []

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            r, out = rows.iloc[0], []
            ids, distance, before = pickle.loads(r["pack"]).ids, np.frombuffer(r["distances"]), np.frombuffer(r["befores"], np.int64)
            for w in r["walks"]:
                way, at = [], w["at"]
                while True:
                    k = int(np.searchsorted(ids, at))
                    if k >= len(ids) or ids[k] != at or not np.isfinite(distance[k]):
                        break
                    way.append(int(at))
                    at = int(before[k])
                    if at < 0:
                        break
                if way:
                    out.append((r["origin"], w["dest"], None if at < 0 else at, [*way[::-1], *w["path"]]))
            return pd.DataFrame(out, columns=["origin", "dest", "at", "path"]).astype({"at": "Int64"})

        while True:
            asked = ahead.join(self.places.select(F.col("id").alias("at"), "tile"), "at").groupBy("origin", "tile").agg(F.collect_list(F.struct("dest", "at", "path")).alias("walks"))
            ready = asked.join(state, ["origin", "tile"]).join(self.packs, "tile")
            moved = written(ready.groupBy("origin", "tile").applyInPandas(run, f"origin {kind}, dest long, at long, path array<long>"), "tiled-paths")
            finished.append(moved.where("at IS NULL").select("origin", "dest", "path"))
            ahead = moved.where("at IS NOT NULL")
            if ahead.isEmpty():
                return functools.reduce(DataFrame.union, finished)
            if len(finished) >= 32:
                finished = [written(functools.reduce(DataFrame.union, finished), "tiled-finished")]
