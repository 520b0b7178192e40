"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.skew import shuffled
from gridloom.session import written

#: Different edges up to which one task joins the sets itself: a table of a few hundred kilobytes, whose size is checked.
ONE_TASK_EDGES = 20_000


def _joined_sets(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` of a small table of edges (u, v) by union-find in one task."""
    kind = edges.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        arrow = None
        for batch in batches:
            arrow = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        if parent:
            nodes = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, type=arrow), pa.array([root(n) for n in nodes], type=arrow)], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _to_minimum(arcs: DataFrame) -> DataFrame:
    """``arcs`` (u, v) with ``m``: the least of u and all its v. The minimum is aggregated before the shuffle; a hub's rows can be split in the join."""
    return arcs.join(shuffled(arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))), "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """``node`` and ``component`` (the least node of its component) for every node on an edge.

    Direction, repeated edges and loops don't matter; edges with a null end are left out; no edges give no rows. Each
    round is written to the shared folder, so lineage stays short; the rounds grow with the logarithm of the number of nodes.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    now = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    if now.count() <= ONE_TASK_EDGES:
        return _joined_sets(now)
    loops, now = now.where("u = v"), now.where("u > v")
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _to_minimum(large)
        arcs = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = written(arcs.where("u > v").distinct(), "components")
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).union(loops.select("u", "u"))
    return ends.groupBy("node").agg(F.min("component").alias("component"))
