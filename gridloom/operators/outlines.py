"""Outlines of zones: the rings around sets of cells, from their boundary sides."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.network import POINTS
from gridloom.operators.rasters import Grid
from gridloom.operators.roads import simplify_metres


def boundary_sides(zones: DataFrame) -> DataFrame:
    """``component`` and the directed sides (``r0``, ``c0`` to ``r1``, ``c1``, corners of the grid) that cells (``r``, ``c``, ``component``) share with no cell of theirs; the inside lies on the right.

    A side between two cells of a component occurs once in each direction, so they cancel in one aggregation.
    """
    corners = ((0, 0, 0, 1), (0, 1, 1, 1), (1, 1, 1, 0), (1, 0, 0, 0))
    sides = F.array(*[F.struct((F.col("r") + a).alias("r0"), (F.col("c") + b).alias("c0"), (F.col("r") + x).alias("r1"), (F.col("c") + y).alias("c1")) for a, b, x, y in corners])
    each = zones.select("component", F.explode(sides).alias("s"))
    ends = F.array_sort(F.array(*[F.struct(F.col(f"s.r{i}").alias("r"), F.col(f"s.c{i}").alias("c")) for i in (0, 1)]))
    single = each.groupBy("component", ends.alias("ends")).agg(F.count("*").alias("n"), F.first("s").alias("s")).where("n = 1")
    return single.select("component", "s.*")


def traced(sides: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings of corners (row, column; first and last the same) from directed sides. Where two rings touch each takes the right turn, so none crosses itself; corners on straight lines are left out."""
    onward: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r0, c0, r1, c1 in sorted(sides):
        onward.setdefault((r0, c0), []).append((r1, c1))
    rings = []
    while onward:
        start = min(onward)
        ring, at, way = [start], start, None
        while True:
            choices = onward[at]
            if way is not None and len(choices) > 1:  # of two ways on, the one that turns right
                right = (at[0] + way[1], at[1] - way[0])
                step = right if right in choices else choices[0]
            else:
                step = choices[0]
            choices.remove(step)
            if not choices:
                del onward[at]
            way, at = (step[0] - at[0], step[1] - at[1]), step
            ring.append(at)
            if at == start:
                break
        turns = [p for before, p, after in zip([ring[-2], *ring[:-2]], ring[:-1], ring[1:], strict=True) if (p[0] - before[0], p[1] - before[1]) != (after[0] - p[0], after[1] - p[1])]
        rings.append([*turns, turns[0]])
    return rings


def outlines(zones: DataFrame, grid: Grid, tolerance_m: float = 0.0) -> DataFrame:
    """``component``, ``ring`` (from 1, outer ones first), ``hole``, ``cells`` (the ring's area; negative for holes) and closed ``points`` (lon x, lat y), simplified if ``tolerance_m``.

    A zone's rings are traced in one task, from its boundary sides alone.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for ring in traced(list(frame[["r0", "c0", "r1", "c1"]].itertuples(index=False, name=None))):
            area = sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:], strict=False)) / 2
            rows.append((area, [{"x": grid.west + c * grid.dx, "y": grid.north - r * grid.dy} for r, c in ring]))
        rows.sort(key=lambda x: -x[0])
        return pd.DataFrame([(frame["component"].iloc[0], i + 1, a < 0, a, p) for i, (a, p) in enumerate(rows)], columns=["component", "ring", "hole", "cells", "points"])

    found = boundary_sides(zones).groupBy("component").applyInPandas(run, f"component long, ring int, hole boolean, cells double, points {POINTS}")
    if not tolerance_m:
        return found
    keyed = found.select(F.struct("component", "ring").alias("line"), "hole", "cells", "points")
    middle = grid.north - grid.rows * grid.dy / 2
    simple = simplify_metres(keyed.select("line", "points"), tolerance_m, middle)
    return keyed.drop("points").join(simple, "line").select("line.component", "line.ring", "hole", "cells", "points")
