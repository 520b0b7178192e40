"""Raster operators on cell tables (``r``, ``c``, bands): bounds, resampling, gradients, focal windows, temporal reducers."""

from __future__ import annotations

import functools
import math
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.projections import TransverseMercator
from gridloom.functions.cells import dequantise, rescale
from gridloom.operators.quantiles import quantiles
from gridloom.session import written


#: Rows and columns of a tile, the unit of work of windows.
TILE = 256


def bounds(cells: DataFrame, bands: Sequence[str], winsor: float | None = 0.99) -> DataFrame:
    """One row: ``<band>_lo`` and ``<band>_hi`` of each band. ``cells`` should be a written table: it is read more than once.

    The high bound is the winsor quantile where that exceeds the minimum, else the maximum. A band without any value is an error: there is nothing to rescale.
    """
    ends = cells.agg(*[F.min(b).cast("double").alias(f"{b}_lo") for b in bands], *[F.max(b).cast("double").alias(f"{b}_hi") for b in bands])
    known = [F.when(F.col(f"{b}_lo").isNull(), F.raise_error(F.lit(f"band {b} has no valid cell"))).otherwise(F.col(f"{b}_lo")).alias(f"{b}_lo") for b in bands]
    if winsor is None:
        return ends.select(*known, *[f"{b}_hi" for b in bands])
    tops = quantiles(cells, {f"{b}_top": (b, [winsor]) for b in bands})
    high = [F.when(F.col(f"{b}_top")[0] > F.col(f"{b}_lo"), F.col(f"{b}_top")[0]).otherwise(F.col(f"{b}_hi")).alias(f"{b}_hi") for b in bands]
    return ends.join(F.broadcast(tops), how="cross").select(*known, *high)


def normalise(cells: DataFrame, bands: Sequence[str], limits: DataFrame | None = None) -> DataFrame:
    """The bands rescaled to 0 to 1 by their bounds; the bounds are one row, so the product with it moves no cells.

    Without ``limits`` the cells are written first: they are read for their number, for the bounds, and to be rescaled.
    """
    if limits is None:
        cells = written(cells, "cells")
        limits = bounds(cells, bands)
    both = cells.join(F.broadcast(limits), how="cross")
    return both.withColumns({b: rescale(F.col(b), F.col(f"{b}_lo"), F.col(f"{b}_hi")) for b in bands}).drop(*limits.columns)


def disc(radius: float, step: float = 1.0) -> list[tuple[int, int]]:
    """Offsets of cells whose centres are within the radius."""
    k = int(radius // step)
    return [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if math.hypot(i, j) * step <= radius + 1e-9]


def square(k: int) -> list[tuple[int, int]]:
    """Offsets of a square of side 2k + 1."""
    return [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1)]


def diamond(k: int) -> list[tuple[int, int]]:
    """Offsets at most k steps away along rows and columns."""
    return [(i, j) for i, j in square(k) if abs(i) + abs(j) <= k]


def spread(cells: DataFrame, offsets: Sequence[tuple[int, int]], columns: Sequence[str | Column], weights: Sequence[float] | None = None) -> DataFrame:
    """Each cell's columns handed to the cells around it, with ``weight`` if given: rows times offsets, before a partial aggregation."""
    rows = [F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc"), *([F.lit(float(weights[n])).alias("weight")] if weights else [])) for n, (i, j) in enumerate(offsets)]
    moved = cells.withColumn("o", F.explode(F.array(*rows)))
    return moved.select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), *columns, *([F.col("o.weight").alias("weight")] if weights else []))


def _windowed(cells: DataFrame, value: str, halo: int, outs: Sequence[str], run: Callable[[np.ndarray], list[np.ndarray]], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``r``, ``c`` and ``outs`` of each cell from the square around its tile: ``run`` gets a tile's values with ``halo`` cells on each side (NaN where there is none) and returns arrays of the tile.

    A cell goes to its tile and to those whose halo it lies in, about 1.1 copies in all, whatever the size of the window.
    """

    def reached(axis: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(axis) - halo) / TILE).cast("long"), F.floor((F.col(axis) + halo) / TILE).cast("long")))

    copies = cells.select(*by, "r", "c", F.col(value).cast("double").alias("v")).withColumn("tr", reached("r")).withColumn("tc", reached("c"))
    side = TILE + 2 * halo

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        r, c = (frame[x].to_numpy() - frame[f"t{x}"].to_numpy() * TILE for x in "rc")
        grid = np.full((side, side), np.nan)
        grid[r + halo, c + halo] = frame["v"].to_numpy(dtype=float)
        own = (r >= 0) & (r < TILE) & (c >= 0) & (c < TILE)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # windows without any value
            found = run(grid)
        return frame.loc[own, [*by, "r", "c"]].assign(**{name: x[r[own], c[own]] for name, x in zip(outs, found, strict=True)})

    fields = [*(cells.schema[x] for x in by), T.StructField("r", T.LongType()), T.StructField("c", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in outs)]
    return copies.withColumns({"r": F.col("r").cast("long"), "c": F.col("c").cast("long")}).groupBy(*by, "tr", "tc").applyInPandas(tile, T.StructType(fields))


def _shifted(grid: np.ndarray, halo: int, i: int, j: int) -> np.ndarray:
    """The tile's neighbours at an offset."""
    return grid[halo + i : halo + i + TILE, halo + j : halo + j + TILE]


def _halo(offsets: Sequence[tuple[int, int]]) -> int:
    return max((max(abs(i), abs(j)) for i, j in offsets), default=0)


def focal(cells: DataFrame, value: str, offsets: Sequence[tuple[int, int]], how: str = "mean", out: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """The ``mean``, ``max`` or ``median`` of each cell's window, for the cells that are there (a grid for each value of ``by``); null and missing neighbours don't count, null without any."""
    halo = _halo(offsets)

    def run(grid: np.ndarray) -> list[np.ndarray]:
        near = (_shifted(grid, halo, i, j) for i, j in offsets)
        if how == "median":
            return [np.nanmedian(np.stack(list(near)), axis=0)]
        if how == "max":
            return [functools.reduce(np.fmax, near)]
        total, n = np.zeros((TILE, TILE)), np.zeros((TILE, TILE))
        for x in near:
            total += np.nan_to_num(x)
            n += ~np.isnan(x)
        return [np.where(n > 0, total / np.maximum(n, 1), np.nan)]

    if how not in ("mean", "max", "median"):
        raise ValueError(f"no window statistic {how}")
    return _windowed(cells, value, halo, [out], run, by)


def gaussian(radius: int, sigma: float) -> tuple[list[tuple[int, int]], list[float]]:
    """Offsets of a disc and Gaussian weights that add up to 1."""
    offsets = disc(radius)
    weights = [math.exp(-(i * i + j * j) / (2 * sigma * sigma)) for i, j in offsets]
    return offsets, [w / sum(weights) for w in weights]


def density(cells: DataFrame, value: str, radius: int, sigma: float, out: str = "density") -> DataFrame:
    """Kernel density: ``r``, ``c`` and the weighted sum of values around each cell; null without any."""
    offsets, weights = gaussian(radius, sigma)
    halo = _halo(offsets)

    def run(grid: np.ndarray) -> list[np.ndarray]:
        total, seen = np.zeros((TILE, TILE)), np.zeros((TILE, TILE), dtype=bool)
        for (i, j), w in zip(offsets, weights, strict=True):
            x = _shifted(grid, halo, i, j)
            total += np.nan_to_num(x) * w
            seen |= ~np.isnan(x)
        return [np.where(seen, total, np.nan)]

    return _windowed(cells, value, halo, [out], run)


def dilate(marked: DataFrame, steps: int = 2) -> DataFrame:
    """The marked cells and all cells within ``steps`` of them along rows and columns."""
    return spread(marked, diamond(steps), []).distinct()


def downsample(cells: DataFrame, k: int, bands: Sequence[str]) -> DataFrame:
    """Means over blocks of k by k cells."""
    return cells.groupBy(F.floor(F.col("r") / k).cast("long").alias("r"), F.floor(F.col("c") / k).cast("long").alias("c")).agg(*[F.avg(b).alias(b) for b in bands])


def gradient(cells: DataFrame, value: str, step: float) -> DataFrame:
    """``r``, ``c``, ``gr`` and ``gc``: central differences along rows and columns; a missing neighbour is replaced by the cell itself, and without both there is no slope."""

    def run(grid: np.ndarray) -> list[np.ndarray]:
        own, out = _shifted(grid, 1, 0, 0), []
        for i, j in ((1, 0), (0, 1)):
            ahead, behind = _shifted(grid, 1, i, j), _shifted(grid, 1, -i, -j)
            span = (~np.isnan(ahead)).astype(float) + ~np.isnan(behind)
            rise = np.where(np.isnan(ahead), own, ahead) - np.where(np.isnan(behind), own, behind)
            out.append(np.nan_to_num(np.where(span > 0, rise / np.maximum(span * step, 1e-300), 0.0)))
        return out

    return _windowed(cells, value, 1, ["gr", "gc"], run)


def slope(cells: DataFrame, value: str, step: float) -> DataFrame:
    """``r``, ``c`` and ``slope`` in degrees from the gradient."""
    return gradient(cells, value, step).withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("gr") * F.col("gr") + F.col("gc") * F.col("gc"))))).drop("gr", "gc")


def hillshade(cells: DataFrame, value: str, step: float, light: tuple[float, float, float] = (-0.5, 0.8, -0.4)) -> DataFrame:
    """``r``, ``c`` and ``shade``: the diffuse part of a fixed light on the surface."""
    length = math.sqrt(sum(x * x for x in light))
    x, y, z = (v / length for v in light)
    dot = (-F.col("gc") * x + y - F.col("gr") * z) / F.sqrt(F.col("gr") * F.col("gr") + F.col("gc") * F.col("gc") + 1)
    return gradient(cells, value, step).withColumn("shade", F.greatest(dot, F.lit(0.0))).drop("gr", "gc")


def bilinear(points: DataFrame, cells: DataFrame, value: str, out: str = "value") -> DataFrame:
    """``points`` (``id``, ``y``, ``x`` in cell units) with the value between the four cells around; null if one of them is missing."""
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    at = points.withColumn("k", corners).withColumns({"r": (F.floor("y") + F.col("k.i")).cast("long"), "c": (F.floor("x") + F.col("k.j")).cast("long")})
    part = (1 - F.abs(F.col("y") - F.col("r"))) * (1 - F.abs(F.col("x") - F.col("c")))
    found = at.withColumn("w", part).join(cells.select("r", "c", F.col(value).alias("__v")), ["r", "c"], "left")
    return found.groupBy("id").agg(F.when(F.count(F.when((F.col("w") > 0) & F.col("__v").isNull(), 1)) == 0, F.sum(F.col("w") * F.coalesce("__v", F.lit(0.0)))).alias(out))


def histogram(values: DataFrame, value: str, buckets: int = 255, least_width: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """``bin``, ``n`` and ``mean`` of equal-width buckets over each group's range, not narrower than ``least_width``.

    Without groups the limits are one row; with groups their join is left to the planner, which knows how many there are.
    """
    limits = values.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    both = values.join(limits, list(by)) if by else values.join(F.broadcast(limits), how="cross")
    width = F.greatest((F.col("hi") - F.col("lo")) / buckets, F.lit(least_width))
    bin_ = F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(buckets - 1)).cast("long")
    return both.where(F.col(value).isNotNull()).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def otsu(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``threshold`` of each group: the mean of the last lower bin at the greatest variance between classes; ties to the lower bin."""
    w = W.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy("bin")
    up_to, all_ = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    mass = F.col("n") * F.col("mean")
    sums = bins.withColumns({"n0": F.sum("n").over(up_to), "s0": F.sum(mass).over(up_to), "n1": F.sum("n").over(all_), "s1": F.sum(mass).over(all_)})
    apart = F.try_divide(F.col("s0"), F.col("n0")) - F.try_divide(F.col("s1") - F.col("s0"), F.col("n1") - F.col("n0"))
    between = F.col("n0") * (F.col("n1") - F.col("n0")) * apart * apart
    return sums.withColumn("between", F.coalesce(between, F.lit(0.0))).groupBy(*by).agg(F.max_by("mean", F.struct("between", (-F.col("bin")).alias("b"))).alias("threshold"))


def guarded(threshold: Column, fallback: float, low: float, high: float) -> Column:
    """A threshold inside its range; the fallback where there is none."""
    return F.least(F.greatest(F.coalesce(threshold, F.lit(fallback)), F.lit(low)), F.lit(high))


def near_segments(points: DataFrame, segments: DataFrame, limit: float) -> DataFrame:
    """``id`` and ``distance``: to the nearest segment (``ax, ay, bx, by``) up to ``limit``, else the limit.

    A range join on square buckets as wide as the limit: a segment is copied to the buckets that its box, widened by
    the limit, touches, and a point looks into its own bucket only.
    """
    from gridloom.functions.geo import segment_distance

    def span(a: str, b: str) -> Column:
        low, high = F.floor((F.least(a, b) - limit) / limit), F.floor((F.greatest(a, b) + limit) / limit)
        return F.explode(F.sequence(low.cast("long"), high.cast("long")))

    spread_out = segments.withColumn("bx_", span("ax", "bx")).withColumn("by_", span("ay", "by"))
    here = points.withColumns({"bx_": F.floor(F.col("x") / limit).cast("long"), "by_": F.floor(F.col("y") / limit).cast("long")})
    d, _ = segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return here.join(spread_out, ["bx_", "by_"], "left").groupBy("id").agg(F.least(F.coalesce(F.min(d), F.lit(limit)), F.lit(limit)).alias("distance"))


def season_max(scenes: DataFrame, months: tuple[int, int], keys: Sequence[str], value: str = "value", ts: str = "ts") -> DataFrame:
    """Greatest yearly sum over the months (both ends in), for each key."""
    seasons = scenes.where(F.month(ts).between(*months)).groupBy(*keys, F.year(ts).alias("year")).agg(F.sum(value).alias("total"))
    return seasons.groupBy(*keys).agg(F.max("total").alias("season_max"))


@dataclass(frozen=True)
class Grid:
    """The frame of a north-up grid: west and north edges, steps in degrees, rows and columns."""

    west: float
    north: float
    dx: float
    dy: float
    rows: int
    columns: int

    @property
    def shape(self) -> tuple[int, int]:
        """Rows and columns."""
        return self.rows, self.columns

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """West, south, east and north edges."""
        return self.west, self.north - self.rows * self.dy, self.west + self.columns * self.dx, self.north

    def aligned(self, other: Grid, part: float = 1e-3) -> bool:
        """Whether both have the same shape, and edges that agree to a part of a cell."""
        close = all(abs(a - b) <= part * min(self.dx, self.dy) for a, b in zip(self.bounds, other.bounds, strict=True))
        return self.shape == other.shape and close

    def cells(self, spark: SparkSession) -> DataFrame:
        """``r`` and ``c`` of all cells."""
        return spark.range(self.rows * self.columns).select(F.floor(F.col("id") / self.columns).cast("long").alias("r"), (F.col("id") % self.columns).alias("c"))


def resample(cells: DataFrame, value: str, source: Grid, target: Grid, plane: TransverseMercator | None = None) -> DataFrame:
    """``r``, ``c`` and the value at the centres of the target's cells, bilinear between the source's; edges are held half a cell beyond the outer centres, null further out.

    With a ``plane`` the target lies on it, in metres, and the source in degrees.
    """
    lon, lat = F.lit(target.west) + (F.col("c") + 0.5) * target.dx, F.lit(target.north) - (F.col("r") + 0.5) * target.dy
    if plane is not None:
        lon, lat = plane.inverse(lon, lat)
    x, y = (lon - F.lit(source.west)) / source.dx - 0.5, (F.lit(source.north) - lat) / source.dy - 0.5

    def held(place: Column, n: int) -> Column:
        return F.when((place >= -0.5) & (place <= n - 0.5), F.least(F.greatest(place, F.lit(0.0)), F.lit(float(n - 1))))

    points = target.cells(cells.sparkSession).select(F.struct("r", "c").alias("id"), held(y, source.rows).alias("y"), held(x, source.columns).alias("x"))
    found = bilinear(points.where("y IS NOT NULL AND x IS NOT NULL"), cells, value, value)
    return points.select("id").join(found, "id", "left").select("id.r", "id.c", value)


def lookup(points: DataFrame, cells: DataFrame, bands: Sequence[str], grid: Grid) -> DataFrame:
    """``points`` (``id``, ``lon``, ``lat``) with the quantised ``bands`` of the cell that holds them, back as values; null outside the grid and where there is none."""
    keyed = points.withColumns({"r": F.floor((F.lit(grid.north) - F.col("lat")) / grid.dy).cast("long"), "c": F.floor((F.col("lon") - F.lit(grid.west)) / grid.dx).cast("long")})
    return keyed.join(cells.select("r", "c", *bands), ["r", "c"], "left").select("id", *[dequantise(F.col(b)).alias(b) for b in bands])
