"""Zones: components of cells as hotspots, zonal statistics, discs around points, verdicts and settlement origins."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import constants as K
from gridloom.functions.geo import EARTH_M, band, band_width, haversine_m
from gridloom.operators.components import connected_components
from gridloom.operators.rasters import diamond, spread
from gridloom.operators.skew import numbered
from gridloom.session import written

#: Cells along a side of the tiles that components are labelled in.
LABEL_TILE = 256


def joined_sets(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least one that the pairs (a, b) join it to: roots hook onto smaller roots, then all take their root's root, until nothing changes."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if not (apart := x != y).any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (further := root[root] != root).any():
            root[further] = root[root[further]]


def _tile_labels(marked: DataFrame, columns: int) -> DataFrame:
    """``r``, ``c`` and ``label``: the least cell number of a marked cell's 8-connected set inside its tile. One task labels a tile of LABEL_TILE squared cells at most."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r, c = frame["r"].to_numpy(), frame["c"].to_numpy()
        order = np.lexsort((c, r))
        r, c = r[order], c[order]
        at = np.full((LABEL_TILE + 2, LABEL_TILE + 2), -1, np.int32)
        i, j = r % LABEL_TILE + 1, c % LABEL_TILE + 1
        at[i, j] = np.arange(len(r))
        pairs = []
        for di, dj in ((0, 1), (1, -1), (1, 0), (1, 1)):
            other = at[i + di, j + dj]
            pairs.append((at[i, j][other >= 0], other[other >= 0]))
        root = joined_sets(len(r), *(np.concatenate(p) for p in zip(*pairs, strict=True)))
        return pd.DataFrame({"r": r, "c": c, "label": (r * columns + c)[root]})

    tiled = marked.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct().withColumns({"tr": F.floor(F.col("r") / LABEL_TILE), "tc": F.floor(F.col("c") / LABEL_TILE)})
    return tiled.groupBy("tr", "tc").applyInPandas(run, "r long, c long, label long")


def cell_components(marked: DataFrame, columns: int) -> DataFrame:
    """``r``, ``c`` and ``component`` (least cell number ``r * columns + c``) of the 8-connected sets of marked cells.

    Each tile is labelled in its own task; only cells along the borders of tiles are joined to their neighbours, and only labels are joined across the whole grid.
    """
    labels = written(_tile_labels(marked, columns), "tile-labels")
    edge = lambda x: F.pmod(x, F.lit(LABEL_TILE)).isin(0, LABEL_TILE - 1)
    border = labels.where(edge("r") | edge("c"))
    ahead = spread(border, [(0, 1), (1, -1), (1, 0), (1, 1)], [F.col("label").alias("src")])
    links = ahead.join(border.withColumnRenamed("label", "dst"), ["r", "c"]).where("src <> dst").select("src", "dst").distinct()
    parts = connected_components(links).withColumnRenamed("node", "label")
    return labels.join(parts, "label", "left").select("r", "c", F.coalesce("component", "label").alias("component"))


def zonal_statistics(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """``component``, ``cells``, ``area_km2``, ``mean_risk``, ``max_risk`` and ``built_km2`` of each zone; null risk counts as 0."""
    risk, built = F.coalesce("risk", F.lit(0.0)), F.coalesce("exposure", F.lit(0.0))
    return cells.join(zones, ["r", "c"]).groupBy("component").agg(F.count("*").alias("cells"), F.sum("area").alias("area_km2"), F.avg(risk).alias("mean_risk"), F.max(risk).alias("max_risk"), F.sum(built * F.col("area")).alias("built_km2"))


def hotspots(cells: DataFrame, top: int, columns: int, least_km2: float) -> DataFrame:
    """Zones of the top class with at least ``least_km2``, ranked by area (ties: lower component)."""
    stats = zonal_statistics(cells, cell_components(cells.where(F.col("class") == top), columns)).where(F.col("area_km2") >= least_km2)
    return numbered(stats, [F.round("area_km2", 6).desc(), F.col("component")], "rank")


def hotspot_summary(spots: DataFrame, study_km2: float | None, cells: DataFrame) -> DataFrame:
    """One row: number, area, percent of the study area, largest and built area of hotspots."""
    total = cells.agg(F.sum("area").alias("study")) if study_km2 is None else cells.sparkSession.createDataFrame([(study_km2,)], "study double")
    found = spots.agg(F.count("*").alias("n"), F.coalesce(F.sum("area_km2"), F.lit(0.0)).alias("area_km2"), F.coalesce(F.max("area_km2"), F.lit(0.0)).alias("largest_km2"), F.coalesce(F.sum("built_km2"), F.lit(0.0)).alias("built_km2"))
    return found.join(F.broadcast(total), how="cross").withColumn("percent", F.coalesce(F.try_divide(F.col("area_km2") * 100, F.col("study")), F.lit(0.0))).drop("study")


def discs(points: DataFrame, cells: DataFrame, radius_m: float) -> DataFrame:
    """``points`` (``label``, ``plon``, ``plat``) with every cell (``lon``, ``lat``) within the radius: a range join on buckets as high as the radius and, by latitude, as wide.

    A point is copied to the nine buckets that its disc may touch; its own row stays if no cell is near.
    """
    rows = points.withColumn("band", F.explode(F.sequence(band(F.col("plat"), radius_m) - 1, band(F.col("plat"), radius_m) + 1)))
    at = F.floor(F.col("plon") / band_width(F.col("band"), radius_m)).cast("long")
    keyed = rows.withColumn("slot", F.explode(F.sequence(at - 1, at + 1)))
    there = cells.withColumn("band", band(F.col("lat"), radius_m)).withColumn("slot", F.floor(F.col("lon") / band_width(F.col("band"), radius_m)).cast("long"))
    near = keyed.join(there, ["band", "slot"]).where(haversine_m(F.col("plon"), F.col("plat"), F.col("lon"), F.col("lat")) <= radius_m).drop("band", "slot", "plon", "plat")
    return points.select("label").join(near, "label", "left")


def class_histogram(zone_cells: DataFrame) -> DataFrame:
    """``label``, ``class``, ``n`` and ``share`` of the classes in each disc."""
    counts = zone_cells.where("class IS NOT NULL").groupBy("label", "class").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("label")))


def verdicts(zone_cells: DataFrame, high: tuple[int, ...] = K.PASS_CLASSES, least_share: float = K.PASS_SHARE) -> DataFrame:
    """``label``, ``mode`` (ties: lower class), ``high_share`` and ``passed``; a disc without cells did not pass."""
    labels, hist = zone_cells.select("label").distinct(), class_histogram(zone_cells)
    found = hist.groupBy("label").agg(F.max_by("class", F.struct("n", (-F.col("class")).alias("b"))).alias("mode"), F.sum(F.when(F.col("class").isin(*high), F.col("share")).otherwise(0.0)).alias("high_share"))
    return labels.join(found, "label", "left").withColumn("passed", F.coalesce(F.col("mode").isin(*high) & (F.col("high_share") >= least_share), F.lit(False)))


def report(points: DataFrame, cells: DataFrame, radius_m: float, factors: Sequence[str], at_cell: tuple[Column, Column], names: Sequence[str] = K.CLASS_NAMES) -> DataFrame:
    """A row for each point (``label``, ``plon``, ``plat``): the class and index of its own cell, and the zone around it: mean index, modal class, share of high classes, mean of each factor, ``passed``, ``outside``.

    ``cells`` have ``r``, ``c``, ``lon``, ``lat``, ``class``, ``risk`` and the factors; ``at_cell`` gives row and column of a point. A zone without cells lies outside and did not pass.
    """
    labels = F.array(*[F.lit(n) for n in names])
    zone = written(discs(points, cells, radius_m), "zone-cells")
    verdict = verdicts(zone, K.PASS_CLASSES, K.PASS_SHARE)
    means = zone.groupBy("label").agg(F.avg("risk").alias("zone_mean_index"), *[F.avg(f).alias(f"zone_{f}") for f in factors])
    own = points.withColumns({"r": at_cell[0], "c": at_cell[1]}).join(cells.select("r", "c", "class", F.col("risk").alias("point_index")), ["r", "c"], "left")
    both = own.join(verdict, "label").join(means, "label")
    return both.select(
        "label", F.col("class").alias("point_class"), F.get(labels, F.col("class") - 1).alias("point_class_name"), "point_index", "zone_mean_index", F.get(labels, F.col("mode") - 1).alias("zone_modal_class"),
        F.round("high_share", 4).alias("zone_high_share"), *[f"zone_{f}" for f in factors], "passed", F.col("mode").isNull().alias("outside"),
    )


def diagnosis(zone_cells: DataFrame, cells: DataFrame, factors: list[str], weights: dict[str, float] | None = None, step: float = 0.05) -> DataFrame:
    """``label``, the ``dominant`` factor (greatest mean in the disc), the ``weakest`` (least ratio to the mean everywhere; infinite where that mean is 0 or missing) and its ``ratio``.

    With ``weights`` also ``suggested``: the weakest factor's weight less ``step``, but not under it. Ties go to the earlier factor.
    """
    rank = F.create_map(*[F.lit(x) for i, f in enumerate(factors) for x in (f, -i)])
    zone = zone_cells.groupBy("label").agg(*[F.avg(f).alias(f) for f in factors]).unpivot("label", factors, "factor", "mean")
    everywhere = cells.agg(*[F.avg(f).alias(f) for f in factors]).unpivot([], factors, "factor", "all")
    ratio = F.coalesce(F.try_divide("mean", F.nullif("all", F.lit(0.0))), F.lit(float("inf")))
    rated = zone.where("mean IS NOT NULL").join(F.broadcast(everywhere), "factor").withColumns({"ratio": ratio, "place": rank[F.col("factor")]})
    found = rated.groupBy("label").agg(F.max_by("factor", F.struct("mean", "place")).alias("dominant"), F.min_by(F.struct("factor", "ratio"), F.struct("ratio", -F.col("place"))).alias("w")).select("label", "dominant", F.col("w.factor").alias("weakest"), F.col("w.ratio").alias("ratio"))
    if weights is None:
        return found
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return found.withColumn("suggested", F.greatest(known[F.col("weakest")] - step, F.lit(step)))


def greedy_apart(rows: list, n: int, apart_m: float, taken: Sequence = ()) -> list:
    """The first n rows, in their order, that are ``apart_m`` from all taken before; rows have lon and lat."""

    def metres(a, b) -> float:
        dlat, dlon = math.radians(b.lat - a.lat) / 2, math.radians(b.lon - a.lon) / 2
        return 2 * EARTH_M * math.asin(math.sqrt(math.sin(dlat) ** 2 + math.cos(math.radians(a.lat)) * math.cos(math.radians(b.lat)) * math.sin(dlon) ** 2))

    out: list = []
    for row in rows:
        if len(out) < n and all(metres(row, t) >= apart_m for t in (*taken, *out)):
            out.append(row)
    return out


def settlements(cells: DataFrame, n: int, thresholds: tuple[float, ...], least_cells: int, apart_m: float, columns: int, page: int = 1000) -> DataFrame:
    """n settlement origins: clusters of cells ``built`` up to a threshold, dilated by two, by mean risk, ``apart_m`` from each other.

    ``cells`` have ``r``, ``c``, ``built``, ``risk``, ``lon`` and ``lat``; a missing band counts as 0. The highest threshold that gives n is taken; if none does it is an error.
    Clusters come to the driver in pages, best first, until n are apart or none is left, so none is passed over.
    """
    known = cells.withColumns({"built": F.coalesce("built", F.lit(0.0)), "risk": F.coalesce("risk", F.lit(0.0))})
    level = F.posexplode(F.array(*[F.lit(t) for t in thresholds])).alias("level", "threshold")
    marked = known.select("*", level).where(F.col("built") >= F.col("threshold"))
    size = F.lit(1 << 40)
    wide = spread(marked, diamond(2), ["level"]).distinct().join(cells.select("r", "c"), ["r", "c"])
    keyed = written(wide.select("r", "c", "level", (F.col("level") * size + F.col("r") * columns + F.col("c")).alias("id")), "built-wide")
    ahead = spread(keyed, [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)], ["level", F.col("id").alias("other")])
    found = connected_components(ahead.join(keyed, ["r", "c", "level"]).select(F.col("other").alias("src"), F.col("id").alias("dst")))
    zones = keyed.join(found, F.col("id") == F.col("node")).select("r", "c", "level", "component")
    clusters = marked.join(zones, ["r", "c", "level"]).groupBy("level", "component").agg(
        F.count("*").alias("cells"), (F.sum(F.col("built") * F.col("lon")) / F.sum("built")).alias("lon"), (F.sum(F.col("built") * F.col("lat")) / F.sum("built")).alias("lat"), F.avg("risk").alias("mean_risk")
    )
    ranked = written(clusters.where(F.col("cells") >= least_cells).withColumn("mean_risk", F.round("mean_risk", 12)), "clusters")
    for i, threshold in enumerate(thresholds):
        chosen: list = []
        here = ranked.where(F.col("level") == i)
        while len(chosen) < n:
            rows = here.orderBy(F.desc("mean_risk"), "component").limit(page).collect()
            chosen = chosen + greedy_apart(rows, n - len(chosen), apart_m, chosen)
            if len(rows) < page:
                break
            last = rows[-1]
            here = ranked.where(F.col("level") == i).where((F.col("mean_risk") < last.mean_risk) | ((F.col("mean_risk") == last.mean_risk) & (F.col("component") > last.component)))
        if len(chosen) >= n:
            out = [(k + 1, r.component % (1 << 40), r.cells, r.lon, r.lat, r.mean_risk, threshold) for k, r in enumerate(chosen)]
            return cells.sparkSession.createDataFrame(out, "origin_id int, component long, cells long, lon double, lat double, mean_risk double, threshold double")
    raise ValueError(f"no threshold gives {n} settlements {apart_m} m apart")
