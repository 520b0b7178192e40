"""Hazard layers put together from scenes and cells: flood from radar windows and surface water, landslide from four rated factors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import constants as K
from gridloom.functions.cells import normalised_difference, rating
from gridloom.operators import rasters
from gridloom.session import written

Offsets = Sequence[tuple[int, int]]


@dataclass
class Flood:
    """The layer (``r``, ``c``, ``flood``) and the ``thresholds`` by window: ``scenes`` and ``db``."""

    layer: DataFrame
    thresholds: DataFrame


def flood(scenes: DataFrame, cells: DataFrame, *, speckle: Offsets, zone: Offsets, smooth: Offsets, buckets: int = 255) -> Flood:
    """Flood hazard from ``scenes`` (``r``, ``c``, ``win``, ``vv``) and ``cells`` (``r``, ``c``, ``slope``, ``occurrence`` in percent, null counts as 0).

    Each window is a median composite, freed of speckle by a focal median. Its threshold is Otsu's over the flat cells near known water, guarded; a window
    without such a cell takes the fallback. Water on flat land that isn't permanent counts as flooded; the smoothed share of windows and
    the smoothed occurrence of other surface water are weighed and rescaled. Without any scene the occurrence decides alone.
    """
    ground = written(cells.select("r", "c", "slope", F.coalesce("occurrence", F.lit(0.0)).alias("occurrence")), "flood-ground")
    permanent = F.col("occurrence") > K.FLOOD_PERMANENT_OCCURRENCE
    flat = F.col("slope") <= K.FLOOD_MAX_SLOPE_DEG
    median = written(scenes.groupBy("win", "r", "c").agg(F.median("vv").alias("vv")), "flood-median")
    clean = written(rasters.focal(median, "vv", speckle, "median", "vv", by=["win"]), "flood-clean")
    known = rasters.focal(ground.withColumn("water", (F.col("occurrence") > K.FLOOD_ZONE_OCCURRENCE).cast("int")), "water", zone, "max", "known")
    sampled = clean.join(ground.where(flat).join(known.where("known = 1"), ["r", "c"]).select("r", "c"), ["r", "c"], "left_semi")
    found = rasters.otsu(rasters.histogram(sampled, "vv", buckets, by=["win"]), ["win"])
    counts = scenes.groupBy("win").agg(F.count("*").alias("scenes"))
    limits = written(counts.join(found, "win", "left").select("win", "scenes", rasters.guarded(F.col("threshold"), K.FLOOD_FALLBACK_DB, *K.FLOOD_RANGE_DB).alias("db")), "flood-limits")
    history = rasters.focal(ground.withColumn("other", F.when(permanent, 0.0).otherwise(F.col("occurrence") / 100)), "other", smooth, "mean", "history")
    if limits.isEmpty():
        raw = history.select("r", "c", F.col("history").alias("flood"))
    else:
        seen = clean.join(limits.select("win", "db"), "win").join(ground, ["r", "c"])
        wet = seen.groupBy("r", "c").agg(F.avg(((F.col("vv") < F.col("db")) & flat & ~permanent).cast("double")).alias("share"))
        shares = rasters.focal(ground.select("r", "c").join(wet, ["r", "c"], "left"), "share", smooth, "mean", "sar")
        raw = shares.join(history, ["r", "c"]).select("r", "c", (F.col("sar") * K.FLOOD_PARTS[0] + F.col("history") * K.FLOOD_PARTS[1]).alias("flood"))
    return Flood(rasters.normalise(raw, ["flood"]), limits)


def greenness(scenes: DataFrame, cells: DataFrame, gap: Offsets, fill: float = K.NDVI_FILL) -> DataFrame:
    """``r``, ``c`` and ``ndvi``: the median over scenes (``r``, ``c``, ``b8``, ``b4``, ``scl``) of what clouds leave; gaps take the median around them, then a neutral value."""
    clear = scenes.where(~F.col("scl").isin(*K.CLOUD_CLASSES))
    median = clear.groupBy("r", "c").agg(F.median(normalised_difference(F.col("b8"), F.col("b4"))).alias("own"))
    known = written(cells.select("r", "c").join(median, ["r", "c"], "left"), "ndvi")
    near = rasters.focal(known, "own", gap, "median", "near")
    return known.join(near, ["r", "c"]).select("r", "c", F.coalesce("own", "near", F.lit(fill)).alias("ndvi"))


def rainfall(rain: DataFrame, cells: DataFrame, step: int, months: tuple[int, int] = K.MONSOON_MONTHS) -> DataFrame:
    """``r``, ``c`` and ``rainfall``: the greatest seasonal sum of a coarse grid (``r``, ``c`` over ``step`` cells, ``ts``, ``value``), bilinear between its cells."""
    season = written(rasters.season_max(rain, months, ["r", "c"]), "rain")
    ends = season.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))

    def held(axis: str) -> Column:
        return F.least(F.greatest((F.col(axis) + 0.5) / step - 0.5, F.col(f"{axis}0").cast("double")), F.col(f"{axis}1").cast("double"))

    points = cells.select("r", "c").join(F.broadcast(ends), how="cross").select(F.struct("r", "c").alias("id"), held("r").alias("y"), held("c").alias("x"))
    return rasters.bilinear(points, season, "season_max", "rainfall").select("id.r", "id.c", "rainfall")


def landslide(factors: DataFrame, weights: dict[str, float] = K.FACTOR_WEIGHTS) -> DataFrame:
    """``r``, ``c``, the weighted rating of each factor (``slope``, ``elevation``, ``ndvi``, ``rainfall``), their sum ``lsi``, and ``landslide``, the sum rescaled. Cells without a factor have none."""
    parts = [(rating(F.col(f), *K.FACTORS[f]) * w).alias(f) for f, w in weights.items()]
    rated = factors.select("r", "c", *parts)
    total = sum((F.col(f) for f in weights), F.lit(0.0))
    summed = rated.withColumn("lsi", total).withColumn("landslide", F.col("lsi"))
    return rasters.normalise(summed, ["landslide"])
