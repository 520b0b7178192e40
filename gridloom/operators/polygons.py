"""Polygons as rings by the even-odd rule: filling of cells by scanlines, statistics of what they cover, and points in many polygons through slabs of edges.

``rings`` are rows of ``polygon`` and ``points`` (a closed or open ring); a polygon's rings count together, so holes, islands and rings that cross themselves need no repair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import ring_area_km2
from gridloom.operators import zones
from gridloom.operators.outlines import outlines
from gridloom.operators.rasters import Grid
from gridloom.operators.skew import numbered
from gridloom.session import written

#: Slabs of equal height that a polygon's edges are cut into.
SLABS = 64


def ring_edges(rings: DataFrame) -> DataFrame:
    """``polygon``, ``ax``, ``ay``, ``bx`` and ``by`` of the edges of rings that aren't level; rings of fewer than three points have none."""
    after = F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1))
    cut = rings.where(F.size("points") >= 3).select("polygon", F.explode(F.zip_with("points", after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e"))
    return cut.select("polygon", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by")).where("ay <> by")


def rasterised(rings: DataFrame, rows: int, columns: int) -> DataFrame:
    """``r``, ``c`` and ``polygon`` of the cells whose centre lies in a polygon (x: columns, y: rows); where several do the greatest polygon wins.

    Each row of cells that an edge passes gets its crossing; the crossings of a polygon and row, in order, bound the runs that are filled. A task holds
    the crossings of single rows, whatever the size of a polygon.
    """
    edges = ring_edges(rings)
    first, last = F.ceil(F.least("ay", "by") - 0.5), F.ceil(F.greatest("ay", "by") - 0.5) - 1
    clipped = edges.withColumns({"r0": F.greatest(first, F.lit(0)), "r1": F.least(last, F.lit(rows - 1))}).where("r0 <= r1")
    lined = clipped.withColumn("r", F.explode(F.sequence("r0", "r1")))
    x = F.col("ax") + (F.col("r") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    crossings = lined.groupBy("polygon", "r").agg(F.sort_array(F.collect_list(x)).alias("xs"))
    runs = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.ceil(F.get("xs", i * 2) - 0.5).alias("c0"), (F.ceil(F.get("xs", i * 2 + 1) - 0.5) - 1).alias("c1")))
    filled = crossings.select("polygon", "r", F.explode(runs).alias("run")).select("polygon", "r", F.greatest("run.c0", F.lit(0)).alias("c0"), F.least("run.c1", F.lit(columns - 1)).alias("c1")).where("c0 <= c1")
    return filled.select("polygon", "r", F.explode(F.sequence("c0", "c1")).alias("c")).groupBy("r", "c").agg(F.max("polygon").alias("polygon"))


def polygon_statistics(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """zones.zonal_statistics() of the cells of rasterised() labels, by ``polygon``."""
    return zones.zonal_statistics(cells, labels.withColumnRenamed("polygon", "component")).withColumnRenamed("component", "polygon")


def hotspot_polygons(cells: DataFrame, top: int, grid: Grid, tolerance_m: float, least_km2: float) -> tuple[DataFrame, DataFrame]:
    """Zones of the top class as polygons: their rings, and by ``hotspot_id`` (from 1, largest first) ``polygon_km2`` and the statistics of the cells that they cover.

    Outlines are simplified first; area (outer rings less holes), the least area and the statistics are those of the simplified polygons. One that
    covers no cell centre has no cells.
    """
    rings = written(outlines(zones.cell_components(cells.where(F.col("class") == top), grid.columns), grid, tolerance_m), "polygon-rings")
    sizes = rings.groupBy("component").agg(F.sum(F.when(F.col("hole"), -ring_area_km2(F.col("points"))).otherwise(ring_area_km2(F.col("points")))).alias("polygon_km2")).where(F.col("polygon_km2") >= least_km2)
    kept = written(numbered(sizes, [F.round("polygon_km2", 9).desc(), F.col("component")], "hotspot_id"), "polygon-hotspots")
    named = rings.join(kept.select("component", "hotspot_id"), "component")
    whole = F.transform("points", lambda p: F.struct(((p["x"] - grid.west) / grid.dx).alias("x"), ((grid.north - p["y"]) / grid.dy).alias("y")))
    labels = rasterised(named.select(F.col("hotspot_id").alias("polygon"), whole.alias("points")), grid.rows, grid.columns)
    stats = polygon_statistics(cells, labels).withColumnRenamed("polygon", "hotspot_id")
    return named, kept.join(stats, "hotspot_id", "left").fillna(0, ["cells"])


def same_shapes(rings: DataFrame) -> DataFrame:
    """``polygon`` and ``shape``: the least polygon of the same rings, told by digests of their points."""
    digests = rings.where("polygon IS NOT NULL").groupBy("polygon").agg(F.array_join(F.sort_array(F.collect_list(F.sha2(F.col("points").cast("string"), 256))), ",").alias("rings")).select("polygon", F.sha2("rings", 256).alias("digest"))
    named = written(digests, "polygon-digests")
    return written(named.join(named.groupBy("digest").agg(F.min("polygon").alias("shape")), "digest").select("polygon", "shape"), "polygon-shapes")


def in_polygons(points: DataFrame, rings: DataFrame) -> DataFrame:
    """``id`` and ``polygon`` for each point (``id``, ``x``, ``y``) and polygon that holds it.

    Points of one spot and polygons of the same rings are tested once; what holds is then joined to all of them, so only rows of the result grow with both tables.
    A spot meets the polygons whose box holds it, through buckets of about the mean size of a box, and of such a polygon only the edges in its slab; the crossings of a
    ray are counted by aggregation. No polygon is a literal of the plan.
    """
    alike = same_shapes(rings)
    inside = written(_spots_in(points.select("x", "y").distinct(), rings.join(alike.where("polygon = shape").select("polygon"), "polygon", "left_semi")), "polygon-spots")
    holders = inside.withColumnRenamed("polygon", "shape").join(alike, "shape").select("x", "y", "polygon")
    return points.select("id", "x", "y").join(holders, ["x", "y"]).select("id", "polygon")


def _spots_in(spots: DataFrame, rings: DataFrame) -> DataFrame:
    """``x``, ``y`` and ``polygon`` for each spot and polygon that holds it."""
    edges = written(ring_edges(rings), "polygon-edges")
    boxes = written(edges.groupBy("polygon").agg(*[f(g(f"a{c}", f"b{c}")).alias(f"{c}{n}") for c in "xy" for f, g, n in ((F.min, F.least, 0), (F.max, F.greatest, 1))]), "polygon-boxes")
    size = boxes.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0
    cell = lambda x: F.floor(x / F.lit(size)).cast("long")
    spread = boxes.withColumn("cx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1")))))
    near = spots.select("x", "y", cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy")).join(spread, ["cx", "cy"]).where("x >= x0 AND x <= x1 AND y >= y0 AND y <= y1")
    slab = lambda y: F.least(F.lit(SLABS - 1), F.floor((y - F.col("y0")) / (F.col("y1") - F.col("y0")) * SLABS)).cast("int")
    cut = edges.join(boxes.select("polygon", "y0", "y1"), "polygon").withColumn("slab", F.explode(F.sequence(slab(F.least("ay", "by")), slab(F.greatest("ay", "by"))))).drop("y0", "y1")
    met = near.withColumn("slab", slab(F.col("y"))).select("x", "y", "polygon", "slab").join(cut, ["polygon", "slab"])
    crosses = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))
    return met.groupBy("x", "y", "polygon").agg(F.count_if(crosses).alias("n")).where("n % 2 = 1").select("x", "y", "polygon")
