"""Queries on zones: components, hotspots, discs around points and settlement origins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import constants as K
from gridloom.functions.geo import cell_centre
from gridloom.operators import outlines, polygons, zones
from gridloom.plans.layers import BANDS, GRID, rounded
from gridloom.plans.registry import query
from gridloom.plans.scoring import RISK_SQL, risk_classes
from gridloom.session import table
from gridloom.sources import surrogates as S

COMP_SQL = RISK_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, top AS (SELECT r, c, r * 50 + c AS id, risk, exposure, area FROM classes WHERE class = 5),
adj AS (SELECT a.id AS a, b.id AS b FROM top a JOIN top b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
reach(a, b) AS (SELECT id, id FROM top UNION SELECT reach.a, adj.b FROM reach JOIN adj ON adj.a = reach.b),
comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a),
spots AS (SELECT component, count(*) AS cells, sum(area) AS area_km2, avg(risk) AS mean_risk, max(risk) AS max_risk, sum(exposure * area) AS built_km2 FROM top JOIN comp USING (id) GROUP BY component HAVING sum(area) >= 1.5e0)"""


@query(f"{COMP_SQL} SELECT r, c, component FROM top JOIN comp USING (id)")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, _ = risk_classes(spark, sf_dir)
    return zones.cell_components(grid.where("class = 5"), S.COLS)


_STATS = "cells, round(area_km2, 6) AS area_km2, round(mean_risk, 6) AS mean_risk, round(max_risk, 6) AS max_risk, round(built_km2, 6) AS built_km2"


@query(f"{COMP_SQL.replace(' HAVING sum(area) >= 1.5e0', '')} SELECT component, {_STATS} FROM spots")
def zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, _ = risk_classes(spark, sf_dir)
    return rounded(zones.zonal_statistics(grid, zones.cell_components(grid.where("class = 5"), S.COLS)))


@query(f"{COMP_SQL} SELECT component, {_STATS}, row_number() OVER (ORDER BY round(area_km2, 6) DESC, component) AS rank FROM spots")
def hotspot_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, _ = risk_classes(spark, sf_dir)
    return rounded(zones.hotspots(grid, 5, S.COLS, 1.5))


@query(f"""{COMP_SQL} SELECT count(*) AS n, round(coalesce(sum(area_km2), 0e0), 6) AS area_km2, round(coalesce(max(area_km2), 0e0), 6) AS largest_km2, round(coalesce(sum(built_km2), 0e0), 6) AS built_km2,
round(coalesce(sum(area_km2), 0e0) * 100 / (SELECT sum(area) FROM classes), 6) AS percent FROM spots""")
def hotspot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, _ = risk_classes(spark, sf_dir)
    return rounded(zones.hotspot_summary(zones.hotspots(grid, 5, S.COLS, 1.5), None, grid))


@query(f"""{COMP_SQL}, t AS (SELECT top.r, top.c, component FROM top JOIN comp USING (id)), near_ AS (SELECT * FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) n(dr, dc)),
sides AS (SELECT t.component, count(*) AS sides FROM t CROSS JOIN near_ LEFT JOIN t u ON u.r = t.r + dr AND u.c = t.c + dc WHERE u.r IS NULL GROUP BY 1)
SELECT component, count(*) AS cells, any_value(sides) AS sides FROM t JOIN sides USING (component) GROUP BY component""")
def hotspot_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rings around each zone of the top class: the area inside them in cells, and their length in sides."""
    grid, _ = risk_classes(spark, sf_dir)
    rings = outlines.outlines(zones.cell_components(grid.where("class = 5"), S.COLS), GRID)
    steps = F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), lambda a, b: (F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])) / S.STEP)
    length = F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)
    return rings.groupBy("component").agg(F.sum("cells").cast("long").alias("cells"), F.round(F.sum(length)).cast("long").alias("sides"))


#: A polygon for each supplier, in cells: a star that crosses itself, so that its middle is outside, a triangle beside it, and a hole in one point of the star.
RINGS = (((0.13, -6.07), (3.61, 4.93), (-5.77, -1.87), (5.83, -1.91), (-3.59, 5.03)), ((8.03, 0.11), (11.07, 1.13), (9.01, 4.21)), ((0.21, -4.97), (0.91, -3.03), (-0.83, -2.97)))
POLYGON_SQL = "corner AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, {x}e0, {y}e0, {ring[(i + 1) % len(ring)][0]}e0, {ring[(i + 1) % len(ring)][1]}e0)" for r, ring in enumerate(RINGS) for i, (x, y) in enumerate(ring)) + """) t(ring, x0, y0, x1, y1)),
side AS (SELECT s_suppkey AS polygon, x0 + s_suppkey * 7 % 53 + 0.0371e0 AS ax, y0 + s_suppkey * 11 % 43 + 0.0293e0 AS ay, x1 + s_suppkey * 7 % 53 + 0.0371e0 AS bx, y1 + s_suppkey * 11 % 43 + 0.0293e0 AS by_ FROM supplier, corner)"""


def supplier_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' polygons, a row for each ring."""
    k = F.col("s_suppkey")
    x, y = k * 7 % 53 + F.lit(0.0371), k * 11 % 43 + F.lit(0.0293)
    rings = F.array(*[F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ring]) for ring in RINGS])
    moved = F.transform(F.col("ring"), lambda p: F.struct((p["x"] + x).alias("x"), (p["y"] + y).alias("y")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(rings).alias("ring")).select(k.alias("polygon"), moved.alias("points"))


@query(f"""{RISK_SQL}, {POLYGON_SQL}, hit AS (SELECT polygon, r, c FROM classes JOIN side ON (ay > r + 0.5e0) <> (by_ > r + 0.5e0) AND c + 0.5e0 < (bx - ax) * (r + 0.5e0 - ay) / (by_ - ay) + ax GROUP BY polygon, r, c HAVING count(*) % 2 = 1),
label AS (SELECT r, c, max(polygon) AS polygon FROM hit GROUP BY r, c)
SELECT polygon, count(*) AS cells, round(sum(area), 6) AS area_km2, round(avg(coalesce(risk, 0e0)), 6) AS mean_risk, round(max(coalesce(risk, 0e0)), 6) AS max_risk, round(sum(coalesce(exposure, 0e0) * area), 6) AS built_km2 FROM classes JOIN label USING (r, c) GROUP BY polygon""")
def polygon_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the cells that each supplier's polygon covers; where several do the later one."""
    grid, _ = risk_classes(spark, sf_dir)
    return rounded(polygons.polygon_statistics(grid, polygons.rasterised(supplier_rings(spark, sf_dir), S.ROWS, S.COLS)))


@query(f"""WITH {POLYGON_SQL}, spot AS (SELECT p_partkey AS id, p_partkey * 17 % 500 / 10e0 + 0.0317e0 AS x, p_partkey * 13 % 400 / 10e0 + 0.0413e0 AS y FROM part)
SELECT id, polygon FROM spot JOIN side ON (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay) + ax GROUP BY id, polygon HAVING count(*) % 2 = 1""")
def points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' polygons that hold each part's point."""
    k = F.col("p_partkey")
    spots = table(spark, sf_dir, "part").select(k.alias("id"), (k * 17 % 500 / 10.0 + 0.0317).alias("x"), (k * 13 % 400 / 10.0 + 0.0413).alias("y"))
    return polygons.in_polygons(spots, supplier_rings(spark, sf_dir))


POINTS = (("verified", 76.2, 11.6), ("reported", 76.31, 11.52), ("outside", 79.0, 12.9))
POINTS_SQL = "pts AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {x}e0, {y}e0)" for n, x, y in POINTS) + ") t(label, plon, plat))"
ZONE_SQL = f"""{RISK_SQL}, {POINTS_SQL}, zone AS (
  SELECT label, class, {", ".join(BANDS)} FROM pts JOIN (SELECT *, 76e0 + (c + 0.5e0) * 0.009e0 AS lon, 11.8e0 - (r + 0.5e0) * 0.009e0 AS lat FROM classes) g
  ON 2 * 6371000e0 * asin(sqrt(power(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * power(sin(radians(lon - plon) / 2), 2))) <= 2000),
hist AS (SELECT label, class, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY label) AS share FROM zone GROUP BY label, class)"""


def zone_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cells in discs of 2 km around the points, and all cells."""
    grid, _ = risk_classes(spark, sf_dir)
    placed = grid.withColumns({"lon": cell_centre(F.col("c"), S.WEST, S.STEP), "lat": cell_centre(F.col("r"), S.NORTH, -S.STEP)})
    return zones.discs(spark.createDataFrame(list(POINTS), "label string, plon double, plat double"), placed, 2000.0), placed


@query(f"{ZONE_SQL} SELECT label, class, n, round(share, 6) AS share FROM hist")
def zone_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(zones.class_histogram(zone_cells(spark, sf_dir)[0]))


@query(f"""{ZONE_SQL}, v AS (SELECT label, arg_max(class, (n, -class)) AS mode, sum(CASE WHEN class IN (4, 5) THEN share ELSE 0e0 END) AS high_share FROM hist GROUP BY label)
SELECT label, mode, round(high_share, 6) AS high_share, coalesce(mode IN (4, 5) AND high_share >= 0.5e0, false) AS passed FROM pts LEFT JOIN v USING (label)""")
def validation_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(zones.verdicts(zone_cells(spark, sf_dir)[0]))


@query(f"""{ZONE_SQL}, v AS (SELECT label, arg_max(class, (n, -class)) AS mode, sum(CASE WHEN class IN (4, 5) THEN share ELSE 0e0 END) AS high_share FROM hist GROUP BY label),
zone2 AS (SELECT label, risk, {", ".join(BANDS)} FROM pts JOIN (SELECT *, 76e0 + (c + 0.5e0) * 0.009e0 AS lon, 11.8e0 - (r + 0.5e0) * 0.009e0 AS lat FROM classes) g
  ON 2 * 6371000e0 * asin(sqrt(power(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * power(sin(radians(lon - plon) / 2), 2))) <= 2000),
m AS (SELECT label, avg(risk) AS mean_index, {", ".join(f"avg({b}) AS zone_{b}" for b in BANDS)} FROM zone2 GROUP BY label),
own AS (SELECT label, class, risk FROM pts LEFT JOIN classes ON classes.r = CAST(floor((plat - 11.8e0) / -0.009e0) AS BIGINT) AND classes.c = CAST(floor((plon - 76e0) / 0.009e0) AS BIGINT)),
names AS (SELECT {list(K.CLASS_NAMES)!r} AS n)
SELECT pts.label, own.class AS point_class, n[own.class] AS point_class_name, round(own.risk, 6) AS point_index, round(mean_index, 6) AS zone_mean_index, n[mode] AS zone_modal_class, round(high_share, 4) AS zone_high_share, {", ".join(f"round(zone_{b}, 6) AS zone_{b}" for b in BANDS)},
coalesce(mode IN (4, 5) AND high_share >= 0.5e0, false) AS passed, mode IS NULL AS outside FROM names, pts LEFT JOIN v USING (label) LEFT JOIN m USING (label) LEFT JOIN own USING (label)""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the validation tells about each point; the headline is that of the verified one."""
    from gridloom.functions.geo import cell_index

    _, grid = zone_cells(spark, sf_dir)
    points = spark.createDataFrame(list(POINTS), "label string, plon double, plat double")
    return rounded(zones.report(points, grid, 2000.0, BANDS, (cell_index(F.col("plat"), S.NORTH, -S.STEP), cell_index(F.col("plon"), S.WEST, S.STEP))))


#: Factors of the diagnosis and their weights; ``none`` is 0 everywhere, so its ratio is infinite and it is never the weakest.
DIAGNOSED = {"flood": 0.40, "landslide": 0.25, "exposure": 0.20, "fire": 0.08, "none": 0.07}


@query(f"""{ZONE_SQL}, zm AS (UNPIVOT (SELECT label, {", ".join(f"avg({b}) AS {b}" for b in BANDS)}, 0e0 AS "none" FROM zone GROUP BY label) ON {", ".join(BANDS)}, "none" INTO NAME factor VALUE m),
am AS (UNPIVOT (SELECT {", ".join(f"avg({b}) AS {b}" for b in BANDS)}, 0e0 AS "none" FROM classes) ON {", ".join(BANDS)}, "none" INTO NAME factor VALUE a),
w AS (SELECT * FROM (VALUES {", ".join(f"('{f}', {x}e0)" for f, x in DIAGNOSED.items())}) t(factor, weight)),
d AS (SELECT label, arg_max(factor, m) AS dominant, arg_min(factor, coalesce(m / nullif(a, 0), 'inf'::DOUBLE)) AS weakest, min(coalesce(m / nullif(a, 0), 'inf'::DOUBLE)) AS ratio FROM zm JOIN am USING (factor) GROUP BY label)
SELECT label, dominant, weakest, round(ratio, 6) AS ratio, round(greatest(weight - 0.05e0, 0.05e0), 6) AS suggested FROM d JOIN w ON w.factor = d.weakest""")
def zone_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, grid = zone_cells(spark, sf_dir)
    none = lambda df: df.withColumn("none", F.lit(0.0))
    return rounded(zones.diagnosis(none(near.where("class IS NOT NULL")), none(grid), list(DIAGNOSED), DIAGNOSED))


#: Built-up land: towns of four by four cells in every block of twelve, in them the exposure band.
_TOWN = "r % 12 < 4 AND c % 12 < 4"


@query(f"""{RISK_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, g AS (SELECT r, c, risk, CASE WHEN {_TOWN} THEN 0.3e0 + 0.7e0 * exposure ELSE 0e0 END AS built, 76e0 + (c + 0.5e0) * 0.009e0 AS lon, 11.8e0 - (r + 0.5e0) * 0.009e0 AS lat FROM classes),
m AS (SELECT * FROM g WHERE built >= 0.5e0), offs AS (SELECT dr, dc FROM range(-2, 3) a(dr), range(-2, 3) b(dc) WHERE abs(dr) + abs(dc) <= 2),
offs_ AS (SELECT dr, dc FROM range(-1, 2) a(dr), range(-1, 2) b(dc)), wide AS (SELECT DISTINCT g.r, g.c, g.r * 50 + g.c AS id FROM m CROSS JOIN offs JOIN g ON g.r = m.r + dr AND g.c = m.c + dc),
nbrs AS (SELECT w.id AS a, n.id AS b FROM wide w JOIN offs_ ON true JOIN wide n ON n.r = w.r + dr AND n.c = w.c + dc),
reach(id, component) USING KEY (id) AS (SELECT id, id FROM wide UNION SELECT n.b, min(p.component) FROM reach p JOIN nbrs n ON n.a = p.id JOIN recurring.reach q ON q.id = n.b WHERE p.component < q.component GROUP BY n.b),
comp AS (SELECT id, component FROM reach),
clusters AS (SELECT component, count(*) AS cells, sum(built * lon) / sum(built) AS lon, sum(built * lat) / sum(built) AS lat, avg(risk) AS mean_risk FROM m JOIN comp ON comp.id = m.r * 50 + m.c GROUP BY component HAVING count(*) >= 3),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(mean_risk, 12) DESC, component) AS n FROM clusters)
SELECT CAST(n AS INTEGER) AS origin_id, component, cells, round(lon, 6) AS lon, round(lat, 6) AS lat, round(mean_risk, 6) AS mean_risk, 0.5e0 AS threshold FROM ranked WHERE n <= 5""")
def settlement_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five towns by risk. The towns of the grid all lie apart, which the SQL uses; the search for separated ones is tested by itself."""
    _, grid = zone_cells(spark, sf_dir)
    built = grid.withColumn("built", F.when(F.expr(_TOWN), F.col("exposure") * 0.7 + 0.3).otherwise(0.0))
    return rounded(zones.settlements(built, 5, K.SETTLEMENT_THRESHOLDS, 3, K.SEPARATION_M, S.COLS))
