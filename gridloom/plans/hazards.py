"""Queries on the composed layers, the stack that they make, and the acceptance of a whole run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import constants as K
from gridloom.operators import hazards, rasters, weights
from gridloom.plans import layers, network, scoring, zones
from gridloom.plans.layers import WITH_NORM, normalised, rounded
from gridloom.plans.registry import ORACLE_SQL, query
from gridloom.session import table, written
from gridloom.sources import surrogates as S

#: Scenes: each row of lineitem is a look at one cell, its number the window, with radar, two bands, a scene class and rain.
SCENES_SQL = f"""looks AS (SELECT l_orderkey % {S.ROWS} AS r, l_partkey % {S.COLS} AS c, l_linenumber % 3 AS win, -25e0 + (l_discount * 5 + l_tax * 6) * 20e0 + l_quantity / 50e0 AS vv,
  l_extendedprice / 1000 + l_quantity AS b8, l_quantity / 2 + 1 AS b4, (l_linenumber + l_suppkey) % 9 AS scl, l_shipdate AS ts, l_quantity * 3 AS rain FROM lineitem)"""
GROUND_SQL = f"{WITH_NORM}, {SCENES_SQL}, ground AS (SELECT r, c, exposure * 8 AS slope, landslide * 60 AS occurrence, fire * 2500 AS elevation FROM norm)"


def looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes over the grid, one for each row of lineitem."""
    number = lambda x: F.col(x)
    return table(spark, sf_dir, "lineitem").select(
        (number("l_orderkey") % S.ROWS).alias("r"), (number("l_partkey") % S.COLS).alias("c"), (number("l_linenumber") % 3).alias("win"), (F.lit(-25.0) + (number("l_discount") * 5 + number("l_tax") * 6) * 20.0 + number("l_quantity") / 50.0).alias("vv"),
        (number("l_extendedprice") / 1000 + number("l_quantity")).alias("b8"), (number("l_quantity") / 2 + 1).alias("b4"), ((number("l_linenumber") + number("l_suppkey")) % 9).alias("scl"), number("l_shipdate").alias("ts"), (number("l_quantity") * 3).alias("rain"),
    )


def ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope in degrees, surface water in percent and elevation of each cell."""
    return normalised(spark, sf_dir).select("r", "c", (F.col("exposure") * 8).alias("slope"), (F.col("landslide") * 60).alias("occurrence"), (F.col("fire") * 2500).alias("elevation"))


_D1, _D2 = (f"(SELECT dr, dc FROM range(-{k}, {k + 1}) a(dr), range(-{k}, {k + 1}) b(dc) WHERE dr * dr + dc * dc <= {k * k})" for k in (1, 2))
FLOOD_SQL = f"""{GROUND_SQL}, med AS (SELECT win, r, c, median(vv) AS vv FROM looks GROUP BY 1, 2, 3),
clean AS (SELECT x.win, x.r, x.c, median(y.vv) AS vv FROM med x CROSS JOIN {_D1} o JOIN med y ON y.win = x.win AND y.r = x.r + dr AND y.c = x.c + dc GROUP BY 1, 2, 3),
zone_ AS (SELECT g.r, g.c FROM ground g CROSS JOIN {_D2} o JOIN ground w ON w.r = g.r + dr AND w.c = g.c + dc WHERE g.slope <= 5 GROUP BY 1, 2 HAVING max(CASE WHEN w.occurrence > 5 THEN 1 ELSE 0 END) = 1),
v AS (SELECT clean.* FROM clean JOIN zone_ USING (r, c)), lim AS (SELECT win, min(vv) AS lo, greatest((max(vv) - min(vv)) / 255, 0.1e0) AS w FROM v GROUP BY win),
bins AS (SELECT v.win, CAST(least(floor((vv - lo) / w), 254) AS BIGINT) AS bin, count(*) AS n, avg(vv) AS mean FROM v JOIN lim USING (win) GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER up AS n0, sum(n * mean) OVER up AS s0, sum(n) OVER (PARTITION BY win) AS n1, sum(n * mean) OVER (PARTITION BY win) AS s1 FROM bins WINDOW up AS (PARTITION BY win ORDER BY bin)),
b AS (SELECT *, coalesce(n0 * (n1 - n0) * power(s0 / nullif(n0, 0) - (s1 - s0) / nullif(n1 - n0, 0), 2), 0e0) AS between_ FROM s),
limits AS (SELECT looks.win, count(*) AS scenes, least(greatest(coalesce(any_value(t.threshold), -16e0), -22e0), -13e0) AS db FROM looks LEFT JOIN (SELECT win, arg_max(mean, (between_, -bin)) AS threshold FROM b GROUP BY win) t USING (win) GROUP BY looks.win),
wet AS (SELECT r, c, avg(CASE WHEN vv < db AND slope <= 5 AND occurrence <= 50 THEN 1e0 ELSE 0e0 END) AS share FROM clean JOIN limits USING (win) JOIN ground USING (r, c) GROUP BY 1, 2),
sar AS (SELECT x.r, x.c, avg(y.share) AS sar FROM ground x CROSS JOIN {_D1} o JOIN wet y ON y.r = x.r + dr AND y.c = x.c + dc GROUP BY 1, 2),
hist AS (SELECT x.r, x.c, avg(CASE WHEN y.occurrence > 50 THEN 0e0 ELSE y.occurrence / 100 END) AS history FROM ground x CROSS JOIN {_D1} o JOIN ground y ON y.r = x.r + dr AND y.c = x.c + dc GROUP BY 1, 2),
raw AS (SELECT r, c, 0.7e0 * sar + 0.3e0 * history AS flood FROM sar JOIN hist USING (r, c)), {layers._norm_sql("raw", "flood", "out_")}"""


def flood(spark: SparkSession, sf_dir: str) -> hazards.Flood:
    """The flood layer of the scenes."""
    return hazards.flood(looks(spark, sf_dir).select("r", "c", "win", "vv"), ground(spark, sf_dir), speckle=rasters.disc(1), zone=rasters.disc(2), smooth=rasters.disc(1))


@query(f"{FLOOD_SQL} SELECT r, c, round(flood, 6) AS flood FROM out_")
def flood_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flood(spark, sf_dir).layer)


@query(f"{FLOOD_SQL} SELECT win, scenes, round(db, 6) AS db FROM limits")
def flood_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flood(spark, sf_dir).thresholds)


STEP = 4
LANDSLIDE_SQL = f"""{GROUND_SQL}, clear AS (SELECT r, c, median((b8 - b4) / nullif(b8 + b4, 0)) AS own FROM looks WHERE scl NOT IN (3, 8, 9, 10, 11) GROUP BY 1, 2),
known AS (SELECT g.r, g.c, own FROM ground g LEFT JOIN clear USING (r, c)),
near_ AS (SELECT x.r, x.c, median(y.own) AS near_ FROM known x CROSS JOIN {_D2} o JOIN known y ON y.r = x.r + dr AND y.c = x.c + dc WHERE y.own IS NOT NULL GROUP BY 1, 2),
ndvi AS (SELECT known.r, known.c, coalesce(own, near_, 0.6e0) AS ndvi FROM known LEFT JOIN near_ USING (r, c)),
season AS (SELECT r, c, max(total) AS v FROM (SELECT r // {STEP} AS r, c // {STEP} AS c, year(ts) AS y, sum(rain) AS total FROM looks WHERE month(ts) BETWEEN 6 AND 9 GROUP BY 1, 2, 3) GROUP BY 1, 2),
ends_ AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM season),
at_ AS (SELECT r, c, least(greatest((r + 0.5e0) / {STEP} - 0.5e0, r0), r1) AS y, least(greatest((c + 0.5e0) / {STEP} - 0.5e0, c0), c1) AS x FROM ground, ends_),
corners AS (SELECT at_.*, CAST(floor(y) AS BIGINT) + i AS cr, CAST(floor(x) AS BIGINT) + j AS cc FROM at_, range(2) p(i), range(2) q(j)),
parts AS (SELECT k.r, k.c, (1 - abs(y - cr)) * (1 - abs(x - cc)) AS w, v FROM corners k LEFT JOIN season ON season.r = cr AND season.c = cc),
rain AS (SELECT r, c, CASE WHEN count(*) FILTER (WHERE w > 0 AND v IS NULL) = 0 THEN sum(w * coalesce(v, 0e0)) END AS rainfall FROM parts GROUP BY 1, 2),
fac AS (SELECT r, c, slope * 6 AS slope, elevation, ndvi, rainfall FROM ground JOIN ndvi USING (r, c) JOIN rain USING (r, c)),
rated AS (SELECT r, c, {", ".join(f"CASE WHEN {f} IS NOT NULL THEN {w}e0 * {layers._case(f, f)} END AS {f}" for f, w in K.FACTOR_WEIGHTS.items())} FROM fac),
lsi AS (SELECT *, {" + ".join(K.FACTOR_WEIGHTS)} AS lsi FROM rated), lim AS (SELECT min(lsi) AS lo, CASE WHEN quantile_cont(lsi, 0.99) > min(lsi) THEN quantile_cont(lsi, 0.99) ELSE max(lsi) END AS hi FROM lsi)"""


def landslide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landslide layer: four factors, of which greenness and rain come from the scenes."""
    land, seen = written(ground(spark, sf_dir), "ground"), looks(spark, sf_dir)
    green = hazards.greenness(seen.select("r", "c", "b8", "b4", "scl"), land, rasters.disc(2))
    coarse = seen.select(F.floor(F.col("r") / STEP).cast("long").alias("r"), F.floor(F.col("c") / STEP).cast("long").alias("c"), "ts", F.col("rain").alias("value"))
    factors = land.select("r", "c", (F.col("slope") * 6).alias("slope"), "elevation").join(green, ["r", "c"]).join(hazards.rainfall(coarse, land, STEP), ["r", "c"])
    return hazards.landslide(factors)


@query(f"{LANDSLIDE_SQL} SELECT r, c, {', '.join(f'round({f}, 6) AS {f}' for f in K.FACTOR_WEIGHTS)}, round(lsi, 6) AS lsi, round(CASE WHEN lsi IS NULL THEN NULL WHEN hi = lo THEN 0e0 ELSE greatest(least((lsi - lo) / (hi - lo), 1e0), 0e0) END, 6) AS landslide FROM lsi, lim")
def landslide_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(landslide(spark, sf_dir))


STACK_SQL = f"""fl AS ({ORACLE_SQL["flood_composed"]}), ls AS ({ORACLE_SQL["landslide_composed"]}), ex AS ({ORACLE_SQL["exposure_layer"]}), fi AS ({ORACLE_SQL["fire_layer"]}),
stack AS (SELECT r, c, flood, landslide, exposure, fire FROM fl JOIN ls USING (r, c) JOIN ex USING (r, c) JOIN fi USING (r, c))"""


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four layers side by side, each as composed, written."""
    flood_, slide = flood_composed(spark, sf_dir), landslide_composed(spark, sf_dir).select("r", "c", "landslide")
    return written(flood_.join(slide, ["r", "c"]).join(layers.exposure_layer(spark, sf_dir), ["r", "c"]).join(layers.fire_layer(spark, sf_dir), ["r", "c"]), "stack")


@query(f"WITH {STACK_SQL} SELECT * FROM stack")
def layer_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack(spark, sf_dir)


@query(f"""WITH {STACK_SQL}, norm AS (SELECT * FROM stack), {scoring._AHP_SQL}, {scoring._ENTROPY_SQL}, weights AS (SELECT criterion, ((ahp + entropy) / 2) / sum((ahp + entropy) / 2) OVER () AS combined FROM ahp JOIN entropy USING (criterion)),
{scoring.RISK_SQL[scoring.RISK_SQL.index("one AS (SELECT"):]}, areas AS (SELECT class, sum(area) AS area FROM classes GROUP BY class)
SELECT class, round(area, 6) AS area_km2, round(area * 100 / sum(area) OVER (), 6) AS percent FROM areas""")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From scenes to the areas of the risk classes, through all four layers."""
    classed = run_classes(spark, sf_dir)
    areas = classed.groupBy("class").agg(F.sum("area").alias("area_km2"))
    total = classed.agg(F.sum("area").alias("total"))
    return rounded(areas.join(F.broadcast(total), how="cross").select("class", "area_km2", (F.col("area_km2") * 100 / F.col("total")).alias("percent")))


def run_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stack with its weighted index, class and area."""
    from gridloom.functions.geo import cell_area_km2

    cells = stack(spark, sf_dir)
    scored = written(weights.weighted_index(cells, weights.weight_table(spark, cells, S.BANDS, K.PAIRWISE), S.BANDS), "run-risk")
    return weights.classified(scored, "risk", weights.quantile_breaks(scored, "risk")).withColumn("area", cell_area_km2(F.col("r"), S.NORTH, S.STEP, S.STEP))


@query(f"""SELECT round({scoring.AHP["cr"]!r}e0, 6) AS cr, {str(scoring.AHP["cr"] < K.MAX_CONSISTENCY_RATIO).lower()} AS cr_ok, (SELECT count(*) FROM ({ORACLE_SQL["class_area_stats"]})) AS classes, (SELECT count(*) FROM ({ORACLE_SQL["route_tradeoff"]})) AS pairs,
(SELECT count(*) >= {K.LEAST_PAIRS} FROM ({ORACLE_SQL["route_tradeoff"]})) AS pairs_ok, (SELECT passed FROM ({ORACLE_SQL["validation_verdict"]}) WHERE label = 'verified') AS headline""")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: is the run acceptable? Consistent judgements, all classes reported, enough routed pairs, and the headline event in a high class."""
    found = weights.pairwise_weights(K.PAIRWISE)
    classes = scoring.class_area_stats(spark, sf_dir).agg(F.count("*").alias("classes"))
    pairs = network.route_tradeoff(spark, sf_dir).agg(F.count("*").alias("pairs"))
    headline = zones.validation_verdict(spark, sf_dir).where("label = 'verified'").agg(F.max("passed").alias("headline"))
    one = classes.join(F.broadcast(pairs), how="cross").join(F.broadcast(headline), how="cross")
    return one.select(F.round(F.lit(found["cr"]), 6).alias("cr"), F.lit(found["cr"] < K.MAX_CONSISTENCY_RATIO).alias("cr_ok"), "classes", "pairs", (F.col("pairs") >= K.LEAST_PAIRS).alias("pairs_ok"), "headline")
