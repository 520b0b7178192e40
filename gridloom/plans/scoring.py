"""Queries on weights, the composite index, its classes and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import constants as K
from gridloom.functions.geo import cell_area_km2
from gridloom.operators import weights as wt
from gridloom.plans.layers import BANDS, WITH_NORM, normalised, rounded
from gridloom.plans.registry import query
from gridloom.session import table, written
from gridloom.sources import surrogates as S

AHP = wt.pairwise_weights(K.PAIRWISE)
_AHP_SQL = "ahp AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {w!r}e0)" for c, w in zip(BANDS, AHP["weights"], strict=True)) + ") t(criterion, ahp))"
_ENTROPY_SQL = (
    "sums AS (" + " UNION ALL ".join(f"SELECT '{b}' AS criterion, count(*) AS n, sum(greatest({b}, 0e0) + 1e-6) AS s, sum((greatest({b}, 0e0) + 1e-6) * ln(greatest({b}, 0e0) + 1e-6)) AS l FROM norm" for b in BANDS) + "), "
    "div AS (SELECT criterion, 1 + (l / s - ln(s)) / ln(n) AS d FROM sums), entropy AS (SELECT criterion, CASE WHEN sum(d) OVER () > 0 THEN d / sum(d) OVER () ELSE 0.25e0 END AS entropy FROM div)"
)
_PAIRS = [(a, b) for i, a in enumerate(BANDS) for b in BANDS[i + 1 :]]
_CRITIC_SQL = (
    "stats AS (SELECT " + ", ".join([f"stddev_samp({b}) AS sd_{b}" for b in BANDS] + [f"coalesce(corr({a}, {b}), 0e0) AS r_{a}_{b}" for a, b in _PAIRS]) + " FROM norm), "
    "craw AS (" + " UNION ALL ".join(f"SELECT '{b}' AS criterion, greatest(sd_{b} * (" + " + ".join(f"(1 - r_{p}_{q})" for p, q in _PAIRS if b in (p, q)) + "), 1e-6) AS x FROM stats" for b in BANDS) + "), "
    "critic AS (SELECT criterion, x / sum(x) OVER () AS critic FROM craw)"
)
WEIGHTS_SQL = f"{WITH_NORM}, {_AHP_SQL}, {_ENTROPY_SQL}, weights AS (SELECT criterion, ahp, entropy, ((ahp + entropy) / 2) / sum((ahp + entropy) / 2) OVER () AS combined FROM ahp JOIN entropy USING (criterion))"
RISK_SQL = (
    WEIGHTS_SQL + ", one AS (SELECT " + ", ".join(f"max(combined) FILTER (WHERE criterion = '{b}') AS w_{b}" for b in BANDS) + " FROM weights), "
    "score AS (SELECT r, c, " + ", ".join(BANDS) + ", " + " + ".join(f"coalesce({b}, 0e0) * w_{b}" for b in BANDS) + " AS raw FROM norm, one), "
    "lim AS (SELECT min(raw) AS lo, CASE WHEN quantile_cont(raw, 0.99) > min(raw) THEN quantile_cont(raw, 0.99) ELSE max(raw) END AS hi FROM score), "
    "risk AS (SELECT r, c, " + ", ".join(BANDS) + ", CASE WHEN hi = lo THEN 0e0 ELSE greatest(least((raw - lo) / (hi - lo), 1e0), 0e0) END AS risk FROM score, lim), "
    "breaks AS (SELECT quantile_cont(risk, [0.2, 0.4, 0.6, 0.8]) AS b FROM risk), "
    "classes AS (SELECT r, c, " + ", ".join(BANDS) + ", risk, CAST(1 + (risk >= b[1])::INT + (risk >= b[2])::INT + (risk >= b[3])::INT + (risk >= b[4])::INT AS INTEGER) AS class, cos(radians(11.8e0 - (r + 0.5e0) * 0.009e0)) * (0.009e0 * 111.32e0 * 0.009e0 * 110.57e0) AS area FROM risk, breaks)"
)


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with its composite risk; computed weights.

    normalise() and weighted_index() write the grid before the passes over it; the scored grid is written before those for breaks and classes.
    """
    grid = normalised(spark, sf_dir)
    return written(wt.weighted_index(grid, wt.weight_table(spark, grid, BANDS, K.PAIRWISE), BANDS), "risk")


def risk_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The grid with risk, ``class`` and ``area``, and the row of breaks."""
    scored = risk(spark, sf_dir)
    breaks = wt.quantile_breaks(scored, "risk")
    return wt.classified(scored, "risk", breaks).withColumn("area", cell_area_km2(F.col("r"), S.NORTH, S.STEP, S.STEP)), breaks


#: Each supplier judges the criteria pair by pair: the group's base value, a little more or less.
_BASE_SQL = ", ".join(f"({i}, {j}, {K.PAIRWISE[i][j]!r}e0)" for i in range(len(BANDS)) for j in range(i + 1, len(BANDS)))
_NAMED_SQL = ", ".join(f"({i}, '{c}')" for i, c in enumerate(BANDS))


@query(f"""WITH RECURSIVE base AS (SELECT * FROM (VALUES {_BASE_SQL}) t(i, j, v)), named AS (SELECT * FROM (VALUES {_NAMED_SQL}) t(i, criterion)),
mean AS (SELECT i, j, exp(avg(ln(v * (80 + s_suppkey * (i + 1) * (j + 2) % 41) / 100e0))) AS v FROM base, supplier GROUP BY i, j),
m AS (SELECT i, j, v FROM mean UNION ALL SELECT j, i, 1 / v FROM mean UNION ALL SELECT i, i, 1e0 FROM named),
power(k, i, w) AS (SELECT 0, i, 1e0 / {len(BANDS)} FROM named UNION ALL SELECT k + 1, i, x / sum(x) OVER () FROM (SELECT k, m.i AS i, sum(v * w) AS x FROM power JOIN m ON m.j = power.i WHERE k < 200 GROUP BY k, m.i)),
w AS (SELECT i, w FROM power WHERE k = 200), value AS (SELECT avg(x / w.w) AS top FROM (SELECT m.i AS i, sum(v * w.w) AS x FROM m JOIN w ON w.i = m.j GROUP BY m.i) y JOIN w ON w.i = y.i)
SELECT criterion, round(w, 6) AS weight, round(top, 6) AS lambda_max, round((top - {len(BANDS)}) / {len(BANDS) - 1} / {K.RANDOM_INDEX[len(BANDS)]}e0, 6) AS cr FROM w JOIN named USING (i), value""")
def ahp_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the criteria from the judgements of all suppliers."""
    k, n = F.col("s_suppkey"), len(BANDS)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(K.PAIRWISE[i][j])).alias("v")) for i in range(n) for j in range(i + 1, n)]))
    judged = table(spark, sf_dir, "supplier").select(k, pairs.alias("p")).select("p.i", "p.j", (F.col("p.v") * (k * (F.col("p.i") + 1) * (F.col("p.j") + 2) % 41 + 80) / 100.0).alias("value"))
    found = wt.pairwise_weights(wt.group_matrix(judged, n))
    return rounded(spark.createDataFrame([(c, w, found["lambda_max"], found["cr"]) for c, w in zip(BANDS, found["weights"], strict=True)], "criterion string, weight double, lambda_max double, cr double"))


@query(f"{WITH_NORM}, {_ENTROPY_SQL} SELECT criterion, round(entropy, 6) AS weight FROM entropy")
def entropy_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wt.entropy_weights(normalised(spark, sf_dir), BANDS))


@query(f"{WITH_NORM}, {_CRITIC_SQL} SELECT criterion, round(critic, 6) AS weight FROM critic")
def critic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wt.conflict_weights(normalised(spark, sf_dir), BANDS))


@query(f"{WEIGHTS_SQL}, {_CRITIC_SQL} SELECT criterion, round(ahp, 6) AS ahp, round(entropy, 6) AS entropy, round(critic, 6) AS critic, round(combined, 6) AS combined FROM weights JOIN critic USING (criterion)")
def combined_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wt.weight_table(spark, normalised(spark, sf_dir), BANDS, K.PAIRWISE))


@query(f"{RISK_SQL} SELECT r, c, round(risk, 6) AS risk FROM risk")
def composite_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk(spark, sf_dir).select("r", "c", "risk"))


@query(f"{RISK_SQL} SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS n, round(unnest(b), 6) AS break_value FROM breaks")
def class_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wt.quantile_breaks(risk(spark, sf_dir), "risk")
    return rounded(found.select(F.posexplode("breaks").alias("n", "break_value")).withColumn("n", F.col("n") + 1))


@query(f"{RISK_SQL} SELECT r, c, class FROM classes")
def classify_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_classes(spark, sf_dir)[0].select("r", "c", "class")


@query(f"""{RISK_SQL}, names AS (SELECT * FROM (VALUES (1, 'Very Low'), (2, 'Low'), (3, 'Moderate'), (4, 'High'), (5, 'Very High')) t(class, class_name)),
areas AS (SELECT class, sum(area) AS area FROM classes GROUP BY class)
SELECT names.class, class_name, round(([0e0] || b || [1e0])[names.class], 6) AS index_min, round(([0e0] || b || [1e0])[names.class + 1], 6) AS index_max, round(coalesce(area, 0e0), 6) AS area_km2, round(coalesce(area, 0e0) * 100 / sum(area) OVER (), 6) AS percent
FROM names LEFT JOIN areas ON names.class = areas.class, breaks""")
def class_area_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, breaks = risk_classes(spark, sf_dir)
    return rounded(wt.class_statistics(spark, grid, breaks))


_COLOURS = ["#%02x%02x%02x" % c for c in K.CLASS_COLOURS]


@query(f"""{RISK_SQL}, names AS (SELECT * FROM (VALUES {", ".join(f"({i + 1}, '{n}', '{c}')" for i, (n, c) in enumerate(zip(K.CLASS_NAMES, _COLOURS, strict=True)))}) t(class, class_name, colour)), areas AS (SELECT class, sum(area) AS area FROM classes GROUP BY class)
SELECT names.class, class_name, colour, printf('%.3f-%.3f', ([0e0] || b || [1e0])[names.class], ([0e0] || b || [1e0])[names.class + 1]) AS index_range, printf('%.1f', coalesce(area, 0e0)) AS area, printf('%.1f%%', coalesce(area, 0e0) * 100 / sum(area) OVER ()) AS percent FROM names LEFT JOIN areas ON names.class = areas.class, breaks""")
def class_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the class table as they are shown: names, colours and numbers as text."""
    grid, breaks = risk_classes(spark, sf_dir)
    colours = F.array(*[F.lit(c) for c in _COLOURS])
    found = wt.class_statistics(spark, grid, breaks)
    return found.select(
        "class", "class_name", F.get(colours, F.col("class") - 1).alias("colour"), F.format_string("%.3f-%.3f", "index_min", "index_max").alias("index_range"), F.format_string("%.1f", "area_km2").alias("area"), F.format_string("%.1f%%", "percent").alias("percent")
    )


@query(f"{RISK_SQL} SELECT round(sum(area), 6) AS area_km2, round(sum(area) FILTER (WHERE class >= 4) * 100 / sum(area), 6) AS high_percent FROM classes")
def risk_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, _ = risk_classes(spark, sf_dir)
    return rounded(grid.agg(F.sum("area").alias("area_km2"), (F.sum(F.when(F.col("class") >= 4, F.col("area"))) * 100 / F.sum("area")).alias("high_percent")))


@query(f"{WITH_NORM} SELECT r, c, " + ", ".join(f"round({b}, 6) AS {b}" for b in BANDS) + " FROM norm ORDER BY md5(r || ':' || c || ':42') LIMIT 500")
def layer_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wt.hashed_sample(normalised(spark, sf_dir), BANDS, 500, 42).select("r", "c", *BANDS))


#: Quantiles that stand for all values, and classes.
PROBES, CLASSES = 1500, 5
_COSTS = "cost AS (SELECT a.n AS i, b.n AS j, b.s2 - a.s2 - (b.s - a.s) * (b.s - a.s) / (b.n - a.n) AS cost FROM prefix_ a JOIN prefix_ b ON b.n > a.n)"
_LEVELS = ", ".join(
    ["best1 AS (SELECT j AS n, cost AS d, CAST(0 AS BIGINT) AS cut FROM cost WHERE i = 0)"]
    + [f"best{k} AS (SELECT j AS n, min(best{k - 1}.d + cost) AS d, arg_min(i, best{k - 1}.d + cost) AS cut FROM cost JOIN best{k - 1} ON best{k - 1}.n = cost.i GROUP BY j)" for k in range(2, CLASSES + 1)]
)


@query(f"""{RISK_SQL}, v AS (SELECT unnest(CASE WHEN count(risk) <= {PROBES} THEN list_sort(list(risk)) ELSE quantile_cont(risk, [{", ".join(f"{i}e0/{PROBES - 1}" for i in range(PROBES))}]) END) AS x FROM risk),
numbered AS (SELECT x, row_number() OVER (ORDER BY x) AS n FROM v),
prefix_ AS (SELECT n, sum(x) OVER (ORDER BY n) AS s, sum(x * x) OVER (ORDER BY n) AS s2 FROM numbered UNION ALL SELECT 0, 0e0, 0e0), {_COSTS}, {_LEVELS},
c5 AS (SELECT cut FROM best5 WHERE n = (SELECT max(n) FROM numbered)), c4 AS (SELECT cut FROM best4 WHERE n = (SELECT cut FROM c5)), c3 AS (SELECT cut FROM best3 WHERE n = (SELECT cut FROM c4)), c2 AS (SELECT cut FROM best2 WHERE n = (SELECT cut FROM c3)),
cuts AS (SELECT 0 AS k, cut FROM c2 UNION ALL SELECT 1, cut FROM c3 UNION ALL SELECT 2, cut FROM c4 UNION ALL SELECT 3, cut FROM c5)
SELECT CAST(k AS INTEGER) AS n, round(x, 6) AS break_value FROM cuts JOIN numbered ON numbered.n = cut + 1""")
def natural_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wt.jenks(risk(spark, sf_dir), "risk", CLASSES, PROBES).select(F.posexplode("breaks").alias("n", "break_value")))
