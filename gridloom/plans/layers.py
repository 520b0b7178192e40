"""Queries on cells and scenes: bounds, rescaling, focal windows, resampling, temporal reducers and the four layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import cells as fc
from gridloom.functions import constants as K
from gridloom.functions import projections
from gridloom.functions.geo import cell_area_km2
from gridloom.operators import rasters
from gridloom.plans.registry import query
from gridloom.session import table
from gridloom.sources import surrogates as S

BANDS = S.BANDS
BOUNDS_SQL = "bounds AS (SELECT " + ", ".join(f"min({b}) AS {b}_lo, CASE WHEN quantile_cont({b}, 0.99) > min({b}) THEN quantile_cont({b}, 0.99) ELSE max({b}) END AS {b}_hi" for b in BANDS) + " FROM cells)"
NORM_SQL = "norm AS (SELECT r, c, " + ", ".join(f"CASE WHEN {b}_hi = {b}_lo THEN 0e0 ELSE greatest(least(({b} - {b}_lo) / ({b}_hi - {b}_lo), 1e0), 0e0) END AS {b}" for b in BANDS) + " FROM cells, bounds)"
WITH_NORM = f"WITH {S.CELLS_SQL}, {BOUNDS_SQL}, {NORM_SQL}"


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with its four bands rescaled."""
    return rasters.normalise(S.cells(spark, sf_dir), BANDS)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded as results."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def focal_sql(value: str, agg: str, near: str, reach: int, source: str = "norm") -> str:
    """A window aggregate in SQL: join of each cell with those around it."""
    return f"""{WITH_NORM}, offs AS (SELECT dr, dc FROM range(-{reach}, {reach + 1}) a(dr), range(-{reach}, {reach + 1}) b(dc) WHERE {near})
SELECT x.r, x.c, round({agg}(y.{value}), 6) AS value
FROM {source} x CROSS JOIN offs JOIN {source} y ON y.r = x.r + dr AND y.c = x.c + dc GROUP BY x.r, x.c"""


@query(f"WITH {S.CELLS_SQL}, {BOUNDS_SQL} SELECT " + ", ".join(f"round({b}_lo, 4) AS {b}_lo, round({b}_hi, 4) AS {b}_hi" for b in BANDS) + " FROM bounds")
def minmax_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rasters.bounds(S.cells(spark, sf_dir), BANDS), 4)


@query(f"{WITH_NORM} SELECT r, c, " + ", ".join(f"round({b}, 6) AS {b}" for b in BANDS) + " FROM norm")
def normalized_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normalised(spark, sf_dir).select("r", "c", *BANDS))


@query(focal_sql("flood", "avg", "dr * dr + dc * dc <= 9", 3))
def focal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rasters.focal(normalised(spark, sf_dir), "flood", rasters.disc(3)))


@query(focal_sql("exposure", "median", "dr * dr + dc * dc <= 4", 2))
def focal_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rasters.focal(normalised(spark, sf_dir), "exposure", rasters.disc(2), "median"))


@query(focal_sql("fire", "max", "dr * dr + dc * dc <= 9", 3))
def focal_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rasters.focal(normalised(spark, sf_dir), "fire", rasters.disc(3), "max"))


@query(focal_sql("landslide", "avg", "true", 2))
def area_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rasters.focal(normalised(spark, sf_dir), "landslide", rasters.square(2)))


@query(f"""{WITH_NORM}, raw AS (SELECT dr, dc, exp(-(dr * dr + dc * dc) / 12.5e0) AS w FROM range(-5, 6) a(dr), range(-5, 6) b(dc) WHERE dr * dr + dc * dc <= 25),
offs AS (SELECT dr, dc, w / (SELECT sum(w) FROM raw) AS w FROM raw)
SELECT x.r, x.c, round(sum(w * y.fire), 6) AS density FROM norm x CROSS JOIN offs JOIN norm y ON y.r = x.r + dr AND y.c = x.c + dc GROUP BY x.r, x.c""")
def gaussian_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rasters.density(normalised(spark, sf_dir).select("r", "c", "fire"), "fire", 5, 2.5).select("r", "c", "density"))


@query(f"""{WITH_NORM}, offs AS (SELECT dr, dc FROM range(-2, 3) a(dr), range(-2, 3) b(dc) WHERE abs(dr) + abs(dc) <= 2)
SELECT DISTINCT r + dr AS r, c + dc AS c FROM norm CROSS JOIN offs WHERE exposure > 0.7e0""")
def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.dilate(normalised(spark, sf_dir).where("exposure > 0.7").select("r", "c"))


@query(f"{WITH_NORM} SELECT CAST(floor(r / 4) AS BIGINT) AS r, CAST(floor(c / 4) AS BIGINT) AS c, " + ", ".join(f"round(avg({b}), 6) AS {b}" for b in BANDS) + " FROM norm GROUP BY 1, 2")
def downsample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rasters.downsample(normalised(spark, sf_dir), 4, BANDS))


GRADIENT_SQL = f"""{WITH_NORM}, near AS (
  SELECT m.r, m.c, m.landslide AS v, u.landslide AS up, d.landslide AS down, l.landslide AS lft, g.landslide AS rgt
  FROM norm m LEFT JOIN norm u ON u.r = m.r - 1 AND u.c = m.c LEFT JOIN norm d ON d.r = m.r + 1 AND d.c = m.c
  LEFT JOIN norm l ON l.c = m.c - 1 AND l.r = m.r LEFT JOIN norm g ON g.c = m.c + 1 AND g.r = m.r
), grad AS (
  SELECT r, c, coalesce((coalesce(down, v) - coalesce(up, v)) / nullif((CASE WHEN down IS NULL THEN 0 ELSE 1 END + CASE WHEN up IS NULL THEN 0 ELSE 1 END) * 0.5e0, 0), 0e0) AS gr,
         coalesce((coalesce(rgt, v) - coalesce(lft, v)) / nullif((CASE WHEN rgt IS NULL THEN 0 ELSE 1 END + CASE WHEN lft IS NULL THEN 0 ELSE 1 END) * 0.5e0, 0), 0e0) AS gc
  FROM near)"""


@query(f"{GRADIENT_SQL} SELECT r, c, round(degrees(atan(sqrt(gr * gr + gc * gc))), 6) AS slope FROM grad")
def slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rasters.slope(normalised(spark, sf_dir).select("r", "c", "landslide"), "landslide", 0.5).select("r", "c", "slope"))


@query(f"{GRADIENT_SQL} SELECT r, c, round(greatest((gc * 0.5e0 + 0.8e0 + gr * 0.4e0) / sqrt(1.05e0) / sqrt(gr * gr + gc * gc + 1), 0e0), 6) AS shade FROM grad")
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rasters.hillshade(normalised(spark, sf_dir).select("r", "c", "landslide"), "landslide", 0.5).select("r", "c", "shade"))


@query(f"""{WITH_NORM}, pts AS (SELECT p_partkey AS id, (p_partkey * 13 % 380) / 10e0 AS y, (p_partkey * 17 % 480) / 10e0 AS x FROM part),
corners AS (SELECT id, y, x, CAST(floor(y) AS BIGINT) + i AS r, CAST(floor(x) AS BIGINT) + j AS c FROM pts, range(2) a(i), range(2) b(j)),
parts AS (SELECT id, (1 - abs(y - corners.r)) * (1 - abs(x - corners.c)) AS w, flood FROM corners LEFT JOIN norm ON norm.r = corners.r AND norm.c = corners.c)
SELECT id, CASE WHEN count(*) FILTER (WHERE w > 0 AND flood IS NULL) = 0 THEN round(sum(w * coalesce(flood, 0e0)), 6) END AS value FROM parts GROUP BY id""")
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 13 % 380 / 10.0).alias("y"), (F.col("p_partkey") * 17 % 480 / 10.0).alias("x"))
    return rounded(rasters.bilinear(points, normalised(spark, sf_dir), "flood"))


@query(f"""{WITH_NORM}, {S.POI_SQL} SELECT id, round(flood, 6) AS flood, round(76e0 + (poi.c + 0.5e0) * 0.009e0, 6) AS lon, round(11.8e0 - (poi.r + 0.5e0) * 0.009e0, 6) AS lat
FROM poi LEFT JOIN norm ON norm.r = poi.r AND norm.c = poi.c""")
def point_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.functions.geo import cell_centre, cell_index

    points = S.poi(spark, sf_dir).select("id", cell_centre(F.col("c"), S.WEST, S.STEP).alias("lon"), cell_centre(F.col("r"), S.NORTH, -S.STEP).alias("lat"))
    keyed = points.withColumns({"r": cell_index(F.col("lat"), S.NORTH, -S.STEP), "c": cell_index(F.col("lon"), S.WEST, S.STEP)})
    return rounded(keyed.join(normalised(spark, sf_dir).select("r", "c", "flood"), ["r", "c"], "left").select("id", "flood", "lon", "lat"))


@query(f"{WITH_NORM} SELECT r, count(*) AS cells, round(count(*) * cos(radians(11.8e0 - (r + 0.5e0) * 0.009e0)) * 0.009e0 * 111.32e0 * 0.009e0 * 110.57e0, 6) AS area_km2 FROM norm GROUP BY r")
def row_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalised(spark, sf_dir).groupBy("r").agg(F.count("*").alias("cells"))
    return rounded(found.withColumn("area_km2", F.col("cells") * cell_area_km2(F.col("r"), S.NORTH, S.STEP, S.STEP)))


@query(f"{WITH_NORM} SELECT r, c, " + ", ".join(f"CAST(round_even({b} * 254, 0) AS INTEGER) AS {b}" for b in BANDS) + " FROM norm")
def quantised_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(spark, sf_dir).select("r", "c", *[fc.quantise(F.col(b)).alias(b) for b in BANDS])


_RAMP = [[c[i] for c in K.CLASS_COLOURS] for i in range(3)]
_AT = "CAST(least(floor(flood * 4), 3) AS INTEGER)"
_EXACT = [f"({v}[{_AT} + 1] + ({v}[{_AT} + 2] - {v}[{_AT} + 1]) * (flood * 4 - {_AT}))" for v in _RAMP]
_PART = [f"CAST(round_even({v}, 0) AS INTEGER)" for v in _EXACT]


@query(f"{WITH_NORM} SELECT r, c, '#' || " + " || ".join(f"lower(lpad(to_hex({p}), 2, '0'))" for p in _PART) + " AS colour FROM norm")
def colour_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(spark, sf_dir).select("r", "c", fc.hex_colour(fc.ramp(F.col("flood"), K.CLASS_COLOURS)).alias("colour"))


@query(f"{WITH_NORM} SELECT r, c, " + ", ".join(f"CAST(floor({v}) AS INTEGER) AS {n}" for v, n in zip(_EXACT, ("red", "green", "blue"), strict=True)) + ", CAST(floor((flood * 0.70e0 + 0.30e0) * 255) AS INTEGER) AS alpha FROM norm")
def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(spark, sf_dir).select("r", "c", fc.pixel(F.col("flood"), K.CLASS_COLOURS).alias("p")).select("r", "c", "p.*")


GRID = rasters.Grid(S.WEST, S.NORTH, S.STEP, S.STEP, S.ROWS, S.COLS)


@query(f"""{WITH_NORM}, at_ AS (SELECT p_partkey AS id, CAST(floor((11.8e0 - (11.81e0 - (p_partkey * 13 % 400) / 1000e0)) / 0.009e0) AS BIGINT) AS r, CAST(floor((75.99e0 + (p_partkey * 17 % 500) / 1000e0 - 76e0) / 0.009e0) AS BIGINT) AS c FROM part)
SELECT id, {", ".join(f"round(round_even({b} * 254, 0) / 254, 6) AS {b}" for b in BANDS)} FROM at_ LEFT JOIN norm USING (r, c)""")
def click_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a click on the map shows: the quantised bands of the cell, nothing outside."""
    k = F.col("p_partkey")
    points = table(spark, sf_dir, "part").select(k.alias("id"), (F.lit(75.99) + k * 17 % 500 / 1000.0).alias("lon"), (F.lit(11.81) - k * 13 % 400 / 1000.0).alias("lat"))
    return rounded(rasters.lookup(points, quantised_grid(spark, sf_dir), BANDS, GRID))


TARGET = rasters.Grid(S.WEST - 0.02, S.NORTH + 0.011, 0.0131, 0.0117, 33, 37)


@query(f"""{WITH_NORM}, t AS (SELECT r, c, (({TARGET.west!r}e0 + (c + 0.5e0) * {TARGET.dx}e0) - {S.WEST}e0) / {S.STEP}e0 - 0.5e0 AS x, ({S.NORTH}e0 - ({TARGET.north!r}e0 - (r + 0.5e0) * {TARGET.dy}e0)) / {S.STEP}e0 - 0.5e0 AS y FROM range({TARGET.rows}) a(r), range({TARGET.columns}) b(c)),
h AS (SELECT r, c, CASE WHEN x >= -0.5e0 AND x <= {S.COLS - 0.5}e0 THEN least(greatest(x, 0e0), {S.COLS - 1}e0) END AS x, CASE WHEN y >= -0.5e0 AND y <= {S.ROWS - 0.5}e0 THEN least(greatest(y, 0e0), {S.ROWS - 1}e0) END AS y FROM t),
k AS (SELECT h.*, CAST(floor(y) AS BIGINT) + i AS cr, CAST(floor(x) AS BIGINT) + j AS cc FROM h, range(2) p(i), range(2) q(j)),
w AS (SELECT k.r, k.c, (1 - abs(y - cr)) * (1 - abs(x - cc)) AS w, flood FROM k LEFT JOIN norm ON norm.r = cr AND norm.c = cc)
SELECT r, c, CASE WHEN count(w) > 0 AND count(*) FILTER (WHERE w > 0 AND flood IS NULL) = 0 THEN round(sum(w * coalesce(flood, 0e0)), 6) END AS flood FROM w GROUP BY r, c""")
def resampled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rasters.resample(normalised(spark, sf_dir), "flood", GRID, TARGET))


#: The plane that areas and distances in metres are taken on, and a grid on it.
PLANE, PLANE_GRID = projections.zone(43), rasters.Grid(608_100.0, 1_305_900.0, 1_310.0, 1_290.0, 36, 41)
#: The series of the projection in SQL, in the third flattening n.
TM_SQL = """tm0 AS (SELECT (1 / 298.257223563e0) / (2 - 1 / 298.257223563e0) AS n), tm AS (SELECT n, 0.9996e0 * 6378137e0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS u, 2 * sqrt(n) / (1 + n) AS k,
  [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440, 61 * n ** 3 / 240 - 103 * n ** 4 / 140, 49561 * n ** 4 / 161280] AS a,
  [n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 - n ** 4 / 360, n ** 2 / 48 + n ** 3 / 15 - 437 * n ** 4 / 1440, 17 * n ** 3 / 480 - 37 * n ** 4 / 840, 4397 * n ** 4 / 161280] AS b,
  [2 * n - 2 * n ** 2 / 3 - 2 * n ** 3 + 116 * n ** 4 / 45, 7 * n ** 2 / 3 - 8 * n ** 3 / 5 - 227 * n ** 4 / 45, 56 * n ** 3 / 15 - 136 * n ** 4 / 35, 4279 * n ** 4 / 630] AS d FROM tm0)"""


def _back_sql(x: str, y: str, rows: str) -> str:
    """``rows`` with the degrees ``lon`` and ``lat`` of metres on the plane."""
    turn = " + ".join("b[{0}] * {1}({2} * xi) * {3}({2} * eta)".replace("{0}", str(j)).replace("{2}", str(2 * j)) for j in range(1, 5))
    u, v = turn.replace("{1}", "cos").replace("{3}", "sinh"), turn.replace("{1}", "sin").replace("{3}", "cosh")
    lat = " + ".join(f"d[{j}] * sin({2 * j} * chi)" for j in range(1, 5))
    return f"""(SELECT *, degrees(atan2(sinh(uu), cos(vv))) + 75 AS lon, degrees(chi + {lat}) AS lat FROM (SELECT *, asin(sin(vv) / cosh(uu)) AS chi FROM (SELECT *, eta - ({u}) AS uu, xi - ({v}) AS vv FROM (SELECT *, ({x} - 500000e0) / u AS eta, {y} / u AS xi FROM {rows}, tm))))"""


@query(f"""WITH {TM_SQL}, spot AS (SELECT p_partkey AS id, {S.WEST}e0 + (p_partkey * 17 % 500 / 10e0 + 0.0317e0) * {S.STEP}e0 AS lon0, {S.NORTH}e0 - (p_partkey * 13 % 400 / 10e0 + 0.0413e0) * {S.STEP}e0 AS lat0 FROM part),
conformal AS (SELECT *, sinh(atanh(sin(radians(lat0))) - k * atanh(k * sin(radians(lat0)))) AS t, radians(lon0 - 75) AS w FROM spot, tm),
plane0 AS (SELECT *, atan2(t, cos(w)) AS p, asinh(sin(w) / sqrt(t * t + cos(w) * cos(w))) AS q FROM conformal),
plane AS (SELECT id, 500000 + u * (q + {" + ".join(f"a[{j}] * cos({2 * j} * p) * sinh({2 * j} * q)" for j in range(1, 5))}) AS x, u * (p + {" + ".join(f"a[{j}] * sin({2 * j} * p) * cosh({2 * j} * q)" for j in range(1, 5))}) AS y FROM plane0)
SELECT id, round(x, 4) AS x, round(y, 4) AS y, round(lon, 9) AS lon, round(lat, 9) AS lat FROM {_back_sql("x", "y", "plane")}""")
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' points in metres on the plane, and back in degrees."""
    k = F.col("p_partkey")
    x, y = PLANE.forward(F.lit(S.WEST) + (k * 17 % 500 / 10.0 + 0.0317) * S.STEP, F.lit(S.NORTH) - (k * 13 % 400 / 10.0 + 0.0413) * S.STEP)
    placed = table(spark, sf_dir, "part").select(k.alias("id"), x.alias("x"), y.alias("y"))
    lon, lat = PLANE.inverse(F.col("x"), F.col("y"))
    return placed.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query(f"""{WITH_NORM}, {TM_SQL}, m AS (SELECT r, c, {PLANE_GRID.west}e0 + (c + 0.5e0) * {PLANE_GRID.dx}e0 AS mx, {PLANE_GRID.north}e0 - (r + 0.5e0) * {PLANE_GRID.dy}e0 AS my FROM range({PLANE_GRID.rows}) a_(r), range({PLANE_GRID.columns}) b_(c)),
t AS (SELECT r, c, (lon - {S.WEST}e0) / {S.STEP}e0 - 0.5e0 AS x, ({S.NORTH}e0 - lat) / {S.STEP}e0 - 0.5e0 AS y FROM {_back_sql("mx", "my", "m")}),
h AS (SELECT r, c, CASE WHEN x >= -0.5e0 AND x <= {S.COLS - 0.5}e0 THEN least(greatest(x, 0e0), {S.COLS - 1}e0) END AS x, CASE WHEN y >= -0.5e0 AND y <= {S.ROWS - 0.5}e0 THEN least(greatest(y, 0e0), {S.ROWS - 1}e0) END AS y FROM t),
k_ AS (SELECT h.*, CAST(floor(y) AS BIGINT) + i AS cr, CAST(floor(x) AS BIGINT) + j AS cc FROM h, range(2) p(i), range(2) q(j)),
w_ AS (SELECT k_.r, k_.c, (1 - abs(y - cr)) * (1 - abs(x - cc)) AS w, flood FROM k_ LEFT JOIN norm ON norm.r = cr AND norm.c = cc)
SELECT r, c, CASE WHEN count(w) > 0 AND count(*) FILTER (WHERE w > 0 AND flood IS NULL) = 0 THEN round(sum(w * coalesce(flood, 0e0)), 6) END AS flood FROM w_ GROUP BY r, c""")
def projected_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flood layer on a grid in metres."""
    return rounded(rasters.resample(normalised(spark, sf_dir), "flood", GRID, PLANE_GRID, PLANE))


@query(f"{WITH_NORM} SELECT r, c, round((flood - fire) / nullif(flood + fire, 0), 6) AS nd FROM norm WHERE CAST(floor(exposure * 12) AS BIGINT) NOT IN (3, 8, 9, 10, 11)")
def normalised_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    clear = normalised(spark, sf_dir).where(~F.floor(F.col("exposure") * 12).isin(*K.CLOUD_CLASSES))
    return rounded(clear.select("r", "c", fc.normalised_difference(F.col("flood"), F.col("fire")).alias("nd")))


def _case(column: str, factor: str) -> str:
    edges, ratings = K.FACTORS[factor]
    return "CASE " + " ".join(f"WHEN {column} < {float(e)}e0 THEN {r}e0" for e, r in zip(edges, ratings, strict=False)) + f" ELSE {ratings[-1]}e0 END"


#: Factor values on the scale of their edges, from the rescaled bands.
FACTOR_VALUES = {"slope": ("flood", 60.0), "elevation": ("landslide", 2500.0), "ndvi": ("exposure", 1.0), "rainfall": ("fire", 4500.0)}


@query(f"{WITH_NORM} SELECT r, c, " + ", ".join(f"{_case(f'({b} * {s}e0)', f)} AS {f}" for f, (b, s) in FACTOR_VALUES.items()) + " FROM norm")
def fr_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(spark, sf_dir).select("r", "c", *[fc.rating(F.col(b) * s, *K.FACTORS[f]).alias(f) for f, (b, s) in FACTOR_VALUES.items()])


LSI_SQL = f"{WITH_NORM}, lsi AS (SELECT r, c, " + " + ".join(f"{K.FACTOR_WEIGHTS[f]}e0 * {_case(f'({b} * {s}e0)', f)}" for f, (b, s) in FACTOR_VALUES.items()) + " AS lsi FROM norm)"


@query(f"{LSI_SQL}, lim AS (SELECT min(lsi) AS lo, CASE WHEN quantile_cont(lsi, 0.99) > min(lsi) THEN quantile_cont(lsi, 0.99) ELSE max(lsi) END AS hi FROM lsi) SELECT r, c, round(lsi, 6) AS lsi, round(CASE WHEN hi = lo THEN 0e0 ELSE greatest(least((lsi - lo) / (hi - lo), 1e0), 0e0) END, 6) AS landslide FROM lsi, lim")
def landslide_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = sum((fc.rating(F.col(b) * s, *K.FACTORS[f]) * K.FACTOR_WEIGHTS[f] for f, (b, s) in FACTOR_VALUES.items()), F.lit(0.0))
    rated = normalised(spark, sf_dir).select("r", "c", index.alias("lsi")).withColumn("landslide", F.col("lsi"))
    return rounded(rasters.normalise(rated, ["landslide"]))


@query("SELECT user_id AS cell, event_type AS band, round(median(value), 6) AS value FROM events GROUP BY 1, 2")
def temporal_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.scenes(spark, sf_dir).groupBy("cell", "band").agg(F.median("value").alias("value")))


@query("SELECT cell, round(max(total), 4) AS season_max FROM (SELECT user_id AS cell, year(ts) AS y, sum(value) AS total FROM events WHERE month(ts) BETWEEN 1 AND 3 GROUP BY 1, 2) GROUP BY cell")
def season_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rasters.season_max(S.scenes(spark, sf_dir), (1, 3), ["cell"]), 4)


@query("""SELECT user_id AS cell, CAST(coalesce(count(*) FILTER (WHERE event_type = 'click' AND value >= 30), 0) + coalesce(count(*) FILTER (WHERE event_type = 'view' AND value >= 7), 0) AS BIGINT) AS detections
FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1""")
def detection_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = S.scenes(spark, sf_dir).where("ts >= timestamp_ntz '2024-01-05' AND ts < timestamp_ntz '2024-01-25'")
    hit = ((F.col("band") == "click") & (F.col("value") >= K.FIRE_CONFIDENCE)) | ((F.col("band") == "view") & (F.col("value") >= K.FIRE_MASK))
    return scenes.groupBy("cell").agg(F.count_if(hit).alias("detections"))


@query("SELECT user_id AS cell, round(avg(CASE WHEN value < 20 THEN 1e0 ELSE 0e0 END), 6) AS frequency, count(*) AS scenes FROM events WHERE event_type = 'view' GROUP BY 1")
def mask_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = S.scenes(spark, sf_dir).where("band = 'view'")
    return rounded(seen.groupBy("cell").agg(F.avg((F.col("value") < 20).cast("double")).alias("frequency"), F.count("*").alias("scenes")))


@query("SELECT user_id AS cell, " + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{b}'), 6) AS {b}" for b in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.scenes(spark, sf_dir).groupBy("cell").pivot("band", ["click", "error", "purchase", "signup", "view"]).avg("value"))


@query("""SELECT event_type AS band, count(*) AS scenes, CAST(min(ts) AS VARCHAR) AS first FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND user_id < 50 GROUP BY 1""")
def scene_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.scenes(spark, sf_dir).where("ts >= timestamp_ntz '2024-01-10' AND ts < timestamp_ntz '2024-01-20' AND cell < 50")
    return found.groupBy("band").agg(F.count("*").alias("scenes"), F.min("ts").cast("string").alias("first"))


HIST_SQL = """WITH v AS (SELECT -25e0 + (l_discount * 5 + l_tax * 6) * 20e0 + (l_quantity / 50e0) AS vv, l_linenumber AS win FROM lineitem),
lim AS (SELECT win, min(vv) AS lo, greatest((max(vv) - min(vv)) / 255, 0.1e0) AS w FROM v GROUP BY win),
bins AS (SELECT v.win, CAST(least(floor((vv - lo) / w), 254) AS BIGINT) AS bin, count(*) AS n, avg(vv) AS mean FROM v JOIN lim USING (win) GROUP BY 1, 2)"""


def _backscatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.lit(-25.0) + (F.col("l_discount") * 5 + F.col("l_tax") * 6) * 20.0 + F.col("l_quantity") / 50.0).alias("vv"), F.col("l_linenumber").alias("win"))


@query(HIST_SQL + " SELECT win, bin, n, CAST(round(mean * n * 100) AS BIGINT) AS hundredths FROM bins")
def band_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums in whole hundredths, as the values are: rounded means would hang on the order of addition where they fall between two digits."""
    found = rasters.histogram(_backscatter(spark, sf_dir), "vv", by=["win"])
    return found.select("win", "bin", "n", F.round(F.col("mean") * F.col("n") * 100).cast("long").alias("hundredths"))


OTSU_SQL = HIST_SQL + """, s AS (
  SELECT *, sum(n) OVER up AS n0, sum(n * mean) OVER up AS s0, sum(n) OVER (PARTITION BY win) AS n1, sum(n * mean) OVER (PARTITION BY win) AS s1 FROM bins WINDOW up AS (PARTITION BY win ORDER BY bin)
), b AS (SELECT *, coalesce(n0 * (n1 - n0) * power(s0 / nullif(n0, 0) - (s1 - s0) / nullif(n1 - n0, 0), 2), 0e0) AS between_ FROM s),
t AS (SELECT win, arg_max(mean, (between_, -bin)) AS threshold FROM b GROUP BY win)
SELECT win, round(threshold, 6) AS threshold, round(least(greatest(coalesce(threshold, -16e0), -22e0), -13e0), 6) AS guarded FROM t"""


@query(OTSU_SQL)
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rasters.otsu(rasters.histogram(_backscatter(spark, sf_dir), "vv", by=["win"]), ["win"])
    return rounded(found.withColumn("guarded", rasters.guarded(F.col("threshold"), K.FLOOD_FALLBACK_DB, *K.FLOOD_RANGE_DB)))


def _norm_sql(table_: str, value: str, out: str) -> str:
    return f"{out}_l AS (SELECT min({value}) AS lo, CASE WHEN quantile_cont({value}, 0.99) > min({value}) THEN quantile_cont({value}, 0.99) ELSE max({value}) END AS hi FROM {table_}), {out} AS (SELECT r, c, CASE WHEN hi = lo THEN 0e0 ELSE greatest(least(({value} - lo) / (hi - lo), 1e0), 0e0) END AS {value} FROM {table_}, {out}_l)"


DISC1 = "offs AS (SELECT dr, dc FROM range(-1, 2) a(dr), range(-1, 2) b(dc) WHERE dr * dr + dc * dc <= 1)"


@query(f"""{WITH_NORM}, {DISC1}, m AS (SELECT r, c, (CASE WHEN flood < 0.5e0 AND exposure < 0.9e0 THEN 1e0 ELSE 0e0 END + CASE WHEN fire < 0.5e0 THEN 1e0 ELSE 0e0 END) / 2 AS mask, CASE WHEN landslide < 0.8e0 THEN landslide ELSE 0e0 END AS water FROM norm),
f AS (SELECT x.r, x.c, avg(y.mask) AS mask, avg(y.water) AS water FROM m x CROSS JOIN offs JOIN m y ON y.r = x.r + dr AND y.c = x.c + dc GROUP BY 1, 2),
raw AS (SELECT r, c, 0.7e0 * mask + 0.3e0 * water AS flood FROM f), {_norm_sql("raw", "flood", "out_")} SELECT r, c, round(flood, 6) AS flood FROM out_""")
def flood_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = normalised(spark, sf_dir)
    masks = grid.select(
        "r", "c",
        ((((F.col("flood") < 0.5) & (F.col("exposure") < 0.9)).cast("double") + (F.col("fire") < 0.5).cast("double")) / 2).alias("mask"),
        F.when(F.col("landslide") < 0.8, F.col("landslide")).otherwise(0.0).alias("water"),
    )
    around = rasters.focal(masks, "mask", rasters.disc(1), out="mask").join(rasters.focal(masks, "water", rasters.disc(1), out="water"), ["r", "c"])
    raw = around.select("r", "c", (F.col("mask") * K.FLOOD_PARTS[0] + F.col("water") * K.FLOOD_PARTS[1]).alias("flood"))
    return rounded(rasters.normalise(raw, ["flood"]))


@query(f"""{WITH_NORM}, raw0 AS (SELECT dr, dc, exp(-(dr * dr + dc * dc) / 12.5e0) AS w FROM range(-5, 6) a(dr), range(-5, 6) b(dc) WHERE dr * dr + dc * dc <= 25),
offs AS (SELECT dr, dc, w / (SELECT sum(w) FROM raw0) AS w FROM raw0),
k AS (SELECT x.r, x.c, sum(w * y.fire) AS fire FROM norm x CROSS JOIN offs JOIN norm y ON y.r = x.r + dr AND y.c = x.c + dc GROUP BY 1, 2), {_norm_sql("k", "fire", "kn")},
raw AS (SELECT kn.r, kn.c, kn.fire * (0.2e0 + 0.8e0 * greatest(least(norm.flood + norm.exposure, 1e0), 0e0)) AS fire FROM kn JOIN norm ON norm.r = kn.r AND norm.c = kn.c), {_norm_sql("raw", "fire", "out_")}
SELECT r, c, round(fire, 6) AS fire FROM out_""")
def fire_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = normalised(spark, sf_dir)
    dense = rasters.normalise(rasters.density(grid.select("r", "c", "fire"), "fire", 5, 2.5, out="dense").select("r", "c", "dense"), ["dense"])
    fuel = F.lit(K.FIRE_VEGETATION[0]) + fc.clamp(F.col("flood") + F.col("exposure")) * K.FIRE_VEGETATION[1]
    return rounded(rasters.normalise(dense.join(grid, ["r", "c"]).select("r", "c", (F.col("dense") * fuel).alias("fire")), ["fire"]))


ROADS_SQL = "roads AS (SELECT CAST(s_suppkey % 50 AS DOUBLE) * 1000 AS ax, CAST(s_suppkey * 3 % 40 AS DOUBLE) * 1000 AS ay, CAST(s_suppkey % 50 + s_suppkey % 5 AS DOUBLE) * 1000 AS bx, CAST(s_suppkey * 3 % 40 + s_suppkey % 3 AS DOUBLE) * 1000 AS by_ FROM supplier)"
DISTANCE_SQL = f"""{ROADS_SQL}, near AS (SELECT r, c, least(coalesce(min(sqrt(power(x - (ax + t * (bx - ax)), 2) + power(y - (ay + t * (by_ - ay)), 2))), 1500e0), 1500e0) AS distance
FROM (SELECT r, c, c * 1000 + 500e0 AS x, r * 1000 + 500e0 AS y, ax, ay, bx, by_, coalesce(greatest(least(((c * 1000 + 500e0 - ax) * (bx - ax) + (r * 1000 + 500e0 - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0), 1e0), 0e0), 0e0) AS t FROM norm, roads) GROUP BY r, c)"""


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in metres over the grid, a kilometre a cell, of all suppliers, each different one once."""
    k = F.col("s_suppkey")
    metres = lambda x: x.cast("double") * 1000
    return table(spark, sf_dir, "supplier").select(metres(k % 50).alias("ax"), metres(k * 3 % 40).alias("ay"), metres(k % 50 + k % 5).alias("bx"), metres(k * 3 % 40 + k % 3).alias("by")).distinct()


def road_distance(grid: DataFrame, lines: DataFrame) -> DataFrame:
    """Distance of each cell's centre to the nearest road, up to the limit."""
    centres = grid.select(F.struct("r", "c").alias("id"), (F.col("c") * 1000 + 500.0).alias("x"), (F.col("r") * 1000 + 500.0).alias("y"))
    return rasters.near_segments(centres, lines, K.ROAD_LIMIT_M).select("id.r", "id.c", "distance")


@query(f"{WITH_NORM}, {DISTANCE_SQL} SELECT r, c, round(distance, 4) AS distance FROM near")
def distance_to_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(road_distance(normalised(spark, sf_dir), roads(spark, sf_dir)), 4)


@query(f"""{WITH_NORM}, {DISTANCE_SQL}, {DISC1}, b AS (SELECT x.r, x.c, avg(y.exposure) AS built FROM norm x CROSS JOIN offs JOIN norm y ON y.r = x.r + dr AND y.c = x.c + dc GROUP BY 1, 2),
raw AS (SELECT b.r, b.c, 0.7e0 * built + 0.3e0 * (1500 - distance) / 1500 AS exposure FROM b JOIN near ON near.r = b.r AND near.c = b.c), {_norm_sql("raw", "exposure", "out_")} SELECT r, c, round(exposure, 6) AS exposure FROM out_""")
def exposure_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exposure(normalised(spark, sf_dir), "exposure", roads(spark, sf_dir)))


def exposure(grid: DataFrame, built: str, lines: DataFrame | None) -> DataFrame:
    """The exposure layer: smoothed built-up share and nearness to roads, rescaled; of the built-up share alone where there are no roads."""
    smooth = rasters.focal(grid, built, rasters.disc(1), out="smooth")
    if lines is None:
        return rasters.normalise(smooth.select("r", "c", F.col("smooth").alias("exposure")), ["exposure"])
    near = road_distance(grid, lines)
    raw = smooth.join(near, ["r", "c"]).select("r", "c", (F.col("smooth") * K.EXPOSURE_PARTS[0] + (F.lit(K.ROAD_LIMIT_M) - F.col("distance")) * K.EXPOSURE_PARTS[1] / K.ROAD_LIMIT_M).alias("exposure"))
    return rasters.normalise(raw, ["exposure"])


@query(f"""{WITH_NORM}, {DISC1}, raw AS (SELECT x.r, x.c, avg(y.exposure) AS exposure FROM norm x CROSS JOIN offs JOIN norm y ON y.r = x.r + dr AND y.c = x.c + dc GROUP BY 1, 2), {_norm_sql("raw", "exposure", "out_")} SELECT r, c, round(exposure, 6) AS exposure FROM out_""")
def exposure_without_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exposure(normalised(spark, sf_dir), "exposure", None))
