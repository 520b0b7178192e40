"""Views over the driver's tables that stand for rasters, scenes, roads and places, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import table

#: Rows, columns and geographic frame of the cell grid: west edge, north edge, step in degrees.
ROWS, COLS, WEST, NORTH, STEP = 40, 50, 76.0, 11.8, 0.009
BANDS = ("flood", "landslide", "exposure", "fire")

CELLS_SQL = """cells AS (
  SELECT l_orderkey % 40 AS r, l_partkey % 50 AS c, avg(l_discount) AS flood, avg(l_extendedprice) AS landslide, avg(l_quantity) AS exposure, avg(l_tax) AS fire
  FROM lineitem GROUP BY 1, 2)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid: ``r``, ``c`` and four bands; cells without rows are missing."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy((F.col("l_orderkey") % ROWS).alias("r"), (F.col("l_partkey") % COLS).alias("c")).agg(
        F.avg("l_discount").alias("flood"), F.avg("l_extendedprice").alias("landslide"), F.avg("l_quantity").alias("exposure"), F.avg("l_tax").alias("fire")
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-stamped scenes: ``cell``, ``ts``, ``band`` and ``value``."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), "ts", F.col("event_type").alias("band"), "value")


POI_SQL = "poi AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_partkey % 40 AS r, (p_partkey * 7) % 50 AS c FROM part)"


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of interest on the grid: ``id``, ``name``, ``kind``, ``r`` and ``c``."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), (F.col("p_partkey") % ROWS).alias("r"), (F.col("p_partkey") * 7 % COLS).alias("c"))
