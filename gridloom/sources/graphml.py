"""Road graphs stored as GraphML, read and written as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.network import POINTS

_DATA = "data array<struct<_VALUE: string, _key: string>>"


def _keys(spark: SparkSession, path: str) -> dict[tuple[str, str], str]:
    """(node or edge, attribute name) -> key of the file: a row for each attribute."""
    found = spark.read.format("xml").option("rowTag", "key").schema("`_id` string, `_for` string, `_attr.name` string").load(path).collect()
    return {(r["_for"], r["_attr.name"]): r["_id"] for r in found}


def _value(keys: dict[tuple[str, str], str], kind: str, name: str) -> Column:
    key = keys.get((kind, name))
    return F.lit(None).cast("string") if key is None else F.get(F.filter("data", lambda d: d["_key"] == key), F.lit(0))["_VALUE"]


def line_points(text: Column) -> Column:
    """The points of ``LINESTRING (x y, x y, ...)``; null if the text is null."""
    inner = F.regexp_extract(text, r"\(([^)]*)\)", 1)
    pair = lambda p: F.split(F.trim(p), r"\s+")
    return F.when(text.isNotNull(), F.transform(F.split(inner, ","), lambda p: F.struct(F.get(pair(p), F.lit(0)).cast("double").alias("x"), F.get(pair(p), F.lit(1)).cast("double").alias("y"))))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id``, ``x``, ``y``, ``street_count``) and edges (``src``, ``dst``, ``length``, ``highway``, ``points``, null where an edge is straight)."""
    keys = _keys(spark, path)
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"`_id` long, {_DATA}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"`_source` long, `_target` long, {_DATA}").load(path)
    own = lambda name: _value(keys, "edge", name)
    return (
        nodes.select(F.col("_id").alias("id"), *[_value(keys, "node", c).cast("double").alias(c) for c in "xy"], _value(keys, "node", "street_count").cast("long").alias("street_count")),
        edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), own("length").cast("double").alias("length"), own("highway").alias("highway"), line_points(own("geometry")).cast(POINTS).alias("points")),
    )
