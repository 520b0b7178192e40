"""Files in and out: tables with explicit schemas, GeoJSON, stage tables with resume, failover, and compact payloads."""

from __future__ import annotations

import base64
import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A GeoJSON feature collection's features as text; properties are read as strings.
FEATURES = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system that Spark itself uses for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_table(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """A CSV or JSON table with a stated schema; a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True) if kind == "csv" else spark.read.schema(schema).json(path)


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A CSV with header, or JSON lines."""
    df.write.mode("overwrite").csv(path, header=True) if kind == "csv" else df.write.mode("overwrite").json(path)


def read_stack(spark: SparkSession, path: str, bands: Sequence[str], required: str = "risk") -> DataFrame:
    """Cells of a stored stack with the bands that are there; without the required band an error."""
    found = spark.read.parquet(path)
    if required not in found.columns:
        raise ValueError(f"the stack has no band {required}")
    return found.select("r", "c", *[b for b in bands if b in found.columns])


def feature(geometry: str, properties: Sequence[str]):
    """One GeoJSON feature as text. ``geometry`` is a column of struct (type, coordinates)."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(geometry).alias("geometry"), F.struct(*properties).alias("properties")))


def write_geojson(df: DataFrame, path: str, geometry: str, properties: Sequence[str]) -> None:
    """Feature lines, one a row (newline-delimited GeoJSON): files grow with the rows, no task holds them all."""
    df.select(feature(geometry, properties).alias("value")).write.mode("overwrite").text(path)


def feature_collection(df: DataFrame, geometry: str, properties: Sequence[str], most: int = 100_000) -> str:
    """A whole feature collection as text, for results whose size is checked; empty input gives an empty collection."""
    rows = df.select(feature(geometry, properties).alias("value")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} features; use write_geojson()")
    return '{"type":"FeatureCollection","features":[' + ",".join(r["value"] for r in rows) + "]}"


def read_geojson_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """``geometry`` (type, coordinates as text) and the stated properties of newline-delimited GeoJSON."""
    schema = f"geometry struct<type: string, coordinates: string>, properties struct<{properties}>"
    return spark.read.schema(schema).json(path).select("geometry", "properties.*")


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], resume: bool = True, attempts: int = 1, wait_s: float = 5.0) -> DataFrame:
    """A stage's table: read if it was finished before and ``resume``, else built and written, with up to ``attempts`` trials (a wait between them that doubles); the last failure is raised."""
    if not (resume and exists(spark, f"{path}/_SUCCESS")):
        for trial in range(attempts):
            try:
                build().write.mode("overwrite").parquet(path)
                break
            except Exception:  # noqa: BLE001  any failure of a remote source may pass
                if trial + 1 == attempts:
                    raise
                time.sleep(wait_s * 2**trial)
    return spark.read.parquet(path)


def study_area(spark: SparkSession, cache: str, providers: Sequence[Callable[[], DataFrame]], box: tuple[float, float, float, float]) -> tuple[DataFrame, str]:
    """A row with the ``ring`` of the study area (array of struct x, y), and where it is from: the cache, the first provider that gives a ring of three points or more (cached then), or the box.

    A cache that can't be read, and a provider that fails or gives none, pass on to the next.
    """
    ring = "ring array<struct<x: double, y: double>>"
    tries = [("cache", lambda: spark.read.schema(ring).parquet(cache))] if exists(spark, cache) else []
    for name, source in [*tries, *((f"provider {i + 1}", p) for i, p in enumerate(providers))]:
        try:
            row = source().select("ring").first()
        except Exception:  # noqa: BLE001  any failure of a source passes on to the next
            continue
        if row is not None and row["ring"] is not None and len(row["ring"]) >= 3:
            found = spark.createDataFrame([row], ring)
            if name != "cache":
                found.write.mode("overwrite").parquet(cache)
            return found, name
    west, south, east, north = box
    corners = [{"x": x, "y": y} for x, y in ((west, south), (east, south), (east, north), (west, north))]
    return spark.createDataFrame([(corners,)], ring), "box"


def first_that_works(sources: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that can be read and has rows' schema; if none, the last error."""
    error: Exception | None = None
    for source in sources:
        try:
            found = source()
            found.limit(1).collect()
            return found
        except Exception as e:  # noqa: BLE001  any failure of a source passes on to the next
            error = e
    raise error or ValueError("no sources")


def row_count(spark: SparkSession, path: str, kind: str = "parquet") -> int:
    """Number of rows stored at a path, 0 if nothing is there; any other failure is raised."""
    return spark.read.format(kind).load(path).count() if exists(spark, path) else 0


def mismatches(routes: DataFrame, metrics: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Rows of one table without a row of the other that agrees within the tolerance: empty when both are consistent."""
    both = routes.alias("a").join(metrics.select(*keys, F.col(value).alias("__other")).alias("b"), list(keys), "left")
    return both.where(F.col("__other").isNull() | (F.abs(F.col(value) - F.col("__other")) > tolerance)).drop("__other")


def typed(values: np.ndarray, kind: str) -> str:
    """Base64 of an array in the given type."""
    return base64.b64encode(np.ascontiguousarray(values, dtype=kind).tobytes()).decode()


def untyped(text: str, kind: str) -> np.ndarray:
    """The inverse of typed()."""
    return np.frombuffer(base64.b64decode(text), dtype=kind)


def graph_payload(nodes: DataFrame, edges: DataFrame, scale: float = 1e5, most: int = 5_000_000) -> dict:
    """Compact arrays of an undirected graph (``id``, ``x``, ``y``; ``a``, ``b``, ``length``, ``risk``): coordinates, ends, lengths, risk bytes and row offsets.

    For graphs whose size is checked; each edge stands at both ends in the adjacency.
    """
    if edges.count() > most:
        raise ValueError(f"more than {most} edges")
    n, e = nodes.orderBy("id").toPandas(), edges.orderBy("a", "b").toPandas()
    at = {int(i): k for k, i in enumerate(n["id"])}
    a, b = (np.array([at[int(i)] for i in e[c]], dtype=np.int64) for c in ("a", "b"))
    ends = np.concatenate([a, b])
    order, offsets = np.argsort(ends, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=len(n)))])
    return {
        "xy": typed(np.round(n[["x", "y"]].to_numpy() * scale).ravel(), "<i4"), "ends": typed(np.stack([a, b], axis=1).ravel(), "<u4"), "length": typed(np.round(e["length"].to_numpy()), "<u4"),
        "risk": typed(np.round(np.clip(e["risk"].to_numpy(), 0, 1) * 254), "<u1"), "offsets": typed(offsets, "<u4"), "adjacent": typed(order % max(len(a), 1), "<u4"),
    }
