"""OpenStreetMap extracts (PBF) as tables of elements, and the tables of ways, places and roads made of them.

Spark reads the file; one pass cuts it into its compressed blocks, which are then dealt out and decoded in parallel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = "kind string, id long, lon double, lat double, refs array<long>, tags map<string, string>"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message; fixed-width values come as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def packed(data: bytes, signed: bool = False) -> np.ndarray:
    """A packed list of varints, zigzag if signed."""
    out, at = [], 0
    while at < len(data):
        v, at = _varint(data, at)
        out.append((v >> 1) ^ -(v & 1) if signed else v)
    return np.array(out, dtype=np.int64)


def blocks(data: bytes) -> Iterator[bytes]:
    """The data blobs of a file, still compressed."""
    at = 0
    while at < len(data):
        (size,) = struct.unpack_from(">i", data, at)
        header = dict(fields(data[at + 4 : at + 4 + size]))
        at += 4 + size
        if header[1] == b"OSMData":
            yield data[at : at + header[3]]
        at += header[3]


def elements(blob: bytes) -> Iterator[tuple]:
    """Nodes and ways of a blob: (kind, id, lon, lat, refs, tags); relations are passed over."""
    parts = dict(fields(blob))
    block = parts[1] if 1 in parts else zlib.decompress(parts[3])
    strings: list[str] = []
    groups: list[bytes] = []
    scale, lat0, lon0 = 100, 0, 0
    for n, v in fields(block):
        if n == 1:
            strings = [s.decode("utf-8", "replace") for _, s in fields(v)]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            scale = v
        elif n in (19, 20):
            v = v - (1 << 64) if v >> 63 else v
            lat0, lon0 = (v, lon0) if n == 19 else (lat0, v)
    for group in groups:
        for n, v in fields(group):
            own = dict(fields(v)) if n in (1, 2, 3) else {}
            if n == 2:
                ids, lats, lons = (np.cumsum(packed(own.get(k, b""), True)) for k in (1, 8, 9))
                pairs, at = packed(own.get(10, b"")).tolist(), 0
                for i, lat, lon in zip(ids.tolist(), lats.tolist(), lons.tolist(), strict=True):
                    tags = {}
                    while at < len(pairs) and pairs[at]:
                        tags[strings[pairs[at]]] = strings[pairs[at + 1]]
                        at += 2
                    at += 1
                    yield "node", i, 1e-9 * (lon0 + scale * lon), 1e-9 * (lat0 + scale * lat), [], tags
            elif n in (1, 3):
                tags = {strings[a]: strings[b] for a, b in zip(packed(own.get(2, b"")).tolist(), packed(own.get(3, b"")).tolist(), strict=True)}
                if n == 1:
                    i, lat, lon = ((own[k] >> 1) ^ -(own[k] & 1) for k in (1, 8, 9))
                    yield "node", i, 1e-9 * (lon0 + scale * lon), 1e-9 * (lat0 + scale * lat), [], tags
                else:
                    yield "way", own[1], None, None, np.cumsum(packed(own.get(8, b""), True)).tolist(), tags


def read_extract(spark: SparkSession, path: str, partitions: int = 64) -> DataFrame:
    """Elements of an extract (files up to Spark's limit of 2 GB each; larger ones are to be split first)."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                for n, blob in enumerate(blocks(content)):
                    yield pd.DataFrame({"n": [n], "blob": [blob]})

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for blob in f["blob"]:
                yield pd.DataFrame(list(elements(blob)), columns=["kind", "id", "lon", "lat", "refs", "tags"])

    blobs = spark.read.format("binaryFile").load(path).select("content").mapInPandas(cut, "n long, blob binary")
    return blobs.repartition(partitions, "n").select("blob").mapInPandas(decode, ELEMENTS)


def tagged_points(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``id``, ``lon``, ``lat`` and ``tags`` of elements with any of the keys; a way stands at the mean of its nodes."""
    has = F.exists(F.map_keys("tags"), lambda k: k.isin(*keys))
    nodes = found.where("kind = 'node'")
    centres = way_points(found.where("kind = 'way'").where(has), nodes).groupBy("id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.first("tags").alias("tags"))
    return nodes.where(has).select("id", "lon", "lat", "tags").unionByName(centres)


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id``, ``tags``, ``pos``, ``node``, ``lon`` and ``lat`` of each node of each way, by a join on node ids."""
    each = ways.select("id", "tags", F.posexplode("refs").alias("pos", "node"))
    return each.join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node").select("id", "tags", "pos", "node", "lon", "lat")


def way_segments(points: DataFrame) -> DataFrame:
    """``id``, ``tags``, ``a`` and ``b``: neighbouring nodes of each way, with their coordinates."""
    from pyspark.sql import Window as W

    w = W.partitionBy("id").orderBy("pos")
    ahead = points.select("id", "tags", F.col("node").alias("a"), F.col("lon").alias("alon"), F.col("lat").alias("alat"), F.lead("node").over(w).alias("b"), F.lead("lon").over(w).alias("blon"), F.lead("lat").over(w).alias("blat"))
    return ahead.where("b IS NOT NULL")


def inside_box(found: DataFrame, west: float, south: float, east: float, north: float, margin: float = 0.01) -> DataFrame:
    """Rows whose point lies in a box widened by the margin."""
    return found.where(F.col("lon").between(west - margin, east + margin) & F.col("lat").between(south - margin, north + margin))
