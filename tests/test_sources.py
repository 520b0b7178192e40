from __future__ import annotations

import struct
import zipfile
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import places
from gridloom.session import table
from gridloom.sources import geotiff, osm
from gridloom.streaming.detections import daily_detections


def varint(n):
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def field(n, v):
    return varint(n << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(n << 3) + varint(v)


def zigzag(values):
    out, last = b"", 0
    for v in values:
        d, last = v - last, v
        out += varint(d << 1 if d >= 0 else (-d << 1) - 1)
    return out


def extract():
    """A small extract: three nodes, one of them a hospital, and a way."""
    strings = b"".join(field(1, s) for s in (b"", b"amenity", b"hospital", b"name", "Ålesund".encode(), b"highway", b"primary"))
    at = [(1, 760000000, 115000000), (2, 761000000, 116000000), (5, 759000000, 114000000)]
    dense = field(1, zigzag([i for i, _, _ in at])) + field(8, zigzag([y for _, _, y in at])) + field(9, zigzag([x for _, x, _ in at])) + field(10, b"".join(map(varint, (0, 1, 2, 3, 4, 0, 0))))
    way = field(1, 77) + field(2, varint(5)) + field(3, varint(6)) + field(8, zigzag([1, 2, 5]))
    block = field(1, strings) + field(2, field(2, dense)) + field(2, field(3, way))
    out = b""
    for kind, data in ((b"OSMHeader", b""), (b"OSMData", block)):
        blob = field(2, len(data)) + field(3, zlib.compress(data))
        header = field(1, kind) + field(3, len(blob))
        out += struct.pack(">i", len(header)) + header + blob
    return out


def test_extract(spark, tmp_path):
    (tmp_path / "small.osm.pbf").write_bytes(extract())
    found = osm.read_extract(spark, str(tmp_path / "small.osm.pbf"), 2)
    rows = {(r.kind, r.id): r for r in found.collect()}
    assert rows["node", 2].tags == {"amenity": "hospital", "name": "Ålesund"} and abs(rows["node", 2].lon - 76.1) < 1e-9 and abs(rows["node", 5].lat - 11.4) < 1e-9
    assert rows["way", 77].refs == [1, 2, 5] and rows["way", 77].tags == {"highway": "primary"}
    points = osm.tagged_points(found, ("amenity", "highway")).select("id", "lon", places.facility_category().alias("cat")).collect()
    assert {(p.id, round(p.lon, 6), p.cat) for p in points} == {(2, 76.1, "health"), (77, 76.0, None)}
    segments = osm.way_segments(osm.way_points(found.where("kind = 'way'"), found.where("kind = 'node'")))
    assert sorted((s.a, s.b) for s in segments.collect()) == [(1, 2), (2, 5)]
    assert [r.id for r in osm.inside_box(found, 76.05, 11.5, 76.2, 11.7).collect()] == [2]


def test_geotiff(spark, tmp_path):
    grid = np.array([[0.5, np.nan, 2], [3, 4, 5]], dtype=np.float32)
    frame = (76.0, 11.8, 0.1, 0.1)
    data = geotiff.encode(grid, frame)
    values, got, nodata = geotiff.decode(data)
    assert np.array_equal(values[0], grid, equal_nan=True) and np.allclose(got, frame) and np.isnan(nodata)
    (tmp_path / "a.tif").write_bytes(data)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x.tif", data)
    cells = geotiff.read_rasters(spark, f"{tmp_path}/*")
    assert cells.count() == 12 and cells.where("value IS NULL").count() == 2
    one = cells.where("file LIKE '%a.tif'")
    assert abs(one.where("r = 1 AND c = 2").first().lat - 11.65) < 1e-9
    assert np.array_equal(geotiff.decode(geotiff.raster_bytes(one, "value", 2, 3, frame))[0][0], grid, equal_nan=True)
    with pytest.raises(ValueError):
        geotiff.raster_bytes(one, "value", 10**5, 10**5, frame)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    scenes = table(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), F.col("ts").cast("timestamp").alias("ts"), "value")
    scenes.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(scenes.schema).parquet(f"{tmp_path}/in")
    query = daily_detections(stream, 30.0, "100 days").writeStream.outputMode("complete").format("memory").queryName("detections").start()
    query.processAllAvailable()
    query.stop()
    want = sorted(map(tuple, daily_detections(scenes, 30.0).collect()))
    assert sorted(map(tuple, spark.table("detections").collect())) == want and len(want) > 20 and Path(f"{tmp_path}/in").exists()
