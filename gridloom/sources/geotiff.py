"""GeoTIFF rasters as cell tables and back: plain or deflated strips, one value type, pixel scale and tie point."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# --- fixed values: sizes and codes of TIFF field types, and sample formats
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8)}
_SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def decode(data: bytes) -> tuple[np.ndarray, tuple[float, float, float, float], float | None]:
    """Values (band, row, column), the frame (west, north, step x, step y) and the nodata value of a TIFF."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    (at,) = struct.unpack_from(order + "I", data, 4)
    tags = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        code, size = _TYPES[kind]
        place = at + 2 + 12 * k + 8
        if n * size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        tags[tag] = data[place : place + n] if kind == 2 else struct.unpack_from(order + code * n, data, place)
    width, height, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    if tags.get(317, (1,))[0] != 1 or 322 in tags or tags.get(259, (1,))[0] not in (1, 8, 32946):
        raise ValueError("only plain or deflated strips without a predictor can be read")
    strips = [data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True)]
    raw = b"".join(s if tags.get(259, (1,))[0] == 1 else zlib.decompress(s) for s in strips)
    values = np.frombuffer(raw, dtype=order + _SAMPLES[tags.get(339, (1,))[0], tags[258][0]])
    values = values.reshape(bands, height, width) if tags.get(284, (1,))[0] == 2 else values.reshape(height, width, bands).transpose(2, 0, 1)
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    nodata = float(tags[42113].strip(b"\0 ").decode()) if 42113 in tags else None
    return values, (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1]), nodata


def encode(values: np.ndarray, frame: tuple[float, float, float, float], nodata: str = "nan") -> bytes:
    """A one-band float32 TIFF, deflated, in degrees."""
    west, north, dx, dy = frame
    strip = zlib.compress(values.astype("<f4").tobytes())
    fields = [
        (256, 4, [values.shape[1]]), (257, 4, [values.shape[0]]), (258, 3, [32]), (259, 3, [8]), (262, 3, [1]), (273, 4, [0]), (277, 3, [1]), (278, 4, [values.shape[0]]), (279, 4, [len(strip)]), (339, 3, [3]),
        (33550, 12, [dx, dy, 0.0]), (33922, 12, [0.0, 0.0, 0.0, west, north, 0.0]), (34735, 3, [1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326]), (42113, 2, nodata.encode() + b"\0"),
    ]
    extra, rows, after = b"", b"", 8 + 2 + 12 * len(fields) + 4
    payload = [f[2] if f[1] == 2 else struct.pack("<" + _TYPES[f[1]][0] * len(f[2]), *f[2]) for f in fields]
    strip_at = after + sum(len(p) + len(p) % 2 for p in payload if len(p) > 4)
    for (tag, kind, v), p in zip(fields, payload, strict=True):
        if tag == 273:
            p = struct.pack("<I", strip_at)
        if len(p) > 4:
            p, extra = struct.pack("<I", after + len(extra)), extra + p + b"\0" * (len(p) % 2)
        rows += struct.pack("<HHI", tag, kind, len(v)) + p.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + rows + struct.pack("<I", 0) + extra + strip


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``band``, ``r``, ``c``, ``lon``, ``lat`` and ``value`` of TIFF files or zips of them; nodata and NaN are null."""

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                files = [(name, content)]
                if content[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        files = [(f"{name}/{m}", z.read(m)) for m in sorted(z.namelist()) if m.lower().endswith((".tif", ".tiff"))]
                for own, data in files:
                    values, (west, north, dx, dy), nodata = decode(data)
                    for band, grid in enumerate(values.astype(np.float64)):
                        for r, row in enumerate(grid):
                            gone = np.isnan(row) | (row == nodata if nodata is not None else False)
                            c = np.arange(len(row))
                            yield pd.DataFrame({"file": own, "band": band + 1, "r": r, "c": c, "lon": west + (c + 0.5) * dx, "lat": north - (r + 0.5) * dy, "value": np.where(gone, np.nan, row)})

    schema = "file string, band int, r long, c long, lon double, lat double, value double"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, schema)


def raster_bytes(cells: DataFrame, value: str, rows: int, columns: int, frame: tuple[float, float, float, float], most: int = 50_000_000) -> bytes:
    """A layer of a cell table as one TIFF, for grids whose size is checked."""
    if rows * columns > most:
        raise ValueError(f"more than {most} cells")
    found = cells.select("r", "c", value).toPandas()
    grid = np.full((rows, columns), np.nan, dtype=np.float32)
    grid[found["r"], found["c"]] = found[value].astype(float)
    return encode(grid, frame)
