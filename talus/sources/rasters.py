"""GeoTIFF rasters: cells to files tile by tile, and files back to cells."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODATA = -9999.0


def encode_geotiff(z: np.ndarray, size: float, west: float, south: float, epsg: int | None = None, geographic: bool = False, vertical: int | None = None) -> bytes:
    """A little-endian float32 GeoTIFF of one strip; z by rows from the south, nan as -9999."""
    rows, cols = z.shape
    body = np.where(np.isfinite(z), z, NODATA)[::-1].astype("<f4").tobytes()
    # GeoKeys for model and raster type, and for the horizontal and vertical system.
    keys = [(1024, 32767 if epsg is None else 2 if geographic else 1), (1025, 1)]
    keys += [(2048 if geographic else 3072, epsg)] * (epsg is not None) + [(4096, vertical)] * (vertical is not None)
    shorts = [1, 1, 0, len(keys)] + [v for k, w in keys for v in (k, 0, 1, w)]
    nodata = f"{NODATA:g}".encode() + b"\0"
    far = {33550: struct.pack("<3d", size, size, 0.0), 33922: struct.pack("<6d", 0, 0, 0, west, south + rows * size, 0.0), 34735: struct.pack(f"<{len(shorts)}H", *shorts), 42113: nodata}
    counts = {33550: 3, 33922: 6, 34735: len(shorts), 42113: len(nodata)}
    # Tags of the format with their types (3 short, 4 long, 12 double, 2 text).
    plain = [(256, 4, cols), (257, 4, rows), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, None), (277, 3, 1), (278, 4, rows), (279, 4, len(body)), (339, 3, 3)]
    kinds = {33550: 12, 33922: 12, 34735: 3, 42113: 2}
    at = 8 + 2 + 12 * (len(plain) + len(far)) + 4
    place = {}
    for tag, data in far.items():
        place[tag] = at
        at += len(data) + len(data) % 2
    entries = [struct.pack("<HHIHH" if t == 3 else "<HHII", k, t, 1, *((v, 0) if t == 3 else (at if v is None else v,))) for k, t, v in plain]
    entries += [struct.pack("<HHI", k, kinds[k], counts[k]) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", place[k])) for k, data in far.items()]
    blobs = b"".join(d + b"\0" * (len(d) % 2) for d in far.values())
    return b"II" + struct.pack("<HIH", 42, 8, len(entries)) + b"".join(entries) + struct.pack("<I", 0) + blobs + body


def decode_geotiff(data: bytes) -> tuple[np.ndarray, dict]:
    """z by rows from the south (nan where there is no data) and size, west, south, epsg of a file as `encode_geotiff` writes it."""
    if data[:4] != b"II*\0":
        raise ValueError("not a little-endian TIFF")
    at = struct.unpack_from("<I", data, 4)[0]
    tags = {}
    for i in range(struct.unpack_from("<H", data, at)[0]):
        tag, kind, n = struct.unpack_from("<HHI", data, at + 2 + 12 * i)
        code, width = {2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}[kind]
        place = at + 10 + 12 * i
        if n * width > 4:
            place = struct.unpack_from("<I", data, place)[0]
        tags[tag] = struct.unpack_from(f"<{n}{code}", data, place)
    if tags[259][0] != 1 or tags[258][0] != 32 or tags[339][0] != 3 or len(tags[273]) != 1:
        raise ValueError("only float32 in one strip without compression is supported")
    cols, rows = tags[256][0], tags[257][0]
    z = np.frombuffer(data, "<f4", rows * cols, tags[273][0]).reshape(rows, cols)[::-1].astype(float)
    missing = float(tags[42113][0].rstrip(b"\0")) if 42113 in tags else NODATA
    keys = dict(zip(tags[34735][4::4], tags[34735][7::4], strict=True))
    size = tags[33550][0]
    return np.where(z == missing, np.nan, z), {"size": size, "west": tags[33922][3], "south": tags[33922][4] - rows * size, "epsg": keys.get(3072, keys.get(2048))}


def geotiff_tiles(cells: DataFrame, size: float, epsg: int | None = None, tile: int = 512, geographic: bool = False, vertical: int | None = None) -> DataFrame:
    """tile_row, tile_col, n, content: a GeoTIFF for each tile that holds a cell, tile x tile cells whatever the table's size."""

    def run(key: tuple[Any, ...], t: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(key[0]), int(key[1])
        z = np.full((tile, tile), np.nan)
        z[t["row"].to_numpy() - tr * tile, t["col"].to_numpy() - tc * tile] = t["z"]
        return pd.DataFrame({"tile_row": [tr], "tile_col": [tc], "n": [len(t)], "content": [encode_geotiff(z, size, tc * tile * size, tr * tile * size, epsg, geographic, vertical)]})

    keyed = cells.select("row", "col", "z", F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"))
    return keyed.groupBy("tr", "tc").applyInPandas(run, "tile_row long, tile_col long, n long, content binary")


def tile_cells(files: DataFrame) -> DataFrame:
    """row, col, z of the tiles' cells with data, by where their corners lie on the common grid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                z, at = decode_geotiff(bytes(data))
                r, c = np.nonzero(np.isfinite(z))
                yield pd.DataFrame({"row": r + round(at["south"] / at["size"]), "col": c + round(at["west"] / at["size"]), "z": z[r, c]})

    return files.select("content").mapInPandas(run, "row long, col long, z double")


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    return tile_cells(spark.read.format("binaryFile").load(path))
