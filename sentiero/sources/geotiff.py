"""Rasters in TIFF files with map coordinates: tiles of pixel tables written with overviews, files read as pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels of a tile each way, and the factors of the overviews.
TILE, FACTORS = 256, (2, 4, 8, 16)
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
_KINDS = {(1, 8): "u1", (2, 8): "i1", (1, 16): "u2", (2, 16): "i2", (1, 32): "u4", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def _halved(a: np.ndarray, factor: int, nodata: float) -> np.ndarray:
    """Means of the known pixels of blocks of ``factor`` each way."""
    h, w = -(-a.shape[0] // factor), -(-a.shape[1] // factor)
    wide = np.full((h * factor, w * factor), np.nan)
    wide[: a.shape[0], : a.shape[1]] = np.where(a == nodata, np.nan, a)
    blocks = wide.reshape(h, factor, w, factor)
    n = (~np.isnan(blocks)).sum((1, 3))
    return np.where(n > 0, np.nansum(blocks, (1, 3)) / np.maximum(n, 1), nodata).astype("f4")


def encode(a: np.ndarray, x0: float, y0: float, size: float, nodata: float = -9999.0, epsg: int = 25832, factors: Sequence[int] = FACTORS) -> bytes:
    """One band of 32-bit floats as a deflated, tiled TIFF with averaged overviews; (x0, y0) is the upper left corner."""
    out, levels = bytearray(b"II*\0\0\0\0\0"), [a.astype("f4"), *[_halved(a, f, nodata) for f in factors if min(a.shape) >= f]]
    link = 4
    for k, level in enumerate(levels):
        h, w = level.shape
        offsets, sizes = [], []
        for r in range(0, h, TILE):
            for c in range(0, w, TILE):
                tile = np.full((TILE, TILE), nodata, "<f4")
                part = level[r : r + TILE, c : c + TILE]
                tile[: part.shape[0], : part.shape[1]] = part
                data = zlib.compress(tile.tobytes())
                offsets.append(len(out))
                sizes.append(len(data))
                out += data + b"\0" * (len(data) % 2)
        entries = [(254, 4, [int(k > 0)]), (256, 4, [w]), (257, 4, [h]), (258, 3, [32]), (259, 3, [8]), (262, 3, [1]), (277, 3, [1]), (322, 4, [TILE]), (323, 4, [TILE]), (324, 4, offsets), (325, 4, sizes), (339, 3, [3])]
        if not k:
            entries += [(33550, 12, [size, size, 0.0]), (33922, 12, [0.0, 0.0, 0.0, x0, y0, 0.0]), (34735, 3, [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg])]
        entries.append((42113, 2, f"{nodata:g}".encode() + b"\0"))
        table = bytearray(struct.pack("<H", len(entries)))
        for tag, kind, values in entries:
            data = bytes(values) if kind == 2 else struct.pack(f"<{len(values)}{_CODES[kind]}", *values)
            if len(data) > 4:
                at = len(out)
                out += data + b"\0" * (len(data) % 2)
                data = struct.pack("<I", at)
            table += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        out[link : link + 4] = struct.pack("<I", len(out))
        link = len(out) + len(table)
        out += table + b"\0\0\0\0"
    return bytes(out)


def decode(content: bytes) -> Iterator[dict]:
    """The images of a TIFF file of one band: array, corner, pixel size, nodata and EPSG code (None where not given).

    Tiles or strips, not compressed or deflated, without predictor; other files raise.
    """
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if not order or struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("no plain TIFF file")
    (at,) = struct.unpack(order + "I", content[4:8])
    first: dict = {}
    while at:
        (n,) = struct.unpack(order + "H", content[at : at + 2])
        tags: dict = {}
        for i in range(n):
            tag, kind, count, raw = struct.unpack(order + "HHI4s", content[at + 2 + 12 * i : at + 14 + 12 * i])
            size = _SIZES.get(kind, 1) * count
            data = raw[:size] if size <= 4 else content[struct.unpack(order + "I", raw)[0] :][:size]
            tags[tag] = data.rstrip(b"\0").decode("ascii", "replace") if kind == 2 else list(struct.unpack(f"{order}{count}{_CODES.get(kind, 'B')}", data[: size if kind in _CODES else count]))
        first = first or tags
        w, h, packing = tags[256][0], tags[257][0], tags.get(259, [1])[0]
        kind = _KINDS.get((tags.get(339, [1])[0], tags.get(258, [1])[0]))
        if packing not in (1, 8, 32946) or tags.get(317, [1])[0] != 1 or tags.get(277, [1])[0] != 1 or not kind:
            raise ValueError(f"compression {packing}, predictor {tags.get(317)}, {tags.get(277)} bands or samples aren't read")
        tiled = 322 in tags
        th, tw = (tags[323][0], tags[322][0]) if tiled else (tags.get(278, [h])[0], w)
        a, places = np.zeros((h, w)), [(r, c) for r in range(0, h, th) for c in range(0, w, tw)]
        for (r, c), o, s in zip(places, tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True):
            part = content[o : o + s]
            part = np.frombuffer(zlib.decompress(part) if packing != 1 else part, order + kind).reshape(-1, tw)[: h - r, : w - c]
            a[r : r + part.shape[0], c : c + part.shape[1]] = part
        keys = first.get(34735, [])
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
        x0, y0 = first.get(33922, [0, 0, 0, 0.0, 0.0, 0])[3:5]
        nodata = first.get(42113)
        yield {"array": a, "x0": x0, "y0": y0, "size": first.get(33550, [1.0])[0] * first[256][0] / w, "nodata": float(nodata) if nodata else None, "epsg": codes.get(3072) or codes.get(2048)}
        (at,) = struct.unpack(order + "I", content[at + 2 + 12 * n : at + 6 + 12 * n])


def raster_tiles(pixels: DataFrame, x0: float, y0: float, size: float, nodata: float = -9999.0, epsg: int = 25832) -> DataFrame:
    """(tile_row, tile_col, content): a pixel table (row, col, v) as one file for each tile of ``TILE`` pixels each way.

    No task holds more than a tile; null values and missing pixels are nodata. (x0, y0) is the corner of pixel (0, 0).
    """
    at = pixels.select(F.floor(F.col("row") / TILE).cast("int").alias("tile_row"), F.floor(F.col("col") / TILE).cast("int").alias("tile_col"), F.pmod("row", F.lit(TILE)).cast("int").alias("r"), F.pmod("col", F.lit(TILE)).cast("int").alias("c"), F.col("v").cast("double"))

    def write(g: pd.DataFrame) -> pd.DataFrame:
        a = np.full((TILE, TILE), nodata)
        a[g["r"], g["c"]] = g["v"].fillna(nodata)
        tr, tc = int(g["tile_row"].iloc[0]), int(g["tile_col"].iloc[0])
        return pd.DataFrame({"tile_row": [tr], "tile_col": [tc], "content": [encode(a, x0 + tc * TILE * size, y0 - tr * TILE * size, size, nodata, epsg)]})

    return at.groupBy("tile_row", "tile_col").applyInPandas(write, "tile_row int, tile_col int, content binary")


def raster_pixels(files: DataFrame, epsg: int | None = None, window: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(level, x, y, size, v): known pixels of raster ``files`` (content) by their centre; level 0 is the full resolution.

    A file of another code than ``epsg`` raises; ``window`` (x0, y0, x1, y1) keeps the pixels whose centre lies in it.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                for level, image in enumerate(decode(content)):
                    if epsg is not None and image["epsg"] != epsg:
                        raise ValueError(f"the raster is in {image['epsg']}, not {epsg}")
                    a, size = image["array"], image["size"]
                    good = np.isfinite(a) & (a != image["nodata"] if image["nodata"] is not None else True)
                    r, c = np.nonzero(good)
                    x, y = image["x0"] + (c + 0.5) * size, image["y0"] - (r + 0.5) * size
                    keep = (x >= window[0]) & (x <= window[2]) & (y >= window[1]) & (y <= window[3]) if window else np.ones(len(r), bool)
                    yield pd.DataFrame({"level": np.full(int(keep.sum()), level, "i4"), "x": x[keep], "y": y[keep], "size": size, "v": a[r[keep], c[keep]]})

    return files.select("content").mapInPandas(read, "level int, x double, y double, size double, v double")
