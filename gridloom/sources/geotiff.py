"""GeoTIFF by its public format (TIFF 6.0 and the GeoTIFF tags): strips or tiles, raw or deflated, north up.

The driver reads heads only. Each strip or tile of a file is one row of work, and executors read just its bytes, so one
large file is read by many tasks. Files must lie where driver and executors can open them by path (a shared mount); what
lies in a store that only Spark reads can be taken whole, one file a row, by ``read_geotiff_files``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..errors import FileOpen
from ..grid import PixelGrid

#: Bytes and struct letter of field types (fixed values of TIFF 6.0 and BigTIFF).
_TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
#: numpy letter of sample formats: unsigned, signed, floating point.
_FORMATS = {1: "u", 2: "i", 3: "f"}
_CELLS = "band int, r long, c long, v double"


def _head(read) -> dict:
    """Tags of the first image, by number; ``read(offset, n)`` gives bytes."""
    raw = read(0, 16)
    end = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if end is None:
        raise FileOpen("not a TIFF")
    big = struct.unpack(end + "H", raw[2:4])[0] == 43
    at = struct.unpack(end + "Q", raw[8:16])[0] if big else struct.unpack(end + "I", raw[4:8])[0]
    count = struct.unpack(end + ("Q" if big else "H"), read(at, 8 if big else 2))[0]
    at, width, word = at + (8 if big else 2), 20 if big else 12, "Q" if big else "I"
    table, tags = read(at, count * width), {}
    for k in range(count):
        e = table[k * width : (k + 1) * width]
        tag, kind, n = struct.unpack(end + "HH" + word, e[: 12 if big else 8])
        if kind not in _TYPES:
            continue
        size, letter = _TYPES[kind]
        place = e[12 if big else 8 :]
        data = place[: size * n] if size * n <= len(place) else read(struct.unpack(end + word, place)[0], size * n)
        tags[tag] = data if letter == "c" else struct.unpack(end + letter * n, data)
    tags["end"] = end
    return tags


def _layout(t: dict) -> dict:
    bits, fmt = t.get(258, (1,)), t.get(339, (1,))
    if t.get(259, (1,))[0] not in (1, 8, 32946) or len(set(bits)) > 1 or bits[0] % 8 or t.get(317, (1,))[0] not in (1, 2):
        raise FileOpen("only raw or deflated whole bytes, with horizontal differences or none")
    ncols, nrows, bands = t[256][0], t[257][0], t.get(277, (1,))[0]
    tiled = 322 in t
    w, h = (t[322][0], t[323][0]) if tiled else (ncols, min(t.get(278, (nrows,))[0], nrows))
    return {
        "dtype": t["end"] + _FORMATS[fmt[0]] + str(bits[0] // 8),
        "nrows": nrows, "ncols": ncols, "bands": bands, "tiled": tiled, "w": w, "h": h,
        "planar": t.get(284, (1,))[0] == 2, "deflated": t.get(259, (1,))[0] != 1, "differences": t.get(317, (1,))[0] == 2,
        "offsets": t[324] if tiled else t[273], "counts": t[325] if tiled else t[279],
    }


def _grid(t: dict) -> PixelGrid:
    (sx, sy), tie = t.get(33550, (1.0, 1.0, 0.0))[:2], t.get(33922, (0.0,) * 6)
    keys = t.get(34735, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    code = codes.get(3072) or codes.get(2048)
    half = 0.5 if codes.get(1025) == 2 else 0.0  # the tie point is a centre
    return PixelGrid.of(tie[3] - (tie[0] + half) * sx, tie[4] + (tie[1] + half) * sy, t[256][0], t[257][0], sx, sy, f"EPSG:{code}" if code else "")


def _decoded(raw: bytes, f: dict, k: int) -> pd.DataFrame:
    """Cells of the k-th strip or tile."""
    across, down = -(-f["ncols"] // f["w"]), -(-f["nrows"] // f["h"])
    plane, k = (k // (across * down), k % (across * down)) if f["planar"] else (0, k)
    top, left, depth = k // across * f["h"], k % across * f["w"], 1 if f["planar"] else f["bands"]
    h = f["h"] if f["tiled"] else min(f["h"], f["nrows"] - top)
    a = np.frombuffer(zlib.decompress(raw) if f["deflated"] else raw, f["dtype"], h * f["w"] * depth).reshape(h, f["w"], depth)
    if f["differences"]:
        a = np.cumsum(a, axis=1, dtype=a.dtype)
    a = a[: f["nrows"] - top, : f["ncols"] - left]
    rr, cc, bb = np.meshgrid(np.arange(a.shape[0]) + top, np.arange(a.shape[1]) + left, np.arange(depth) + plane + 1, indexing="ij")
    return pd.DataFrame({"band": bb.ravel().astype("int32"), "r": rr.ravel(), "c": cc.ravel(), "v": a.ravel().astype(float)})


def read_geotiff(spark: SparkSession, path: str) -> tuple[DataFrame, PixelGrid, float | None]:
    """(band, r, c, v) as doubles, the grid, and the no-data value."""

    def read_of(fh):
        def read(at: int, n: int) -> bytes:
            fh.seek(at)
            return fh.read(n)

        return read

    try:
        with open(path, "rb") as fh:
            t = _head(read_of(fh))
    except OSError as e:
        raise FileOpen(path) from e
    f = _layout(t)
    offsets, counts = f.pop("offsets"), f.pop("counts")
    work = spark.createDataFrame(pd.DataFrame({"k": range(len(offsets)), "at": offsets, "n": counts}), "k long, at long, n long")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(path, "rb") as fh:
            for b in batches:
                for k, at, n in b.itertuples(index=False):
                    fh.seek(at)
                    yield _decoded(fh.read(n), f, k)

    null = t[42113].split(b"\0")[0].strip() if 42113 in t else b""
    return work.repartition(max(1, min(len(offsets), 2 * spark.sparkContext.defaultParallelism))).mapInPandas(cells, _CELLS), _grid(t), float(null) if null else None


def read_geotiff_files(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all files below ``path`` with their ``path``: many files of moderate size, each read whole by one task."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in b.itertuples(index=False):
                f = _layout(_head(lambda at, n: raw[at : at + n]))  # noqa: B023
                for k, (at, n) in enumerate(zip(f["offsets"], f["counts"])):
                    yield _decoded(raw[at : at + n], f, k).assign(path=name)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, _CELLS + ", path string")


def geotiff_bytes(a: np.ndarray, grid: PixelGrid, nodata: float | None = None, rows: int = 64, deflate: bool = True) -> bytes:
    """(bands, rows, columns) as one file, bands apart, in strips."""
    a = a[None] if a.ndim == 2 else a
    bands, nrows, ncols = a.shape
    letter = a.dtype.kind if a.dtype.kind in "uif" else None
    if letter is None or 8 * a.dtype.itemsize > 64:
        raise ValueError(f"no sample format for {a.dtype}")
    a = a.astype(a.dtype.newbyteorder("<"))
    pack = zlib.compress if deflate else bytes
    strips = [pack(np.ascontiguousarray(a[b, top : top + rows]).tobytes()) for b in range(bands) for top in range(0, nrows, rows)]
    offsets = 8 + np.concatenate([[0], np.cumsum([len(s) for s in strips])])
    code = int(grid.crs.split(":")[1]) if grid.crs.upper().startswith("EPSG:") else 0
    geographic = 4000 <= code < 5000
    keys = [1, 1, 0, 2 + bool(code), 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1] + ([2048 if geographic else 3072, 0, 1, code] if code else [])
    fields = [(256, "I", [ncols]), (257, "I", [nrows]), (258, "H", [8 * a.dtype.itemsize] * bands), (259, "H", [8 if deflate else 1]), (262, "H", [1]), (273, "I", list(offsets[:-1])), (277, "H", [bands]), (278, "I", [rows])]
    fields += [(279, "I", [len(s) for s in strips]), (284, "H", [2]), (339, "H", [{"u": 1, "i": 2, "f": 3}[letter]] * bands)]
    fields += [(33550, "d", [grid.xres, grid.yres, 0.0]), (33922, "d", [0.0, 0.0, 0.0, grid.xmin, grid.ymax, 0.0]), (34735, "H", keys)]
    if nodata is not None:
        fields.append((42113, "s", [f"{nodata:g}".encode() + b"\0"]))
    kinds = {"I": 4, "H": 3, "d": 12, "s": 2}
    at = int(offsets[-1]) + 2 + 12 * len(fields) + 4
    table, extra = struct.pack("<H", len(fields)), b""
    for tag, kind, values in fields:
        data = values[0] if kind == "s" else struct.pack("<" + kind * len(values), *(float(v) if kind == "d" else int(v) for v in values))
        n = len(data) if kind == "s" else len(values)
        table += struct.pack("<HHI", tag, kinds[kind], n)
        if len(data) <= 4:
            table += data.ljust(4, b"\0")
        else:
            table += struct.pack("<I", at + len(extra))
            extra += data
    return struct.pack("<2sHI", b"II", 42, int(offsets[-1])) + b"".join(strips) + table + struct.pack("<I", 0) + extra
