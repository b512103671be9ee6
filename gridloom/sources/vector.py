"""Vector layers from files: rows (fid, part, ring, attributes), a row for each ring; rings of one feature fill by the even-odd rule.

Readers give polygons; where ``shapes`` names others as well ('line', 'point'), each row has its ``shape`` beside the ring.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FileOpen

_POINT = "struct<x:double,y:double>"
POLYGONS = ("polygon",)
#: Types of the main file, flat, with heights, with measures. 8 and its like hold many points a record.
_TYPES = {"polygon": (5, 15, 25), "line": (3, 13, 23), "point": (1, 11, 21, 8, 18, 28)}
_SINGLE = (1, 11, 21)
#: Shape, and depth of lists in the coordinates, of a geometry's type.
_GEOMETRIES = {"Polygon": ("polygon", 3), "MultiPolygon": ("polygon", 4), "LineString": ("line", 2), "MultiLineString": ("line", 3), "Point": ("point", 1), "MultiPoint": ("point", 2)}


def read_geojson(spark: SparkSession, path: str, properties: str = "", lines: bool = False, shapes: tuple[str, ...] = POLYGONS) -> DataFrame:
    """Features of GeoJSON: one on each line (``lines``, read in parallel) or a collection a file (whole in one task).

    ``properties`` is the DDL of the attributes wanted. Features of other shapes have no row; a feature's fid is unique, and
    later features of a file have greater ones.
    """
    geometry = "struct<type:string,coordinates:string>"
    text = spark.read.text(path, wholetext=not lines)
    if lines:
        each = text.select(F.from_json("value", f"geometry {geometry}, properties string").alias("f"))
    else:
        each = text.select(F.explode(F.from_json("value", f"features array<struct<geometry:{geometry},properties:string>>")["features"]).alias("f"))
    wanted = {k: x for k, x in _GEOMETRIES.items() if x[0] in shapes}
    kind, at = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    each = each.select(F.monotonically_increasing_id().alias("fid"), "f").where(kind.isin(*wanted))

    def rings(depth: int) -> Column:
        whole = F.from_json(at, "array<" * depth + "double" + ">" * depth)
        return F.flatten(whole) if depth == 4 else F.array(F.array(whole)) if depth == 1 else F.array(whole) if depth == 2 else whole

    each_rings, shape = F.lit(None), F.lit(None)
    for name, (x, depth) in wanted.items():
        each_rings, shape = F.when(kind == name, rings(depth)).otherwise(each_rings), F.when(kind == name, x).otherwise(shape)
    # a file closes its rings; here the last point is joined to the first
    points = F.when(F.col("shape") == "polygon", F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0)))).otherwise(F.col("points"))
    ring = F.transform(points, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    out = each.select("fid", shape.alias("shape"), F.col("f.properties").alias("p"), F.posexplode(each_rings).alias("part", "points"))
    kept = [] if tuple(shapes) == POLYGONS else ["shape"]
    out = out.select("fid", "part", ring.alias("ring"), *kept, "p")
    return out.withColumn("p", F.from_json("p", properties)).select("fid", "part", "ring", *kept, "p.*") if properties else out.drop("p")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _fields(head: bytes) -> list[tuple[str, str, int, int, str]]:
    """Of an attribute file's head: name, kind, place in a record, width, DDL type."""
    out, at, k = [], 1, 32
    while k + 32 <= len(head) and head[k] != 0x0D:
        name, kind, width, decimals = head[k : k + 11].split(b"\0")[0].decode(), chr(head[k + 11]), head[k + 16], head[k + 17]
        ddl = {"N": "double" if decimals else "long", "F": "double", "L": "boolean"}.get(kind, "string")
        out.append((name, kind, at, width, ddl))
        at += width
        k += 32
    return out


def _value(raw: bytes, ddl: str):
    text = raw.decode("latin-1").strip(" \0")
    if not text or set(text) <= {"*", "?"}:
        return None
    return {"long": int, "double": float, "boolean": lambda t: t in "TtYy", "string": str}[ddl](text)


def read_shapefile(spark: SparkSession, path: str, shapes: tuple[str, ...] = POLYGONS) -> DataFrame:
    """Features of ``path`` (.shp) with the attributes beside it (.dbf). Each of the two files is whole in one task, so it must fit there."""
    head = _whole(spark, path).select(F.substring("content", 1, 100).alias("h")).first()
    held = struct.unpack("<i", head.h[32:36])[0] if head is not None and struct.unpack(">i", head.h[:4])[0] == 9994 else None
    shape = next((k for k in shapes if held in _TYPES[k]), None)
    if shape is None:
        raise FileOpen(f"{path} holds no {' or '.join(shapes)}")
    types, closing = _TYPES[shape], int(shape == "polygon")
    beside = path[:-4] + ".dbf"
    first = _whole(spark, beside).select(F.substring("content", 1, 32 * 257).alias("h")).first().h
    fields = _fields(first[: struct.unpack("<H", first[8:10])[0]])

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for raw in (x for f in frames for x in f.content):
            at, rows = 100, []
            while at + 8 <= len(raw):
                number, words = struct.unpack(">2i", raw[at : at + 8])
                at += 8
                kind = struct.unpack("<i", raw[at : at + 4])[0]
                if kind in types and shape == "point":
                    n, begin = (1, at + 4) if kind in _SINGLE else (struct.unpack("<i", raw[at + 36 : at + 40])[0], at + 40)
                    xy = np.frombuffer(raw, "<f8", 2 * n, begin).reshape(-1, 2)
                    rows.append((number - 1, 0, [{"x": x, "y": y} for x, y in xy.tolist()]))
                elif kind in types:
                    parts, points = struct.unpack("<2i", raw[at + 36 : at + 44])
                    starts = [*struct.unpack(f"<{parts}i", raw[at + 44 : at + 44 + 4 * parts]), points]
                    xy = np.frombuffer(raw, "<f8", 2 * points, at + 44 + 4 * parts).reshape(-1, 2)
                    rows += [(number - 1, k, [{"x": x, "y": y} for x, y in xy[a : b - closing].tolist()]) for k, (a, b) in enumerate(zip(starts, starts[1:]))]
                at += 2 * words
                if len(rows) > 2000:
                    yield pd.DataFrame(rows, columns=["fid", "part", "ring"])
                    rows = []
            yield pd.DataFrame(rows, columns=["fid", "part", "ring"])

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["fid", *(f[0] for f in fields)]
        for raw in (x for f in frames for x in f.content):
            n, begin, size = struct.unpack("<IHH", raw[4:12])
            for a in range(0, n, 10_000):
                rows = []
                for k in range(a, min(a + 10_000, n)):
                    one = raw[begin + k * size : begin + (k + 1) * size]
                    rows.append((k, *(_value(one[at : at + width], ddl) for _, _, at, width, ddl in fields)))
                yield pd.DataFrame(rows, columns=names, dtype=object)

    rings = _whole(spark, path).mapInPandas(parsed, f"fid long, part int, ring array<{_POINT}>")
    if tuple(shapes) != POLYGONS:
        rings = rings.withColumn("shape", F.lit(shape))
    ddl = ", ".join(["fid long", *(f"`{f[0]}` {f[4]}" for f in fields)])
    return rings.join(_whole(spark, beside).mapInPandas(records, ddl), "fid", "left")
