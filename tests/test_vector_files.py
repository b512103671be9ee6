"""Vector files, and the options of jobs that name folders and callbacks."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.errors import FileOpen
from gridloom.functions import colour
from gridloom.grid import PixelGrid
from gridloom.operators.vector import edges_of, rasterize
from gridloom.plans.apply import Controls, apply
from gridloom.sources import raster, vector

SQUARE, HOLE, FAR = [(1, 1), (1, 7), (7, 7), (7, 1), (1, 1)], [(3, 3), (5, 3), (5, 5), (3, 5), (3, 3)], [(8, 8), (8, 10), (10, 10), (10, 8), (8, 8)]


def shapefile(path, features, fields, rows, kind=5):
    body = b""
    for k, rings in enumerate(features, 1):
        points = [p for r in rings for p in r]
        starts = np.cumsum([0, *map(len, rings)])[:-1]
        one = struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", k, len(one) // 2) + one
    (path / "x.shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, kind, *[0] * 8) + body)
    size = 1 + sum(f[2] for f in fields)
    head = struct.pack("<4BIHH20x", 3, 1, 1, 1, len(rows), 32 + 32 * len(fields) + 1, size)
    head += b"".join(n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, t, w, d in fields) + b"\r"
    (path / "x.dbf").write_bytes(head + b"".join(b" " + b"".join(str(v).rjust(w).encode() for v, (_, _, w, _) in zip(r, fields)) for r in rows))
    return str(path / "x.shp")


def burnt(spark, layer, attribute=None):
    g = PixelGrid.of(0, 12, 12, 12, 1.0)
    out = np.zeros((12, 12), int)
    for x in rasterize(edges_of(layer), g, attributes=layer, attribute=attribute).collect():
        out[x.r, x.c] = x.v
    return out[::-1]  # rows by y


def test_shapefile_polygons_with_holes_and_attributes(spark, tmp_path):
    path = shapefile(tmp_path, [[SQUARE, HOLE], [FAR]], [("CODE", "N", 6, 0), ("H", "N", 8, 2), ("NAME", "C", 5, 0), ("OK", "L", 1, 0)], [(4, "1.50", "one", "T"), (9, "", "two", "F")])
    layer = vector.read_shapefile(spark, path)
    assert [tuple(r) for r in layer.select("fid", "part", "CODE", "H", "NAME", "OK").orderBy("fid", "part").collect()] == [(0, 0, 4, 1.5, "one", True), (0, 1, 4, 1.5, "one", True), (1, 0, 9, None, "two", False)]
    want = np.zeros((12, 12), int)
    want[1:7, 1:7], want[3:5, 3:5], want[8:10, 8:10] = 4, 0, 9
    assert (burnt(spark, layer, "CODE") == want).all()
    with pytest.raises(FileOpen):
        vector.read_shapefile(spark, shapefile(tmp_path, [], [("A", "C", 1, 0)], [], kind=1))


@pytest.mark.parametrize("lines", [False, True])
def test_geojson_polygons(spark, tmp_path, lines):
    features = [
        {"type": "Feature", "properties": {"code": 4, "name": "one"}, "geometry": {"type": "Polygon", "coordinates": [SQUARE, HOLE]}},
        {"type": "Feature", "properties": {"code": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"code": 9}, "geometry": {"type": "MultiPolygon", "coordinates": [[FAR]]}},
    ]
    text = "\n".join(map(json.dumps, features)) if lines else json.dumps({"type": "FeatureCollection", "features": features}, indent=1)
    (tmp_path / "x.json").write_text(text)
    layer = vector.read_geojson(spark, str(tmp_path / "x.json"), "code int, name string", lines)
    assert [tuple(r) for r in layer.select("part", "code", "name").orderBy("fid", "part").collect()] == [(0, 4, "one"), (1, 4, "one"), (0, 9, None)]
    want = np.zeros((12, 12), int)
    want[1:7, 1:7], want[3:5, 3:5], want[8:10, 8:10] = 4, 0, 9
    assert (burnt(spark, layer, "code") == want).all()
    assert vector.read_geojson(spark, str(tmp_path / "x.json"), lines=lines).columns == ["fid", "part", "ring"]


def point_file(path, features, kind):
    body = b""
    for k, points in enumerate(features, 1):
        xy = b"".join(struct.pack("<2d", *p) for p in points)
        one = struct.pack("<i", kind) + (xy if kind == 1 else struct.pack("<4di", 0, 0, 0, 0, len(points)) + xy)
        body += struct.pack(">2i", k, len(one) // 2) + one
    (path / "x.shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, kind, *[0] * 8) + body)


def walked(x1, y1, x2, y2):
    """Pixels (y, x) of the thin path, one step at a time."""
    x, y, dx, dy, out, error = x1, y1, abs(x2 - x1), abs(y2 - y1), set(), 0
    long, short = max(dx, dy), min(dx, dy)
    error = -long
    for _ in range(long + 1):
        out.add((y, x))
        error += 2 * short
        aside = error > 0
        error -= 2 * long * aside
        x += np.sign(x2 - x1) if dx >= dy or aside else 0
        y += np.sign(y2 - y1) if dy > dx or aside else 0
    return out


@pytest.mark.parametrize("ends", [(1, 1, 10, 4), (10, 1, 1, 8), (2, 11, 3, 0), (5, 5, 5, 5), (-7, 3, 20, 8), (4, 30, 4, -30), (0, 0, 11, 11), (20, 20, 30, 30)])
def test_lines_are_thin_paths(spark, ends):
    x1, y1, x2, y2 = ends
    layer = spark.createDataFrame([(0, 0, [(x1 + 0.5, y1 + 0.5), (x2 + 0.5, y2 + 0.5)], "line")], "fid long, part int, ring array<struct<x:double,y:double>>, shape string")
    # rows run down, so the path is walked with y upside down
    want = {(11 - y, x) for y, x in {(11 - a, b) for a, b in walked(x1, 11 - y1, x2, 11 - y2)} if 0 <= y < 12 and 0 <= x < 12}
    assert {(11 - r, c) for r, c in zip(*np.nonzero(burnt(spark, layer)))} == want


def test_points_and_lines_of_files(spark, tmp_path):
    every = ("polygon", "line", "point")
    features = [
        {"properties": {"code": 4}, "geometry": {"type": "LineString", "coordinates": [[0.5, 0.5], [3.5, 0.5], [3.5, 2.5]]}},
        {"properties": {"code": 5}, "geometry": {"type": "MultiLineString", "coordinates": [[[6.2, 6.2], [6.8, 6.8]], [[9.5, 0.5]]]}},
        {"properties": {"code": 6}, "geometry": {"type": "Point", "coordinates": [11.5, 11.5, 3]}},
        {"properties": {"code": 7}, "geometry": {"type": "MultiPoint", "coordinates": [[0.5, 11.5], [1.5, 10.5], [40, 40]]}},
        {"properties": {"code": 9}, "geometry": {"type": "Polygon", "coordinates": [FAR]}},
        {"properties": {"code": 2}, "geometry": None},
    ]
    (tmp_path / "x.json").write_text(json.dumps({"features": features}))
    layer = vector.read_geojson(spark, str(tmp_path / "x.json"), "code int", shapes=every)
    want = np.zeros((12, 12), int)
    want[0, 0:4], want[0:3, 3], want[6, 6], want[11, 11], want[11, 0], want[10, 1], want[8:10, 8:10] = 4, 4, 5, 6, 7, 7, 9
    assert layer.columns == ["fid", "part", "ring", "shape", "code"] and (burnt(spark, layer, "code") == want).all()

    path = shapefile(tmp_path, [[[(0.5, 0.5), (3.5, 0.5)], [(5.5, 5.5), (5.5, 7.5)]]], [("CODE", "N", 6, 0)], [(4,)], kind=3)
    want = np.zeros((12, 12), int)
    want[0, 0:4], want[5:8, 5] = 4, 4
    assert (burnt(spark, vector.read_shapefile(spark, path, every), "CODE") == want).all()
    for kind, points in ((1, [[(2.5, 3.5)]]), (8, [[(2.5, 3.5), (4.5, 3.5)]])):
        point_file(tmp_path, points, kind)
        want = np.zeros((12, 12), int)
        for x, y in points[0]:
            want[int(y), int(x)] = 4
        assert (burnt(spark, vector.read_shapefile(spark, path, every), "CODE") == want).all()
    with pytest.raises(FileOpen):
        vector.read_shapefile(spark, path)


def test_all_touched_lines_take_every_crossed_pixel(spark):
    layer = spark.createDataFrame([(0, 0, [(0.2, 0.7), (1.8, 1.3)], "line")], "fid long, part int, ring array<struct<x:double,y:double>>, shape string")
    g = PixelGrid.of(0, 2, 2, 2, 1.0)
    cells = lambda touched: {(x.r, x.c) for x in rasterize(edges_of(layer), g, all_touched=touched).where("v = 1").collect()}
    assert cells(False) == {(1, 0), (0, 1)}
    # the side passes through the corner that the four pixels share
    assert cells(True) >= {(1, 0), (0, 1)}


def test_progress_and_temporary_folder(spark, tmp_path):
    px = spark.range(100).select(F.floor(F.col("id") / 10).alias("r"), (F.col("id") % 10).alias("c"), F.col("id").alias("v"))
    told = []
    c = Controls().set("temp_dir", str(tmp_path / "t")).set("progress", lambda percent, name: told.append((percent, name))).set("pyramids", False)
    job = apply(lambda x, _: {"a": x["x"] + 1, "b": x["x"] * 2}, {"x": (px, PixelGrid.of(0, 0, 10, 10, 1.0))}, c)
    assert all(str(tmp_path / "t") in f for k in "ab" for f in job.outputs[k].inputFiles()) and job.stats["a"].first().vmax == 100
    raster.write_job(job, str(tmp_path / "out"), c)
    assert told == [(0, "a"), (50, "b"), (100, None)]


def test_ramps_from_a_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("name,position,red,green,blue\nmine,1,200,100,0\nmine,0,0,0,0\n")
    assert colour.read_ramps(spark, str(tmp_path / "r.csv")) == ["mine"] and "mine" in colour.ramp_names()
    assert tuple(colour.ramp(spark, 3, "mine").orderBy("value").collect()[1]) == (1, 100, 50, 0, 255)
