"""Whole jobs: block mode, wired options, projections each way, GeoTIFF files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import crs
from gridloom.errors import ArrayShape, BadOption, FileOpen, ResampleNeeded, SinglePassImpossible
from gridloom.grid import INTERSECTION, UNION, PixelGrid, common_region, without_surrounding
from gridloom.operators import align, stats
from gridloom.plans.apply import Controls, apply
from gridloom.plans.blocks import BlockInfo, all_totals, apply_all
from gridloom.sources import geotiff, raster


def image(spark, a, kind="long"):
    rows = [(int(r), int(c), a[r, c].item()) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, f"r long, c long, v {kind}")


def array(df, shape, fill=np.nan):
    out = np.full(shape, fill)
    for x in df.collect():
        assert np.isnan(out[x.r, x.c]) or not np.isnan(fill), "a cell twice"
        out[x.r, x.c] = x.v
    return out


def test_blocks_of_two_inputs_with_margin_outputs_and_totals(spark, tmp_path):
    a, b = np.random.default_rng(1).integers(0, 99, (2, 23, 31))
    ga, gb = PixelGrid.of(0, 0, 31, 23, 1.0), PixelGrid.of(4, -3, 31, 23, 1.0)
    seen = Controls().set("block_size", 8).set("overlap", 1).set("footprint", UNION).set("input_nodata", 7, "b")

    def fn(info, x, p):
        s = sum(np.roll(x["a"], (i, j), (1, 2)) for i in (-1, 0, 1) for j in (-1, 0, 1))
        core = x["b"][0][1:-1, 1:-1]
        return {"sum": s, "both": np.concatenate([x["a"], x["b"] * p]), "cells": core.size, "most": core.max()}

    res = apply_all(fn, {"a": (image(spark, a), ga), "b": (image(spark, b), gb)}, ["sum", "both"], seen, 2, {"cells": "sum", "most": "max"})
    whole_a, whole_b = np.zeros((26, 35)), np.full((26, 35), 7)
    whole_a[:23, :31], whole_b[3:, 4:] = a, b
    pad = np.pad(whole_a, 1)
    want = sum(pad[i : i + 26, j : j + 35] for i in range(3) for j in range(3))
    assert (array(res.output("sum"), (26, 35)) == want).all()
    kept = res.write(str(tmp_path / "out"))
    assert (array(kept.output("both").where("band = 1"), (26, 35)) == whole_a).all()
    assert (array(kept.output("both").where("band = 2"), (26, 35)) == 2 * whole_b).all()
    assert tuple(all_totals(res, {"cells": "sum", "most": "max"}).first()) == (26 * 35, whole_b.max())
    with pytest.raises(BadOption):
        res.output("other")


def test_blocks_without_inputs_and_wrong_shapes(spark):
    g = PixelGrid.of(100, 50, 10, 6, 2.0)
    c = Controls().set("footprint", "bounds_from_reference").set("reference", g).set("block_size", 4)
    res = apply_all(lambda info, x, p: {"x": info.coordinates()[0]}, {}, ["x"], c, spark=spark)
    assert (array(res.output("x"), (6, 10)) == 100 + (np.arange(10) + 0.5) * 2).all()
    with pytest.raises(Exception, match="ArrayShape"):
        apply_all(lambda info, x, p: {"x": np.zeros((1, 2, 2))}, {}, ["x"], c, spark=spark).output("x").collect()
    with pytest.raises(BadOption):
        apply_all(lambda info, x, p: {}, {}, [], Controls(dict(c.values)).set("overlap", 5), spark=spark)
    assert issubclass(ArrayShape, Exception)


def test_block_info_by_hand():
    i = BlockInfo(PixelGrid.of(0, 0, 10, 6, 1.0), 4, 8, 2, 2, 1, 4, {})
    assert (i.count, i.total, i.first, i.last, i.percent) == ((2, 1), (3, 2), False, True, 83)
    assert i.pixel_at(8.5, -4.5) == (1, 1) and i.pixel_at(2.0, -4.5) == (None, None)
    assert i.in_grid(1, 1) == (8, 4)


def test_options_reach_the_job(spark):
    a = np.arange(60).reshape(6, 10) % 4
    g = PixelGrid.of(0, 0, 10, 6, 1.0)
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((2.0, -1.0), (6.0, -1.0), (6.0, -4.0), (2.0, -4.0))])
    shape = spark.range(1).select(F.col("id").alias("fid"), ring.alias("ring"))
    c = Controls().set("thematic", True, "o").set("auto_colours", "gray", "o").set("nodata", None).set("burn_value", 3, "p")
    c.set("overview_levels", (2,)).set("overview_least", 1).set("overview_method", "average", "f")
    job = apply(lambda x, _: {"o": F.col("v"), "f": x["v"] / 2, "m": x["p"].cast("int")}, {"v": (image(spark, a), g), "p": (shape, None)}, c)
    assert {(r.bin, r.n) for r in job.histograms["o"].collect()} == {(k, 15) for k in range(4)}
    assert job.colours["o"].count() == 4 and set(job.colours) == {"o"}
    burnt = array(job.outputs["m"], a.shape)
    assert burnt[1:4, 2:6].min() == 3 and burnt.sum() == 36
    assert (array(job.pyramids["f"][2], (3, 5)) == (a / 2).reshape(3, 2, 5, 2).mean((1, 3))).all()
    with pytest.raises(SinglePassImpossible):
        apply(lambda x, _: {"f": x["v"] / 2}, {"v": (image(spark, a), g)}, Controls().set("single_pass", True))


def test_histogram_of_whole_numbers_by_range(spark):
    few, many = np.arange(100).reshape(10, 10) + 50, np.arange(100).reshape(10, 10) * 7
    assert [tuple(x) for x in stats.histogram_ints(image(spark, few)).orderBy("bin").collect()] == [(k, 1) for k in range(50, 150)]
    got = stats.histogram_ints(image(spark, many)).orderBy("bin").collect()
    assert got == stats.histogram_linear(image(spark, many)).orderBy("bin").collect() and len(got) == 256
    assert stats.histogram_ints(image(spark, few).where("false")).count() == 0


@pytest.mark.parametrize("code", ["EPSG:3857", "EPSG:3577", "EPSG:28355", "EPSG:32756", "EPSG:32633"])
def test_projections_there_and_back(spark, code):
    lon, lat = (16.2, 48.1) if code == "EPSG:32633" else (149.3, -31.7)
    there, back = crs.transform("EPSG:4326", code), crs.transform(code, "EPSG:4326")
    assert back(*there(lon, lat)) == pytest.approx((lon, lat), abs=1e-8)
    row = spark.range(1).select(*[x.alias(k) for k, x in zip("xy", there(F.lit(lon), F.lit(lat)))]).first()
    assert tuple(row) == pytest.approx(there(lon, lat), abs=1e-5)


def test_regions_across_projections():
    box = PixelGrid.of(500000, 7000000, 100, 100, 10.0, crs="EPSG:28355")
    world = PixelGrid.of(-180, 90, 360, 180, 1.0, crs="EPSG:4283")
    assert without_surrounding([world, box]) == [box]
    assert common_region([world, box], box, INTERSECTION) == box
    assert box.resolution_in("EPSG:3577") == pytest.approx((10, 10), rel=0.05)
    with pytest.raises(ResampleNeeded):
        crs.transform("EPSG:4326", "EPSG:1")


def test_warp_between_projections_takes_the_pixel_under_each_centre(spark):
    a = np.arange(900).reshape(30, 30)
    g = PixelGrid.of(500000, 7000000, 30, 30, 100.0, crs="EPSG:28355")
    x, y = crs.transform(g.crs, "EPSG:3577")(501500.0, 6998500.0)
    t = PixelGrid.of(x - 500, y + 500, 10, 10, 100.0, crs="EPSG:3577")
    got = array(align.resample(image(spark, a), g, t), (10, 10))
    back = crs.transform("EPSG:3577", g.crs)
    for r in range(10):
        for c in range(10):
            px, py = back(t.xmin + (c + 0.5) * 100, t.ymax - (r + 0.5) * 100)
            assert got[r, c] == a[int((7000000 - py) // 100), int((px - 500000) // 100)]
    banded = align.stack_bands([image(spark, a), image(spark, a * 2)])
    both = align.resample(banded, g, t, "bilinear")
    one = {(k.r, k.c): k.v for k in both.where("band = 1").collect()}
    two = {(k.r, k.c): k.v for k in both.where("band = 2").collect()}
    assert len(one) == 100 and all(two[k] == pytest.approx(2 * v) for k, v in one.items())


@pytest.mark.parametrize("dtype,deflate", [("uint8", True), ("int16", False), ("float32", True), ("float64", False), ("uint32", True)])
def test_geotiff_round_trip(spark, tmp_path, dtype, deflate):
    a = (np.random.default_rng(3).random((2, 37, 21)) * 200).astype(dtype)
    g = PixelGrid.of(500000, 7000000, 21, 37, 10.0, 20.0, "EPSG:28355")
    f = tmp_path / "a.tif"
    f.write_bytes(geotiff.geotiff_bytes(a, g, 5, 8, deflate))
    px, grid, null = geotiff.read_geotiff(spark, str(f))
    assert grid == g and null == 5
    for b in (1, 2):
        assert (array(px.where(F.col("band") == b), a.shape[1:]) == a[b - 1]).all()
    whole = geotiff.read_geotiff_files(spark, str(f))
    assert whole.count() == a.size and whole.where("path LIKE '%a.tif'").count() == a.size


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"no image, but long enough")
    with pytest.raises(FileOpen):
        geotiff.read_geotiff(spark, str(tmp_path / "x"))
    with pytest.raises(FileOpen):
        geotiff.read_geotiff(spark, str(tmp_path / "none"))


def test_a_written_job_and_its_parts(spark, tmp_path):
    a = np.arange(256).reshape(16, 16) % 5
    c = Controls().set("overview_levels", (2,)).set("overview_least", 1).set("nodata", None).set("thematic", True, "o").set("auto_colours", "gray", "o")
    g = PixelGrid.of(0, 0, 16, 16, 1.0)
    job = apply(lambda x, _: {"o": x["v"], "bad": F.when(x["v"] == 0, float("nan")).otherwise(x["v"] / 2)}, {"v": (image(spark, a), g)}, c)
    with pytest.warns(UserWarning, match="bad"):
        paths = raster.write_job(job, str(tmp_path), c)
    px, grid = raster.read_raster(spark, paths["o"])
    assert grid == g and (array(px, a.shape) == a).all()
    assert raster.read_part(spark, paths["o"], "stats").first().vmax == 4
    assert {(r.bin, r.n) for r in raster.read_part(spark, paths["o"], "histogram").collect()} == {(k, int((a == k).sum())) for k in range(5)}
    assert raster.read_part(spark, paths["o"], "pyramids").where("level = 2").count() == 64
    assert raster.read_part(spark, paths["o"], "colours").count() == 5 and raster.read_part(spark, paths["bad"], "colours") is None
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((2.0, -1.0), (6.0, -1.0), (6.0, -4.0))])
    spark.range(1).select(F.col("id").alias("fid"), ring.alias("ring")).write.parquet(str(tmp_path / "layer"))
    rows = {r.name: r for r in raster.describe(spark, {"r": paths["o"], "v": str(tmp_path / "layer")}).collect()}
    assert (rows["r"].kind, rows["r"].xmax, rows["r"].ymin) == ("raster", 16.0, -16.0)
    assert (rows["v"].kind, rows["v"].xmax, rows["v"].ymin) == ("vector", 6.0, -4.0)
    with pytest.raises(FileOpen):
        raster.describe(spark, {"x": str(tmp_path / "nothing")})


def test_raw_strips_join_to_a_file(spark, tmp_path):
    a = np.random.default_rng(5).integers(0, 99, (10, 7))
    raster.write_raw(image(spark, a), PixelGrid.of(0, 0, 7, 10, 1.0), str(tmp_path / "s"), "<i2", rows=4)
    data = b"".join(bytes(r.data) for r in spark.read.parquet(str(tmp_path / "s")).orderBy("band", "top").collect())
    (tmp_path / "f.raw").write_bytes(data)
    assert (array(raster.read_raw(spark, str(tmp_path / "f.raw"), 10, 7, "<i2"), a.shape) == a).all()


def test_layers_formats_names_and_partitions_have_an_effect(spark, tmp_path):
    g = PixelGrid.of(0, 0, 8, 8, 1.0)
    a = np.arange(64).reshape(8, 8)
    square = lambda x, n: spark.sql(f"SELECT 1L fid, array(named_struct('x', {x}.0, 'y', 0.0), named_struct('x', {x + n}.0, 'y', 0.0), named_struct('x', {x + n}.0, 'y', -{n}.0), named_struct('x', {x}.0, 'y', -{n}.0)) ring")
    layers = {"small": square(0, 2), "large": square(3, 4)}
    for which, n in (("large", 16), (0, 4), (1, 16), ("small", 4)):
        c = Controls().set("vector_layer", which, "v").set("partitions", 3)
        res = apply_all(lambda info, x, p: {"o": x["v"] * x["a"], "n": x["v"].sum()}, {"v": (layers, None), "a": (image(spark, a), g)}, ["o"], c, totals={"n": "sum"})
        assert all_totals(res, {"n": "sum"}).first().n == n
        assert res.cells.rdd.getNumPartitions() == 3
        job = apply(lambda x, p: {"o": x["v"] * x["a"]}, {"v": (layers, None), "a": (image(spark, a), g)}, c)
        assert job.outputs["o"].where("v > 0").count() in (n - 1, n)
    with pytest.raises(BadOption):
        apply(lambda x, p: {}, {"v": (layers, None), "a": (image(spark, a), g)}, Controls().set("vector_layer", "none", "v"))
    c = Controls().set("format", "orc", "o").set("writer_options", {"compression": "zlib"}, "o").set("job_name", "trial").set("histogram", False)
    paths = raster.write_job(apply(lambda x, p: {"o": x["a"] + 1}, {"a": (image(spark, a), g)}, c), str(tmp_path), c)
    assert list((tmp_path / "o/pixels").rglob("*.zlib.orc"))
    px, grid = raster.read_raster(spark, paths["o"])
    assert grid == g and (array(px, (8, 8)) == a + 1).all()
    assert raster.read_part(spark, paths["o"], "stats").first().vmax == 64
    with pytest.raises(BadOption):
        raster.write_raster(image(spark, a), g, str(tmp_path / "x"), kind="csv")
