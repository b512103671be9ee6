"""Queries against DuckDB at the smallest scale, and operators against numpy."""

import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom import crs, queries
from gridloom.cli import version_tuple
from gridloom.errors import BadOption, NoOverlap, RatMismatch, ResampleNeeded
from gridloom.functions import colour
from gridloom.grid import PixelGrid, common_region, round_away, snap, without_surrounding, working_grid
from gridloom.operators import focal, rat, stats, vector
from gridloom.plans.apply import Controls, apply
from gridloom.sources import raster

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    res = duck.execute(queries.SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=str)
    assert got == want


def image(spark, a):
    rows = [(int(r), int(c), int(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "r long, c long, v long")


def test_focal_strategies_agree(spark):
    a = np.random.default_rng(0).integers(1, 99, (13, 17))
    px = image(spark, a)
    pad = np.pad(a, 2)
    want = {(r, c): pad[r : r + 5, c : c + 5].max() for r in range(13) for c in range(17)}
    assert {(r.r, r.c): r.v for r in focal.focal_separable(px, 2, F.max).collect()} == want

    def most(b, info):
        out = b.copy()
        for i in range(-2, 3):
            for j in range(-2, 3):
                out = np.maximum(out, np.roll(np.roll(b, i, 0), j, 1))
        return out

    assert {(r.r, r.c): r.v for r in focal.block_apply(px, most, 13, 17, 8, 2).collect()} == want


def test_statistics_of_all_null_and_negative(spark):
    px = spark.createDataFrame([(0, 0, 5), (0, 1, 5)], "r long, c long, v long")
    assert stats.band_stats(px, 5).first().n == 0
    assert stats.histogram_direct(px, 5).count() == 0
    neg = spark.createDataFrame([(0, i, v) for i, v in enumerate((-3, -1, -1, 0))], "r long, c long, v long")
    h = stats.histogram_direct(neg)
    assert {(r.bin, r.n) for r in h.collect()} == {(-3, 1), (-2, 0), (-1, 2), (0, 1)}
    assert tuple(stats.median_and_mode(h).first()) == (-1.0, -1.0)


def test_linear_histogram_matches_a_loop(spark):
    v = np.random.default_rng(1).integers(100, 5000, 3000)
    got = {r.bin: r.n for r in stats.histogram_linear(spark.createDataFrame([(int(x),) for x in v], "v long")).collect()}
    counts, low, step = np.bincount(v - v.min()), v.min(), (v.max() - v.min()) / 256
    for i in range(256):
        a, b = math.ceil(i * step) if i * step != int(i * step) else int(i * step), (i + 1) * step
        want = sum(int(n) for j, n in enumerate(counts) if int(i * step) <= j < (int(b) if i < 255 else len(counts)))
        assert got[i] == want, (i, a, low)


@given(st.floats(-1e6, 1e6), st.floats(-100, 100), st.sampled_from([0.5, 1.0, 10.0]))
@settings(max_examples=50, deadline=None)
def test_snap_is_on_the_grid_and_near(v, on, res):
    s = snap(v, on, res)
    assert abs(s - v) <= res / 2 + 1e-6
    assert abs((s - on) / res - round_away((s - on) / res)) < 1e-6


def test_grid_algebra():
    a, b = PixelGrid.of(0, 100, 10, 10, 10), PixelGrid.of(50, 50, 10, 10, 10)
    i, u = a.intersection(b), a.union(b)
    assert (i.nrows, i.ncols) == (5, 5) and (u.nrows, u.ncols) == (15, 15)
    assert u.surrounds(a) and without_surrounding([u, a, b]) == [a, b]
    with pytest.raises(NoOverlap):
        a.intersection(PixelGrid.of(100, 100, 10, 10, 10))
    with pytest.raises(ResampleNeeded):
        working_grid({"a": a, "b": PixelGrid.of(4, 100, 10, 10, 10)})
    assert common_region([a, b], a, "bounds_from_reference") == a


def test_projections_round_trip():
    for lon, lat in ((147.3, -42.9), (150.0, -20.0)):
        x, y = crs.to_web_mercator(lon, lat)
        assert np.allclose(crs.from_web_mercator(x, y), (lon, lat), atol=1e-9)
        x, y = crs.to_utm(lon, lat, 55, True)
        assert np.allclose(crs.from_utm(x, y, 55, True), (lon, lat), atol=1e-8)
    assert np.allclose(crs.to_utm(147.0, 0.0, 55, True), (500000, 10000000), atol=1e-6)
    assert np.allclose(crs.to_albers(132.0, 0.0), (0, 0), atol=1e-6)


def test_rasterize_ignores_what_is_outside(spark):
    g = PixelGrid.of(0, 10, 10, 10, 1)
    ring = spark.createDataFrame([(1, [(2.0, 2.0), (5.0, 2.0), (5.0, 6.0), (2.0, 6.0)]), (2, [(50.0, 50.0), (60.0, 50.0), (55.0, 60.0)])], "fid long, ring array<struct<x:double,y:double>>")
    v = {(r.r, r.c) for r in vector.rasterize(vector.edges_of(ring), g).where("v = 1").collect()}
    assert v == {(r, c) for r in range(4, 8) for c in range(2, 5)}


def test_attribute_tables(spark):
    t = rat.new_rat(spark, 10, x=F.col("row_id") * 2)
    with pytest.raises(RatMismatch):
        rat.joined({"a": t, "b": rat.new_rat(spark, 9, y=F.lit(1))})
    assert [r.row_id for r in rat.reduced(t, F.col("x") % 4 == 0).orderBy("row_id").collect()] == list(range(5))
    assert rat.usage_of(rat.with_usage(t, "x", "red"), "x") == "red"


def test_apply_and_controls(spark):
    g = PixelGrid.of(0, 4, 4, 4, 1)
    px = image(spark, np.arange(16).reshape(4, 4))
    job = apply(lambda x, k: {"out": (x["a"] + k).cast("long")}, {"a": (px, g)}, Controls(), 1)
    assert job.stats["out"].first().vmax == 16
    with pytest.raises(BadOption):
        Controls().set("nonsense", 1)
    with pytest.raises(BadOption):
        apply(lambda x, _: {"out": x["a"]}, {"a": (px, g)}, Controls().set("thematic", True, "nobody"))


def test_raster_store_round_trip(spark, tmp_path):
    g = PixelGrid.of(0, 4, 4, 4, 1, crs="x")
    px = image(spark, np.arange(16).reshape(4, 4))
    raster.write_raster(px, g, str(tmp_path / "a"), 0)
    back, grid = raster.read_raster(spark, str(tmp_path / "a"), [1], (1, 1, 2, 2))
    assert grid == g and sorted(r.v for r in back.collect()) == [5, 6, 9, 10]
    np.arange(12, dtype="<f4").tofile(tmp_path / "b.raw")
    assert raster.read_raw(spark, str(tmp_path / "b.raw"), 2, 3, bands=2).agg(F.sum("v")).first()[0] == 66
    raster.write_tiles(px, str(tmp_path / "t"), 3)
    assert raster.read_tiles(spark, str(tmp_path / "t")).count() == 16


def test_tiles_as_a_stream(spark, tmp_path):
    from gridloom.streaming import tiles

    px = image(spark, np.arange(16).reshape(4, 4))
    raster.write_tiles(px, str(tmp_path / "t"), 2)
    schema = spark.read.parquet(str(tmp_path / "t")).schema
    q = tiles.running_stats(tiles.once(tiles.tile_stream(spark, str(tmp_path / "t"), schema))).writeStream.format("memory").queryName("tile_stats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.table("tile_stats").first())[:3] == (16, 0, 15)


def test_small_things(spark):
    assert version_tuple("2.0.9rc1") == (2, 0, 9)
    assert stats.pyramid_levels(2048, 2048) == [4, 8]
    with pytest.raises(ValueError):
        colour.add_ramp("gray", [])
    assert colour.ramp(spark, 5, "RANDOM").count() == 5


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
