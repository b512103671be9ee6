"""Kernels of resampling against loops, and what a task holds of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.grid import PixelGrid
from gridloom.operators import align

SCHEMA = "band int, r long, c long, v double"
GRID = PixelGrid.of(100.0, 50.0, 23, 19, 2.0, 3.0)
TARGETS = {
    "finer": PixelGrid.of(99.1, 52.3, 90, 80, 0.7, 1.1),
    "coarser": PixelGrid.of(96.5, 47.7, 6, 9, 9.3, 8.2),
    "one in many": PixelGrid.of(90.0, 60.0, 2, 2, 31.0, 37.0),
    "same, half a pixel off": PixelGrid.of(101.0, 48.5, 23, 19, 2.0, 3.0),
    "beside it": PixelGrid.of(400.0, 50.0, 8, 8, 2.0, 3.0),
}


def weights(method, t):
    a = np.abs(t)
    if method == "bilinear":
        return np.maximum(0, 1 - a)
    if method == "cubic":
        return np.where(a <= 1, 1.5 * a**3 - 2.5 * a**2 + 1, np.where(a < 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2, 0))
    if method == "cubicspline":
        return np.where(a <= 1, a**3 / 2 - a**2 + 2 / 3, np.where(a < 2, (2 - a) ** 3 / 6, 0))
    return np.where(a < 3, np.sinc(t) * np.sinc(t / 3), 0)


def looped(rows, source, target, method, nodata, place=lambda x, y: (x, y)):
    out = {}
    for band in {b for b, *_ in rows}:
        r, c, v = (np.array([x[k] for x in rows if x[0] == band and x[3] != nodata]) for k in (1, 2, 3))
        for i in range(target.nrows):
            for j in range(target.ncols):
                x, y = place(target.xmin + (j + 0.5) * target.xres, target.ymax - (i + 0.5) * target.yres)
                w = weights(method, (source.ymax - y) / source.yres - 0.5 - r) * weights(method, (x - source.xmin) / source.xres - 0.5 - c)
                if abs(w.sum()) > 1e-12:
                    out[band, i, j] = (w * v).sum() / w.sum()
    return out


def pixels():
    """Two bands; holes, no-data, a pixel twice and one beyond the grid."""
    rng = np.random.default_rng(3)
    rows = [(b, r, c, float(rng.integers(1, 99))) for b in (1, 2) for r in range(GRID.nrows) for c in range(GRID.ncols) if rng.random() < 0.8]
    return [*rows, (1, 4, 4, 50.0), (2, 5, 5, 5.0), rows[7], (1, -1, 3, 70.0)]


def near(got, want):
    assert got.keys() == want.keys()
    # where weights nearly cancel, the order of a sum shows
    assert all(abs(got[k] - x) <= 1e-6 * max(1, abs(x)) for k, x in want.items())


@pytest.mark.parametrize("method", list(align.KERNELS))
@pytest.mark.parametrize("target", list(TARGETS))
def test_kernels_match_a_loop(spark, method, target):
    rows = pixels()
    df = align.resample(spark.createDataFrame(rows, SCHEMA), GRID, TARGETS[target], method, 5)
    assert dict(df.dtypes) == {"band": "int", "r": "bigint", "c": "bigint", "v": "double"}
    near({(x.band, x.r, x.c): x.v for x in df.collect()}, looped(rows, GRID, TARGETS[target], method, 5))


@pytest.mark.parametrize("method", list(align.KERNELS))
def test_kernels_match_a_loop_where_the_way_back_is_turned(spark, method):
    rows, target = pixels(), TARGETS["finer"]
    turned = lambda x, y: (x * 0.9 - y * 0.3 + 20, x * 0.3 + y * 0.9 - 30)
    df = align.resample(spark.createDataFrame(rows, SCHEMA), GRID, target, method, 5, turned)
    near({(x.band, x.r, x.c): x.v for x in df.collect()}, looped(rows, GRID, target, method, 5, turned))


@pytest.mark.parametrize("inverse", [None, lambda x, y: (x, y)])
@pytest.mark.parametrize("method", list(align.KERNELS))
def test_pixels_without_a_place_and_null_values(spark, method, inverse):
    grid, target = PixelGrid.of(0.0, 0.0, 4, 4, 1.0), PixelGrid.of(0.0, 0.0, 3, 3, 1.5)
    rows = [(1, r, c, float(3 * r + c)) for r in range(4) for c in range(4) if (r, c) != (2, 2)]
    odd = [*rows, (1, None, 1, 1e6), (1, 1, None, 1e6), (1, None, None, 1e6), (1, 2, 2, None)]
    df = align.resample(spark.createDataFrame(odd, SCHEMA), grid, target, method, 5, inverse)
    near({(x.band, x.r, x.c): x.v for x in df.collect()}, looped(rows, grid, target, method, 5))
    assert align.resample(spark.createDataFrame([], SCHEMA), grid, target, method, 5, inverse).count() == 0


@pytest.mark.parametrize("inverse", [None, lambda x, y: (x, y)])
def test_a_task_holds_few_cells_of_a_large_target(spark, monkeypatch, inverse):
    monkeypatch.setattr(align, "CELLS_A_TASK", 10_000, raising=False)
    px = spark.range(150 * 1500).select(F.floor(F.col("id") / 150).alias("r"), (F.col("id") % 150).alias("c"), (F.col("id") % 97).alias("v"))
    df = align.resample(px, PixelGrid.of(0.0, 0.0, 150, 1500, 1.0), PixelGrid.of(0.0, 0.0, 100, 1000, 1.5), "lanczos", inverse=inverse)
    n = [x["count"] for x in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(n) == 100_000 and max(n) <= 25_000


@pytest.mark.parametrize("inverse", [None, lambda x, y: (x, y)])
def test_kernels_shuffle_no_row_for_each_pixel_of_each_cell(spark, inverse):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "-1")):
        spark.conf.set(k, v)
    try:
        px = spark.range(150 * 150).select(F.floor(F.col("id") / 150).alias("r"), (F.col("id") % 150).alias("c"), (F.col("id") % 97).alias("v"))
        df = align.resample(px, PixelGrid.of(0.0, 0.0, 150, 150, 1.0), PixelGrid.of(0.0, 0.0, 100, 100, 1.5), "lanczos", inverse=inverse)
        assert len(df.collect()) == 10_000
        nodes, written = [df._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            kids = node.children()
            nodes += [kids.apply(k) for k in range(kids.size())]
            if node.nodeName() == "Exchange":
                written += node.metrics().apply("shuffleRecordsWritten").value()
        assert 0 < written < 10 * 10_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
