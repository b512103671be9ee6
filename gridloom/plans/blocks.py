"""Block mode for whole jobs: numpy arrays of all inputs, any number of outputs, and totals over all blocks.

Inputs are aligned lazily, dealt to blocks (with margins) in one shuffle, and each block is one group: a task holds
(size + 2 overlap) squared cells of every band, whatever the raster's size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArrayShape, BadOption
from ..grid import PixelGrid
from .apply import Controls, lined_up

_LONG = "img string, band int, r long, c long, v double"


@dataclass(frozen=True)
class BlockInfo:
    """Where a block lies; sizes leave out the margin, arrays hold it."""

    grid: PixelGrid
    top: int
    left: int
    nrows: int
    ncols: int
    overlap: int
    size: int
    nodata: dict[str, float | None]

    @property
    def count(self) -> tuple[int, int]:
        """(across, down): the block's place among blocks."""
        return self.left // self.size, self.top // self.size

    @property
    def total(self) -> tuple[int, int]:
        return -(-self.grid.ncols // self.size), -(-self.grid.nrows // self.size)

    @property
    def first(self) -> bool:
        return self.count == (0, 0)

    @property
    def last(self) -> bool:
        return self.count == (self.total[0] - 1, self.total[1] - 1)

    @property
    def percent(self) -> int:
        """Of blocks before this one, row by row."""
        (x, y), (across, down) = self.count, self.total
        return 100 * (y * across + x) // (across * down)

    def coordinates(self) -> tuple[np.ndarray, np.ndarray]:
        """x and y of the centre of every pixel, margin included."""
        g, m = self.grid, self.overlap
        r, c = np.mgrid[self.top - m : self.top + self.nrows + m, self.left - m : self.left + self.ncols + m]
        return g.xmin + (c + 0.5) * g.xres, g.ymax - (r + 0.5) * g.yres

    def pixel_at(self, x: float, y: float) -> tuple[int, int] | tuple[None, None]:
        """(row, column) within the block's arrays, or two Nones outside of them."""
        g, m = self.grid, self.overlap
        r, c = int(np.floor((g.ymax - y) / g.yres)) - self.top + m, int(np.floor((x - g.xmin) / g.xres)) - self.left + m
        inside = 0 <= r < self.nrows + 2 * m and 0 <= c < self.ncols + 2 * m
        return (r, c) if inside else (None, None)

    def in_grid(self, col: int, row: int) -> tuple[int, int]:
        """(column, row) in the whole grid of a place in the block's arrays."""
        return self.left + col - self.overlap, self.top + row - self.overlap


@dataclass
class BlockResult:
    """``cells``: (img, band, r, c, v) of all outputs, lazy. Write it once when several outputs are wanted."""

    cells: DataFrame
    grid: PixelGrid
    names: list[str]

    def output(self, name: str) -> DataFrame:
        if name not in self.names:
            raise BadOption(name)
        return self.cells.where(F.col("img") == name).select("band", "r", "c", "v")

    def write(self, path: str) -> BlockResult:
        """All outputs by one run, by image and band; the result reads what was written."""
        self.cells.where(F.col("img").isin(self.names)).write.mode("overwrite").partitionBy("img", "band").parquet(path)
        return BlockResult(self.cells.sparkSession.read.schema(_LONG).parquet(path), self.grid, self.names)


def _cells(inputs: dict[str, tuple[DataFrame, PixelGrid]], grid: PixelGrid) -> DataFrame:
    parts = []
    for k, (px, g) in inputs.items():
        dr, dc = g.offset_to(grid)
        band = F.col("band").cast("int") if "band" in px.columns else F.lit(1)
        parts.append(px.select(F.lit(k).alias("img"), band.alias("band"), (F.col("r") + dr).cast("long").alias("r"), (F.col("c") + dc).cast("long").alias("c"), F.col("v").cast("double").alias("v")))
    return reduce(DataFrame.unionByName, parts)


def apply_all(
    fn: Callable[[BlockInfo, dict[str, np.ndarray], Any], dict[str, np.ndarray]],
    inputs: dict[str, tuple[DataFrame, PixelGrid]],
    outputs: list[str],
    controls: Controls | None = None,
    params: Any = None,
    totals: dict[str, str] | None = None,
    spark: SparkSession | None = None,
) -> BlockResult:
    """``fn(info, arrays, params)`` on every block of the working grid.

    Arrays are (bands, rows, columns) of doubles, whole numbers exact to 2^53, with each input's no-data (or 0)
    outside of it. The function returns arrays by output, (bands, rows, columns) or (rows, columns), margins included,
    and numbers for the names in ``totals``; ``all_totals`` adds those up over blocks. Nothing else passes between blocks.
    """
    controls = controls or Controls()
    totals = totals or {}
    controls.check(set(inputs) | set(outputs))
    ready, grid = lined_up(inputs, controls)
    spark = spark or next(iter(ready.values()))[0].sparkSession
    size, m = controls.get("block_size"), controls.get("overlap")
    nodata = {k: controls.get("input_nodata", k) for k in inputs}
    bands = {k: (px.agg(F.max("band")).first()[0] or 1) if "band" in px.columns else 1 for k, (px, _) in ready.items()}
    rows, cols = grid.nrows, grid.ncols
    near = lambda x: F.array_distinct(F.array(F.floor((x - m) / size), F.floor(x / size), F.floor((x + m) / size)))
    if m > size:
        raise BadOption(f"a margin of {m} is wider than blocks of {size}")
    # one marker a block, so that blocks without any pixel are processed too
    blocks = grid.blocks(spark, size).select(F.lit(None).cast("string").alias("img"), F.lit(0).alias("band"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("v"), (F.col("top") / size).cast("long").alias("br"), (F.col("left") / size).cast("long").alias("bc"))
    dealt = blocks
    if ready:
        dealt = _cells(ready, grid).withColumn("br", F.explode(near(F.col("r")))).withColumn("bc", F.explode(near(F.col("c"))))
        dealt = dealt.where(F.col("br").between(0, (rows - 1) // size) & F.col("bc").between(0, (cols - 1) // size)).unionByName(blocks)

    if (parts := controls.get("partitions")) is not None:  # the grouping keeps this partitioning
        dealt = dealt.repartition(parts, "br", "bc")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(key[0]) * size, int(key[1]) * size
        h, w = min(size, rows - top), min(size, cols - left)
        info = BlockInfo(grid, top, left, h, w, m, size, nodata)
        pdf = pdf[pdf.img.notna()]
        arrays = {}
        for k, n in bands.items():
            a = arrays[k] = np.full((n, h + 2 * m, w + 2 * m), float(nodata[k] or 0))
            p = pdf[pdf.img == k]
            b, i, j = p.band.to_numpy() - 1, p.r.to_numpy() - top + m, p.c.to_numpy() - left + m
            ok = (b >= 0) & (i >= 0) & (i < a.shape[1]) & (j >= 0) & (j < a.shape[2])
            a[b[ok], i[ok], j[ok]] = p.v.to_numpy()[ok]
        made = fn(info, arrays, params) or {}
        frames = []
        rr, cc = np.mgrid[top : top + h, left : left + w]
        for k in outputs:
            out = np.asarray(made[k], float)
            out = out[None] if out.ndim == 2 else out
            if out.ndim != 3 or out.shape[1:] != (h + 2 * m, w + 2 * m):
                raise ArrayShape(f"{k} has shape {out.shape}, not (bands, {h + 2 * m}, {w + 2 * m})")
            for b, layer in enumerate(out[:, m : m + h, m : m + w], 1):
                frames.append(pd.DataFrame({"img": k, "band": b, "r": rr.ravel(), "c": cc.ravel(), "v": layer.ravel()}))
        for k in totals:
            frames.append(pd.DataFrame({"img": [k], "band": [0], "r": [top], "c": [left], "v": [float(made[k])]}))
        return pd.concat(frames) if frames else pd.DataFrame({"img": [], "band": [], "r": [], "c": [], "v": []})

    return BlockResult(dealt.groupBy("br", "bc").applyInPandas(run, _LONG), grid, list(outputs))


def all_totals(result: BlockResult, totals: dict[str, str]) -> DataFrame:
    """One row: every total of the blocks merged by its built-in aggregate (sum, min, max)."""
    v = lambda k: F.when(F.col("img") == k, F.col("v"))
    return result.cells.agg(*[getattr(F, how)(v(k)).alias(k) for k, how in totals.items()])
