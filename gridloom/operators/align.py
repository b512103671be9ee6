"""Alignment of rasters: an equi-join on cells where grids are in line, a kernel resample where they are not.

Pixels are long rows (r, c, v); r and c count in the raster's own grid. A cell outside a raster's extent takes its
no-data value, or 0 if it has none.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..crs import transform
from ..grid import BOUNDS_FROM_REFERENCE, INTERSECTION, PixelGrid, common_region


def moved(px: DataFrame, grid: PixelGrid, to: PixelGrid) -> DataFrame:
    """Pixel numbers of an aligned grid in another's."""
    dr, dc = grid.offset_to(to)
    return px.withColumns({"r": F.col("r") + dr, "c": F.col("c") + dc}) if dr or dc else px


def combine(inputs: dict[str, tuple[DataFrame, PixelGrid]], how: str = INTERSECTION, reference: PixelGrid | None = None, fill: dict[str, float] | None = None) -> tuple[DataFrame, PixelGrid]:
    """One row per cell of the common grid with a column per input."""
    fill = fill or {}
    base = reference or next(iter(inputs.values()))[1]
    grid = common_region([g for _, g in inputs.values()], base, how)
    parts = {k: moved(px, g, grid).select("r", "c", F.col("v").alias(k)) for k, (px, g) in inputs.items()}
    if how == INTERSECTION:
        out = None
        for k, p in parts.items():
            inside = p.where(F.col("r").between(0, grid.nrows - 1) & F.col("c").between(0, grid.ncols - 1))
            out = inside if out is None else out.join(inside, ["r", "c"])
        return out, grid
    out = grid.cells(next(iter(parts.values())).sparkSession)
    for k, p in parts.items():
        out = out.join(p, ["r", "c"], "left")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(fill.get(k, 0)).cast(parts[k].schema[k].dataType)) for k in parts}), grid


def bounds_fill(px: DataFrame, grid: PixelGrid, reference: PixelGrid, fill: float = 0) -> DataFrame:
    return combine({"v": (px, grid)}, BOUNDS_FROM_REFERENCE, reference, {"v": fill})[0]


def stack_bands(bands: list[DataFrame]) -> DataFrame:
    """(band, r, c, v), bands numbered from 1 in the order given."""
    out = None
    for k, px in enumerate(bands, 1):
        one = px.select(F.lit(k).alias("band"), "r", "c", "v")
        out = one if out is None else out.unionByName(one)
    return out


def select_bands(px: DataFrame, bands: list[int]) -> DataFrame:
    """These bands, renumbered from 1 in the order asked for; a filter that reaches the scan."""
    number = F.element_at(F.create_map(*[F.lit(x) for k, b in enumerate(bands, 1) for x in (b, k)]), F.col("band"))
    return px.where(F.col("band").isin(bands)).withColumn("band", number)


def cellwise(px: DataFrame, nodata: float | None, **aggs: Column) -> DataFrame:
    """Aggregates over all images of a long stack, cell by cell; write them on the column ``v``, no-data being null."""
    v = F.col("v") if nodata is None else F.when(F.col("v") != nodata, F.col("v"))
    return px.withColumn("v", v).groupBy("r", "c").agg(*[a.alias(k) for k, a in aggs.items()])


def _cubic(t: Column) -> Column:
    a = F.abs(t)
    return F.when(a <= 1, 1.5 * a * a * a - 2.5 * a * a + 1).when(a < 2, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2).otherwise(0.0)


def _spline(t: Column) -> Column:
    a = F.abs(t)
    return F.when(a <= 1, a * a * a / 2 - a * a + 2.0 / 3).when(a < 2, (2 - a) * (2 - a) * (2 - a) / 6).otherwise(0.0)


def _lanczos(t: Column) -> Column:
    p = t * math.pi
    return F.when(F.abs(t) < 1e-12, 1.0).when(F.abs(t) < 3, 3 * F.sin(p) * F.sin(p / 3) / (p * p)).otherwise(0.0)


#: Reach in pixels and weight by distance.
KERNELS: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "bilinear": (1, lambda t: F.greatest(F.lit(0.0), 1 - F.abs(t))),
    "cubic": (2, _cubic),
    "cubicspline": (2, _spline),
    "lanczos": (3, _lanczos),
}
#: Cells of the target whose sums a task holds, so that its memory doesn't grow with the raster.
CELLS_A_TASK, MOST_TASKS = 1 << 17, 20_000
#: Blocks of the target have 64 cells a side, tiles of the source 8 pixels.
BLOCK_BITS, TILE_BITS = 6, 3
#: Part of a pixel by which ends of a kernel are rounded outwards; weights decide what is in.
SLACK = 0.001


def resample(px: DataFrame, source: PixelGrid, target: PixelGrid, method: str = "near", nodata: float | None = None, inverse: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """Values of ``px`` at the centres of the target's pixels.

    ``inverse`` maps target world coordinates to the source's. Kernels leave out no-data and missing neighbours and
    renormalise, so no-data never smears; a pixel without any valid neighbour is absent. Bands, if there is a column
    of them, are kept apart. Without ``inverse``, grids of different projections take the way between them.
    """
    if method == "near" and inverse is None and source.aligned_with(target):
        return moved(px, source, target).where(F.col("r").between(0, target.nrows - 1) & F.col("c").between(0, target.ncols - 1))
    x, y = target.world_of(F.col("r") + 0.5, F.col("c") + 0.5)
    if inverse is None and source.crs != target.crs:
        inverse = transform(target.crs, source.crs)
    if inverse:
        x, y = inverse(x, y)
    fr, fc = source.pixel_of(x, y)
    valid = px if nodata is None else px.where(F.col("v") != nodata)
    band = [k for k in ("band",) if k in px.columns]
    valid = valid.select(*band, F.col("r").alias("sr"), F.col("c").alias("sc"), "v")
    cells = target.cells(px.sparkSession)
    if method == "near":
        asked = cells.select("r", "c", F.floor(fr).alias("sr"), F.floor(fc).alias("sc"))
        return asked.join(valid, ["sr", "sc"]).select(*band, "r", "c", "v")
    reach, weight = KERNELS[method]
    fr, fc = fr - 0.5, fc - 0.5
    if inverse is None:
        met = _sent(valid, source, target, fr, fc, reach, weight, band)
    else:
        met = _fetched(valid, cells.select("r", "c", fr.alias("fr"), fc.alias("fc")), _tasks(target), reach, weight, band)
    return met.where("abs(w) > 1e-12").select(*band, "r", "c", (F.col("s") / F.col("w")).alias("v"))


def _tasks(target: PixelGrid) -> int:
    return min(MOST_TASKS, target.nrows * target.ncols // CELLS_A_TASK + 1)


def _between(lo: Column, hi: Column) -> Column:
    """A row for each whole number from ``lo`` to ``hi``, none if there is none."""
    return F.explode(F.when(lo <= hi, F.sequence(lo, hi)))


def _sent(valid: DataFrame, source: PixelGrid, target: PixelGrid, fr: Column, fc: Column, reach: int, weight: Callable[[Column], Column], band: list[str]) -> DataFrame:
    """Weighted sums of a target in the source's projection: each pixel goes once to the blocks of the target that it
    reaches, and is spread over their cells only there. A task holds the sums of its own blocks."""
    sr, sc = F.col("sr") + 0.5, F.col("sc") + 0.5
    ends = [target.pixel_of(*source.world_of(sr + k, sc + k)) for k in (-reach, reach)]
    (top, left), (bottom, right) = ([x - 0.5 for x in end] for end in ends)
    r0, r1 = F.greatest(F.ceil(top - SLACK), F.lit(0)), F.least(F.floor(bottom + SLACK), F.lit(target.nrows - 1))
    c0, c1 = F.greatest(F.ceil(left - SLACK), F.lit(0)), F.least(F.floor(right + SLACK), F.lit(target.ncols - 1))
    block = lambda x: F.shiftright(x, BLOCK_BITS)
    first, last = lambda k: F.shiftleft(F.col(k), BLOCK_BITS), lambda k: F.shiftleft(F.col(k) + 1, BLOCK_BITS) - 1
    dealt = valid.dropna(subset=["sr", "sc"]).where((r0 <= r1) & (c0 <= c1)).withColumn("br", _between(block(r0), block(r1))).withColumn("bc", _between(block(c0), block(c1)))
    dealt = dealt.repartition(_tasks(target), "br", "bc")
    spread = dealt.withColumn("r", _between(F.greatest(r0, first("br")), F.least(r1, last("br"))))
    spread = spread.withColumn("w", weight(fr - F.col("sr"))).where("w <> 0")
    spread = spread.withColumn("c", _between(F.greatest(c0, first("bc")), F.least(c1, last("bc"))))
    spread = spread.withColumn("w", F.col("w") * weight(fc - F.col("sc"))).where("w <> 0")
    return spread.groupBy("br", "bc", *band, "r", "c").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("w"))


def _fetched(valid: DataFrame, asked: DataFrame, tasks: int, reach: int, weight: Callable[[Column], Column], band: list[str]) -> DataFrame:
    """Weighted sums at any places of the source: a cell asks for the small tiles its kernel touches (at most four if
    they are wider than the kernel), not for each pixel; sums of a tile are added up by cell."""
    tiles = lambda f: _between(F.shiftright(F.floor(f) + 1 - reach, TILE_BITS), F.shiftright(F.floor(f) + reach, TILE_BITS))
    asked = asked.withColumn("tr", tiles("fr")).withColumn("tc", tiles("fc")).repartition(tasks, "tr", "tc")
    held = valid.withColumns({"tr": F.shiftright(F.col("sr").cast("long"), TILE_BITS), "tc": F.shiftright(F.col("sc").cast("long"), TILE_BITS)}).repartition(tasks, "tr", "tc")
    dr, dc = F.col("fr") - F.col("sr"), F.col("fc") - F.col("sc")
    near = asked.join(held, ["tr", "tc"]).where((F.abs(dr) < reach) & (F.abs(dc) < reach))
    near = near.select("tr", "tc", *band, "r", "c", "v", (weight(dr) * weight(dc)).alias("w")).where("w <> 0")
    parts = near.groupBy("tr", "tc", *band, "r", "c").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("w"))
    return parts.repartition(tasks, "r", "c").groupBy(*band, "r", "c").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
