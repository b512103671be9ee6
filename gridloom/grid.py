"""Pixel grids: the driver-side algebra that plans alignment, blocks and footprints.

A grid is a handful of numbers, so all of this is plain Python; what touches pixels are the Column expressions
and small DataFrames made from it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .crs import transform
from .errors import NoOverlap, ResampleNeeded

INTERSECTION, UNION, BOUNDS_FROM_REFERENCE = "intersection", "union", "bounds_from_reference"
#: Part of a pixel over the whole width by which grids may be out of line.
ALIGN_TOLERANCE = 0.001
#: Points on each edge when bounds are reprojected.
EDGE_POINTS = 101
DEFAULT_BLOCK = 256


def round_away(x: float) -> int:
    """Nearest integer, halves away from zero."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def snap(value: float, on: float, res: float) -> float:
    return on + round_away((value - on) / res) * res


def snap_column(value: Column, on: float, res: float) -> Column:
    return F.lit(float(on)) + F.round((value - F.lit(float(on))) / F.lit(float(res))) * F.lit(float(res))


@dataclass(frozen=True)
class PixelGrid:
    """Outer pixel edges and resolution of a north-up raster."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float
    xres: float
    yres: float
    crs: str = ""

    @classmethod
    def of(cls, xmin: float, ymax: float, ncols: int, nrows: int, xres: float, yres: float | None = None, crs: str = "") -> PixelGrid:
        yres = xres if yres is None else yres
        return cls(xmin, ymax - nrows * yres, xmin + ncols * xres, ymax, xres, yres, crs)

    @property
    def nrows(self) -> int:
        return round_away((self.ymax - self.ymin) / self.yres)

    @property
    def ncols(self) -> int:
        return round_away((self.xmax - self.xmin) / self.xres)

    @property
    def geotransform(self) -> tuple[float, float, float, float, float, float]:
        return (self.xmin, self.xres, 0.0, self.ymax, 0.0, -self.yres)

    def comparable(self, other: PixelGrid) -> bool:
        return self.same_pixel_size(other) and self.crs == other.crs

    def same_pixel_size(self, other: PixelGrid) -> bool:
        return (self.xres, self.yres) == (other.xres, other.yres)

    def aligned_with(self, other: PixelGrid) -> bool:
        if not self.comparable(other):
            return False
        most = ALIGN_TOLERANCE * min(self.xres, self.yres) / max(self.nrows, self.ncols, 1)
        return abs(snap(self.xmin, other.xmin, other.xres) - self.xmin) <= most and abs(snap(self.ymax, other.ymax, other.yres) - self.ymax) <= most

    def _must_match(self, other: PixelGrid) -> None:
        if not self.comparable(other):
            raise ResampleNeeded(f"{self} and {other} differ in pixel size or projection")

    def intersection(self, other: PixelGrid) -> PixelGrid:
        self._must_match(other)
        g = replace(self, xmin=max(self.xmin, other.xmin), ymin=max(self.ymin, other.ymin), xmax=min(self.xmax, other.xmax), ymax=min(self.ymax, other.ymax))
        if g.xmin >= g.xmax or g.ymin >= g.ymax:
            raise NoOverlap(f"{self} and {other} have no pixel in common")
        return g

    def union(self, other: PixelGrid) -> PixelGrid:
        self._must_match(other)
        return replace(self, xmin=min(self.xmin, other.xmin), ymin=min(self.ymin, other.ymin), xmax=max(self.xmax, other.xmax), ymax=max(self.ymax, other.ymax))

    def surrounds(self, other: PixelGrid) -> bool:
        return self.xmin <= other.xmin and self.xmax >= other.xmax and self.ymin <= other.ymin and self.ymax >= other.ymax

    def edge_points(self, n: int = EDGE_POINTS) -> list[tuple[float, float]]:
        """``n`` evenly spaced points on each edge."""
        xs = [self.xmin + (self.xmax - self.xmin) * k / (n - 1) for k in range(n)]
        ys = [self.ymin + (self.ymax - self.ymin) * k / (n - 1) for k in range(n)]
        return [(x, self.ymin) for x in xs] + [(x, self.ymax) for x in xs] + [(self.xmin, y) for y in ys] + [(self.xmax, y) for y in ys]

    def reproject(self, target: PixelGrid, transform: Callable[[float, float], tuple[float, float]]) -> PixelGrid:
        """The bounds in the target's projection, snapped to its pixels; edges may curve."""
        moved = [transform(x, y) for x, y in self.edge_points()]
        xs, ys = [p[0] for p in moved], [p[1] for p in moved]
        return replace(
            target,
            xmin=snap(min(xs), target.xmin, target.xres),
            xmax=snap(max(xs), target.xmin, target.xres),
            ymin=snap(min(ys), target.ymax, target.yres),
            ymax=snap(max(ys), target.ymax, target.yres),
        )

    def lonlat_bounds(self) -> PixelGrid:
        to = transform(self.crs, "EPSG:4326")
        xs, ys = zip(*(to(x, y) for x, y in self.edge_points()))
        return PixelGrid(min(xs), min(ys), max(xs), max(ys), self.xres, self.yres, "EPSG:4326")

    def corners(self, target: str | None = None) -> list[tuple[float, float]]:
        """Upper left, upper right, lower right, lower left, in ``target``'s projection if one is named."""
        to = transform(self.crs, target or self.crs)
        return [to(*p) for p in ((self.xmin, self.ymax), (self.xmax, self.ymax), (self.xmax, self.ymin), (self.xmin, self.ymin))]

    def resolution_in(self, target: str) -> tuple[float, float]:
        """The size of the centre pixel in another projection."""
        to = transform(self.crs, target)
        x, y = (self.xmin + self.xmax) / 2, (self.ymin + self.ymax) / 2
        (x0, y0), (x1, _), (_, y1) = to(x, y), to(x + self.xres, y), to(x, y + self.yres)
        return abs(x1 - x0), abs(y1 - y0)

    def same_place(self, other: PixelGrid, transform: Callable[[float, float], tuple[float, float]], tolerance: float = 0.5) -> bool:
        """Whether corners and centre land within ``tolerance`` pixels of themselves under the transform."""
        xm, ym = (self.xmin + self.xmax) / 2, (self.ymin + self.ymax) / 2
        pts = [(self.xmin, self.ymin), (self.xmin, self.ymax), (self.xmax, self.ymin), (self.xmax, self.ymax), (xm, ym)]
        return all(abs(a - x) <= tolerance * self.xres and abs(b - y) <= tolerance * self.yres for (x, y), (a, b) in ((p, transform(*p)) for p in pts))

    def pixel_of(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, col) as exact fractions; floor gives the pixel."""
        return (F.lit(float(self.ymax)) - y) / F.lit(float(self.yres)), (x - F.lit(float(self.xmin))) / F.lit(float(self.xres))

    def world_of(self, r: Column, c: Column) -> tuple[Column, Column]:
        """(x, y) of the pixel's upper left for whole numbers; add a half for the centre."""
        return F.lit(float(self.xmin)) + c * F.lit(float(self.xres)), F.lit(float(self.ymax)) - r * F.lit(float(self.yres))

    def offset_to(self, other: PixelGrid) -> tuple[int, int]:
        """(rows, cols) to add to this grid's pixel numbers to get those of an aligned grid."""
        return round_away((other.ymax - self.ymax) / self.yres), round_away((self.xmin - other.xmin) / self.xres)

    def cells(self, spark: SparkSession) -> DataFrame:
        """Every (r, c) of the grid."""
        n = max(1, self.ncols)
        return spark.range(self.nrows * self.ncols).select((F.floor(F.col("id") / n)).cast("long").alias("r"), (F.col("id") % n).alias("c"))

    def blocks(self, spark: SparkSession, size: int = DEFAULT_BLOCK, ysize: int | None = None) -> DataFrame:
        """top, left, nrows, ncols of each block, row by row, ragged at the right and bottom."""
        ysize = size if ysize is None else ysize
        down, across = -(-self.nrows // ysize), -(-self.ncols // size)
        k = spark.range(down * across)
        top, left = F.floor(F.col("id") / across) * ysize, (F.col("id") % across) * size
        return k.select(
            F.col("id").alias("block"),
            top.cast("long").alias("top"),
            left.cast("long").alias("left"),
            F.least(F.lit(ysize), self.nrows - top).cast("int").alias("nrows"),
            F.least(F.lit(size), self.ncols - left).cast("int").alias("ncols"),
            F.floor(100 * F.col("id") / (down * across)).cast("int").alias("percent"),
            (F.col("id") == 0).alias("is_first"),
            (F.col("id") == down * across - 1).alias("is_last"),
        )


def common_region(grids: Iterable[PixelGrid], reference: PixelGrid, combine: str = INTERSECTION) -> PixelGrid:
    """The footprint of a job; the reference's own bounds count only for ``BOUNDS_FROM_REFERENCE``.

    Grids out of line count with their bounds in the reference's projection, snapped to its pixels.
    """
    grids = list(grids)
    if combine == BOUNDS_FROM_REFERENCE or not grids:
        return reference
    if combine == INTERSECTION:
        grids = without_surrounding(grids)
    grids = [g if g.aligned_with(reference) else g.reproject(reference, transform(g.crs, reference.crs)) for g in grids]
    return reduce(PixelGrid.union if combine == UNION else PixelGrid.intersection, grids)


def without_surrounding(grids: list[PixelGrid]) -> list[PixelGrid]:
    """Leaves out, one after the other, a grid that surrounds all others; by longitude and latitude where projections differ."""
    kept = list(grids)
    one = len({g.crs for g in kept}) == 1
    bounds = {g: g if one else g.lonlat_bounds() for g in kept}
    while len(kept) > 1:
        outer = next((i for i, g in enumerate(kept) if all(bounds[g].surrounds(bounds[o]) for j, o in enumerate(kept) if j != i)), None)
        if outer is None:
            break
        kept.pop(outer)
    return kept


def working_grid(inputs: dict[str, PixelGrid], combine: str = INTERSECTION, reference: PixelGrid | str | None = None, extent_from: list[str] | None = None) -> PixelGrid:
    """The grid of a job: an explicit grid, an input's name, or the first input if all match it."""
    if isinstance(reference, str):
        reference = inputs[reference]
    if reference is None:
        if not inputs:
            raise ResampleNeeded("no inputs and no reference grid")
        reference = next(iter(inputs.values()))
        if any(not g.aligned_with(reference) for g in inputs.values()):
            raise ResampleNeeded("inputs differ; name a reference")
    chosen = [g for k, g in inputs.items() if extent_from is None or k in extent_from]
    return common_region(chosen, reference, combine)


def grids_frame(spark: SparkSession, grids: dict[str, PixelGrid]) -> DataFrame:
    """One metadata row per image."""
    rows = [(k, g.crs, float(g.xmin), float(g.ymax), float(g.xres), float(g.yres), g.nrows, g.ncols) for k, g in grids.items()]
    return spark.createDataFrame(rows, "img string, crs string, xmin double, ymax double, xres double, yres double, nrows int, ncols int")
