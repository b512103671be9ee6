"""Jobs over aligned rasters: options, planning, and the two modes of applying a function."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadOption, SinglePassImpossible
from ..grid import INTERSECTION, PixelGrid, working_grid
from ..functions.colour import ramp
from ..operators.align import combine, resample, select_bands
from ..operators.focal import block_apply
from ..operators.stats import approximate_stats, band_stats, histogram_direct, histogram_float, histogram_ints, pyramid_average, pyramid_levels, pyramid_nearest
from ..operators.vector import edges_of, rasterize

#: Options and their defaults; each can be set for all images or for one. ``progress`` is called with (percent, name) as
#: outputs are written; ``temp_dir`` is a folder that all executors share, in which outputs are kept for what is made of them.
DEFAULTS: dict[str, Any] = {
    "overlap": 0,
    "block_size": 256,
    "footprint": INTERSECTION,
    "extent_from": None,
    "reference": None,
    "progress": None,
    "format": "parquet",
    "writer_options": {},
    "nodata": 0,
    "input_nodata": None,
    "basic_stats": True,
    "histogram": True,
    "pyramids": True,
    "overview_levels": (4, 8, 16, 32, 64, 128, 256, 512),
    "overview_least": 128,
    "overview_method": "nearest",
    "single_pass": None,
    "approximate_stats": False,
    "thematic": False,
    "layer_names": None,
    "temp_dir": None,
    "resample": "near",
    "burn_value": 1,
    "burn_attribute": None,
    "vector_null": 0,
    "where": None,
    "all_touched": False,
    "vector_type": "smallint",
    "vector_layer": 0,
    "bands": None,
    "partitions": None,
    "job_name": None,
    "auto_colours": None,
    "before_close": None,
}


@dataclass
class Controls:
    """Options of a job."""

    values: dict[tuple[str, str | None], Any] = field(default_factory=dict)

    def set(self, option: str, value: Any, image: str | None = None) -> Controls:
        if option not in DEFAULTS:
            raise BadOption(option)
        self.values[option, image] = value
        return self

    def get(self, option: str, image: str | None = None) -> Any:
        return self.values.get((option, image), self.values.get((option, None), DEFAULTS[option]))

    def check(self, images: set[str]) -> None:
        unknown = {i for _, i in self.values if i is not None} - images
        if unknown:
            raise BadOption(f"no such image: {sorted(unknown)}")
        for i in [None, *images]:
            if self.get("approximate_stats", i) and not self.get("pyramids", i):
                raise BadOption("approximate statistics need pyramids")
        if self.get("footprint") not in ("intersection", "union", "bounds_from_reference"):
            raise BadOption(self.get("footprint"))


@dataclass
class Result:
    """What a job gives: lazy outputs, the grid, and lazy statistics by output."""

    outputs: dict[str, DataFrame]
    grid: PixelGrid
    stats: dict[str, DataFrame]
    histograms: dict[str, DataFrame]
    pyramids: dict[str, dict[int, DataFrame]]
    colours: dict[str, DataFrame] = field(default_factory=dict)


def as_raster(layer: DataFrame, grid: PixelGrid, controls: Controls, image: str) -> DataFrame:
    """A vector layer (fid, ring, attributes) burnt into pixels of ``grid`` as the options for it say."""
    get = lambda option: controls.get(option, image)
    return rasterize(edges_of(layer), grid, get("burn_value"), get("vector_null"), get("all_touched"), layer, get("burn_attribute"), get("where"), get("vector_type"))


def layer_of(layers: Any, which: int | str) -> DataFrame:
    """One layer of a vector input: the input itself, or of a dict or list of layers the one of that name or place."""
    if isinstance(layers, DataFrame):
        return layers
    names = list(layers) if isinstance(layers, dict) else list(range(len(layers)))
    if which in names:
        return layers[which]
    if isinstance(which, int) and 0 <= which < len(names):
        return layers[names[which]]
    raise BadOption(f"no such layer: {which!r}")


def lined_up(inputs: dict[str, tuple[DataFrame, PixelGrid | None]], controls: Controls) -> tuple[dict[str, tuple[DataFrame, PixelGrid]], PixelGrid]:
    """Every input on pixels in line with the working grid, and that grid.

    An input without a grid is a vector layer in the working grid's projection (or a dict or list of layers, of which
    ``vector_layer`` names one); it takes no part in the footprint.
    """
    grids = {k: g for k, (_, g) in inputs.items() if g is not None}
    grid = working_grid(grids, controls.get("footprint"), controls.get("reference"), controls.get("extent_from"))
    ready = {}
    for k, (px, g) in inputs.items():
        if g is None:
            ready[k] = (as_raster(layer_of(px, controls.get("vector_layer", k)), grid, controls, k), grid)
            continue
        if (bands := controls.get("bands", k)) is not None:
            px = select_bands(px, bands)
        null = controls.get("input_nodata", k)
        ready[k] = (px, g) if g.aligned_with(grid) else (resample(px, g, grid, controls.get("resample", k), null), grid)
    return ready, grid


def aligned(inputs: dict[str, tuple[DataFrame, PixelGrid | None]], controls: Controls) -> tuple[DataFrame, PixelGrid]:
    """All inputs on the working grid, one column each; what is not in line is resampled first."""
    ready, grid = lined_up(inputs, controls)
    fill = {k: controls.get("input_nodata", k) or 0 for k in inputs}
    # a resampled input lacks cells without valid neighbours: they hold no-data, and the footprint keeps them
    whole = {k: _filled(px, grid, fill[k]) if g is not inputs[k][1] and inputs[k][1] is not None else px for k, (px, g) in ready.items()}
    return combine({k: (whole[k], g) for k, (_, g) in ready.items()}, controls.get("footprint"), grid, fill)


def _filled(px: DataFrame, grid: PixelGrid, fill: float) -> DataFrame:
    return grid.cells(px.sparkSession).join(px.select("r", "c", "v"), ["r", "c"], "left").select("r", "c", F.coalesce("v", F.lit(fill).cast(px.schema["v"].dataType)).alias("v"))


def apply(fn: Callable[..., dict[str, Column] | None], inputs: dict[str, tuple[DataFrame, PixelGrid]], controls: Controls | None = None, params: Any = None) -> Result:
    """Column mode: ``fn(columns, params)`` gives output columns; the whole job is one plan."""
    controls = controls or Controls()
    made_of: set[str] = set(inputs)
    table, grid = aligned(inputs, controls)
    made = fn({k: F.col(k) for k in inputs}, params) or {}
    controls.check(made_of | set(made))
    outputs = {k: table.select("r", "c", c.alias("v")) for k, c in made.items()}
    if there := controls.get("temp_dir"):  # outputs are made once; all that is derived reads them there
        outputs = {k: _kept(px, f"{there.rstrip('/')}/{k}-{uuid.uuid4().hex}") for k, px in outputs.items()}
    job = Result(outputs, grid, {}, {}, {}, {})
    for k, px in outputs.items():
        derive(job, k, px, controls)
        if hook := controls.get("before_close", k):
            outputs[k] = hook(px) or px
    return job


def _kept(px: DataFrame, path: str) -> DataFrame:
    px.write.parquet(path)
    return px.sparkSession.read.schema(px.schema).parquet(path)


def derive(job: Result, name: str, px: DataFrame, controls: Controls) -> None:
    """Adds what is made from an output's pixels to ``job``: statistics, histogram, pyramids, colours."""
    get = lambda option: controls.get(option, name)
    null, kind = get("nodata"), px.schema["v"].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    if get("single_pass") and (get("approximate_stats") or (get("histogram") and not whole)):
        raise SinglePassImpossible(f"{name}: approximate statistics, and histograms of fractions, take a further pass")
    if get("basic_stats"):
        job.stats[name] = approximate_stats(px, null) if get("approximate_stats") else band_stats(px, null)
    if get("histogram"):
        job.histograms[name] = _histogram(px, null, whole, get("thematic"))
    if get("pyramids"):
        levels = pyramid_levels(job.grid.nrows, job.grid.ncols, get("overview_levels"), get("overview_least"))
        average = get("overview_method") == "average"
        job.pyramids[name] = {x: pyramid_average(px, x, null) if average else pyramid_nearest(px, x) for x in levels}
    if (palette := get("auto_colours")) and get("thematic"):
        top = band_stats(px, null).first().vmax  # the number of colours is the table's length
        if top is not None:
            job.colours[name] = ramp(px.sparkSession, int(top) + 1, palette, null)


def _histogram(px: DataFrame, null: float | None, whole: bool, thematic: bool) -> DataFrame:
    """Classes and bytes are counted from 0, other whole numbers by their range, fractions in equal steps; all lazily."""
    if not whole:
        return histogram_float(px, null)
    return histogram_direct(px, null, 0) if thematic else histogram_ints(px, null)


def apply_blocks(fn: Callable[[np.ndarray, dict], np.ndarray], px: DataFrame, grid: PixelGrid, controls: Controls | None = None, value: str = "double") -> DataFrame:
    """Block mode for one input: numpy arrays with their margins."""
    controls = controls or Controls()
    return block_apply(px, fn, grid.nrows, grid.ncols, controls.get("block_size"), controls.get("overlap"), controls.get("input_nodata") or 0, value)


def accumulate(table: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, merge: dict[str, str]) -> DataFrame:
    """Partial results of every task by ``fn``, merged by built-in aggregates: what a job without outputs is for."""

    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return table.mapInPandas(run, schema).agg(*[F.expr(f"{how}({c})").alias(c) for c, how in merge.items()])
