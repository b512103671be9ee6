"""Rasters in Parquet: pixels partitioned by band, metadata and statistics beside them; and raw binary tiles."""

from __future__ import annotations

import json
import warnings
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadOption, FileOpen
from ..grid import PixelGrid
from ..operators.stats import band_stats, non_finite
from ..operators.vector import edges_of, layer_info
from ..plans.apply import Controls, Result, derive

#: Columnar formats that pixels can be written in.
PIXEL_FORMATS = ("parquet", "orc")


def write_raster(px: DataFrame, grid: PixelGrid, path: str, nodata: float | None = None, layer_names: list[str] | None = None, thematic: bool = False, stats: bool = True, before_close=None, kind: str = "parquet", options: dict | None = None) -> None:
    """Pixels by band under ``pixels``, one metadata row under ``grid``, statistics under ``stats``.

    ``kind`` is the columnar format of the pixels, parquet or orc, and ``options`` go to its writer.
    """
    if kind not in PIXEL_FORMATS:
        raise BadOption(f"pixels are written as {PIXEL_FORMATS}, not {kind!r}")
    if "band" not in px.columns:
        px = px.withColumn("band", F.lit(1))
    spark = px.sparkSession
    px.write.mode("overwrite").options(**(options or {})).partitionBy("band").format(kind).save(f"{path}/pixels")
    f = lambda x: None if x is None else float(x)
    meta = [(grid.crs, f(grid.xmin), f(grid.ymax), f(grid.xres), f(grid.yres), grid.nrows, grid.ncols, f(nodata), thematic, json.dumps(layer_names or []), kind)]
    spark.createDataFrame(meta, "crs string, xmin double, ymax double, xres double, yres double, nrows int, ncols int, nodata double, thematic boolean, layer_names string, format string").coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")
    if stats:
        band_stats(spark.read.format(kind).load(f"{path}/pixels"), nodata, ("band",)).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    if before_close:
        before_close(path)


def read_raster(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> tuple[DataFrame, PixelGrid]:
    """Pixels and grid. Bands prune partitions; a window (top, left, rows, cols) is pushed to the scan."""
    try:
        m = spark.read.parquet(f"{path}/grid").first()
        px = spark.read.format(m.format if "format" in m else "parquet").load(f"{path}/pixels")
    except Exception as e:
        raise FileOpen(path) from e
    if bands is not None:
        px = px.where(F.col("band").isin(bands))
    if window is not None:
        top, left, rows, cols = window
        px = px.where(F.col("r").between(top, top + rows - 1) & F.col("c").between(left, left + cols - 1))
    return px, PixelGrid.of(m.xmin, m.ymax, m.ncols, m.nrows, m.xres, m.yres, m.crs)


def write_job(job: Result, path: str, controls: Controls) -> dict[str, str]:
    """Every output under ``path``/<name>: the function runs once, all else is made from the pixels as written.

    Beside pixels, grid and statistics: ``histogram``, ``pyramids/level=N`` and ``colours``. Fractions with NaN or infinities bring
    a warning.
    """
    paths = {}
    for done_so_far, (k, px) in enumerate(job.outputs.items()):
        if tell := controls.get("progress"):
            tell(100 * done_so_far // len(job.outputs), k)
        if name := controls.get("job_name"):
            px.sparkSession.sparkContext.setJobDescription(f"{name}: {k}")
        at = paths[k] = f"{path}/{k}"
        get = lambda option: controls.get(option, k)  # noqa: B023, E731
        write_raster(px, job.grid, at, get("nodata"), get("layer_names"), get("thematic"), get("basic_stats") and not get("approximate_stats"), kind=get("format"), options=get("writer_options"))
        back = px.sparkSession.read.schema(px.schema).format(get("format")).load(f"{at}/pixels")
        done = type(job)({k: back}, job.grid, {}, {}, {}, {})
        derive(done, k, back, controls)
        if get("basic_stats") and get("approximate_stats"):
            done.stats[k].coalesce(1).write.mode("overwrite").parquet(f"{at}/stats")
        for kind, frame in (("histogram", done.histograms.get(k)), ("colours", done.colours.get(k))):
            if frame is not None:
                frame.coalesce(1).write.mode("overwrite").parquet(f"{at}/{kind}")
        for level, frame in done.pyramids.get(k, {}).items():
            frame.write.mode("overwrite").parquet(f"{at}/pyramids/level={level}")
        if px.schema["v"].dataType.simpleString() in ("float", "double"):
            bad = non_finite(back).first()
            if bad.has_nan or bad.has_inf:
                warnings.warn(f"{k} holds NaN or infinite values", stacklevel=2)
        px.sparkSession.sparkContext.setJobDescription(None)
    if job.outputs and (tell := controls.get("progress")):
        tell(100, None)
    return paths


def read_part(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """Stored ``stats``, ``histogram``, ``colours`` or ``pyramids`` of a raster; None where there are none."""
    try:
        return spark.read.parquet(f"{path}/{kind}")
    except AnalysisException:
        return None


def describe(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One row per input: its kind and, of a raster, its grid; of a layer of rings, its extent."""
    parts = []
    for name, path in paths.items():
        head = [F.lit(name).alias("name")]
        try:
            m = spark.read.parquet(f"{path}/grid")
            parts.append(m.select(*head, F.lit("raster").alias("kind"), "crs", "nrows", "ncols", "xmin", (F.col("ymax") - F.col("nrows") * F.col("yres")).alias("ymin"), (F.col("xmin") + F.col("ncols") * F.col("xres")).alias("xmax"), "ymax"))
            continue
        except AnalysisException:
            pass
        try:
            layer = spark.read.parquet(path)
        except AnalysisException as e:
            raise FileOpen(path) from e
        if not {"fid", "ring"} <= set(layer.columns):
            raise FileOpen(f"{path} is neither raster nor layer")
        none = lambda kind, k: F.lit(None).cast(kind).alias(k)
        parts.append(layer_info(edges_of(layer)).select(*head, F.lit("vector").alias("kind"), none("string", "crs"), none("int", "nrows"), none("int", "ncols"), "xmin", "ymin", "xmax", "ymax"))
    if not parts:
        raise FileOpen("nothing to describe")
    return reduce(DataFrame.unionByName, parts)


def write_raw(px: DataFrame, grid: PixelGrid, path: str, dtype: str = "<f4", fill: float = 0, rows: int = 256) -> None:
    """Flat binary strips of ``rows`` rows, one a group of rows, as (band, top, nrows, data) in Parquet; joined in order they are a band-sequential file."""
    if "band" not in px.columns:
        px = px.withColumn("band", F.lit(1))
    nrows, ncols = grid.nrows, grid.ncols

    def strip(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top = int(key[1]) * rows
        a = np.full((min(rows, nrows - top), ncols), fill, dtype)
        a[pdf.r.to_numpy() - top, pdf.c.to_numpy()] = pdf.v.to_numpy()
        return pd.DataFrame({"band": [key[0]], "top": [top], "nrows": [len(a)], "data": [a.tobytes()]})

    inside = px.where(F.col("r").between(0, nrows - 1) & F.col("c").between(0, ncols - 1))
    inside.groupBy("band", F.floor(F.col("r") / rows).alias("k")).applyInPandas(strip, "band int, top long, nrows int, data binary").write.mode("overwrite").parquet(path)


def layer_number(meta: DataFrame, name: str) -> int:
    """1-based number of a layer, 0 if there is none of that name."""
    names = json.loads(meta.first().layer_names)
    return names.index(name) + 1 if name in names else 0


def read_raw(spark: SparkSession, path: str, nrows: int, ncols: int, dtype: str = "<f4", bands: int = 1, header: int = 0) -> DataFrame:
    """Band-sequential flat binary files as (band, r, c, v)."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def cells(batches):
        for b in batches:
            for raw in b.column(0):
                a = np.frombuffer(raw.as_buffer(), dtype, offset=header).reshape(bands, nrows, ncols)
                for k in range(bands):
                    for top in range(0, nrows, max(1, 100_000 // ncols)):
                        part = a[k, top : top + max(1, 100_000 // ncols)]
                        rr, cc = np.mgrid[top : top + len(part), 0:ncols]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(part.size, k + 1, np.int32)), pa.array(rr.ravel()), pa.array(cc.ravel()), pa.array(part.ravel().astype(float))], names=["band", "r", "c", "v"])

    return files.mapInArrow(cells, "band int, r long, c long, v double")


def write_tiles(px: DataFrame, path: str, size: int = 256) -> None:
    """One row per block of ``size`` squared cells: band, top, left, cells as a map from place to value."""
    t = px.withColumns({"top": F.floor(F.col("r") / size) * size, "left": F.floor(F.col("c") / size) * size})
    keys = [k for k in ("band",) if k in px.columns] + ["top", "left"]
    t.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("r", "c", "v"))).alias("cells")).write.mode("overwrite").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.parquet(path)
    return t.select(*[c for c in t.columns if c == "band"], F.inline("cells"))
