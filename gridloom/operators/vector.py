"""Polygons to pixels by scan lines, lines and points by steps: work grows with edges and burnt pixels, not with pixels times edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import PixelGrid


def edges_of(layer: DataFrame) -> DataFrame:
    """``layer``: fid, ring (array of struct x, y), further columns. One row per side (fid, part, x1, y1, x2, y2).

    A column ``shape`` says 'line' (the ring is not closed) or 'point' (each point is a side without length); it is kept.
    Without it, and with any other value, rows are polygons, and the last point is joined to the first.
    """
    n, shaped = F.size("ring"), "shape" in layer.columns
    last, step, least = n - 1, F.lit(1), F.lit(3)
    if shaped:
        line, point = F.col("shape") == "line", F.col("shape") == "point"
        last, step = F.when(line, n - 2).otherwise(n - 1), F.when(point, 0).otherwise(1)
        least = F.when(line, 2).when(point, 1).otherwise(3)
    side = F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.get("ring", k).alias("a"), F.get("ring", (k + step) % n).alias("b"))))
    kept = ["shape"] if shaped else []
    return layer.where(n >= least).select("fid", *kept, side.alias("part", "s")).select("fid", "part", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"), *kept)


def _pixel_edges(edges: DataFrame, grid: PixelGrid) -> DataFrame:
    """Sides in fractional pixel coordinates, the upper end first."""
    r1, c1 = grid.pixel_of(F.col("x1"), F.col("y1"))
    r2, c2 = grid.pixel_of(F.col("x2"), F.col("y2"))
    e = edges.select("fid", r1.alias("a"), c1.alias("ca"), r2.alias("b"), c2.alias("cb"))
    flip = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    return e.select("fid", pick("a", "b").alias("r1"), pick("ca", "cb").alias("c1"), pick("b", "a").alias("r2"), pick("cb", "ca").alias("c2"))


def centre_cells(edges: DataFrame, grid: PixelGrid) -> DataFrame:
    """(fid, r, c) of pixels whose centre is inside by the even-odd rule; a centre on a left or upper side is inside."""
    e = _pixel_edges(edges, grid)
    low, high = F.greatest(F.ceil(F.col("r1") - 0.5), F.lit(0)), F.least(F.ceil(F.col("r2") - 0.5) - 1, F.lit(grid.nrows - 1))
    rows = e.where(low <= high).withColumn("r", F.explode(F.sequence(low, high)))
    cross = F.col("c1") + (F.col("r") + 0.5 - F.col("r1")) / (F.col("r2") - F.col("r1")) * (F.col("c2") - F.col("c1"))
    lines = rows.groupBy("fid", "r").agg(F.sort_array(F.collect_list(cross)).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda k: F.struct(F.get("xs", k).alias("a"), F.get("xs", k + 1).alias("b")))
    spans = lines.where(F.size("xs") >= 2).withColumn("s", F.explode(pairs))
    first, last = F.greatest(F.ceil(F.col("s.a") - 0.5), F.lit(0)), F.least(F.ceil(F.col("s.b") - 0.5) - 1, F.lit(grid.ncols - 1))
    return spans.select("fid", "r", first.alias("f"), last.alias("l")).where("f <= l").select("fid", "r", F.explode(F.sequence("f", "l")).alias("c"))


def crossed_cells(edges: DataFrame, grid: PixelGrid) -> DataFrame:
    """(fid, r, c) of pixels that a side crosses; more than once where several do."""
    e = _pixel_edges(edges, grid)
    low, high = F.greatest(F.floor("r1"), F.lit(0)), F.least(F.floor("r2"), F.lit(grid.nrows - 1))
    rows = e.where(low <= high).withColumn("r", F.explode(F.sequence(low, high)))
    level = F.col("r1") == F.col("r2")
    at = lambda row: F.col("c1") + (row - F.col("r1")) / (F.col("r2") - F.col("r1")) * (F.col("c2") - F.col("c1"))
    x, y = F.when(level, F.col("c1")).otherwise(at(F.greatest(F.col("r"), F.col("r1")))), F.when(level, F.col("c2")).otherwise(at(F.least(F.col("r") + 1, F.col("r2"))))
    first, last = F.greatest(F.floor(F.least(x, y)), F.lit(0)), F.least(F.floor(F.greatest(x, y)), F.lit(grid.ncols - 1))
    return rows.select("fid", "r", first.alias("f"), last.alias("l")).where("f <= l").select("fid", "r", F.explode(F.sequence("f", "l")).alias("c"))


def touched_cells(edges: DataFrame, grid: PixelGrid) -> DataFrame:
    """(fid, r, c) of pixels with their centre inside or crossed by a side."""
    return crossed_cells(edges, grid).unionByName(centre_cells(edges, grid)).distinct()


def stepped_cells(lines: DataFrame, grid: PixelGrid) -> DataFrame:
    """(fid, r, c) of the thin path between the end pixels of each side: one pixel a step of the longer way, a tie stays back.

    Steps outside the grid are never made.
    """
    (r1, c1), (r2, c2) = grid.pixel_of(F.col("x1"), F.col("y1")), grid.pixel_of(F.col("x2"), F.col("y2"))
    e = lines.select("fid", F.floor(r1).alias("r1"), F.floor(c1).alias("c1"), (F.floor(r2) - F.floor(r1)).alias("dr"), (F.floor(c2) - F.floor(c1)).alias("dc"))
    steep, size = F.abs("dr") > F.abs("dc"), F.when(F.abs("dr") > F.abs("dc"), grid.nrows).otherwise(grid.ncols)
    start, way = F.when(steep, F.col("r1")).otherwise(F.col("c1")), F.when(steep, F.col("dr")).otherwise(F.col("dc"))
    e = e.withColumns({"steep": steep, "long": F.abs(way), "short": F.least(F.abs("dr"), F.abs("dc")), "low": F.greatest(F.lit(0), F.when(way >= 0, -start).otherwise(start - size + 1)), "high": F.least(F.abs(way), F.when(way >= 0, size - 1 - start).otherwise(start))})
    e = e.where("low <= high").withColumn("k", F.explode(F.sequence("low", "high")))
    aside = F.greatest(F.lit(0), F.ceil((2 * F.col("short") * F.col("k") - F.col("long")) / (2 * F.greatest("long", F.lit(1)))))
    r = F.col("r1") + F.signum("dr").cast("long") * F.when(F.col("steep"), F.col("k")).otherwise(aside)
    c = F.col("c1") + F.signum("dc").cast("long") * F.when(F.col("steep"), aside).otherwise(F.col("k"))
    return e.select("fid", r.alias("r"), c.alias("c")).where(F.col("r").between(0, grid.nrows - 1) & F.col("c").between(0, grid.ncols - 1))


def feature_cells(edges: DataFrame, grid: PixelGrid, all_touched: bool = False) -> DataFrame:
    """(fid, r, c) of the pixels that polygons, lines and points burn, each once a feature."""
    fill = touched_cells if all_touched else centre_cells
    if "shape" not in edges.columns:
        return fill(edges, grid)
    of = lambda shape: edges.where(F.col("shape") == shape)
    areas = fill(edges.where("shape IS NULL OR shape NOT IN ('line', 'point')"), grid)
    paths = (crossed_cells if all_touched else stepped_cells)(of("line"), grid)
    return areas.unionByName(paths).unionByName(crossed_cells(of("point"), grid)).distinct()


def rasterize(edges: DataFrame, grid: PixelGrid, burn: float | Column = 1, null: float = 0, all_touched: bool = False, attributes: DataFrame | None = None, attribute: str | None = None, where: str | None = None, kind: str = "smallint") -> DataFrame:
    """(r, c, v) for every pixel of the grid: the burn value, or an attribute of the feature with the greatest fid there."""
    if where is not None and attributes is not None:
        edges = edges.join(attributes.where(where).select("fid"), "fid", "left_semi")
    cells = feature_cells(edges, grid, all_touched)
    if attribute is not None:
        cells = cells.join(attributes.select("fid", F.col(attribute).alias("b")), "fid")
        burnt = cells.groupBy("r", "c").agg(F.max_by("b", "fid").alias("b"))
    else:
        burnt = cells.select("r", "c").distinct().withColumn("b", F.lit(burn))
    return grid.cells(edges.sparkSession).join(burnt, ["r", "c"], "left").select("r", "c", F.coalesce("b", F.lit(null)).cast(kind).alias("v"))


def layer_info(features: DataFrame) -> DataFrame:
    """Feature count and extent of an edge table."""
    return features.agg(F.count_distinct("fid").alias("features"), F.min(F.least("x1", "x2")).alias("xmin"), F.max(F.greatest("x1", "x2")).alias("xmax"), F.min(F.least("y1", "y2")).alias("ymin"), F.max(F.greatest("y1", "y2")).alias("ymax"))
