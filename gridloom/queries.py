"""Every operator on the driver's tables, with the same result in DuckDB SQL.

Virtual rasters: EV (events, 100 columns, v = floor(value)), EMB (embeddings, one column per element), LP (part keys
of line items, thematic), LE (floor of extended prices, wide range).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crs
from .functions import colour, timing
from .grid import UNION, PixelGrid, grids_frame, snap_column, without_surrounding
from .operators import align, focal, rat, stats, vector
from .plans.apply import Controls, apply
from .plans.blocks import all_totals, apply_all

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EV = "ev AS (SELECT event_id // 100 AS r, event_id % 100 AS c, floor(value)::BIGINT AS v FROM events)"
DIM = "dim AS (SELECT max(r) + 1 AS h, 100 AS w FROM ev)"


def query(name: str, sql: str) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name], SQL[name] = fn, sql
        return fn

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ev(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select(F.floor(F.col("event_id") / 100).alias("r"), (F.col("event_id") % 100).alias("c"), F.floor("value").cast("long").alias("v"))


def ev_grid(spark: SparkSession, d: str, xmin: float = 0.0, ymax: float = 0.0, res: float = 1.0) -> PixelGrid:
    top = _t(spark, d, "events").agg(F.max("event_id")).first()[0]
    return PixelGrid.of(xmin, ymax, 100, 0 if top is None else top // 100 + 1, res)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


def ev_mirror(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).withColumn("c", 99 - F.col("c"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    g = ev_grid(spark, d)
    job = apply(lambda x, _: {"mean": F.floor((x["a"] + x["b"]) / 2).bitwiseAND(255)}, {"a": (ev(spark, d), g), "b": (ev_mirror(spark, d), g)}, Controls().set("nodata", 0))
    return stats.block_stats(job.outputs["mean"], 32)


# statistics


@query("band_stats_null", f"WITH {EV} SELECT count(*) AS n, min(v) AS vmin, max(v) AS vmax, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stddev FROM ev WHERE v <> 5")
def _(spark, d):
    return rounded(stats.band_stats(ev(spark, d), 5), "mean", "stddev")


@query("histogram_direct", f"WITH {EV}, b AS (SELECT unnest(generate_series(min(v), max(v))) AS bin FROM ev) SELECT b.bin, count(ev.v) AS n FROM b LEFT JOIN ev ON ev.v = b.bin GROUP BY 1")
def _(spark, d):
    return stats.histogram_direct(ev(spark, d))


@query(
    "histogram_linear_256",
    """WITH le AS (SELECT floor(l_extendedprice)::BIGINT AS v FROM lineitem), e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 256.0::DOUBLE AS step FROM le),
    x AS (SELECT greatest(0, least(ceil((v - lo + 1) / step) - 1, 255))::BIGINT AS bin FROM le, e), b AS (SELECT unnest(generate_series(0, 255)) AS bin)
    SELECT b.bin, count(x.bin) AS n FROM b LEFT JOIN x ON x.bin = b.bin GROUP BY 1""",
)
def _(spark, d):
    return stats.histogram_linear(_t(spark, d, "lineitem").select(F.floor("l_extendedprice").alias("v")))


@query(
    "median_mode",
    f"""WITH {EV}, h AS (SELECT v, count(*) AS n FROM ev GROUP BY 1), k AS (SELECT v, n, sum(n) OVER (ORDER BY v) AS cum, sum(n) OVER () AS total, max(n) OVER () AS top FROM h)
    SELECT min(CASE WHEN cum >= total / 2.0 THEN v END)::DOUBLE AS median, min(CASE WHEN n = top THEN v END)::DOUBLE AS mode FROM k""",
)
def _(spark, d):
    return rounded(stats.median_and_mode(stats.histogram_direct(ev(spark, d))), "median", "mode")


@query("hist_metadata_string", f"WITH {EV}, b AS (SELECT unnest(generate_series(min(v), max(v))) AS bin FROM ev), h AS (SELECT b.bin, count(ev.v) AS n FROM b LEFT JOIN ev ON ev.v = b.bin GROUP BY 1) SELECT string_agg(n::VARCHAR, '|' ORDER BY bin) || '|' AS counts FROM h")
def _(spark, d):
    return stats.histogram_string(stats.histogram_direct(ev(spark, d)))


@query("histogram_float", "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(floor((value - lo) / ((hi - lo) / 256)), 255)::BIGINT AS bin, count(*) AS n FROM events, e GROUP BY 1")
def _(spark, d):
    return stats.histogram_float(_t(spark, d, "events").select(F.col("value").alias("v")))


@query("block_stats", f"WITH {EV} SELECT r // 32 AS br, c // 32 AS bc, count(*) AS n, sum(v)::BIGINT AS total, min(v) AS vmin, max(v) AS vmax FROM ev GROUP BY 1, 2")
def _(spark, d):
    return stats.block_stats(ev(spark, d), 32)


@query("nan_flag", "SELECT coalesce(bool_or(isnan(value)), false) AS has_nan, coalesce(bool_or(isinf(value)), false) AS has_inf FROM events")
def _(spark, d):
    return stats.non_finite(_t(spark, d, "events"), "value")


@query("multiband_stats", "WITH x AS (SELECT generate_subscripts(embedding, 1) AS band, unnest(embedding) AS v FROM embeddings) SELECT band::INT AS band, count(*) AS n, min(v)::DOUBLE AS vmin, max(v)::DOUBLE AS vmax FROM x GROUP BY 1")
def _(spark, d):
    px = _t(spark, d, "embeddings").select(F.posexplode("embedding").alias("p", "v")).select((F.col("p") + 1).alias("band"), F.col("v").cast("double").alias("v"))
    return stats.band_stats(px, by=("band",)).select("band", "n", "vmin", "vmax")


@query("distinct_classes", "SELECT DISTINCT l_partkey AS v FROM lineitem")
def _(spark, d):
    return stats.classes(_t(spark, d, "lineitem").select(F.col("l_partkey").alias("v")))


@query("pyramid_nearest_l4", f"WITH {EV} SELECT (r - 2) // 4 AS r, (c - 2) // 4 AS c, v FROM ev WHERE r >= 2 AND c >= 2 AND (r - 2) % 4 = 0 AND (c - 2) % 4 = 0")
def _(spark, d):
    return stats.pyramid_nearest(ev(spark, d), 4)


@query("pyramid_avg_l8", f"WITH {EV} SELECT r // 8 AS r, c // 8 AS c, round(avg(v), 6) AS v FROM ev WHERE v <> 5 GROUP BY 1, 2")
def _(spark, d):
    return rounded(stats.pyramid_average(ev(spark, d), 8, 5), "v")


@query("pyramid_levels", f"WITH {EV}, {DIM}, l AS (SELECT unnest([4, 8, 16, 32, 64, 128, 256, 512]) AS level) SELECT level::BIGINT AS level FROM l, dim WHERE least(h, w) * 16 // level > 128")
def _(spark, d):
    g = ev_grid(spark, d)
    return spark.createDataFrame([(x,) for x in stats.pyramid_levels(g.nrows * 16, g.ncols * 16)], "level long")


# local, list and zonal operations


@query("two_raster_mean_u8", f"WITH {EV} SELECT a.r, a.c, floor((a.v + b.v) / 2.0)::BIGINT & 255 AS v FROM ev a JOIN ev b ON a.r = b.r AND a.c = 99 - b.c")
def _(spark, d):
    g = ev_grid(spark, d)
    return apply(lambda x, _: {"v": F.floor((x["a"] + x["b"]) / 2).bitwiseAND(255)}, {"a": (ev(spark, d), g), "b": (ev_mirror(spark, d), g)}).outputs["v"]


@query("median_composite", f"WITH {EV} SELECT 0::BIGINT AS r, c, quantile_cont(v, 0.5)::DOUBLE AS v FROM ev WHERE v <> 0 GROUP BY c")
def _(spark, d):
    return align.cellwise(ev(spark, d).withColumn("r", F.lit(0).cast("long")), 0, v=F.percentile("v", F.lit(0.5)))


@query("block_udf_double", f"WITH {EV} SELECT r, c, (2 * v)::DOUBLE AS v FROM ev")
def _(spark, d):
    g = ev_grid(spark, d)
    return focal.block_apply(ev(spark, d), lambda a, info: a * 2.0, g.nrows, g.ncols, 64)


MASK = "m AS (SELECT DISTINCT p_partkey // 100 AS r, p_partkey % 100 AS c FROM part WHERE p_size > 25)"


def _mask(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").where("p_size > 25").select(F.floor(F.col("p_partkey") / 100).alias("r"), (F.col("p_partkey") % 100).alias("c"))


@query("mask_semi", f"WITH {EV}, {MASK} SELECT * FROM ev SEMI JOIN m USING (r, c)")
def _(spark, d):
    return stats.masked(ev(spark, d), _mask(spark, d))


@query("mask_anti", f"WITH {EV}, {MASK} SELECT * FROM ev ANTI JOIN m USING (r, c)")
def _(spark, d):
    return stats.masked(ev(spark, d), _mask(spark, d), inside=False)


@query("zonal_stats", "SELECT p_size AS zone, count(*) AS n, min(l_quantity) AS vmin, max(l_quantity) AS vmax, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS stddev FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("row_id"), F.col("l_quantity").alias("v"))
    zoned = li.join(_t(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").alias("zone")), "row_id")
    return rounded(stats.band_stats(zoned, by=("zone",)), "mean", "stddev")


@query("global_accumulate", f"WITH {EV} SELECT sum(v)::BIGINT AS total, count(*) AS n FROM ev WHERE v > 100")
def _(spark, d):
    return ev(spark, d).where("v > 100").agg(F.sum("v").alias("total"), F.count("v").alias("n"))


# focal


@query("focal_max_5x5", f"WITH {EV} SELECT a.r, a.c, max(b.v) AS v FROM ev a JOIN ev b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY 1, 2")
def _(spark, d):
    return focal.focal_separable(ev(spark, d), 2, F.max)


@query("focal_mean_3x3", f"WITH {EV} SELECT a.r, a.c, round(avg(b.v), 6) AS v FROM ev a JOIN ev b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY 1, 2")
def _(spark, d):
    return rounded(focal.focal_mean(ev(spark, d), 1), "v")


@query("focal_sum_null", f"WITH {EV} SELECT a.r, a.c, coalesce(sum(b.v), 0)::DOUBLE AS v FROM ev a LEFT JOIN ev b ON b.v <> 5 AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY 1, 2")
def _(spark, d):
    return focal.focal_scatter(ev(spark, d), {(i, j): 1.0 for i in (-1, 0, 1) for j in (-1, 0, 1)}, 5)


@query("focal_block_halo", f"WITH {EV} SELECT a.r, a.c, max(b.v)::DOUBLE AS v FROM ev a JOIN ev b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY 1, 2")
def _(spark, d):
    import numpy as np

    def most(a, info):
        out = a.copy()
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                out = np.maximum(out, np.roll(np.roll(a, i, 0), j, 1))
        return out

    g = ev_grid(spark, d)
    return focal.block_apply(ev(spark, d), most, g.nrows, g.ncols, 64, 1)


# alignment and resampling


@query("union_fill", f"WITH {EV}, {DIM}, cells AS (SELECT r, c FROM (SELECT unnest(generate_series(0, h + 9)) AS r FROM dim), (SELECT unnest(generate_series(0, 109)) AS c)) SELECT cells.r, cells.c, coalesce(a.v, 0) AS a, coalesce(b.v, 7) AS b FROM cells LEFT JOIN ev a ON a.r = cells.r AND a.c = cells.c LEFT JOIN ev b ON b.r = cells.r - 10 AND b.c = cells.c - 10")
def _(spark, d):
    a, b = ev_grid(spark, d), ev_grid(spark, d, 10.0, -10.0)
    return align.combine({"a": (ev(spark, d), a), "b": (ev(spark, d), b)}, UNION, fill={"a": 0, "b": 7})[0]


@query("intersection_pairs", f"WITH {EV} SELECT a.r - 3 AS r, a.c - 5 AS c, a.v AS a, b.v AS b FROM ev a JOIN ev b ON b.r = a.r - 3 AND b.c = a.c - 5")
def _(spark, d):
    a, b = ev_grid(spark, d), ev_grid(spark, d, 5.0, -3.0)
    return align.combine({"a": (ev(spark, d), a), "b": (ev(spark, d), b)})[0]


@query("bounds_fill", f"WITH {EV}, cells AS (SELECT r, c FROM (SELECT unnest(generate_series(0, 19)) AS r), (SELECT unnest(generate_series(0, 19)) AS c)) SELECT cells.r, cells.c, coalesce(ev.v, 9) AS v FROM cells LEFT JOIN ev ON ev.r = cells.r - 5 AND ev.c = cells.c - 5")
def _(spark, d):
    return align.bounds_fill(ev(spark, d), ev_grid(spark, d, 5.0, -5.0), PixelGrid.of(0.0, 0.0, 20, 20, 1.0), 9)


@query("band_select", "WITH x AS (SELECT vec_id AS r, generate_subscripts(embedding, 1) AS b, unnest(embedding) AS v FROM embeddings) SELECT r, CASE b WHEN 4 THEN 1 ELSE 2 END AS band, v::DOUBLE AS v FROM x WHERE b IN (4, 2)")
def _(spark, d):
    px = _t(spark, d, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("p", "v"))
    px = px.select((F.col("p") + 1).alias("band"), "r", F.col("v").cast("double").alias("v"))
    return align.select_bands(px, [4, 2])


@query("band_stack", f"WITH {EV} SELECT 1 AS band, r, c, v FROM ev UNION ALL SELECT 2, r, 99 - c, v FROM ev")
def _(spark, d):
    return align.stack_bands([ev(spark, d), ev_mirror(spark, d)])


def _target(spark: SparkSession, d: str, f: float) -> PixelGrid:
    g = ev_grid(spark, d)
    return PixelGrid.of(0.0, 0.0, int(g.ncols // f), int(g.nrows // f), f)


def _dest(f: float) -> str:
    return f"dst AS (SELECT r, c, (r + 0.5::DOUBLE) * {f} AS y, (c + 0.5::DOUBLE) * {f} AS x FROM (SELECT unnest(generate_series(0, floor(h / {f})::BIGINT - 1)) AS r FROM dim), (SELECT unnest(generate_series(0, floor(100 / {f})::BIGINT - 1)) AS c))"


@query("resample_near", f"WITH {EV}, {DIM}, {_dest(2.5)} SELECT dst.r, dst.c, v FROM dst JOIN ev ON ev.r = floor(y)::BIGINT AND ev.c = floor(x)::BIGINT")
def _(spark, d):
    return align.resample(ev(spark, d), ev_grid(spark, d), _target(spark, d, 2.5))


def _kernel_sql(reach: int, w: Callable[[str], str], f: float) -> str:
    return f"""WITH {EV}, {DIM}, {_dest(f)}, o AS (SELECT unnest(generate_series({1 - reach}, {reach})) AS k),
    n AS (SELECT dst.r, dst.c, y - 0.5 AS fr, x - 0.5 AS fc, floor(y - 0.5)::BIGINT + a.k AS sr, floor(x - 0.5)::BIGINT + b.k AS sc FROM dst, o a, o b),
    k AS (SELECT n.r, n.c, {w("fr - sr")} * {w("fc - sc")} AS w, v FROM n JOIN ev ON ev.r = sr AND ev.c = sc WHERE v <> 5)
    SELECT r, c, round(sum(w * v) / sum(w), 6) AS v FROM k GROUP BY 1, 2 HAVING abs(sum(w)) > 1e-12"""


@query("resample_bilinear", _kernel_sql(1, lambda t: f"greatest(0, 1 - abs({t}))", 1.5))
def _(spark, d):
    return rounded(align.resample(ev(spark, d), ev_grid(spark, d), _target(spark, d, 1.5), "bilinear", 5), "v")


def _cubic_sql(t: str) -> str:
    a = f"abs({t})"
    return f"(CASE WHEN {a} <= 1 THEN 1.5::DOUBLE * {a} * {a} * {a} - 2.5::DOUBLE * {a} * {a} + 1 WHEN {a} < 2 THEN -0.5::DOUBLE * {a} * {a} * {a} + 2.5::DOUBLE * {a} * {a} - 4 * {a} + 2 ELSE 0 END)"


@query("resample_cubic", _kernel_sql(2, _cubic_sql, 1.5))
def _(spark, d):
    return rounded(align.resample(ev(spark, d), ev_grid(spark, d), _target(spark, d, 1.5), "cubic", 5), "v")


# grids


@query("block_list", f"WITH {EV}, {DIM} SELECT t AS top, l AS left, least(32, h - t)::INT AS nrows, least(32, 100 - l)::INT AS ncols FROM (SELECT unnest(generate_series(0, h - 1, 32)) AS t, h FROM dim), (SELECT unnest(generate_series(0, 99, 32)) AS l)")
def _(spark, d):
    return ev_grid(spark, d).blocks(spark, 32).select("top", "left", "nrows", "ncols")


@query("block_coords", f"WITH {EV} SELECT r, c, 1000 + (c + 0.5::DOUBLE) * 10 AS x, 5000 - (r + 0.5::DOUBLE) * 10 AS y FROM ev")
def _(spark, d):
    x, y = ev_grid(spark, d, 1000.0, 5000.0, 10.0).world_of(F.col("r") + 0.5, F.col("c") + 0.5)
    return ev(spark, d).select("r", "c", x.alias("x"), y.alias("y"))


@query("wld2pix", "SELECT event_id, floor((500 - value) / 2.5::DOUBLE)::BIGINT AS r, floor((user_id + 10) / 2.5::DOUBLE)::BIGINT AS c FROM events")
def _(spark, d):
    r, c = PixelGrid.of(-10.0, 500.0, 100, 100, 2.5).pixel_of(F.col("user_id"), F.col("value"))
    return _t(spark, d, "events").select("event_id", F.floor(r).alias("r"), F.floor(c).alias("c"))


@query("snap_grid", "SELECT event_id, round(1.5 + round((value - 1.5) / 7) * 7, 6) AS v FROM events")
def _(spark, d):
    return _t(spark, d, "events").select("event_id", F.round(snap_column(F.col("value"), 1.5, 7.0), 6).alias("v"))


def _two(spark: SparkSession, d: str) -> tuple[PixelGrid, PixelGrid]:
    return ev_grid(spark, d, 0.0, 0.0, 10.0), ev_grid(spark, d, 150.0, -40.0, 10.0)


@query("grid_intersection", f"WITH {EV}, {DIM} SELECT 'x' AS img, 150.0::DOUBLE AS xmin, -40.0::DOUBLE AS ymax, (h - 4)::INT AS nrows, 85 AS ncols FROM dim")
def _(spark, d):
    a, b = _two(spark, d)
    return grids_frame(spark, {"x": a.intersection(b)}).select("img", "xmin", "ymax", "nrows", "ncols")


@query("grid_union", f"WITH {EV}, {DIM} SELECT 'x' AS img, 0.0::DOUBLE AS xmin, 0.0::DOUBLE AS ymax, (h + 4)::INT AS nrows, 115 AS ncols FROM dim")
def _(spark, d):
    a, b = _two(spark, d)
    return grids_frame(spark, {"x": a.union(b)}).select("img", "xmin", "ymax", "nrows", "ncols")


@query("aligned_with", "SELECT * FROM (VALUES (0.0::DOUBLE, true), (30.0::DOUBLE, true), (4.0::DOUBLE, false)) t(shift, aligned)")
def _(spark, d):
    g = ev_grid(spark, d, 0.0, 0.0, 10.0)
    return spark.createDataFrame([(s, g.aligned_with(ev_grid(spark, d, s, 0.0, 10.0))) for s in (0.0, 30.0, 4.0)], "shift double, aligned boolean")


# vectors

POLYGON = [(12.2, 3.3), (70.7, 1.4), (88.1, 8.2), (40.9, 9.7), (55.3, 5.1)]
SIDES = ", ".join(f"({x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[1:] + POLYGON[:1]))
INSIDE = f"""sides(x1, y1, x2, y2) AS (VALUES {SIDES}), hit AS (SELECT r, c FROM ev JOIN sides ON (y1 <= r + 0.5) <> (y2 <= r + 0.5)
    AND x1 + (r + 0.5 - y1) / (y2 - y1) * (x2 - x1) <= c + 0.5 GROUP BY r, c HAVING count(*) % 2 = 1)"""


def _polygons(spark: SparkSession) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(-y).alias("y")) for x, y in POLYGON])
    other = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(-y).alias("y")) for x, y in ((30.0, 2.0), (50.0, 2.0), (50.0, 8.0), (30.0, 8.0))])
    return spark.range(2).select(F.col("id").alias("fid"), F.when(F.col("id") == 0, ring).otherwise(other).alias("ring"), (F.col("id") + 7).alias("code"))


@query("rasterize_polygon", f"WITH {EV}, {INSIDE} SELECT ev.r, ev.c, CASE WHEN hit.r IS NULL THEN 0 ELSE 1 END::SMALLINT AS v FROM ev LEFT JOIN hit USING (r, c)")
def _(spark, d):
    return vector.rasterize(vector.edges_of(_polygons(spark).where("fid = 0")), ev_grid(spark, d))


@query("burn_attribute", f"WITH {EV}, {INSIDE} SELECT ev.r, ev.c, CASE WHEN ev.r BETWEEN 2 AND 7 AND ev.c BETWEEN 30 AND 49 THEN 8 WHEN hit.r IS NULL THEN 0 ELSE 7 END::SMALLINT AS v FROM ev LEFT JOIN hit USING (r, c)")
def _(spark, d):
    p = _polygons(spark)
    return vector.rasterize(vector.edges_of(p), ev_grid(spark, d), attributes=p, attribute="code", where="code > 0")


@query("rasterize_all_touched", f"WITH {EV} SELECT r, c, CASE WHEN r BETWEEN 2 AND 7 AND c BETWEEN 30 AND 50 THEN 1 ELSE 0 END::SMALLINT AS v FROM ev")
def _(spark, d):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(-y).alias("y")) for x, y in ((30.6, 2.6), (50.4, 2.6), (50.4, 7.4), (30.6, 7.4))])
    return vector.rasterize(vector.edges_of(spark.range(1).select(F.col("id").alias("fid"), ring.alias("ring"))), ev_grid(spark, d), all_touched=True)


@query("layer_info", "SELECT 2::BIGINT AS features, 12.2::DOUBLE AS xmin, 88.1::DOUBLE AS xmax, -9.7::DOUBLE AS ymin, -1.4::DOUBLE AS ymax")
def _(spark, d):
    return vector.layer_info(vector.edges_of(_polygons(spark)))


# attribute tables


def _part(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("row_id"), "p_name", "p_size", "p_retailprice")


@query("rat_apply_square", "SELECT p_partkey AS row_id, (p_size * p_size)::INT AS squared FROM part")
def _(spark, d):
    return rat.apply_columns(_part(spark, d), squared=F.col("p_size") * F.col("p_size")).select("row_id", "squared")


@query("rat_apply_block", "SELECT p_partkey AS row_id, p_size::BIGINT + 10 AS plus10 FROM part")
def _(spark, d):
    return rat.apply_blocks(_part(spark, d), lambda state, rows: {"row_id": rows.row_id, "plus10": rows.p_size + 10}, "row_id long, plus10 long")


@query("rat_reduce_even", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_id, p_size FROM part WHERE p_size % 2 = 0")
def _(spark, d):
    return rat.reduced(_part(spark, d), F.col("p_size") % 2 == 0).select("row_id", "p_size")


@query("rat_new_256", "SELECT unnest(generate_series(0, 255)) AS row_id, unnest(generate_series(0, 255)) AS newcol")
def _(spark, d):
    return rat.new_rat(spark, 256, newcol=F.col("row_id"))


@query("rat_copy_omit", "SELECT p_partkey AS row_id, p_name, p_retailprice FROM part")
def _(spark, d):
    return rat.copied(_part(spark, d), ("p_size",))


@query("rat_multi_join", "SELECT s_suppkey AS row_id, s_acctbal AS s_bal, c_acctbal AS c_bal FROM supplier JOIN customer ON s_suppkey = c_custkey")
def _(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_acctbal").alias("bal"))
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("bal"))
    return rat.joined({"s": s, "c": c.join(s.select("row_id"), "row_id", "left_semi")})


@query("rat_write_byte256", "WITH b AS (SELECT unnest(generate_series(0, 255)) AS row_id) SELECT row_id, s_acctbal AS bal FROM b LEFT JOIN supplier ON s_suppkey = row_id")
def _(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_acctbal").alias("bal"))
    return rat.write_column(s.select("row_id"), "bal", s, byte_band=True)


@query(
    "rat_stats_weighted",
    """WITH w AS (SELECT l_partkey AS k, count(*) AS w FROM lineitem GROUP BY 1), x AS (SELECT p_size::DOUBLE AS x, w FROM part JOIN w ON k = p_partkey WHERE p_partkey <> 0)
    SELECT 'p_size' AS "column", sum(w)::BIGINT AS n, round(sum(x * w), 6) AS total, round(sum(x * w) / sum(w), 6) AS mean, round(sqrt(sum(x * x * w) / sum(w) - (sum(x * w) / sum(w)) ** 2), 6) AS stddev, min(x) AS vmin, max(x) AS vmax FROM x""",
)
def _(spark, d):
    hist = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("row_id")).agg(F.count(F.lit(1)).alias("hist"))
    table = _part(spark, d).join(hist, "row_id", "left")
    return rounded(rat.weighted_stats(table, ["p_size"], "hist", 0), "total", "mean", "stddev")


# colours and timing


@query("color_gray", "SELECT i AS value, floor(round(i * 255 / 999.0::DOUBLE, 9))::INT AS red, floor(round(i * 255 / 999.0::DOUBLE, 9))::INT AS green, floor(round(i * 255 / 999.0::DOUBLE, 9))::INT AS blue, 255 AS alpha FROM (SELECT unnest(generate_series(0, 999)) AS i)")
def _(spark, d):
    return colour.ramp(spark, 1000)


@query(
    "ramp_interp",
    """WITH p AS (SELECT i, i * 2 / 999.0::DOUBLE AS x FROM (SELECT unnest(generate_series(0, 999)) AS i)), q AS (SELECT i, least(floor(x), 1)::INT AS k, x - least(floor(x), 1) AS f FROM p),
    pts(k, r, g, b) AS (VALUES (0, 10, 0, 255), (1, 200, 120, 30), (2, 90, 255, 0))
    SELECT i AS value, CASE WHEN i = 5 THEN 0 ELSE floor(round(a.r * (1 - f) + z.r * f, 9))::INT END AS red, CASE WHEN i = 5 THEN 0 ELSE floor(round(a.g * (1 - f) + z.g * f, 9))::INT END AS green,
    CASE WHEN i = 5 THEN 0 ELSE floor(round(a.b * (1 - f) + z.b * f, 9))::INT END AS blue, CASE WHEN i = 5 THEN 0 ELSE 255 END AS alpha FROM q JOIN pts a ON a.k = q.k JOIN pts z ON z.k = q.k + 1""",
)
def _(spark, d):
    return colour.ramp(spark, 1000, [(10, 0, 255), (200, 120, 30), (90, 255, 0)], ignore=5)


@query(
    "color_rainbow",
    """SELECT i AS value, CASE WHEN i < 500 THEN 0 ELSE floor((i - 500) * 255 / 499.0::DOUBLE)::INT END AS red, CASE WHEN i < 500 THEN floor(i * 255 / 499.0::DOUBLE)::INT ELSE 255 - floor((i - 500) * 255 / 499.0::DOUBLE)::INT END AS green,
    CASE WHEN i < 500 THEN 255 - floor(i * 255 / 499.0::DOUBLE)::INT ELSE 0 END AS blue, 255 AS alpha FROM (SELECT unnest(generate_series(0, 999)) AS i)""",
)
def _(spark, d):
    return colour.rainbow(spark, 1000)


@query("color_sparse_fill", "WITH b AS (SELECT unnest(generate_series(0, 255)) AS value), t AS (SELECT DISTINCT p_size AS value, p_size * 3 AS k FROM part) SELECT b.value, coalesce(k, 0)::INT AS red, coalesce(k + 1, 0)::INT AS green, coalesce(k + 2, 0)::INT AS blue, CASE WHEN k IS NULL THEN 0 ELSE 255 END AS alpha FROM b LEFT JOIN t USING (value)")
def _(spark, d):
    t = _t(spark, d, "part").select(F.col("p_size").alias("value"), (F.col("p_size") * 3).alias("red")).distinct()
    return colour.filled(spark, t.select("value", "red", (F.col("red") + 1).alias("green"), (F.col("red") + 2).alias("blue")), byte=True)


@query("timer_summary", "SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 6) AS least, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS most FROM events GROUP BY 1")
def _(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("name"), F.lit(0.0).alias("start"), F.col("value").alias("end"))
    return rounded(timing.summary(e), "least", "p25", "p50", "p75", "most").withColumn("total", F.round("total", 4))


# whole jobs


def _pair(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, PixelGrid]]:
    g = ev_grid(spark, d)
    return {"a": (ev(spark, d), g), "b": (ev_mirror(spark, d), g)}


@query("job_blocks_two_inputs", f"WITH {EV} SELECT 1 AS band, a.r, a.c, (a.v * 2 + b.v)::DOUBLE AS v FROM ev a JOIN ev b ON a.r = b.r AND a.c = 99 - b.c")
def _(spark, d):
    return apply_all(lambda info, x, p: {"o": x["a"] * p + x["b"]}, _pair(spark, d), ["o"], Controls().set("block_size", 64), 2).output("o")


@query("job_blocks_totals", f"WITH {EV} SELECT sum(v)::DOUBLE AS total, max(v)::DOUBLE AS most, count(*)::DOUBLE AS cells FROM ev")
def _(spark, d):
    totals = {"total": "sum", "most": "max", "cells": "sum"}
    fn = lambda info, x, p: {"total": x["a"].sum(), "most": x["a"].max(), "cells": x["a"].size}
    return all_totals(apply_all(fn, _pair(spark, d), [], Controls().set("block_size", 64), totals=totals), totals)


@query("job_blocks_coordinates", f"WITH {EV} SELECT 1 AS band, r, c, 1000 + (c + 0.5::DOUBLE) * 10 - (5000 - (r + 0.5::DOUBLE) * 10) AS v FROM ev")
def _(spark, d):
    g = ev_grid(spark, d, 1000.0, 5000.0, 10.0)
    c = Controls().set("footprint", "bounds_from_reference").set("reference", g).set("block_size", 64)

    def fn(info, x, p):
        px, py = info.coordinates()
        return {"o": px - py}

    return apply_all(fn, {}, ["o"], c, spark=spark).output("o")


@query("job_histogram_wide", "SELECT * FROM (" + SQL["histogram_linear_256"] + ")")
def _(spark, d):
    return stats.histogram_ints(_t(spark, d, "lineitem").select(F.floor("l_extendedprice").alias("v")))


@query("job_vector_mask_sum", f"WITH {EV}, {INSIDE} SELECT sum(v)::BIGINT AS total, count(*) AS n FROM ev JOIN hit USING (r, c)")
def _(spark, d):
    g = ev_grid(spark, d)
    job = apply(lambda x, _: {"o": F.when(x["p"] == 1, x["a"])}, {"a": (ev(spark, d), g), "p": (_polygons(spark).where("fid = 0"), None)}, Controls().set("nodata", None))
    return job.outputs["o"].agg(F.sum("v").alias("total"), F.count("v").alias("n"))


@query("job_auto_colours", "WITH m AS (SELECT max(l_partkey) AS m FROM lineitem) SELECT i AS value, floor(round(i * 255 / m::DOUBLE, 9))::INT AS red, floor(round(i * 255 / m::DOUBLE, 9))::INT AS green, floor(round(i * 255 / m::DOUBLE, 9))::INT AS blue, 255 AS alpha FROM (SELECT unnest(generate_series(0, m)) AS i, m FROM m)")
def _(spark, d):
    px = _t(spark, d, "lineitem").select((F.col("l_orderkey")).alias("r"), F.col("l_linenumber").cast("long").alias("c"), F.col("l_partkey").alias("v"))
    g = PixelGrid.of(0.0, 0.0, 10, 10_000_000, 1.0)
    c = Controls().set("thematic", True).set("auto_colours", "gray").set("nodata", None)
    return apply(lambda x, _: {"o": x["a"]}, {"a": (px, g)}, c).colours["o"]


@query("list_inputs_sum", f"WITH {EV}, s AS (SELECT r, c, v FROM ev UNION ALL SELECT r, 99 - c, v FROM ev UNION ALL SELECT r, c, 3 FROM ev) SELECT r, c, sum(v)::BIGINT AS total, count(v) AS n FROM s WHERE v <> 5 GROUP BY 1, 2")
def _(spark, d):
    images = [ev(spark, d), ev_mirror(spark, d), ev(spark, d).withColumn("v", F.lit(3).cast("long"))]
    return align.cellwise(align.stack_bands(images), 5, total=F.sum("v"), n=F.count("v"))


# more kernels, projections and grids


def _spline_sql(t: str) -> str:
    a = f"abs({t})"
    return f"(CASE WHEN {a} <= 1 THEN {a} * {a} * {a} / 2 - {a} * {a} + 2 / 3.0::DOUBLE WHEN {a} < 2 THEN (2 - {a}) * (2 - {a}) * (2 - {a}) / 6 ELSE 0 END)"


def _lanczos_sql(t: str) -> str:
    return f"(CASE WHEN abs({t}) < 1e-12 THEN 1 WHEN abs({t}) < 3 THEN 3 * sin(pi() * ({t})) * sin(pi() * ({t}) / 3) / (pi() * ({t}) * pi() * ({t})) ELSE 0 END)"


@query("resample_cubicspline", _kernel_sql(2, _spline_sql, 1.5))
def _(spark, d):
    return rounded(align.resample(ev(spark, d), ev_grid(spark, d), _target(spark, d, 1.5), "cubicspline", 5), "v")


@query("resample_lanczos", _kernel_sql(3, _lanczos_sql, 1.5))
def _(spark, d):
    return rounded(align.resample(ev(spark, d), ev_grid(spark, d), _target(spark, d, 1.5), "lanczos", 5), "v")


@query(
    "warp_web_mercator",
    f"""WITH {EV}, {DIM}, size AS (SELECT 60.0::DOUBLE / h AS res, 170000.0::DOUBLE * (60.0::DOUBLE / h) AS cell FROM dim),
    cells AS (SELECT r, unnest(generate_series(0, 64)) AS c, res, cell FROM (SELECT unnest(generate_series(0, floor(8300000 / cell)::BIGINT - 1)) AS r, res, cell FROM size)),
    dst AS (SELECT r, c, res, degrees((100 + (c + 0.5::DOUBLE) * cell) / 6378137) AS x, degrees(2 * atan(exp((-100 - (r + 0.5::DOUBLE) * cell) / 6378137)) - pi() / 2) AS y FROM cells)
    SELECT dst.r, dst.c, v FROM dst JOIN ev ON ev.r = floor(-y / res)::BIGINT AND ev.c = floor(x / res)::BIGINT""",
)
def _(spark, d):
    rows = ev_grid(spark, d).nrows  # 60 degrees of latitude, whatever the table's size; the target covers them
    cell = 170000.0 * (60.0 / rows)
    target = PixelGrid.of(100.0, -100.0, 65, int(8300000 // cell), cell, crs="EPSG:3857")
    return align.resample(ev(spark, d), PixelGrid.of(0.0, 0.0, 100, rows, 60.0 / rows, crs="EPSG:4326"), target)


@query("project_points", "SELECT event_id, round(radians(user_id % 360 - 180) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians(value % 80) / 2)) * 6378137, 3) AS y FROM events")
def _(spark, d):
    x, y = crs.transform("EPSG:4326", "EPSG:3857")(F.col("user_id") % 360 - 180, F.col("value") % 80)
    return _t(spark, d, "events").select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("grid_corners", f"WITH {EV}, {DIM} SELECT * FROM (SELECT 0 AS k, 150.0::DOUBLE AS x, -40.0::DOUBLE AS y UNION ALL SELECT 1, 1150, -40 UNION ALL SELECT 2, 1150, -40 - 10 * h FROM dim UNION ALL SELECT 3, 150, -40 - 10 * h FROM dim)")
def _(spark, d):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(_two(spark, d)[1].corners())], "k int, x double, y double")


@query("grid_surrounds", "SELECT * FROM (VALUES ('whole', true), ('moved', false), ('part', true)) t(img, inside)")
def _(spark, d):
    g = PixelGrid.of(0.0, 0.0, 10, 10, 1.0)
    others = {"whole": g, "moved": PixelGrid.of(1.0, 0.0, 10, 10, 1.0), "part": PixelGrid.of(2.0, -2.0, 3, 3, 1.0)}
    return spark.createDataFrame([(k, g.surrounds(o)) for k, o in others.items()], "img string, inside boolean")


@query("grids_without_surrounding", "SELECT * FROM (VALUES (0.0::DOUBLE, 10), (5.0::DOUBLE, 10)) t(xmin, ncols)")
def _(spark, d):
    grids = [PixelGrid.of(-5.0, 5.0, 50, 50, 1.0), PixelGrid.of(0.0, 0.0, 10, 10, 1.0), PixelGrid.of(5.0, 0.0, 10, 10, 1.0)]
    return spark.createDataFrame([(g.xmin, g.ncols) for g in without_surrounding(grids)], "xmin double, ncols int")


@query("block_progress", f"WITH {EV}, {DIM}, b AS (SELECT row_number() OVER (ORDER BY t, l) - 1 AS block, count(*) OVER () AS n FROM (SELECT unnest(generate_series(0, h - 1, 32)) AS t FROM dim), (SELECT unnest(generate_series(0, 99, 32)) AS l)) SELECT block, (100 * block // n)::INT AS percent, block = 0 AS is_first, block = n - 1 AS is_last FROM b")
def _(spark, d):
    return ev_grid(spark, d).blocks(spark, 32).select("block", "percent", "is_first", "is_last")


@query("pyramid_nearest_corner", f"WITH {EV} SELECT r // 4 AS r, c // 4 AS c, v FROM ev WHERE r % 4 = 0 AND c % 4 = 0")
def _(spark, d):
    return stats.pyramid_nearest(ev(spark, d), 4, centred=False)


@query("stats_by_band_null", "WITH x AS (SELECT generate_subscripts(embedding, 1) AS band, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT band::INT AS band, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stddev FROM x WHERE v >= 0 GROUP BY 1")
def _(spark, d):
    px = _t(spark, d, "embeddings").select(F.posexplode("embedding").alias("p", "v")).select((F.col("p") + 1).alias("band"), F.col("v").cast("double").alias("v"))
    null = F.when(F.col("v") >= 0, F.col("v")).otherwise(F.lit(-9.0))
    return rounded(stats.band_stats(px.withColumn("v", null), -9.0, ("band",)).select("band", "n", "mean", "stddev"), "mean", "stddev")


# more of attribute tables


@query("rat_block_state", "SELECT p_partkey AS row_id, (p_partkey // 700) * 700 AS start_row, p_partkey // 700 AS block FROM part")
def _(spark, d):
    fn = lambda state, rows: {"row_id": rows.row_id, "start_row": [state["start_row"]] * len(rows), "block": [state["block"]] * len(rows)}
    return rat.apply_blocks(_part(spark, d), fn, "row_id long, start_row long, block long", 700)


@query("rat_colour_usage", "SELECT p_partkey AS row_id, floor(p_size / 64.0::DOUBLE * 255)::INT AS red FROM part")
def _(spark, d):
    t = _part(spark, d).select("row_id", (F.col("p_size") / 64).alias("red"))
    return rat.read_column(rat.with_usage(t, "red", "red"), "red")


@query("rat_stats_unweighted", """SELECT c AS "column", count(*) AS n, round(avg(x), 6) AS mean, min(x) AS vmin, max(x) AS vmax FROM (SELECT 'p_size' AS c, p_size::DOUBLE AS x FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part) GROUP BY 1""")
def _(spark, d):
    return rounded(rat.weighted_stats(_part(spark, d), ["p_name", "p_size", "p_retailprice"]).select("column", "n", "mean", "vmin", "vmax"), "mean")
