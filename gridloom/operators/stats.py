"""Band statistics and histograms: one aggregation per measure set, no pass per statistic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def valid(nodata: float | None, v: str = "v") -> Column:
    if nodata is None:
        return F.col(v)
    return F.when(~F.isnan(F.col(v)), F.col(v)) if nodata != nodata else F.when(F.col(v) != nodata, F.col(v))


def band_stats(px: DataFrame, nodata: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """n, vmin, vmax, mean and population stddev over valid cells; null where there are none."""
    v = valid(nodata)
    return px.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("vmin"), F.max(v).alias("vmax"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"))


def histogram_direct(px: DataFrame, nodata: float | None = None, low: int | None = None) -> DataFrame:
    """(bin, n) for every integer from the least (or ``low``) to the greatest, gaps with 0."""
    counts = px.select(valid(nodata).cast("long").alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg((F.min("bin") if low is None else F.lit(low)).cast("long").alias("lo"), F.max("bin").alias("hi")).where("hi IS NOT NULL")
    domain = ends.select(F.explode(F.sequence("lo", "hi")).alias("bin"))
    return domain.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram_linear(px: DataFrame, nodata: float | None = None, bins: int = BINS) -> DataFrame:
    """Integers re-binned into ``bins`` equal steps: bin i takes the offsets from int(i step) below int((i+1) step), the last one all the rest."""
    counts = px.select(valid(nodata).cast("long").alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.greatest(F.lit(0), F.least(F.ceil((F.col("x") - F.col("lo") + 1) / step) - 1, F.lit(bins - 1)))
    got = counts.join(F.broadcast(ends)).withColumn("bin", bin_.cast("long")).groupBy("bin").agg(F.sum("n").alias("n"))
    domain = px.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return domain.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_ints(px: DataFrame, nodata: float | None = None, bins: int = BINS) -> DataFrame:
    """The table that fits the range, chosen within the plan: every integer if there are at most ``bins``, else equal steps numbered from 0."""
    counts = px.select(valid(nodata).cast("long").alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("hi IS NOT NULL")
    wide = F.col("hi") - F.col("lo") + 1 > bins
    step = (F.col("hi") - F.col("lo")) / bins
    place = F.when(wide, F.greatest(F.lit(0), F.least(F.ceil((F.col("x") - F.col("lo") + 1) / step) - 1, F.lit(bins - 1)))).otherwise(F.col("x"))
    got = counts.join(F.broadcast(ends)).groupBy(place.cast("long").alias("bin")).agg(F.sum("n").alias("n"))
    first, last = F.when(wide, F.lit(0).cast("long")).otherwise(F.col("lo")), F.when(wide, F.lit(bins - 1).cast("long")).otherwise(F.col("hi"))
    domain = ends.select(F.explode(F.sequence(first, last)).alias("bin"))
    return domain.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram_float(px: DataFrame, nodata: float | None = None, bins: int = BINS) -> DataFrame:
    """Equal steps between the least and the greatest value; one bin if they are the same."""
    x = px.select(valid(nodata).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)))
    return x.join(F.broadcast(ends)).groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_kind(dtype: str, thematic: bool, low: float | None, high: float | None) -> str:
    """direct or linear, by type and range."""
    if thematic or dtype in ("byte", "uint8"):
        if low is not None and low < 0:
            raise ValueError("a thematic histogram can't begin below 0")
        return "direct"
    if dtype in ("float", "double"):
        return "linear"
    return "direct" if low is None or high - low + 1 <= BINS else "linear"


def median_and_mode(hist: DataFrame, low: float = 0, step: float = 1) -> DataFrame:
    """From (bin, n): the first bin that reaches half the total, and the lowest of the fullest. Bins are few, so one window over all is bounded."""
    running = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    h = hist.withColumns({"cum": F.sum("n").over(running), "total": F.sum("n").over(every), "top": F.max("n").over(every)})
    return h.agg(
        (F.min(F.when(F.col("cum") >= F.col("total") / 2, F.col("bin"))) * step + low).alias("median"),
        (F.min(F.when(F.col("n") == F.col("top"), F.col("bin"))) * step + low).alias("mode"),
    )


def histogram_string(hist: DataFrame) -> DataFrame:
    """All counts in order, a bar after each."""
    rows = F.sort_array(F.collect_list(F.struct("bin", "n")))
    return hist.agg(F.concat(F.array_join(F.transform(rows, lambda x: x["n"].cast("string")), "|"), F.lit("|")).alias("counts"))


def non_finite(px: DataFrame, v: str = "v") -> DataFrame:
    """Whether a band holds NaN or infinities."""
    x = F.col(v).cast("double")
    return px.agg(F.coalesce(F.max(F.isnan(x)), F.lit(False)).alias("has_nan"), F.coalesce(F.max(F.abs(x) == float("inf")), F.lit(False)).alias("has_inf"))


def approximate_stats(px: DataFrame, nodata: float | None = None, fraction: float = 0.01, seed: int = 0) -> DataFrame:
    """The same measures from a sample of cells."""
    return band_stats(px.sample(fraction, seed), nodata)


def classes(px: DataFrame, v: str = "v") -> DataFrame:
    return px.select(v).distinct()


def zonal(px: DataFrame, zones: DataFrame, nodata: float | None = None) -> DataFrame:
    """Statistics of ``px`` by the ``zone`` of each cell."""
    return band_stats(px.join(zones.select("r", "c", "zone"), ["r", "c"]), nodata, ("zone",))


def masked(px: DataFrame, mask: DataFrame, inside: bool = True) -> DataFrame:
    return px.join(mask.select("r", "c"), ["r", "c"], "left_semi" if inside else "left_anti")


def block_stats(px: DataFrame, size: int) -> DataFrame:
    b = px.withColumns({"br": F.floor(F.col("r") / size), "bc": F.floor(F.col("c") / size)})
    return b.groupBy("br", "bc").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("vmin"), F.max("v").alias("vmax"))


def pyramid_levels(rows: int, cols: int, levels: tuple[int, ...] = (4, 8, 16, 32, 64, 128, 256, 512), least: int = 128) -> list[int]:
    """As many of the first levels as leave more than ``least`` pixels on the shorter side."""
    return list(levels[: sum(min(rows, cols) // x > least for x in levels)])


def pyramid_nearest(px: DataFrame, level: int, centred: bool = True) -> DataFrame:
    """Every level-th cell, from the middle of each group of cells or from its corner: a filter, no shuffle."""
    o = level // 2 if centred else 0
    keep = ((F.col("r") - o) % level == 0) & ((F.col("c") - o) % level == 0) & (F.col("r") >= o) & (F.col("c") >= o)
    return px.where(keep).select(((F.col("r") - o) / level).cast("long").alias("r"), ((F.col("c") - o) / level).cast("long").alias("c"), "v")


def pyramid_average(px: DataFrame, level: int, nodata: float | None = None) -> DataFrame:
    v = valid(nodata)
    return px.groupBy(F.floor(F.col("r") / level).alias("r"), F.floor(F.col("c") / level).alias("c")).agg(F.avg(v).alias("v")).where("v IS NOT NULL")
