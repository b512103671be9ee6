"""Colour tables: (value, red, green, blue, alpha) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Control points of ramps, evenly spaced (fixed values: end and middle colours of public palettes).
_RAMPS: dict[str, list[tuple[int, int, int]]] = {
    "gray": [(0, 0, 0), (255, 255, 255)],
    "Greens": [(247, 252, 245), (116, 196, 118), (0, 68, 27)],
    "Blues": [(247, 251, 255), (107, 174, 214), (8, 48, 107)],
    "Reds": [(255, 245, 240), (251, 106, 74), (103, 0, 13)],
    "RdYlGn": [(165, 0, 38), (255, 255, 191), (0, 104, 55)],
    "viridis": [(68, 1, 84), (33, 145, 140), (253, 231, 37)],
    "magma": [(0, 0, 4), (183, 55, 121), (252, 253, 191)],
    "plasma": [(13, 8, 135), (204, 71, 120), (240, 249, 33)],
    "inferno": [(0, 0, 4), (188, 55, 84), (252, 255, 164)],
    "cividis": [(0, 32, 76), (124, 123, 120), (255, 233, 69)],
    "rainbow": [(0, 0, 255), (0, 255, 0), (255, 0, 0)],
}


def add_ramp(name: str, points: list[tuple[int, int, int]]) -> None:
    if not isinstance(name, str) or name in _RAMPS:
        raise ValueError(f"{name!r} is no new name")
    _RAMPS[name] = points


def read_ramps(spark: SparkSession, path: str) -> list[str]:
    """Adds the ramps of a CSV file with a header (name, position, red, green, blue) and gives their names."""
    rows = spark.read.csv(path, header=True, schema="name string, position int, red int, green int, blue int").orderBy("name", "position").collect()
    points: dict[str, list[tuple[int, int, int]]] = {}
    for r in rows:
        points.setdefault(r.name, []).append((r.red, r.green, r.blue))
    for name, p in points.items():
        add_ramp(name, p)
    return list(points)


def ramp_names() -> list[str]:
    return [*_RAMPS, "RANDOM"]


def ramp(spark: SparkSession, n: int, points: str | list[tuple[int, int, int]] = "gray", ignore: int | None = None) -> DataFrame:
    """``n`` colours interpolated between the control points and cut to whole numbers."""
    if points == "RANDOM":
        pick = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(255)).cast("int")
        t = spark.range(n).select(F.col("id").alias("value"), *[pick(k).alias(c) for k, c in enumerate(("red", "green", "blue"))])
    else:
        pts = _RAMPS[points] if isinstance(points, str) else points
        k = len(pts) - 1
        x = F.col("id") * (k / max(1, n - 1))
        low = F.least(F.floor(x), F.lit(max(0, k - 1))).cast("int")
        lerp = lambda j: F.floor(F.round(F.get(F.array(*[F.lit(float(p[j])) for p in pts]), low) * (1 - (x - low)) + F.get(F.array(*[F.lit(float(p[j])) for p in pts]), F.least(low + 1, F.lit(k))) * (x - low), 9)).cast("int")
        t = spark.range(n).select(F.col("id").alias("value"), *[lerp(j).alias(c) for j, c in enumerate(("red", "green", "blue"))])
    hidden = F.lit(False) if ignore is None else F.col("value") == ignore
    return t.select("value", *[F.when(hidden, 0).otherwise(F.col(c)).alias(c) for c in ("red", "green", "blue")], F.when(hidden, 0).otherwise(255).alias("alpha"))


def rainbow(spark: SparkSession, n: int) -> DataFrame:
    """Blue to green over the first half, green to red over the second, each linear and cut to whole numbers."""
    half = n // 2
    v = F.col("id")
    up = F.floor(v * 255 / max(1, half - 1)).cast("int")
    on = F.floor((v - half) * 255 / max(1, n - half - 1)).cast("int")
    first = v < half
    return spark.range(n).select(
        v.alias("value"),
        F.when(first, 0).otherwise(on).alias("red"),
        F.when(first, up).otherwise(255 - on).alias("green"),
        F.when(first, 255 - up).otherwise(0).alias("blue"),
        F.lit(255).alias("alpha"),
    )


def filled(spark: SparkSession, table: DataFrame, byte: bool = False) -> DataFrame:
    """Sparse values as a dense table; gaps are transparent black. A byte band has values to 255."""
    top = table.agg(F.max("value").alias("m")).select(F.greatest("m", F.lit(255)).alias("m") if byte else F.col("m"))
    domain = top.where("m IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long"))).alias("value"))
    alpha = table if "alpha" in table.columns else table.withColumn("alpha", F.lit(255))
    return domain.join(alpha.withColumn("value", F.col("value").cast("long")), "value", "left").select("value", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("red", "green", "blue", "alpha")])
