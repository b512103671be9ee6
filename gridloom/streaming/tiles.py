"""Tiles as a stream: each block is processed once, statistics are kept up as blocks arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def tile_stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def once(tiles: DataFrame, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Every (top, left) once; with an event time, state is kept for the delay only."""
    if event_time:
        return tiles.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["top", "left"])
    return tiles.dropDuplicates(["top", "left"])


def running_stats(tiles: DataFrame) -> DataFrame:
    v = tiles.select(F.inline("cells"))
    return v.agg(F.count("v").alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.avg("v").alias("mean"))
