"""Named intervals and their summary."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Timers:
    def __init__(self) -> None:
        self.intervals: list[tuple[str, float, float]] = []

    @contextmanager
    def interval(self, name: str) -> Iterator[None]:
        start = time.time()
        try:
            yield
        finally:
            self.intervals.append((name, start, time.time()))

    def merge(self, other: Timers) -> None:
        self.intervals += other.intervals

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.intervals, "name string, start double, end double")


def summary(intervals: DataFrame) -> DataFrame:
    """n, total, least, quartiles and greatest duration by name."""
    d = F.col("end") - F.col("start")
    q = lambda p: F.percentile(d, F.lit(p))
    return intervals.groupBy("name").agg(F.count(d).alias("n"), F.sum(d).alias("total"), F.min(d).alias("least"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max(d).alias("most"))
