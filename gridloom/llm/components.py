"""Connected components of an edge table: minimum labels with pointer jumping, in joins that can be split.

Every round writes its labels to the shared folder, so a lost executor costs a stage and never the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): long ids. Returns (id, component) for every id in an edge; component is the smallest id reachable."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")), "cc-labels")
    last = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == last or now is None:
            return labels
        last = now
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("component"))
        lower = written(seen.unionByName(labels).groupBy("id").agg(F.min("component").alias("component")), "cc-labels")
        parents = lower.select(F.col("id").alias("component"), F.col("component").alias("above"))
        labels = written(lower.join(parents, "component").select("id", F.col("above").alias("component")), "cc-labels")
