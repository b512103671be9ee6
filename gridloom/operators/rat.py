"""Raster attribute tables: ordinary tables whose ``row_id`` is the pixel value."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import AttributeColumn, RatBlockLength, RatMismatch

BLOCK = 100_000


def read_column(rat: DataFrame, name: str) -> DataFrame:
    if name not in rat.columns:
        raise AttributeColumn(name)
    real_colour = rat.schema[name].metadata.get("usage") in ("red", "green", "blue", "alpha") and rat.schema[name].dataType.simpleString() in ("float", "double")
    return rat.select("row_id", (F.floor(F.col(name) * 255).cast("int") if real_colour else F.col(name)).alias(name))


def with_usage(rat: DataFrame, name: str, usage: str) -> DataFrame:
    """Column usage lives in the field's metadata, so copies keep it."""
    return rat.withMetadata(name, {"usage": usage})


def usage_of(rat: DataFrame, name: str) -> str:
    return rat.schema[name].metadata.get("usage", "generic")


def write_column(rat: DataFrame, name: str, values: DataFrame, byte_band: bool = False) -> DataFrame:
    """Adds or replaces a column by row; a byte band always has 256 rows."""
    out = rat.drop(name).join(values.select("row_id", name), "row_id", "left")
    if byte_band:
        out = rat.sparkSession.range(256).withColumnRenamed("id", "row_id").join(out, "row_id", "left")
    return out


def new_rat(spark: SparkSession, rows: int, **columns: Column) -> DataFrame:
    return spark.range(rows).withColumnRenamed("id", "row_id").select("row_id", *[c.alias(k) for k, c in columns.items()])


def joined(rats: dict[str, DataFrame], check: bool = True) -> DataFrame:
    """Row-by-row union of columns, named <table>_<column>; all tables must have equally many rows."""
    if check and len({r.count() for r in rats.values()}) > 1:
        raise RatMismatch(f"{sorted(rats)} have different row counts")
    out = None
    for k, r in rats.items():
        one = r.select("row_id", *[F.col(c).alias(f"{k}_{c}") for c in r.columns if c != "row_id"])
        out = one if out is None else out.join(one, "row_id")
    return out


def apply_columns(rat: DataFrame, **columns: Column) -> DataFrame:
    """Column mode: expressions that Catalyst sees; only touched columns are read."""
    return rat.withColumns(columns)


def apply_blocks(rat: DataFrame, fn: Callable[[dict, pd.DataFrame], dict], schema: str, block: int = BLOCK) -> DataFrame:
    """Block mode: ``fn(state, rows)`` gives columns of one length for each run of ``block`` rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id", ignore_index=True)
        start = int(pdf.row_id.iloc[0] // block * block)
        out = fn({"start_row": start, "block": start // block, "rows": len(pdf)}, pdf)
        if len({len(v) for v in out.values()}) > 1:
            raise RatBlockLength(f"columns of the block at {start} differ in length")
        return pd.DataFrame(out)

    return rat.groupBy(F.floor(F.col("row_id") / block)).applyInPandas(run, schema)


def reduced(rat: DataFrame, keep: Column) -> DataFrame:
    """The rows kept, numbered anew without gaps and in order.

    Counts per run of rows first, then numbers within a run: no task sorts the whole table.
    """
    kept = rat.where(keep).withColumn("_run", F.floor(F.col("row_id") / BLOCK))
    runs = kept.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    before = runs.withColumn("_before", F.sum("_n").over(Window.orderBy("_run")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy("_run").orderBy("row_id"))
    return kept.withColumn("_k", within).join(before, "_run").withColumn("row_id", (F.col("_before") + F.col("_k") - 1).cast("long")).drop("_run", "_k", "_before")


def copied(rat: DataFrame, omit: tuple[str, ...] = ()) -> DataFrame:
    return rat.drop(*omit)


def weighted_stats(rat: DataFrame, columns: list[str], weight: str | None = None, null_row: int | None = None) -> DataFrame:
    """Per numeric column: count, total, mean, stddev, vmin, vmax, weighted by a histogram; the null row left out."""
    rows = rat if null_row is None else rat.where(F.col("row_id") != null_row)
    w = F.lit(1).cast("long") if weight is None else F.coalesce(F.col(weight), F.lit(0))
    numeric = [c for c in columns if rat.schema[c].dataType.simpleString() not in ("string", "binary")]
    if not numeric:
        raise AttributeColumn("no numeric column among " + ", ".join(columns))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in numeric]))
    x = rows.select(w.alias("w"), cells.alias("s")).select("w", "s.column", "s.x").where("w > 0 AND x IS NOT NULL")
    mean = F.sum(F.col("x") * F.col("w")) / F.sum("w")
    return x.groupBy("column").agg(
        F.sum("w").cast("long").alias("n"),
        F.sum(F.col("x") * F.col("w")).alias("total"),
        mean.alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("x") * F.col("x") * F.col("w")) / F.sum("w") - mean * mean)).alias("stddev"),
        F.min("x").alias("vmin"),
        F.max("x").alias("vmax"),
    )
