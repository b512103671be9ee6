"""``python -m gridloom.cli stats PATH``: statistics of a stored raster, computed and written, or printed."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.stats import approximate_stats, band_stats
from .sources.raster import read_raster


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="gridloom")
    p.add_argument("command", choices=["stats", "print"])
    p.add_argument("path")
    p.add_argument("--ignore", type=float)
    p.add_argument("--approx", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    if a.command == "print":
        spark.read.parquet(f"{a.path}/stats").show(truncate=False)
        return
    px, _ = read_raster(spark, a.path)
    (approximate_stats(px, a.ignore) if a.approx else band_stats(px, a.ignore, ("band",))).coalesce(1).write.mode("overwrite").parquet(f"{a.path}/stats")


def version_tuple(version: str) -> tuple[int, ...]:
    """Whole numbers of a version, what follows them in a part left out."""
    out = []
    for part in version.split("."):
        digits = ""
        for ch in part:
            if not ch.isdigit():
                break
            digits += ch
        if not digits:
            break
        out.append(int(digits))
    return tuple(out)


if __name__ == "__main__":
    main()
