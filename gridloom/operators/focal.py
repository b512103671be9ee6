"""Focal operations: separable windows, scattering to neighbours, or halo blocks for any Python function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArrayShape


def focal_separable(px: DataFrame, m: int, agg: Callable[[Column], Column]) -> DataFrame:
    """max, min, sum or count over (2m+1) x (2m+1) cells: along rows, then along columns; missing cells are left out."""
    across = Window.partitionBy("r").orderBy("c").rangeBetween(-m, m)
    down = Window.partitionBy("c").orderBy("r").rangeBetween(-m, m)
    return px.withColumn("v", agg(F.col("v")).over(across)).withColumn("v", agg(F.col("v")).over(down))


def focal_mean(px: DataFrame, m: int) -> DataFrame:
    """Mean of the cells there are: sums and counts by the same two windows."""
    across = Window.partitionBy("r").orderBy("c").rangeBetween(-m, m)
    down = Window.partitionBy("c").orderBy("r").rangeBetween(-m, m)
    s = px.withColumns({"s": F.sum("v").over(across), "n": F.count("v").over(across)})
    s = s.withColumns({"s": F.sum("s").over(down), "n": F.sum("n").over(down)})
    return s.select("r", "c", (F.col("s") / F.col("n")).alias("v"))


def focal_scatter(px: DataFrame, kernel: dict[tuple[int, int], float], nodata: float | None = None) -> DataFrame:
    """Weighted sums: every cell sends its value to its neighbours, added up before and after one shuffle."""
    offsets = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(float(w)).alias("w")) for (a, b), w in kernel.items()])
    valid = px if nodata is None else px.where(F.col("v") != nodata)
    sent = valid.withColumn("k", F.explode(offsets)).select((F.col("r") - F.col("k.dr")).alias("r"), (F.col("c") - F.col("k.dc")).alias("c"), (F.col("v") * F.col("k.w")).alias("v"))
    sums = sent.groupBy("r", "c").agg(F.sum("v").alias("v"))
    return px.select("r", "c").join(sums, ["r", "c"], "left").select("r", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


def block_apply(px: DataFrame, fn: Callable[[np.ndarray, dict], np.ndarray], rows: int, cols: int, size: int = 256, overlap: int = 0, fill: float = 0, value: str = "double") -> DataFrame:
    """``fn(array, info)`` on blocks with a margin; the margin is cut off what it returns.

    A cell goes to its block and to those whose margin it is in. Blocks bound the memory of a task: the function
    sees (size + 2 overlap) squared cells at most.
    """
    near = lambda x: F.array_distinct(F.array(F.floor((x - overlap) / size), F.floor(x / size), F.floor((x + overlap) / size)))
    dealt = px.withColumn("br", F.explode(near(F.col("r")))).withColumn("bc", F.explode(near(F.col("c"))))
    dealt = dealt.where(F.col("br").between(0, (rows - 1) // size) & F.col("bc").between(0, (cols - 1) // size))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf.br.iloc[0]) * size, int(pdf.bc.iloc[0]) * size
        h, w = min(size, rows - top), min(size, cols - left)
        a = np.full((h + 2 * overlap, w + 2 * overlap), fill, dtype=pdf.v.dtype if fill == int(fill) else float)
        i, j = pdf.r.to_numpy() - top + overlap, pdf.c.to_numpy() - left + overlap
        inside = (i >= 0) & (i < a.shape[0]) & (j >= 0) & (j < a.shape[1])
        a[i[inside], j[inside]] = pdf.v.to_numpy()[inside]
        out = np.asarray(fn(a, {"top": top, "left": left, "nrows": h, "ncols": w, "overlap": overlap}))
        if out.shape != a.shape:
            raise ArrayShape(f"the function returned {out.shape} for {a.shape}")
        out = out[overlap : overlap + h, overlap : overlap + w]
        rr, cc = np.mgrid[top : top + h, left : left + w]
        return pd.DataFrame({"r": rr.ravel(), "c": cc.ravel(), "v": out.ravel()})

    return dealt.groupBy("br", "bc").applyInPandas(run, f"r long, c long, v {value}")
