"""Bounded samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, most_rows: int, most_chars: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list]:
    """Texts and labels of a sample that depends on ids alone: those whose hashed id comes first.

    ``labels``: id (string), y. ``most_rows`` a label and ``most_chars`` in all are the documented bounds. Ids are
    ranked without texts; lengths and then whole texts are fetched by broadcast joins on the chosen few. A text that
    no longer fits a label's share of the characters is left out and shorter ones after it still count; of a label of
    which no text fits, the shortest is taken. An id under several labels counts under the first of them.
    """
    spark = docs.sparkSession
    labels = labels.where("y IS NOT NULL AND id IS NOT NULL")
    first = []
    for y in sorted(r.y for r in labels.select("y").distinct().collect()):
        rows = labels.where(F.col("y") == F.lit(y)).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most_rows).collect()
        first += [(r.id, y, k) for k, r in enumerate(rows)]
    if not first:
        return [], []
    named = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    wanted = _local(spark, first, ["id", "y", "k"])
    lengths = named.select("id", F.char_length("t").alias("n")).join(F.broadcast(wanted), "id").collect()
    chosen = fitting([(r.id, r.y, r.n) for r in sorted(lengths, key=lambda r: (r.y, r.k, r.id, r.n))], most_chars // len({y for _, y, _ in first}))
    got = named.join(F.broadcast(_local(spark, chosen, ["id", "y"])), "id").collect() if chosen else []
    got.sort(key=lambda r: (r.id, r.t))
    return [r.t for r in got], [r.y for r in got]


def _local(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """The first row of each id. Goes through Arrow: rows given as a list would start Python workers on the executors, beside those of the operators."""
    first: dict = {}
    for r in rows:
        first.setdefault(r[0], r)
    return spark.createDataFrame(pa.table([pa.array(c) for c in zip(*first.values())], names)).coalesce(1)


def fitting(rows: list[tuple[str, object, int]], share: int) -> list[tuple[str, object]]:
    """Of (id, label, length) in their order, those that fit ``share`` characters a label, or else a label's shortest. An id that several rows have counts with all of them."""
    size: dict[tuple[str, object], int] = {}
    for id_, y, n in rows:
        size[id_, y] = size.get((id_, y), 0) + n
    used: dict[object, int] = {y: 0 for _, y in size}
    chosen = []
    for (id_, y), n in size.items():
        if used[y] + n <= share:
            used[y] += n
            chosen.append((id_, y))
    none = used.keys() - {y for _, y in chosen}
    return chosen + [min((k for k in size if k[1] == y), key=lambda k: (size[k], k[0])) for y in sorted(none)]
