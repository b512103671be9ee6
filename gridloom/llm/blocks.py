"""Comparison of the rows of a key in bounded blocks, without a row per pair.

Rows of a key either ask, or own (can be found), or both. A key with more rows than ``most`` becomes a grid of
(part of the asking, part of the owned) blocks, so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import written

#: (binaries of the block, places of the asking, places of the owned) -> linked places in both lists.
Pairs = Callable[[list[bytes], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def links(ids: np.ndarray, raw: list[bytes], copies: np.ndarray, role: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In one block: the rows with links from asking (role & 1) to owned ones (role & 2), either side; how many of its own asking each one has, and the root of its local component."""
    q, h = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    none = np.zeros(0, np.int64)
    if not len(q) or not len(h):
        return none, none, none
    pi, pj = pairs(raw, q, h)
    i, j = q[pi], h[pj]
    other = ids[i] != ids[j]
    i, j = i[other], j[other]
    if not len(i):
        return none, none, none
    low, number = np.unique(ids, return_inverse=True)  # a row may be there as asking and as owned
    label, a, b = np.arange(len(low)), number[i], number[j]
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    count = np.bincount(a, weights=copies[j], minlength=len(low)).astype(np.int64)
    hit = np.unique(np.concatenate([a, b]))  # a root can be the asking row itself: the found carry the link then
    return low[hit], count[hit], low[label[hit]]


def compared(rows: DataFrame, pairs: Pairs, most: int) -> DataFrame:
    """``rows``: key, rep, copies, own, asks, x (binary). Written: rep, n (copies linked as asking, 0 for the found), root."""
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    large = written(large.select("key", F.ceil(F.col("n") / most).cast("int").alias("g")), "large-keys")
    g = F.coalesce("g", F.lit(1))
    mine = F.pmod(F.xxhash64("rep"), g).cast("int")
    role = F.when(F.col("asks"), 1).otherwise(0) + F.when(F.col("own"), 2).otherwise(0)
    kind = "array<struct<q:int,h:int,role:int>>"
    one = F.array(F.struct(F.lit(0).alias("q"), F.lit(0).alias("h"), role.alias("role")))
    span = F.sequence(F.lit(0), g - 1)
    none = F.array().cast(kind)
    as_asking = F.when(F.col("asks"), F.transform(span, lambda k: F.struct(mine.alias("q"), k.alias("h"), F.lit(1).alias("role")))).otherwise(none)
    as_owned = F.when(F.col("own"), F.transform(span, lambda k: F.struct(k.alias("q"), mine.alias("h"), F.lit(2).alias("role")))).otherwise(none)
    dealt = rows.join(large, "key", "left").withColumn("d", F.explode(F.when(g == 1, one).otherwise(F.concat(as_asking, as_owned))))
    dealt = dealt.select(F.xxhash64("key", "d.q", "d.h").alias("block"), "key", "rep", "copies", "x", "d.role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[pa.Table]:
            held: list[pa.RecordBatch] = []
            for b in batches:
                block = b.column(0).to_numpy()
                if not len(block):
                    continue
                if held and held[0].column(0)[0].as_py() != block[0]:
                    yield pa.Table.from_batches(held)
                    held = []
                edges = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
                for a, z in zip(edges[:-1], edges[1:]):
                    if z == len(block):
                        held.append(b.slice(a, z - a))
                    elif held or z - a > 1:
                        yield pa.Table.from_batches([*held, b.slice(a, z - a)])
                        held = []
            if held:
                yield pa.Table.from_batches(held)

        out: list[list[np.ndarray]] = [[], [], []]
        for t in blocks():
            role, key = t.column("role").to_numpy(), t.column("key").to_numpy()
            if len(role) < 2 or not (role & 2).any() or not (role & 1).any():
                continue
            x = t.column("x").combine_chunks()
            for k in np.unique(key):  # one, but for colliding hashes
                at = np.flatnonzero(key == k)
                raw = x.take(pa.array(at)).to_pylist()
                for o, f in zip(out, links(t.column("rep").to_numpy()[at], raw, t.column("copies").to_numpy()[at], role[at], pairs)):
                    o.append(f)
            if sum(map(len, out[0])) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["rep", "n", "root"])
                out = [[], [], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["rep", "n", "root"])

    return written(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(compare, "rep long, n long, root long"), "links")
