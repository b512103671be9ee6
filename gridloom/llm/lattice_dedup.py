"""Embedding near-dedup by E8 lattice hashing that misses no pair above the threshold.

A unit vector is turned by a random rotation and cut into blocks of eight coordinates, one table each. Two unit
vectors with cosine t are sqrt(2 - 2t) apart, so in at least one of the B blocks they are within
r = sqrt((2 - 2t) / B). In every table a vector lives in the cell of its nearest E8 point and probes the
neighbouring cells that come within r of it; each pair above the threshold therefore meets in some cell.

Cells hold vectors in one byte a coordinate, with a bound on what that changes of a cosine: pairs that can reach
the threshold join two vectors into a candidate group. Then every group's whole vectors are compared in double
precision. Neither step emits pairs: a block of a cell or group gives link counts and one edge from each vector
to the root of its local component. Cells and groups above ``MOST`` rows are dealt out as a grid of blocks, each
one bounded.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
label, link with nothing and are components of their own; vectors of different lengths do not link. Copies link
to each other and are one vector in all comparisons. Rows repeated under one id are vectors of that id each. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import compared
from .components import components
from .textvec import mix
from .work import table, written

#: Rows in a block of a cell, at most.
MOST = 4096
#: The smallest cell, and the largest radius in cells: home cells of two points at distance r lie 2 + r/cell apart at
#: most, and ``steps`` has all neighbours closer than the next longer ones, sqrt(6).
CELL, REACH = 0.25, 0.44
SLACK = 1e-7


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8 (D8 and D8 shifted by a half)."""

    def d8(y: np.ndarray) -> np.ndarray:
        f = np.rint(y)
        odd = np.flatnonzero(f.sum(1) % 2)
        worst = np.abs(y[odd] - f[odd]).argmax(1)
        f[odd, worst] += np.where(y[odd, worst] > f[odd, worst], 1, -1)
        return f

    a, b = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - b) ** 2).sum(1) < ((x - a) ** 2).sum(1)
    return np.where(nearer[:, None], b, a)


@lru_cache(maxsize=1)
def steps() -> tuple[np.ndarray, np.ndarray]:
    """The 240 vectors of norm 2 and the 2160 of norm 4, and their lengths."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    halves = [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    out += halves
    for i in range(8):
        for s in (2, -2):
            v = np.zeros(8)
            v[i] = s
            out.append(v)
    for four in combinations(range(8), 4):
        for s in product((1, -1), repeat=4):
            v = np.zeros(8)
            v[list(four)] = s
            out.append(v)
    for s in product((1.0, -1.0), repeat=8):
        for i in range(8):
            v = np.array(s) / 2
            v[i] *= 3
            if v.sum() % 2 == 0:
                out.append(v)
    m = np.array(out)
    return m, np.sqrt((m**2).sum(1))


@lru_cache(maxsize=16)
def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """Orthonormal, padded with zero columns to whole blocks of eight."""
    size = -(-dim // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).normal(size=(size, size)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def turned(x: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated: [n, blocks, 8]."""
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    return (unit @ rotation(x.shape[1]).T).reshape(len(x), -1, 8)


def probes(x: np.ndarray, radius: float, cell: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For points [n, 8]: point numbers, cell hashes, and whether it is the point's own cell."""
    if radius > (np.sqrt(6) - 2) * cell:
        raise ValueError(f"cells of {cell} are too small for a radius of {radius}")
    y = x / cell
    home = nearest_e8(y)
    m, length = steps()
    which, key, own = [np.arange(len(x))], [home], [np.ones(len(x), bool)]
    for a in range(0, len(x), 4096):
        near = length / 2 - ((y[a : a + 4096] - home[a : a + 4096]) @ m.T) / length <= radius / cell
        i, j = np.nonzero(near)
        which.append(i + a)
        key.append(home[i + a] + m[j])
        own.append(np.zeros(len(i), bool))
    cells = (np.concatenate(key) * 2).astype(np.int64).astype(np.uint64)
    h = np.zeros(len(cells), np.uint64)
    for j in range(8):
        h = mix(h * np.uint64(31) + cells[:, j])
    return np.concatenate(which), h, np.concatenate(own)


def alike(least, unpack):
    """For ``compared``: pairs of unit vectors whose product is at least ``least(dim)``."""

    def pairs(raw: list[bytes], q: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = unpack(b"".join(raw), len(raw))
        return np.nonzero(unit[q] @ unit[h].T >= least(unit.shape[1]))

    return pairs


def near_vectors(vectors: DataFrame, threshold: float = 0.98, cell: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    ``cell`` is the lattice's scale; by default it follows from the threshold and each vector's dimension. One that is
    too small for the neighbours probed here raises an error, since pairs could be missed.
    """
    v = F.col(vector_col).cast("array<float>")
    finite = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v"), F.col(label_col).cast("string").alias("label"), F.coalesce(F.col(label_col).isNotNull() & finite, F.lit(False)).alias("good"))
    once = written(rows.where("good").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(np.asarray(b.column(1).offsets))
            for dim in np.unique(size):
                for rows in np.array_split(at := np.flatnonzero(size == dim), -(-len(at) // 1000)):
                    part = b.take(pa.array(rows))
                    x = np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(-1, dim)
                    salt = np.array([hash_text(f"{dim}:{y}") for y in part.column(0).to_pylist()], np.uint64)
                    blocks = turned(x)
                    small = np.rint(x / np.sqrt((x * x).sum(1, keepdims=True)) * 127).astype(np.int8)
                    raw = pa.array([r.tobytes() for r in small], pa.binary())
                    radius = float(np.sqrt((2 - 2 * threshold) / blocks.shape[1])) + SLACK
                    scale = max(CELL, radius / REACH) if cell is None else cell
                    for t in range(blocks.shape[1]):
                        which, h, own = probes(blocks[:, t], radius, scale)
                        key = mix(h ^ salt[which] ^ mix(np.full(1, t + 1, np.uint64))).astype(np.int64)
                        cols = [pa.array(key), part.column(2).take(pa.array(which)), pa.array(own), raw.take(pa.array(which))]
                        yield pa.RecordBatch.from_arrays(cols, names=["key", "rep", "own", "x"])

    near = once.mapInArrow(cells, "key long, rep long, own boolean, x binary").withColumns({"copies": F.lit(1).cast("long"), "asks": F.lit(True)})
    # a byte a coordinate moves each vector by at most sqrt(dim) / 254
    met = compared(near, alike(lambda dim: threshold - 2.1 * np.sqrt(dim) / 254 - dim / 254**2, lambda raw, n: np.frombuffer(raw, np.int8).reshape(n, -1).astype(np.float32) / 127), MOST)
    groups = components(met.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())

    def doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.array(x, np.float64).tobytes() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(raw, pa.binary())], names=["key", "rep", "copies", "x"])

    def unit(raw: bytes, n: int) -> np.ndarray:
        x = np.frombuffer(raw, np.float64).reshape(n, -1)
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    # the candidate groups keep labels and lengths apart, since cells do
    inside = once.join(groups.withColumnRenamed("id", "rep"), "rep").select("component", "rep", "copies", "v")
    inside = inside.mapInArrow(doubles, "key long, rep long, copies long, x binary").withColumns({"own": F.lit(True), "asks": F.lit(True)})
    found = compared(inside, alike(lambda dim: threshold, unit), MOST)
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    known = once.join(counts, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    known = written(known.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-parts")
    good = rows.where("good").join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def hash_text(s: str) -> int:
    return zlib.crc32(s.encode()) | zlib.crc32(s.encode()[::-1] + b"#") << 32


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), unit AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM good
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98
), reach(id, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, r.m AS component_id, e.vec_id = r.m AS kept
FROM embeddings e JOIN (SELECT id, min(r) AS m FROM reach GROUP BY id) r ON r.id = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = e.vec_id
"""
