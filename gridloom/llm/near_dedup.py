"""MinHash near-dedup with DartMinHash signatures and banded joining.

A document is the set of its shingles of five words (lower-cased A-Z, split at ASCII white space; a shorter
text is one shingle), each with a weight: 1 (``weights="set"``, similarity is Jaccard) or its count
(``weights="count"``, similarity is weighted Jaccard). Hashed darts fall on each element's region of weight x
rank; those under the element's weight and under a rank bound that yields about k ln k + 2k darts a document
count. Every dart belongs to one of k coordinates; the earliest of each is the signature.

Equal word sequences are made one first. Signature bands meet in buckets, and each bucket's documents are first
compared with one centre. Where that leaves a bucket with several components, the members outside its largest one
are compared with all others of the bucket, in bounded blocks that give a root for each member and never a row per
pair. All comparisons are exact, on whole texts, and no pair of a bucket that could join two components is left
out. Components of the links are the classes.

Defined results: null counts as empty; all texts without words are one class. One row per row of the input,
with doc_id, class_id (smallest id of the class), class_size and kept. Rows repeated under one id are kept
together. A null id is no id: such rows join classes by their texts, and are kept only where the whole class has
null ids; class_id is null there and one row of the class is kept. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import compared
from .components import components
from .textvec import SPACE, mix, shingles, slices, utf8, words
from .work import table, written

SIZE, K, BANDS, THRESHOLD = 5, 120, 24, 0.8
#: Rows in a block of a bucket, at most.
MOST = 512
WORD = ~SPACE


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _edges(width: float, most: float) -> list[float]:
    """Rank intervals: powers of two while the region's area stays under 4, then equal steps."""
    step, out = 4 / width, [0.0, 2.0**-4]
    while out[-1] < most:
        out.append(out[-1] + min(out[-1], step))
    return out


def _poisson(mean: float) -> np.ndarray:
    n = np.arange(1, 40)
    p = np.exp(-mean) * np.concatenate([[1.0], np.cumprod(mean / n)])
    return np.cumsum(p)


def dart_minhash(h: np.ndarray, rows: np.ndarray, n_rows: int, k: int = K, weights: np.ndarray | None = None) -> np.ndarray:
    """[n_rows, k] signatures of weighted sets given as (element hash, row[, weight]); zero where a row has no element.

    An element given twice without weights counts once: its darts are the same.
    """
    sig = np.zeros((n_rows, k), np.uint64)
    w = np.ones(len(h)) if weights is None else weights.astype(float)
    total = np.bincount(rows, weights=w, minlength=n_rows)
    bound = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        active = np.zeros(n_rows, bool)
        active[todo] = True
        if len(todo) < n_rows:
            mine = np.flatnonzero(active[rows])
            eh, er, ew = h[mine], rows[mine], w[mine]
        else:
            eh, er, ew = h, rows, w
        place, rank, dart = [], [], []
        low, width = 0.0, 1.0
        while len(up := np.flatnonzero(ew > low)):
            lim = bound[er[up]]
            edges = _edges(width, float(lim.max()))
            at = up
            for a, b in zip(edges[:-1], edges[1:]):
                if a:
                    still = lim > a
                    at, lim = at[still], lim[still]
                if not len(at):
                    break
                seed = np.frombuffer(np.array([low, a]).tobytes(), np.uint64)
                hr = mix(eh[at] ^ mix(seed[:1] + np.uint64(17)) ^ mix(seed[1:]))
                number = np.searchsorted(_poisson(width * (b - a)), _unit(hr), side="right")
                for j in range(int(number.max(initial=0))):
                    has = np.flatnonzero(number > j)
                    d = mix(hr[has] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
                    d2 = mix(d)
                    r = a + (b - a) * _unit(d2)
                    row = er[at[has]]
                    ok = (r < bound[row]) & (low + width * _unit(mix(d2 + np.uint64(1))) < ew[at[has]])
                    place.append(row[ok] * k + (d[ok] % np.uint64(k)).astype(np.int64))
                    rank.append(r[ok])
                    dart.append(d[ok])
            low, width = (1.0, 1.0) if low == 0 else (low * 2, width * 2)
        if not sum(map(len, place)):  # a text that repeats one shingle: its bound was far too low
            bound[todo] *= 2
            continue
        place_, rank_, dart_ = np.concatenate(place), np.concatenate(rank), np.concatenate(dart)
        first = np.full(n_rows * k, np.inf)
        np.minimum.at(first, place_, rank_)
        wins = rank_ == first[place_]
        sig.reshape(-1)[place_[wins]] = dart_[wins]
        short = np.isinf(first.reshape(n_rows, k)[todo]).any(1)
        todo = todo[short]
        bound[todo] *= 2
    return sig


def bands_of(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, k = sig.shape
    parts = sig.reshape(n, bands, k // bands)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for j in range(k // bands):
        h = mix(h ^ parts[:, :, j])
    return h


def sequences(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """[n, 2]: a 128-bit hash of each row's word sequence."""
    whole = np.zeros((n, 2), np.uint64)
    if len(h):
        count = np.bincount(rows, minlength=n)
        begin = np.cumsum(count) - count
        place = np.arange(len(h)) - begin[rows]
        some = np.flatnonzero(count)
        for j, salt in enumerate((3, 5)):
            each = mix(mix(h + np.uint64(salt)) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            whole[some, j] = np.add.reduceat(each, begin[some])
        whole[:, 0] += count.astype(np.uint64)
    return whole


def elements(col: pa.Array, weights: str = "set", size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray, int]:
    """Shingle hashes, their rows, weights, and a 128-bit hash of each row's word sequence."""
    data, offsets = utf8(col)
    n = len(offsets) - 1
    h, _, _, rows = words(data, offsets, WORD)
    whole = sequences(h, rows, n)
    s, r = shingles(h, rows, n, size)
    if weights == "set":
        return s, r, None, whole, n
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])])) if len(s) else np.zeros(0, np.int64)
    return s[new], r[new], np.diff(np.append(new, len(s))), whole, n


def similarity(a: pa.Array, b: pa.Array, weights: str = "set", size: int = SIZE) -> np.ndarray:
    """Exact (weighted) Jaccard of the texts of two arrays, row by row."""
    sides = []
    for col in (a, b):
        s, r, w, _, n = elements(col, weights, size)
        if w is None:
            order = np.lexsort((s, r))
            s, r = s[order], r[order]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])]) if len(s) else np.zeros(0, bool)
            s, r = s[new], r[new]
            w = np.ones(len(s))
        sides.append((s, r, w.astype(float)))
    (s1, r1, w1), (s2, r2, w2) = sides
    s, r, w = np.concatenate([s1, s2]), np.concatenate([r1, r2]), np.concatenate([w1, w2])
    order = np.lexsort((s, r))
    s, r, w = s[order], r[order], w[order]
    same = np.flatnonzero((s[1:] == s[:-1]) & (r[1:] == r[:-1])) if len(s) else np.zeros(0, np.int64)
    both = np.bincount(r[same], weights=np.minimum(w[same], w[same + 1]), minlength=n)
    every = np.bincount(r, weights=w, minlength=n) - both
    return np.where(every > 0, both / np.maximum(every, 1e-300), 1.0)


def sketch(docs: DataFrame, weights: str = "set", size: int = SIZE, k: int = K, bands: int = BANDS) -> DataFrame:
    """``docs``: doc_id, text. Gives doc_id, whole (binary), bands (array, null without words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                s, r, w, whole, n = elements(b.column(1), weights, size)
                keys = bands_of(dart_minhash(s, r, n, k, w), bands).astype(np.int64)
                has = np.bincount(r, minlength=n) > 0
                lists = pa.array([row if ok else None for row, ok in zip(keys, has)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in whole], pa.binary()), lists], names=["doc_id", "whole", "bands"])

    return docs.select("doc_id", "text").mapInArrow(make, f"doc_id {kind}, whole binary, bands array<long>")


def _sequenced(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """``rows`` with the hash of each text's word sequence, as in ``sketch``, in column ``name``."""
    kinds = T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())])
    at = rows.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text_col):
                data, offsets = utf8(b.column(at))
                h, _, _, r = words(data, offsets, WORD)
                whole = sequences(h, r, b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in whole], pa.binary())], names=kinds.names)

    return rows.mapInArrow(add, kinds)


def _verified(pairs: DataFrame, texts: DataFrame, weights: str, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b), each with ok: whether the similarity reaches the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "ta", 1 << 20):
                ok = similarity(b.column(2), b.column(3), weights, size) >= threshold - 1e-12
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok)], names=["a", "b", "ok"])

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return written(two.mapInArrow(check, "a long, b long, ok boolean"), "near-verified")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, weights: str = "set", size: int = SIZE, k: int = K, bands: int = BANDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept."""
    return _grouped(docs, id_col, text_col, threshold, weights, size, k, bands).drop("whole")


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, weights: str = "set", size: int = SIZE, k: int = K, bands: int = BANDS) -> DataFrame:
    """``near_groups`` with whole. A node is a word sequence, named by the number of one of its rows, so it needs no id."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    sketches = written(sketch(docs, weights, size, k, bands).withColumn("uid", F.monotonically_increasing_id()), "near-sketch")
    first = written(sketches.groupBy("whole").agg(F.min("doc_id").alias("rep"), F.min("uid").alias("node"), F.count(F.lit(1)).alias("copies")), "near-reps")
    reps = sketches.where("bands IS NOT NULL").join(first.select("node"), F.col("uid") == F.col("node")).select("node", "bands")
    each = reps.select("node", F.explode("bands").alias("bucket"))
    starred = each.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    starred = written(starred, "near-buckets")
    members = written(each.join(starred.select("bucket", "centre"), "bucket"), "near-members")
    pairs = members.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    wanted = written(first.join(members.select("node").distinct(), "node").select("node", "rep", "whole"), "near-candidates")
    named = docs.join(wanted.select("rep").where("rep IS NOT NULL").distinct(), docs.doc_id == F.col("rep"), "left_semi")
    texts = _sequenced(named.unionByName(docs.where("doc_id IS NULL")).select("text"), "text", "whole").dropDuplicates(["whole"])
    texts = written(texts.join(wanted, "whole").select("node", "text"), "near-texts")
    tested = _verified(pairs, texts, weights, size, threshold)
    # texts under one smallest id are one class
    least = first.where("rep IS NOT NULL").groupBy("rep").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    together = first.join(least, "rep").where("node <> b").select(F.col("node").alias("a"), "b")
    linked = written(tested.where("ok").select("a", "b").unionByName(together), "near-linked")
    parts = components(linked)
    more = compared(_open_buckets(members, parts, texts), _similar(weights, size, threshold), MOST)
    more = more.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    parts = components(linked.unionByName(more))
    classes = first.join(parts.withColumnRenamed("id", "node"), "node", "left").select("whole", "rep", "node", "copies", F.coalesce("component", "node").alias("part"))
    sizes = classes.groupBy("part").agg(F.min("rep").alias("class_id"), F.min("node").alias("stays"), F.sum("copies").alias("class_size"))
    classes = written(classes.join(sizes, "part").select("whole", "class_id", "stays", "class_size"), "near-classes")
    out = sketches.select("doc_id", "uid", "whole").join(classes, "whole")
    kept = F.when(F.col("class_id").isNull(), F.col("uid") == F.col("stays")).otherwise(F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))
    return out.select("doc_id", "class_id", "class_size", kept.alias("kept"), "whole")


def _open_buckets(members: DataFrame, parts: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows for ``compared``: the members of buckets that hold several components. All can be found; those outside the largest one ask."""
    labelled = members.select("bucket", F.col("node").alias("rep")).join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("part"))
    per = labelled.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    mixed = per.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = written(mixed.select("bucket", F.col("top.part").alias("top")), "near-mixed")
    inside = written(labelled.join(mixed, "bucket").select(F.col("bucket").alias("key"), "rep", (F.col("part") != F.col("top")).alias("asks")), "near-mixed-members")
    return inside.join(texts.select(F.col("node").alias("rep"), F.col("text").cast("binary").alias("x")), "rep").withColumns({"copies": F.lit(1).cast("long"), "own": F.lit(True)})


def _similar(weights: str, size: int, threshold: float):
    """For ``compared``: pairs of texts whose exact similarity reaches the threshold."""

    def pairs(raw: list[bytes], q: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, r, w, _, n = elements(pa.array(raw, pa.large_binary()).cast(pa.large_string()), weights, size)
        if w is None:
            order = np.lexsort((s, r))
            s, r = s[order], r[order]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])])
            s, r = s[new], r[new]
            w = np.ones(len(s))
        _, number = np.unique(s, return_inverse=True)
        total = np.bincount(r, weights=w, minlength=n)
        edge = np.searchsorted(r, np.arange(n + 1))
        mine = np.concatenate([number[edge[j] : edge[j + 1]] for j in h])
        weight = np.concatenate([w[edge[j] : edge[j + 1]] for j in h]).astype(np.float32)
        start = np.cumsum([0, *(edge[h + 1] - edge[h])])[:-1]
        mark = np.zeros(int(number.max()) + 1, np.float32)
        pi, pj = [], []
        for k, i in enumerate(q):
            own = number[edge[i] : edge[i + 1]]
            mark[own] = w[edge[i] : edge[i + 1]]
            both = np.add.reduceat(np.minimum(mark[mine], weight), start, dtype=np.float64)
            mark[own] = 0
            j = np.flatnonzero(both >= (threshold - 1e-12) * (total[i] + total[h] - both))
            pi.append(np.full(len(j), k))
            pj.append(j)
        return np.concatenate(pi), np.concatenate(pj)

    return pairs


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class, and one row of each class without ids, with the columns of ``docs``.

    The ids that go are taken out of ``docs``: they are fewer than those that stay, so the side that is joined is small.
    """
    decided = written(_grouped(docs, id_col, text_col, **how).select(F.col("doc_id").alias("_gl_id"), "kept", F.col("whole").alias("_gl_whole")), "near-kept")
    goes = decided.where("_gl_id IS NOT NULL").groupBy("_gl_id").agg(F.max("kept").alias("kept")).where("NOT kept").select("_gl_id")
    own = F.col(f"`{id_col}`").cast("long")
    named = docs.where(own.isNotNull()).join(written(goes, "near-dropped"), own == F.col("_gl_id"), "left_anti")
    rest = _sequenced(docs.where(own.isNull()), text_col, "_gl_whole").dropDuplicates(["_gl_whole"])
    rest = rest.join(decided.where("_gl_id IS NULL AND kept").select("_gl_whole"), "_gl_whole", "left_semi")
    return named.unionByName(rest.select(*[F.col(f"`{c}`") for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
