"""Best-fit packing of token sequences by large-item matching, planned on the histogram of lengths.

A length is an integer from 1 to the capacity, so all documents together are at most ``capacity`` counts,
however many they are. The driver packs these counts: items above a third of the capacity are matched
greedily, largest with the largest that fits, at most two in a bin; smaller ones go, longest first, to the
bin whose gap fits best. The result is a table of slots (rank range of a length -> sequences, offset), whose
size the capacity bounds; each piece finds its slot by its rank among the pieces of its length. Ranks come
from per-task counters and a prefix sum over (length, task), so no task ever holds the pieces of one length.

Token ids are those of ``byte_bpe_50k.json``. The same vocabulary as ranks gives the same ids several times
faster; the name of a special token in a text is that token, as the tokenizer has it by default.

Defined results: a null text counts as empty and is one piece of one id (0). Documents of up to ``capacity``
ids stay whole; longer ones are cut from the end, so only the first piece may be shorter. Rows repeated
under one id are packed each. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textvec import slices
from .work import table, written

CAPACITY = 2048
RANKS = "byte_bpe_50k.tiktoken"
#: The added tokens of ``byte_bpe_50k.json``; the ranks leave them out.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=1)
def encoder(name: str = RANKS):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of ``n`` ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


def pack_counts(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """counts[L]: items of length L. Bins as (how many alike, [(length, how many in each)])."""
    left = [int(x) for x in counts]
    third = capacity // 3  # a length above it is more than a third
    bins: dict[int, list[list]] = {}  # by gap
    gaps: list[int] = []

    def put(gap: int, n: int, items: list[tuple[int, int]]) -> None:
        if n:
            if gap not in bins:
                bins[gap] = []
                insort(gaps, gap)
            bins[gap].append([n, items])

    large = [x for x in range(third + 1, capacity + 1) if left[x]]
    while large:
        big = large[-1]
        k = bisect_left(large, capacity - big + 1) - 1
        if k < 0:
            put(capacity - big, left[big], [(big, 1)])
            left[big] = 0
        elif (mate := large[k]) == big:
            put(capacity - 2 * big, left[big] // 2, [(big, 2)])
            left[big] %= 2
            if left[big]:
                k2 = k - 1
                if k2 >= 0:
                    put(capacity - big - large[k2], 1, [(big, 1), (large[k2], 1)])
                    left[large[k2]] -= 1
                else:
                    put(capacity - big, 1, [(big, 1)])
                left[big] = 0
        else:
            n = min(left[big], left[mate])
            put(capacity - big - mate, n, [(big, 1), (mate, 1)])
            left[big] -= n
            left[mate] -= n
        large = [x for x in large if left[x]]
    for small in range(third, 0, -1):
        n = left[small]
        while n:
            k = bisect_left(gaps, small)
            if k == len(gaps):
                each = min(capacity // small, n)
                put(capacity - each * small, n // each, [(small, each)])
                n %= each
                continue
            gap = gaps[k]
            group = bins[gap][-1]
            each = min(gap // small, n)
            m = min(group[0], n // each)
            put(gap - each * small, m, [*group[1], (small, each)])
            n -= m * each
            group[0] -= m
            if not group[0]:
                bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
                    gaps.remove(gap)
    return [(n, items) for gap in gaps for n, items in bins[gap]]


def slots(bins: list[tuple[int, list[tuple[int, int]]]], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """By length: columns first rank, how many in each bin, first sequence, offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for n, items in bins:
        offset = 0
        for length, each in items:
            rows.setdefault(length, []).append((int(used[length]), each, sequence, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    return {k: np.array(v, np.int64).T for k, v in rows.items()}


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ranks: str = RANKS) -> DataFrame:
    """Each piece with the task that made it and its rank among that task's pieces of its length; written."""
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = partial(encoder(ranks).encode, allowed_special="all"), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for whole in batches:
            for b in slices(whole, "text", 8 << 20):
                rows: list[list] = [[] for _ in range(6)]
                for i, text in enumerate(b.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), 0], "<u4")
                    for k, (start, n) in enumerate(cut(len(ids), capacity)):
                        for r, v in zip(rows, (i, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), seen[n])):
                            r.append(v)
                        seen[n] += 1
                cols = [pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(cols[0]), *cols[1:], pa.array([task] * len(cols[0]), pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"])

    return written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, nth long, task long"), "pieces")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ranks: str = RANKS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, id_col, text_col, capacity, ranks)
    per_task = written(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in per_task.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    plan = docs.sparkSession.sparkContext.broadcast(slots(pack_counts(counts, capacity), capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    first = per_task.select("length", "task", before.alias("before"))
    ranked = pieces.join(first, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    kind = ranked.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, edges) if len(order) else []:
                size = int(length[at[0]])
                first_rank, each, first_sequence, first_offset = plan.value[size]
                k = np.searchsorted(first_rank, rank[at], "right") - 1
                nth = rank[at] - first_rank[k]
                sequence[at] = first_sequence[k] + nth // each[k]
                offset[at] = first_offset[k] + nth % each[k] * size
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
