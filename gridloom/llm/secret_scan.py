"""Secret scans with corpus-wide ownership frequency.

Pass 1 reads every whole text once and writes the spans found: the three base kinds and ``opaque``
candidates (long mixed tokens outside base spans). Pass 2 counts, for the hash of each found value, the
distinct repositories and owners that hold it; a value that more than ``most_owners`` owners share is a
widely copied example, one that few hold and that is no placeholder is a live-looking credential. Opaque
candidates become spans only if they are live-looking; base spans always stay.

Hot values are counted after (hash, repository, owner) has been made distinct, with map-side partial
aggregation, so that a value in a third of all rows is a handful of rows by the time it is shuffled.

Defined results: a null text counts as empty and has no spans; the SHA-256 of no base spans is that of the
empty string; null sources are one owner of their own; repeated rows are scanned each on its own, and
count once as owners; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textvec import slices, utf8
from .work import table, written

KINDS = ("assign", "access", "hex", "opaque")
_ANY = {c: f"[{c}{c.upper()}]" for c in "abcdefghijklmnopqrstuvwxyz"}
_NAME = "|".join("".join(_ANY.get(c, c) for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_NAME})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

_is_hex = np.zeros(256, bool)
_is_hex[[*b"0123456789abcdef"]] = True
_is_opaque = np.zeros(256, bool)
_is_opaque[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"]] = True


def base_spans(text: str, with_hex: bool = True) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value), by start, then kind as listed."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if with_hex:
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def live_looking(value: str) -> bool:
    """Letters and digits, many different characters, no word that marks a placeholder."""
    low = value.lower()
    if any(x in low for x in ("example", "sample", "changeme", "placeholder", "xxxx", "1234567")):
        return False
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    return entropy >= 3.0 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def opaque_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    found = []
    for m in OPAQUE.finditer(text):
        if live_looking(m[0]) and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            found.append((m.start(), 3, m.end(), m[0]))
    return found


def _rows_with_run(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, least: int) -> np.ndarray:
    """Which rows have a run of ``least`` bytes of the class (it may reach into the next row: a superset)."""
    inside = np.concatenate([[False], member[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    hit = np.zeros(len(offsets) - 1, bool)
    for a, b in zip(np.searchsorted(offsets, begin[long], "right") - 1, np.searchsorted(offsets, end[long] - 1, "right") - 1):
        hit[a : b + 1] = True
    return hit


_FOUND = "uid long, at array<struct<s:long,k:int,e:long,h:long,live:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64()), ("h", pa.int64()), ("live", pa.bool_())]))
    for whole in batches:
        for b in slices(whole, "text"):
            data, offsets = utf8(b.column(1))
            hexed, opaque = _rows_with_run(data, offsets, _is_hex, 24), _rows_with_run(data, offsets, _is_opaque, 20)
            out = []
            for text, x, o in zip(b.column(1).to_pylist(), hexed, opaque):
                spans = base_spans(text or "", bool(x))
                if o:
                    spans = sorted(spans + opaque_spans(text, spans))
                out.append([{"s": s, "k": k, "e": e, "h": int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True), "live": live_looking(v)} for s, k, e, v in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["uid", "at"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), most_owners: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``at``, an array of (s, k, e, n_repos, n_owners, live) in order."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.xxhash64(*repo_cols).alias("repo"))
    kind = named.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = list(_scan(iter([pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column(1)], names=["uid", "text"])])))
            at = pa.concat_arrays([x.column(1) for x in done]) if done else None
            if at is not None:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), at], names=["doc_id", "owner", "repo", "at"])

    found = named.mapInArrow(scan, f"doc_id {kind}, owner string, repo long, {_FOUND.split(', ', 1)[1]}")
    found = written(found.withColumn("uid", F.monotonically_increasing_id()), "secrets-found")
    each = found.where(F.size("at") > 0).select("uid", "owner", "repo", F.explode("at").alias("x"))
    held = each.select(F.col("x.h").alias("h"), "repo", "owner").distinct()
    freq = written(held.groupBy("h").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners")), "secrets-owners")
    known = each.select("uid", "x.*").join(freq, "h").withColumn("live", F.col("live") & (F.col("n_owners") <= most_owners))
    spans = known.where("k < 3 OR live").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("s", "k", "e", "n_repos", "n_owners", "live"))).alias("at"))
    return found.select("uid", "doc_id").join(spans, "uid", "left").select("doc_id", F.coalesce("at", F.array().cast(spans.schema["at"].dataType)).alias("at"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = secret_spans(table(spark, sf_dir, "documents"))
    kind = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("at", lambda x: x["k"] == k)).cast("long")
    return df.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(joined(F.filter("at", lambda x: x["k"] < 3)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("at")).alias("spans"),
        F.size(F.filter("at", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("at", lambda x: ~x["live"])).cast("long").alias("n_copied"),
    )
