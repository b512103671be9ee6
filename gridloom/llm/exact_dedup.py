"""Exact dedup by progressive refinement, in DataFrame functions only.

One scan turns every text into a small key row: normalised length, hash of a prefix, digest. Rows whose
length nobody shares are done; of the rest, those whose (length, prefix hash) nobody shares are done; only
what survives both is grouped by the full digest. No text is ever shuffled, and hot groups are counted with
map-side partial aggregation and joined back by a join that adaptive execution can split.

Defined results: a null text counts as empty, so null and blank texts form one group. Of equal texts the one
with most code points in the original stays, then the smallest id. Rows repeated under one id count each; one
of them is ``kept``. A null id is smaller than any. An empty table gives an empty result. Columns other than
the id and the text are not read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import written

WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Characters of the prefix, and shares into which rows of one length are dealt.
PREFIX, DEALT = 64, 16


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE_SPACE, "")


def _keys(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """The written key row of every row: doc_id, uid, normalised length, prefix hash, original length, digest, and ``more``."""
    norm = normalised(text_col)
    return written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("uid"),
            F.char_length(norm).alias("n"),
            F.xxhash64(F.substring(norm, 1, PREFIX)).alias("p"),
            F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("o"),
            F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"),
            *more,
        ),
        "exact-keys",
    )


def _copies(keys: DataFrame) -> DataFrame:
    """The written groups of two rows and more: digest, keep_id, keep_uid, group_size."""
    shared = F.count(F.lit(1)) > 1
    # rows of a common length are dealt out by their prefixes, and the few lengths go to each share of them
    deal = F.pmod("p", F.lit(DEALT))
    by_length = keys.groupBy("n").agg(shared.alias("s")).where("s").select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))).alias("d"))
    longer = keys.select("n", "p", deal.alias("d")).join(by_length, ["n", "d"], "left_semi")
    by_prefix = written(longer.groupBy("n", "p").agg(shared.alias("s")).where("s").select("n", "p"), "exact-prefixes")
    left = keys.join(by_prefix, ["n", "p"], "left_semi")
    return written(
        left.groupBy("digest")
        .agg(F.min(F.struct((-F.col("o")).alias("o"), "doc_id", "uid")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "group_size"),
        "exact-groups",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = _keys(docs, id_col, text_col)
    alone = F.col("group_size").isNull()
    return keys.join(_copies(keys), "digest", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_uid") == F.col("uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``.

    A row is known by its place in its Parquet file, so no key repeats, and text moves once at most, in the join
    that takes the dropped rows out. A table that isn't read from Parquet is written first.
    """
    names = docs.columns
    placed = _placed(docs)
    keys = _keys(placed, id_col, text_col, F.col("_gl_file"), F.col("_gl_row"))
    dropped = keys.join(_copies(keys).select("digest", "keep_uid"), "digest").where("uid <> keep_uid").select("_gl_file", "_gl_row")
    return placed.join(dropped, ["_gl_file", "_gl_row"], "left_anti").select(*[F.col(f"`{c}`") for c in names])


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with the file and the number in it of every row."""

    def of(df: DataFrame) -> DataFrame:
        place = df.metadataColumn("_metadata")
        return df.select("*", place["file_path"].alias("_gl_file"), place["row_index"].alias("_gl_row"))

    try:
        return of(docs)
    except AnalysisException:  # no files, or files of another format
        return of(written(docs, "exact-rows"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS o, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY o DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
