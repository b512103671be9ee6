"""The queries of this subpackage, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import context_tree, exact_dedup, langid, lattice_dedup, mixing, near_dedup, packing, secret_scan, toxicity, url_filter
from .work import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op2_lattice_dedup": lattice_dedup.query,
    "op3_exact_dedup": lambda spark, d: exact_dedup.exact_groups(table(spark, d, "documents")),
    "op4_dart_minhash": near_dedup.query,
    "op5_context_tree": context_tree.query,
    "op6_soft_mixing": mixing.query,
    "op7_url_filter": url_filter.query,
    "op8_secret_scan": secret_scan.query,
    "op9_language_id": langid.query,
    "op10_best_fit_packing": packing.query,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op2_lattice_dedup": lattice_dedup.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op7_url_filter": url_filter.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
