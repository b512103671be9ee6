"""A training corpus from raw documents: five stages, each written as Parquet and read again for the next.

Each stage is (name, function of spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of documents. ``labels`` is read to train classifiers. A stage can be run again from the table
before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from gridloom.llm.work import crc_mod, table, written

#: Quality mix of the corpus; domains only grow, so no document is lost, and none is there more than ``MOST`` times.
TARGETS = {"good": 0.85, "poor": 0.15}
MOST = 16


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    net = toxicity.learn(table(spark, sf_dir, "documents"), labels.where(crc_mod("doc_id", 5) != 0))
    return toxicity.drop_toxic(docs, net)


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    domains = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mixed_documents(docs, domains, TARGETS, grow_only=True, most=MOST)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact),
    ("minhash_near_dedup", _near),
    ("mixing", _mixing),
    ("best_fit_packing", _packing),
]

#: Trained networks and subword ids have no SQL; tests/llm checks every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
