"""A corpus pipeline over documents: quality rules, near-dedup, secret removal, mixing to target weights, packing.

Each stage reads what the one before it wrote.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import mixing, near_copies, packing, quality_rules, secrets
from wayfare.llm.queries import ORACLES as OPERATOR_ORACLES
from wayfare.llm.queries import QUERIES as OPERATOR_QUERIES
from wayfare.llm.queries import table, tokenizer_path
from wayfare.session import shared_folder, ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the quality rules and cuts frequent lines out of the others."""
    ship_package(spark)
    return quality_rules.without_frequent_lines(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 or more of their five-word shingles) stays: the one with the smallest id."""
    ship_package(spark)
    return near_copies.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    ship_package(spark)
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate and its draw say."""
    ship_package(spark)
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    ship_package(spark)
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("secret_scans", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# SQL has no tokenizer, no forest and no XXH64: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{top}/{k}_{name}")
        docs = spark.read.parquet(path)
    return docs


QUERIES = {**OPERATOR_QUERIES, "pipeline": run}
ORACLES = {**OPERATOR_ORACLES, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
