"""A training corpus from raw documents, in stages that are each written and read again.

Defined cases, in every stage: a null text counts as empty; rows of equal or null ids stay rows of their own, told apart by their text;
texts of any length are taken whole; extra columns are kept as they are, whatever their names; an empty table passes through. Rules
reject texts of under 50 words, null and empty ones among them; near-dedup keeps one of several equal rows; secrets and packing
take every row as it is; the mix leaves out rows that its targets don't reach, and takes others up to twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netquarry.llm.common import materialize, read_table
from netquarry.llm.mixing import mix_documents
from netquarry.llm.near_dedup import keep_first
from netquarry.llm.packing import pack
from netquarry.llm.quality_rules import quality_rules
from netquarry.llm.secret_scan import redact_secrets


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled quality rules keep."""
    return quality_rules(docs, read_table(spark, sf_dir, "labels"), keep_columns=True)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_first(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    return redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the mix, a row for every time one is taken."""
    return mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences with their token ids."""
    return pack(docs, with_ids=True)


STAGES = [
    ("quality rules", rules_stage),
    ("minhash near-dedup", dedup_stage),
    ("secret scan", secrets_stage),
    ("source mixing", mixing_stage),
    ("binary packing", packing_stage),
]

#: Token ids, hashed darts and trained models are beyond SQL; tests/llm holds the whole run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
