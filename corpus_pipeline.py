"""The corpus pipeline: from raw documents to packed sequences, one written table after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, near_copies, packing, quality_rules, secret_scan
from tidemark.llm.common import discard, table, written
from tidemark.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near a language's distributions."""
    return quality_rules.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, 5-word shingles with a Jaccard similarity of 0.8 or more: the one of the least doc_id."""
    return near_copies.deduplicated(docs, shingle=5, similar=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, secrets masked."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences of 4096."""
    return packing.packed(docs, tokenizer_path(), capacity=4096, end_id=1)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("decontamination", decontaminate), ("secret_scan", redact_secrets), ("packing", pack)]
#: Tokenizing and best-fit packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
            discard(last)
    return docs
