"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, secret scans, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import exact_dedup, packing, quality, secrets, simhash
from auditlake.llm.common import documents, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or a certified cutoff rejects go."""
    return quality.decide(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept").select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exact_dedup.distinct_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.one_of_each_group(docs)


def redacted_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced in its text."""
    return secrets.redact(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("secret scans", redacted_secrets),
    ("best-fit packing", packed_sequences),
]

#: Tokenisation, certified cutoffs and links within a Hamming radius have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
