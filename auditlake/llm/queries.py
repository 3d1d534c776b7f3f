"""The queries of the training-data operators, one for each, over whole tables. ORACLE_SQL has the SQL of those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown, exact_dedup, packing, quality, secrets, simhash, substring_dedup, suffix_dedup, token_counts, vector_codes, warc, whitening
from .common import documents, spread
from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(spread(documents(spark, sf_dir)))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = secrets.find_secrets(documents(spark, sf_dir), keep=["doc_id"])
    base = F.filter("found", lambda x: x["kind"].isin([r.kind for r in secrets.BASE]))
    rows = rows.select("row.doc_id", "found", base.alias("base"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("bigint").alias(f"n_{r.kind}") for r in secrets.BASE]
    return rows.select("doc_id", *counts, F.sha2(secrets.spelled(F.col("base")), 256).alias("base_sha256"), secrets.spelled(F.col("found")).alias("spans"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.decide(spread(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id", "lang"])
    return rows.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(spread(documents(spark, sf_dir)))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(spread(documents(spark, sf_dir)))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def op9_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(spread(documents(spark, sf_dir)))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread(documents(spark, sf_dir)))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_suffix_dedup, op3_token_counts, op4_secrets, op5_warc, op6_quality_rules, op7_bpe, op8_simhash, op9_brown_scores, op10_packing, op11_substring_dedup, op12_whitening, op13_vector_codes,
    )
}
