"""The queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, mixing, quality, secrets, setsketch, sharding, substring_dedup, token_store, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_copies(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return planned.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.round_trip(given.unionByName(more))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return scored.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    at, rules = F.col("found"), secrets.RULES
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[secrets.count_of(at, i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)],
        F.sha2(secrets.joined_spans(at, rules, len(secrets.BASE)), 256).alias("base_sha256"),
        secrets.joined_spans(at, rules).alias("spans"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return placed.select(F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


OPERATORS = (op1_substring_dedup, op2_source_mixing, op3_chat_formatting, op4_token_files, op5_decontamination, op6_warc, op7_near_dedup, op8_quality_rules, op9_secret_scan, op10_sharding)


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Sketches, files, fitted rules and codes have no SQL form; tests hold those queries against brute force."""
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
