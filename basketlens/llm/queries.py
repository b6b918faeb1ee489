"""The registered query of each operator of this subpackage: the operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketlens.llm.bpe import round_trip
from basketlens.llm.chat import format_chats, probe, read_back
from basketlens.llm.decontaminate import decontaminate
from basketlens.llm.fingerprint import fingerprints
from basketlens.llm.mixing import mix
from basketlens.llm.near_dedup import near_duplicates
from basketlens.llm.periodic import looped, periodic_runs, run_digests
from basketlens.llm.quality import quality
from basketlens.llm.repair import damaged, repaired
from basketlens.llm.secrets import scan
from basketlens.llm.sharding import shards
from basketlens.llm.tokens import token_counts
from basketlens.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, as this query's contract has it."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(format_chats(probe(table(spark, sf_dir, "conversations"))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, hits = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", hits["n_words"].alias("n_words"), hits["n_hit"].alias("n_hit"), hits["n_items"].alias("n_items"), hits["items_sha256"].alias("items_sha256"), hits["contaminated"].alias("contaminated"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a tenth of the texts are looped first, as this query's contract has it."""
    return run_digests(periodic_runs(looped(table(spark, sf_dir, "documents"))))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows are damaged first, as this query's contract has it."""
    conversations = table(spark, sf_dir, "conversations")
    return repaired(conversations, damaged(conversations))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_near_dedup, op2_quality, op3_mixing, op4_sharding, op5_token_counts, op6_chat_format, op7_toxicity, op8_decontaminate, op9_secrets, op10_fingerprints, op11_periodic_runs, op12_byte_bpe, op13_conversation_repair)
}
