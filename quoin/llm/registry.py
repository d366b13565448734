"""The numbered queries: each applies one operator to its whole table and keeps the
columns that its contract names. SQL for DuckDB stands beside those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm import oracles
from quoin.llm.decontaminate import decontaminate
from quoin.llm.html import extract
from quoin.llm.jaccard import near_duplicates
from quoin.llm.merkle import folded, manifest, proof_digest
from quoin.llm.mixing import mix
from quoin.llm.quality import quality_rules
from quoin.llm.search import search
from quoin.llm.secrets import find_secrets
from quoin.llm.shards import shard_by_bytes
from quoin.llm.substrings import remove_repeats
from quoin.llm.tokens import read_blocks, write_blocks
from quoin.llm.toxicity import score_toxicity
from quoin.llm.warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op5_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return read_blocks(write_blocks(table(spark, sf_dir, "documents"), path), path)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).drop("n_novel")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("class", "component")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(table(spark, sf_dir, "documents"))
    found = found.withColumn("folded_root", folded(F.coalesce("forged", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("sound")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_site_templates, op3_decontaminate, op4_shard_by_bytes, op5_repair_tokens, op6_substring_dedup, op7_toxicity, op8_secrets, op9_ngram_jaccard, op10_mix_sources, op11_ranked_search, op12_merkle_manifest, op13_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": oracles.QUALITY, "op3_decontaminate": oracles.DECONTAMINATE, "op4_shard_by_bytes": oracles.SHARDS, "op6_substring_dedup": oracles.REPEATS, "op9_ngram_jaccard": oracles.NEAR_DUPLICATES, "op10_mix_sources": oracles.MIX, "op11_ranked_search": oracles.SEARCH, "op12_merkle_manifest": oracles.MERKLE, "op13_warc": oracles.WARC}
