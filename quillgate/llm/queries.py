"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, funnel, html, langid, merkle, mixing, oracle, quality, sharding, simhash, tokens, vectors, weak
from .runtime import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason"
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak.score(table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = decontaminate.n_hit(F.col("spans"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def op12_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.funnels(table(spark, sf_dir, "clicks"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = [docs[c] for c in merkle.FIELDS]
    text = F.when(F.pmod(F.crc32(docs.doc_id.cast("string").cast("binary")), F.lit(2)) == 0, F.replace(docs.text, F.lit("\n"), F.lit(""))).otherwise(docs.text)
    leaves = docs.select("doc_id", "source", merkle.leaf(*own).alias("leaf"), merkle.leaf(*own[:-1], text).alias("found"))
    rows = merkle.manifest(leaves, keep=["doc_id", "leaf", "found"])
    again = merkle.folded(F.col("found"), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root"), (again == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_sharding": op5_sharding,
    "op6_weak_labels": op6_weak_labels,
    "op7_embeddings": op7_embeddings,
    "op8_html": op8_html,
    "op9_language": op9_language,
    "op10_token_counts": op10_token_counts,
    "op11_decontamination": op11_decontamination,
    "op12_funnel": op12_funnel,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL
