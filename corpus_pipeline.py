"""A corpus pipeline over `documents`: quality rules, language identification, SimHash near-duplicates,
mixing to target weights, BPE encoding.  Each stage's rows are written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillgate.llm import langid, mixing, quality, simhash, tokens
from quillgate.llm.runtime import prepare, remove, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or lie outside the fertility bands.  Null and empty texts fail; repeated
    rows fare alike; no documents give none; the columns stay as they are, whatever they are named."""
    prepare(spark)
    return quality.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or of an ambiguous language.  Null and blank texts go; a null lang or id trains
    nothing; repeated rows fare alike; no documents give none; the columns stay as they are."""
    prepare(spark)
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near-duplicates: that of the least id, nulls last, of several such the one of
    the least digest.  Equal ids with other texts are documents of their own; null and wordless texts are copies of each
    other; no documents give none; the columns stay as they are."""
    prepare(spark)
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the sources' words meet their targets.  Null texts have no words and are taken at
    their source's rate; a null source is a source of its own; repeated rows count each; no documents give none."""
    prepare(spark)
    return mixing.take_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document.  A null or empty text has none; repeated rows give equal rows; no documents give none."""
    prepare(spark)
    return tokens.encode(docs, keep=["doc_id", "source"])


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("mixing", mixture),
    ("BPE encoding", encoding),
]

#: Pre-tokenising, hashing of shingles, trained models and rounding can't be written in DuckDB SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents, through the shared checkpoint folder.  Each stage's table is removed once
    the next one is written, and what a stage stored for itself once its own is; the last one's stays, as the result reads it."""
    prepare(spark)
    top = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if k:
            remove(spark, f"{top}/{k - 1}")
    return docs
