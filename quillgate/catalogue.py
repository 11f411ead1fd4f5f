"""The catalogue: ledgers of many runs as tables, each partitioned by issue, the claims by run as well.

    claims, reviews    by issue and run        what a run found
    sources, runs      by issue                a run's source, and the index of an issue's runs
    manifests          by issue                the sources as the manifest names them

A run that is stored again replaces its own partitions and no other's.  Only what an issue's index names counts for
it, so that a run which its manifest no longer names is there, but in no report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.operators import analytics, bundle, classify
from quillgate.operators.joins import join_groups
from quillgate.sources.intake import exists

_c = F.col

PARTITIONS = {"claims": ["issue", "run"], "reviews": ["issue", "run"], "sources": ["issue"], "runs": ["issue"], "manifests": ["issue"]}
#: Claims of a run that go to one file, about; a run of more is several files, so that no task writes a whole one.
CLAIMS_A_FILE = 100_000
SOURCE = [
    "issue_id", "run_id", "source_id", "source_type", "source_name", "source_url", "title", "published_at", "captured_at", "observable_state", "raw_input_path", "mode", "sequence",
]


def source_ledger(sources: DataFrame, captured_at: str | Column) -> DataFrame:
    """The record of each source of a manifest (issue_id, at, source_name, source_type, mode, file_path and what else it says)."""
    has = lambda k: _c(k) if k in sources.columns else F.lit(None).cast("string")
    at = captured_at if isinstance(captured_at, Column) else F.lit(captured_at)
    return sources.select(
        "issue_id", F.concat_ws("/", "issue_id", "source_name").alias("run_id"), F.lit("src_001").alias("source_id"), "source_type", "source_name", has("source_url").alias("source_url"),
        F.coalesce(has("title"), F.regexp_extract(has("file_path"), r"([^/\\]*)$", 1)).alias("title"), has("published_at").alias("published_at"), F.coalesce(has("captured_at"), at).alias("captured_at"),
        F.lit("observable").alias("observable_state"), has("file_path").alias("raw_input_path"), "mode", _c("at").cast("long").alias("sequence"),
    )


def review_ledger(claims: DataFrame) -> DataFrame:
    """The items to review of claims with `source_no` and `claim_no`, numbered within their run."""
    todo = claims.filter("needs_human_review").select("issue_id", "run_id", "source_name", "claim_id", "claim_no", "risk_tier", F.lit("open").alias("status"), classify.review_reason().alias("reason"), classify.review_question().alias("verification_question"))
    return bundle.review_ids(todo, "run_id", "claim_no").drop("review_no")


def run_index(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each run: its source, mode and place, and how much it holds.  A run without claims has none."""
    held = claims.groupBy("run_id").agg(F.count("*").alias("claim_count"), F.count_if("needs_human_review").alias("review_count"))
    own = sources.select("issue_id", "run_id", "sequence", "mode", "source_name", "source_type", _c("raw_input_path").alias("file_path"))
    return own.join(held, "run_id", "left").na.fill(0, ["claim_count", "review_count"])


def _keyed(df: DataFrame, table: str) -> DataFrame:
    return df.withColumns({"issue": _c("issue_id"), **({"run": _c("run_id")} if "run" in PARTITIONS[table] else {})})


def store(table: str, df: DataFrame, root: str) -> None:
    """df in place of the partitions that it names."""
    rows, keys = _keyed(df, table), PARTITIONS[table]
    # A run's claims are dealt out by blocks, so that partitions get few files and a task no whole run.
    block = [F.floor(_c("claim_no") / CLAIMS_A_FILE)] if "claim_no" in df.columns else []
    rows.repartition(*keys, *block).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{root}/{table}")


@dataclass
class Catalogue:
    """The tables of a catalogue, as they are on disk: the issue and run to read prune partitions."""

    spark: SparkSession
    root: str

    def table(self, name: str, issue: str | None = None, run: str | None = None) -> DataFrame:
        if not exists(self.spark, f"{self.root}/{name}"):
            raise ValueError(f"missing artifact: {self.root}/{name}")
        rows = self.spark.read.parquet(f"{self.root}/{name}")
        for key, wanted in (("issue", issue), ("run", run)):
            if wanted is not None:
                rows = rows.filter(_c(key) == wanted)
        return rows

    def run(self, issue: str, run: str) -> dict[str, DataFrame]:
        """The four ledgers of one run."""
        indexed = self.table("runs", issue).filter(_c("run_id") == run)
        return {"manifest": indexed, "sources": self.table("sources", issue).filter(_c("run_id") == run)} | {t: self.table(t, issue, run) for t in ("claims", "reviews")}

    def collect(self, issue: str) -> DataFrame:
        """The claims of all runs that the issue's index names, with the source's mode by the manifest and `at`, their order."""
        claims = bundle.collect(self.table("claims", issue), self.table("runs", issue))
        modes = source_modes(self.table("manifests", issue))
        return with_source_mode(claims, modes).withColumn("at", claim_order())


def claim_order() -> Column:
    """Sources in the order of their manifest, the claims of each in the order of its text."""
    return F.coalesce("source_no", F.lit(0)).cast("long") * F.lit(1 << 32) + _c("claim_no")


def source_modes(manifest: DataFrame) -> DataFrame:
    """issue_id, source_name, source_mode of a manifest's sources (with `at`): of a name that comes again the last mode."""
    named = manifest.filter(F.coalesce("source_name", F.lit("")) != "")
    return named.groupBy("issue_id", "source_name").agg(F.max_by("mode", "at").alias("source_mode"))


def with_source_mode(claims: DataFrame, modes: DataFrame) -> DataFrame:
    """Claims with the mode that their manifest gives their source, null if it names none.  A source of very many claims is
    no hot key."""
    keys = ["issue_id", "source_name"]
    sizes = claims.groupBy(*keys).agg(F.count("*").alias("__n"))
    return join_groups(claims, sizes.join(modes, keys, "left"), keys, "__n").drop("__n")


def mask_mode() -> Column:
    """The mode by which a packet of verification masks: finance only where the manifest says so."""
    return F.when(_c("source_mode") == "finance", "finance").otherwise("general")


# integrity ----------------------------------------------------------------------------------------------------------


def broken(claims: DataFrame, sources: DataFrame, entity: str = "claim_id") -> DataFrame:
    """entity, id, rule: what is wrong with the sources' records, with claims' keys to them, and with the claims."""
    keyed = analytics.missing_sources(claims, sources).select(F.lit("claim").alias("entity"), _c(entity).cast("string").alias("id"), F.lit("source is missing").alias("rule"))
    own = analytics.gate_violations(claims, entity).select(F.lit("claim").alias("entity"), _c(entity).cast("string").alias("id"), "rule")
    return analytics.source_violations(sources).unionByName(keyed).unionByName(own)
