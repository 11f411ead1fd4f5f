"""Bundles of runs: their claims as one table, its sections, review items, maps of claims, and captures.

`claims` here has issue_id, run_id, source_name, claim_id, `at` (the claims' order) and what classification adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgate.functions.strings import slug

from .analytics import CASUALTY_METRIC, casualty_divergence, claim_key, hash16, numeric_divergence
from .classify import risky_unresolved, rumor_or_social
from .joins import join_groups
from .lineage import cut
from .names import free_names
from .numbering import number_within

_c = F.col

# Types of the sections, the metric of numeric conflicts, and who is named as their source
LOW_RISK = ["confirmed_fact", "official_reported_status", "market_observation", "reported_claim"]
WEAK = ["unverified_causality", "needs_official_source", "interpretation", "opinion_or_frame"]
METRIC, DIVERGENCE = "reported_numeric_value", "source_divergence"
SEVERITY = ["critical", "high", "medium", "low", "unknown"]
CAUTION = " Operator caution: this source also contains excluded finance material; do not treat adjacent interpretation as advice or verified fact."


def collect(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """Claims of all runs of a bundle with the index's source name and mode.  runs: run_id, source_name, mode; a run
    that the index does not name is left out.  Runs of very many claims are no hot keys."""
    index = runs.select("run_id", _c("source_name").alias("__name"), _c("mode").alias("__mode")).dropDuplicates(["run_id"])
    sizes = claims.groupBy("run_id").agg(F.count("*").alias("__n"))
    out = join_groups(claims, sizes.join(index, "run_id"), ["run_id"], "__n", "inner").drop("__n")
    return out.withColumns({"source_name": F.coalesce("__name", "source_name"), "mode": F.coalesce("__mode", F.lit("finance"))}).drop("__name", "__mode")


def section() -> Column:
    """Where the summary puts a claim: low_risk, weak, other, rumor_social or excluded.  Each claim has one place."""
    crowd = rumor_or_social()
    return (
        F.when(_c("claim_type") == "excluded", "excluded")
        .when(crowd, "rumor_social")
        .when((_c("risk_tier") == "low") & _c("claim_type").isin(LOW_RISK), "low_risk")
        .when(_c("claim_type").isin(WEAK), "weak")
        .otherwise("other")
    )


def with_caution(claims: DataFrame) -> DataFrame:
    """Claims with `beside_excluded`: is another claim of the source excluded?  Sources without a name have no such."""
    of = claims.groupBy("source_name").agg(F.count("*").alias("__n"), F.bool_or((_c("claim_type") == "excluded") & (_c("source_name") != "")).alias("__bad"))
    out = join_groups(claims, of, ["source_name"], "__n")
    return out.withColumn("beside_excluded", F.coalesce("__bad", F.lit(False)) & (_c("claim_type") != "excluded")).drop("__bad", "__n")


def numeric_conflicts(claims: DataFrame) -> DataFrame:
    """(metric, shown values, sources, variants): figures that sources give differently, people counts by event first."""
    people = casualty_divergence(claims).select(F.lit(CASUALTY_METRIC).alias("metric"), _c("event").alias("context"), _c("reported").alias("shown"), "sources", _c("n_values").alias("variants"))
    other = numeric_divergence(claims).select(F.lit(METRIC).alias("metric"), "context", "shown", "sources", F.size(F.split("shown", ", ")).cast("long").alias("variants"))
    return people.union(other)


def numeric_review_items(conflicts: DataFrame) -> DataFrame:
    """One item of medium risk for each conflict."""
    asked = F.concat(
        F.lit("Which primary or official record explains the "), "metric", F.lit(" divergence across values ("), "shown", F.lit(") and sources ("), "sources", F.lit(")?")
    )
    return conflicts.select(
        F.lit(DIVERGENCE).alias("source_name"), F.lit("medium").alias("risk_tier"), F.lit("numeric divergence").alias("reason"),
        asked.alias("verification_question"), F.concat(F.lit("numeric:"), "metric").alias("claim_ids"), F.lit(1).cast("long").alias("n"),
    )


REVIEW_KEYS = ["source_name", "risk_tier", "reason", "verification_question"]


def review_references(reviews: DataFrame) -> DataFrame:
    """The keys of each group of items that ask the same of the same source, with group_id, and its claims, one row each,
    numbered in order.  Null fields are empty; a claim without an id is none."""
    keys = [F.coalesce(k, F.lit("")).alias(k) for k in REVIEW_KEYS]
    each = reviews.filter(F.coalesce("claim_id", F.lit("")) != "").groupBy(*keys, "claim_id").agg(F.min("at").alias("at"))
    each = each.withColumn("group_id", hash16(F.concat_ws("\u0001", *REVIEW_KEYS)))
    return number_within(cut(each), ["group_id"], "at", "nth").drop("at")


def grouped_reviews(reviews: DataFrame) -> DataFrame:
    """Items that ask the same of the same source, with the ids of their claims in order, as one line of a report holds
    them; tables take `review_references`.  Null fields are empty."""
    keys = REVIEW_KEYS
    first = reviews.groupBy(*[F.coalesce(k, F.lit("")).alias(k) for k in keys], "claim_id").agg(F.min("at").alias("at"))
    ids = F.array_sort(F.collect_list(F.when(F.coalesce("claim_id", F.lit("")) != "", F.struct("at", "claim_id"))))
    groups = first.groupBy(*keys).agg(ids.alias("ids"), F.min("at").alias("at"), F.count("*").alias("n"))
    return groups.withColumn("claim_ids", F.array_join(F.transform("ids", lambda x: x["claim_id"]), ", ")).drop("ids")


def review_ids(reviews: DataFrame, run: str, order: str, bounds: list[float] | None = None) -> DataFrame:
    """Review items with review_id: rev_ and their place within the run."""
    return number_within(reviews, [run], order, "review_no", bounds=bounds).withColumn("review_id", F.format_string("rev_%03d", "review_no"))


def claim_map(claims: DataFrame, order: str) -> DataFrame:
    """One row for each claim key: its first claim's text, type, tier and source type, all sources, and whether any of
    its claims is risky and unresolved."""
    rows = claims.withColumn("key", claim_key())
    first = F.min_by(F.struct("claim_text", "claim_type", "risk_tier", "source_type"), order).alias("first")
    out = rows.groupBy("key").agg(first, F.array_sort(F.collect_set("source_name")).alias("sources"), F.bool_or(risky_unresolved()).alias("risky_unresolved"))
    return out.select("key", "first.*", "sources", "risky_unresolved")


def compared_maps(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of both maps by status: new, repeated, disappeared; a repeated claim that is risky on either side appears
    once more as still_unresolved.  What both have is shown as it is after."""
    old = before.select("key", F.struct("claim_text", "claim_type", "risk_tier", "source_type", "sources", "risky_unresolved").alias("old"))
    new = after.select("key", F.struct("claim_text", "claim_type", "risk_tier", "source_type", "sources", "risky_unresolved").alias("new"))
    both = old.join(new, "key", "full_outer")
    status = F.when(_c("old").isNull(), "new").when(_c("new").isNull(), "disappeared").otherwise("repeated")
    again = _c("old.risky_unresolved") | _c("new.risky_unresolved")
    statuses = F.array_compact(F.array(status, F.when(_c("old").isNotNull() & _c("new").isNotNull() & again, "still_unresolved")))
    return both.select(F.explode(statuses).alias("status"), "key", F.coalesce("new", "old").alias("row")).select("status", "key", "row.*")


def counts(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """What a manifest says of each run: claims, claims to review, sources."""
    per_run = claims.groupBy("issue_id").agg(F.count("*").alias("claim_count"), F.count_if("needs_human_review").alias("review_count"))
    return sources.groupBy("issue_id").agg(F.count("*").alias("source_count")).join(per_run, "issue_id", "left").na.fill(0)


# captures and acquisitions ---------------------------------------------------------------------------------------


def capture_files(captures: DataFrame, order: str, log: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Captures (issue_id, source_name) with a file name of their own, the first free one in order, and those whose name,
    ignoring case, came before in the issue or its log (issue_id, source_name, file_path).  `order` has each number once."""
    rows = captures.withColumn("__name", F.lower(F.trim("source_name")))
    nth = number_within(rows, ["issue_id", "__name"], order, "__nth")
    fresh, again = nth.filter("__nth = 1").drop("__nth"), nth.filter("__nth > 1").drop("__nth")
    empty = captures.sparkSession.createDataFrame([], "issue string, stem string")
    if log is not None:
        said = log.select(_c("issue_id").alias("__issue"), F.lower(F.trim("source_name")).alias("__said")).distinct()
        on = _c("issue_id").eqNullSafe(_c("__issue")) & _c("__name").eqNullSafe(_c("__said"))
        fresh, again = fresh.join(said, on, "left_anti"), again.unionByName(fresh.join(said, on, "left_semi"))
        stem = F.regexp_extract("file_path", r"([^/]*)\.txt$", 1)
        empty = log.select(_c("issue_id").alias("issue"), stem.alias("stem")).filter("stem <> ''")
    fresh = cut(fresh.drop("__name").withColumn("__slug", slug(_c("source_name"))))
    found = free_names(fresh.select(_c("issue_id").alias("issue"), _c("__slug").alias("slug"), _c(order).alias("at")), empty)
    named = found.select(_c("issue").alias("__issue"), _c("at").alias("__at"), F.concat("stem", F.lit(".txt")).alias("file_name"))
    out = fresh.join(named, _c("issue_id").eqNullSafe(_c("__issue")) & (_c(order) == _c("__at"))).drop("__slug", "__issue", "__at")
    return out, again.drop("__name")


def fetched(acquired: DataFrame) -> DataFrame:
    """Sources that were fetched and have a file."""
    return acquired.filter((_c("status") == "fetched") & (F.coalesce("file_path", F.lit("")) != ""))


# Content types of text
TEXT_TYPES = ["application/json", "application/xhtml+xml", "application/xml", "text/markdown", "text/xml"]


def content_problem(content_type: Column, size: Column, cap: int = 1_048_576) -> Column:
    """Why fetched content is refused: its type is no text, or it is too large; else null."""
    kind = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    return F.when(~(kind.startswith("text/") | kind.isin(TEXT_TYPES)), "content type not allowed").when(size > cap, "content too large")


def triage_counts(acquired: DataFrame) -> DataFrame:
    """How many sources were attempted, fetched, fetched with warnings, and not fetched."""
    got = F.coalesce(_c("status") == "fetched", F.lit(False))
    return acquired.agg(
        F.count("*").alias("attempted"), F.count_if(got).alias("fetched"),
        F.count_if(F.size(F.coalesce("warnings", F.array().cast("array<string>"))) > 0).alias("with_warnings"), F.count_if(~got).alias("not_fetched"),
    )
