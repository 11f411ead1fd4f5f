"""The bundle's summary, comparison, verification packet and operator package as ordered tables of lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgate.functions.detectors import detect
from quillgate.functions.strings import no_headings
from quillgate.operators import analytics, bundle, classify, verification
from quillgate.operators.lineage import cut
from quillgate.operators.masking import EXCLUDED, escape_inline, mask, safe_claims

from .reports import _headed, _text

_c = F.col

# Sections of the summary and the comparison in order
SECTIONS = [
    ("low_risk", "Low-Risk Reported Material (deterministic classification only)"), ("weak", "Unsupported or Weakly Supported Claims"),
    ("other", "Other Reported Claims Needing Review"), ("rumor_social", "Rumor / Social / Manipulation-Framing Claims"),
    ("excluded", "Excluded Finance Claims Summary"), ("notes", "Source Conflict or Divergence Notes"),
]
COMPARED = [("new", "New Claims"), ("repeated", "Repeated Claims"), ("disappeared", "Disappeared Claims"), ("still_unresolved", "Still-Unresolved Risky Claims")]
TIERS = [("must_verify", "Must verify"), ("nice_to_verify", "Nice to verify"), ("unsafe_to_conclude", "Unsafe to conclude")]


def _notes(claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Divergent causes, divergent figures, texts that several sources carry; in this order."""
    causes = claims.filter("claim_type = 'unverified_causality'").agg(F.count("*").alias("n"), F.count_distinct(F.substring("safe_text", 1, 120)).alias("variants"))
    causes = causes.filter("n > 1 and variants > 1").select(F.lit(0).alias("at"), F.format_string("- Causal explanations diverge across sources (%d variants).", "variants").alias("line"))
    figures = conflicts.select(
        F.lit(1).alias("at"),
        F.format_string("- Numeric divergence requires review: %d reported values for %s (%s) across sources (%s).", "variants", "metric", "shown", "sources").alias("line"),
    )
    shared = analytics.cross_source_groups(claims).select(
        F.lit(2).alias("at"),
        F.format_string(
            "- Cross-source repeated claim group %s: identical/near-identical text repeated across %d sources (%s); repetition is not independent corroboration.", "group_id", "n_sources", "sources"
        ).alias("line"),
    )
    return causes.union(figures).union(shared).select(F.lit("notes").alias("name"), "at", "line")


def bundle_summary(claims: DataFrame, issue: str) -> DataFrame:
    """Lines of an issue's summary: claims by section, notes on divergence, and questions by severity.  `claims` is the
    ledger with `at`; excluded texts appear as placeholders only."""
    spark = claims.sparkSession
    shared = analytics.flag_shared(claims)
    rows = safe_claims(detect(bundle.with_caution(shared)).withColumn("section", bundle.section()))
    rows, figures = cut(rows), cut(bundle.numeric_conflicts(claims))  # masked once; sections and notes read them
    stand = F.concat(F.lit(" (source: "), _c("source_name"), F.lit("; type: "), _c("claim_type"), F.lit("; risk: "), _c("risk_tier"), F.lit(")"))
    tags = F.when(F.size("risk_flags") > 0, F.array_join("risk_flags", ", ")).otherwise("none")
    gone = F.concat(
        F.lit(f"- {EXCLUDED} id="), "source_name", F.lit("/"), "claim_id", F.lit(" (source: "), "source_name", F.lit("; claim_id: "), "claim_id", F.lit("; risk: "), "risk_tier", F.lit("; flags: "), tags, F.lit(")")
    )
    caution = F.when(_c("beside_excluded") & (_c("section") != "rumor_social"), bundle.CAUTION).otherwise("")
    line = F.when(_c("claim_type") == "excluded", gone).otherwise(F.concat(F.lit("- "), "safe_text", stand, caution))
    items = rows.select(_c("section").alias("name"), "at", line.alias("line")).unionByName(_notes(rows, figures))
    todo = claims.filter("needs_human_review").select("source_name", "risk_tier", "claim_id", "at", classify.review_reason().alias("reason"), classify.review_question().alias("verification_question"))
    asked = bundle.grouped_reviews(todo).select(*bundle_columns()).unionByName(bundle.numeric_review_items(figures).withColumn("at", F.lit((1 << 62))).select(*bundle_columns()))
    ask = F.concat(F.lit("- "), "claim_ids", F.lit(" ("), "source_name", F.lit("): "), "verification_question", F.lit(" (reason: "), "reason", F.lit(")"))
    first = 1 + len(SECTIONS)
    tiers = [(t, f"Follow-Up Verification Questions: {t.capitalize()} Priority") for t in bundle.SEVERITY]
    facts = claims.agg(F.count_distinct("source_name").alias("n")).select(F.lit(0).alias("section"), F.lit(9).cast("long").alias("pos"), F.format_string("- Source count: %d", "n").alias("line"))
    parts = [
        _text(spark, 0, ["# Issue Bundle Operator Summary", "", f"- Issue ID: {issue}"]), facts, _headed(spark, items, SECTIONS, 1),
        _headed(spark, asked.select(_c("risk_tier").alias("name"), "at", ask.alias("line")), tiers, first),
    ]
    return reduce(DataFrame.unionByName, parts)


def bundle_columns() -> list[str]:
    return ["source_name", "risk_tier", "reason", "verification_question", "claim_ids", "at"]


def comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines of a comparison: the claims of each status, masked, in order of key."""
    spark = before.sparkSession
    rows = bundle.compared_maps(bundle.claim_map(before, "at"), bundle.claim_map(after, "at"))
    rows = cut(safe_claims(rows.withColumns({"mode": F.lit("finance"), "claim_id": _c("key"), "source_name": F.array_join("sources", ", ")})))
    line = F.concat(F.lit("- "), "safe_text", F.lit(" (type: "), "claim_type", F.lit("; risk: "), "risk_tier", F.lit("; sources: "), "source_name", F.lit(")"))
    items = rows.select(_c("status").alias("name"), F.conv(F.substring("key", 1, 15), 16, 10).cast("long").alias("at"), line.alias("line"))
    return _text(spark, 0, ["# Issue Bundle Comparison", ""]).unionByName(_headed(spark, items, COMPARED, 1))


def verification_lines(claims: DataFrame, issue: str) -> DataFrame:
    """Lines of a verification packet: the work items, grouped, by tier, and how many there are."""
    spark = claims.sparkSession
    items = cut(verification.work_items(bundle.with_caution(claims), "at"))
    grouped = verification.grouped_items(items)
    reason = F.when(_c("reason") != "", F.concat(F.lit(" (reason: "), "reason", F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- "), F.array_join("claim_refs", ", "), F.lit(": "), "question", reason)
    counts = verification.question_counts(items).select(F.lit("counts").alias("name"), F.lit(0).alias("at"), F.format_string("- %s: %d items, %d groups", "tier", "raw", "grouped").alias("line"))
    parts = [_text(spark, 0, [f"# Verification packet: {issue}", ""]), _headed(spark, counts, [("counts", "Counts")], 1), _headed(spark, grouped.select(_c("tier").alias("name"), "at", line.alias("line")), TIERS, 2)]
    return reduce(DataFrame.unionByName, parts)


def operator_package(claims: DataFrame, issue: str) -> DataFrame:
    """Lines of the final package: counts by tier and type, excluded claims, unresolved claims."""
    spark = claims.sparkSession
    sets = claims.groupingSets([[_c("risk_tier")], [_c("claim_type")]], _c("risk_tier"), _c("claim_type")).agg(F.count("*").alias("n"))
    counts = sets.select(F.lit("counts").alias("name"), F.when(_c("risk_tier").isNull(), 1).otherwise(0).alias("at"), F.format_string("- %s: %d", F.coalesce("risk_tier", "claim_type"), "n").alias("line"))
    ref = F.concat(F.lit("- "), "source_name", F.lit("/"), "claim_id", F.lit(" (type: "), "claim_type", F.lit("; risk: "), "risk_tier", F.lit(")"))
    gone = claims.filter("claim_type = 'excluded'").select(F.lit("excluded").alias("name"), "at", ref.alias("line"))
    types = ["unverified_causality", "rumor", "unobservable", "needs_official_source", "excluded"]
    open_ = claims.filter(_c("risk_tier").isin("high", "critical") | _c("claim_type").isin(types)).select(F.lit("open").alias("name"), "at", ref.alias("line"))
    sections = [("counts", "Claim counts by risk tier and type"), ("excluded", "Excluded claims"), ("open", "Unresolved claims")]
    items = counts.withColumn("at", _c("at").cast("long")).unionByName(gone).unionByName(open_)
    head = [f"# Final Operator Package: {issue}", "", "- Safety note: for evidence review and verification planning; not financial advice."]
    return _text(spark, 0, head).unionByName(_headed(spark, items, sections, 1))


def imported_review(texts: DataFrame, text: str = "text") -> DataFrame:
    """Foreign review texts with `safe_text`: escaped, masked as finance, and without headings of their own."""
    rows = texts.withColumns({"__escaped": escape_inline(_c(text)), "__mode": F.lit("finance")})
    return mask(rows, "__escaped", "__mode", "safe_text").withColumn("safe_text", no_headings(_c("safe_text"))).drop("__escaped", "__mode")
