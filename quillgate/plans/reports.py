"""Reports as ordered tables of lines (section, pos, line); text is made from them where it is written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgate.functions.strings import metric
from quillgate.operators import classify
from quillgate.operators.lineage import cut
from quillgate.operators.masking import EXCLUDED, escape_inline, safe_claims

_c = F.col

# Sections of a run's report in order
SECTIONS = [
    ("confirmed_facts", "Confirmed facts"), ("official_reported_status", "Official reported status"), ("market_observations", "Market observations"),
    ("reported_claims", "Reported claims"), ("interpretations", "Interpretations"), ("opinion_frame_risks", "Opinion and frame risks"),
    ("unverified_causality", "Unverified causality"), ("rumors", "Rumors"), ("needs_official_source", "Needs official source"),
    ("unobservable", "Unobservable material"), ("excluded", "Excluded or blocked material"),
]
# Categories of blocked finance claims
CATEGORIES = {
    "investment_advice_language": "investment_action", "target_price_language": "price_target", "position_sizing_language": "allocation",
    "trade_probability_language": "probability_or_outcome",
}
STATUSES = [("new", "New claims"), ("repeated", "Repeated claims"), ("disappeared", "Disappeared claims")]


def blocked_categories() -> Column:
    named = F.array_compact(F.array(*[F.when(F.array_contains("risk_flags", f), F.lit(c)) for f, c in CATEGORIES.items()]))
    return F.when(F.size(named) > 0, F.array_join(named, ", ")).otherwise("finance_policy_block")


def claim_line(detailed: bool = False) -> Column:
    """One line of a claim: its masked text, or a placeholder if it is excluded, and where it stands."""
    tags = F.when(F.size("risk_flags") > 0, F.array_join("risk_flags", ", ")).otherwise("none")
    stand = F.concat(F.lit("source: "), _c("source_name"), F.lit("; type: "), _c("claim_type"), F.lit("; risk: "), _c("risk_tier"), F.lit("; flags: "), tags, F.lit(")"))
    blocked = F.concat(F.lit(f"- {EXCLUDED} (blocked_categories: "), blocked_categories(), F.lit("; ")) if detailed else F.lit(f"- {EXCLUDED} (")
    return F.concat(F.when(_c("claim_type") == "excluded", blocked).otherwise(F.concat(F.lit("- "), _c("safe_text"), F.lit(" ("))), stand)


def _headed(spark, items: DataFrame, sections: list[tuple[str, str]], first: int) -> DataFrame:
    """items (name, at, line) under a heading for each section, with "- None" under empty ones."""
    heads = spark.createDataFrame([(first + i, n, f"## {t}") for i, (n, t) in enumerate(sections)], "section int, name string, line string")
    met = items.join(F.broadcast(heads.select("section", "name")), "name").select("section", _c("at").cast("long").alias("pos"), "line")
    none = heads.join(items.select("name").distinct(), "name", "left_anti").select("section", F.lit(0).cast("long").alias("pos"), F.lit("- None").alias("line"))
    return heads.select("section", F.lit(-1).cast("long").alias("pos"), "line").unionByName(met).unionByName(none)


def _text(spark, section: int, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(section, p, x) for p, x in enumerate(lines, -1)], "section int, pos long, line string")


def run_report(claims: DataFrame, order: str, title: str, detailed: bool = False) -> DataFrame:
    """Lines of the report of one run's classified claims: counts, a section for each bucket, a checklist.

    It refuses nothing itself; hold the claims to `gate_violations` first."""
    spark = claims.sparkSession
    rows = safe_claims(claims.withColumn("claim_id", _c("claim_id") if "claim_id" in claims.columns else _c(order).cast("string")))
    rows = cut(rows.drop("claim_text"))  # masked once; sections, headings and the checklist read it
    items = rows.select(classify.bucket(_c("claim_type")).alias("name"), _c(order).alias("at"), claim_line(detailed).alias("line"))
    counts = claims.groupBy("source_type").agg(F.count("*").alias("n"))
    counts = counts.select(F.lit(1).alias("section"), F.row_number().over(Window.orderBy("source_type")).cast("long").alias("pos"), F.format_string("- %s: %d", "source_type", "n").alias("line"))
    todo = rows.filter("needs_human_review").select(
        F.lit("todo").alias("name"), _c(order).alias("at"),
        F.concat(F.lit("- ["), _c("risk_tier"), F.lit("] "), _c("claim_id"), F.lit(": "), classify.review_question(), F.lit(" (reason: "), classify.review_reason(), F.lit(")")).alias("line"),
    )
    parts = [
        _text(spark, 0, [f"# {title}", "", "This report separates evidence from interpretation and is not financial advice."]),
        _text(spark, 1, ["## Claims by source type"]), counts, _headed(spark, items, SECTIONS, 2), _headed(spark, todo, [("todo", "Verification checklist")], 2 + len(SECTIONS)),
    ]
    return reduce(DataFrame.unionByName, parts)


def comparison_report(compared: DataFrame, title: str) -> DataFrame:
    """Lines of a comparison (key, status, still_unresolved): counts, then the keys of each status in order of key."""
    spark = compared.sparkSession
    totals = compared.groupBy("status").agg(F.count("*").alias("n"), F.count_if("still_unresolved").alias("open"))
    names = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(STATUSES)], "pos long, status string, title string")
    lines = names.join(totals, "status", "left").select(
        F.lit(1).alias("section"), "pos", F.format_string("- %s: %d, still unresolved: %d", "title", F.coalesce("n", F.lit(0)), F.coalesce("open", F.lit(0))).alias("line")
    )
    return _text(spark, 0, [f"# {title}", ""]).unionByName(lines)


def verdict_report(verdicts: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """Lines of the validation of responses: each verdict, then its errors in order of rule and detail."""
    spark = verdicts.sparkSession
    heads = verdicts.select(_c(key).cast("string").alias("k"), F.lit("").alias("o"), F.concat(F.lit("## "), _c(key).cast("string"), F.when(_c("valid"), ": PASS").otherwise(": FAIL")).alias("line"))
    found = errors.select(_c(key).cast("string").alias("k"), F.concat_ws("|", "rule", "detail").alias("o"), F.concat(F.lit("- "), escape_inline(F.concat_ws(": ", "rule", F.when(_c("detail") != "", _c("detail"))))).alias("line"))
    return spark.createDataFrame([("", "", "# Response validation")], "k string, o string, line string").unionByName(heads).unionByName(found)


def _table(rows: DataFrame, section: int, heads: list[str]) -> DataFrame:
    """rows (o, line) as lines under their heads, in the order of o, a text; a few rows for each detector and language."""
    spark = rows.sparkSession
    placed = rows.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy("o", "line")).cast("long").alias("pos"), "line")
    return _text(spark, section, heads).withColumn("pos", _c("pos") - len(heads)).unionByName(placed)


def gold_report(statuses: DataFrame, failures: DataFrame, detectors: DataFrame, accuracies: DataFrame, violations: DataFrame) -> DataFrame:
    """Lines of the evaluation of labelled cases: statuses and failures, detectors overall and by language, accuracies,
    masks.  Cases come by id, figures have three decimals, so the same cases give the same lines."""
    spark = statuses.sparkSession
    wanted = spark.createDataFrame([(0, "enforced", "Enforced"), (1, "aspirational", "Aspirational")], "k int, status string, title string")
    counts = wanted.join(statuses, "status", "left").select(
        F.lit(1).alias("section"), _c("k").cast("long").alias("pos"),
        F.format_string("- %s: %d/%d passing", "title", F.coalesce("passing", F.lit(0)), F.coalesce("total", F.lit(0))).alias("line"),
    )
    parts = [_text(spark, 0, ["# Evaluation Gold Set Report", ""]), _text(spark, 1, ["## Enforced vs Aspirational"]), counts]
    case = F.concat(F.lit("- `"), "case_id", F.lit("`: "))
    for k, (status, title) in enumerate((("enforced", "### Enforced failures (regressions)"), ("aspirational", "### Aspirational failures (gap list)")), 2):
        parts.append(_table(failures.filter(_c("status") == status).select(_c("case_id").alias("o"), F.concat(case, "reason").alias("line")), k, ["", title]))
    three = lambda c: metric(_c(c))
    row = F.concat(F.lit("| "), "detector", *[x for c in ("tp", "fp", "fn", "tn") for x in (F.lit(" | "), _c(c).cast("string"))], *[x for c in ("precision", "recall", "f1") for x in (F.lit(" | "), three(c))], F.lit(" |"))
    heads = ["| detector | tp | fp | fn | tn | precision | recall | f1 |", "|---|---|---|---|---|---|---|---|"]
    parts.append(_table(detectors.filter("language is null").select(_c("detector").alias("o"), row.alias("line")), 4, ["", "## Detector Metrics (overall)", "", *heads]))
    by = detectors.filter("language is not null").select(F.concat_ws("/", "language", "detector").alias("o"), F.concat(F.lit("| "), "language", F.lit(" "), row).alias("line"))
    parts.append(_table(by, 5, ["", "## Detector Metrics (by language)", "", "| language " + heads[0], "|---" + heads[1]]))
    rate = lambda of: F.concat(three(f"{of}_accuracy"), F.lit(" ("), _c(f"{of}_correct").cast("string"), F.lit("/"), _c(f"{of}_total").cast("string"), F.lit(")"))
    name = F.coalesce("language", F.lit("Overall"))
    said = F.concat(F.lit("- "), name, F.lit(": claim_type "), rate("claim_type"), F.lit(", tier "), rate("tier"))
    parts.append(_table(accuracies.select(F.coalesce("language", F.lit("")).alias("o"), said.alias("line")), 6, ["", "## Classification Accuracy", ""]))
    parts.append(_table(violations.select(_c("case_id").alias("o"), F.concat(case, "violations").alias("line")), 7, ["", "## Masking Violations", ""]))
    return reduce(DataFrame.unionByName, parts)


def write_lines(lines: DataFrame, path: str, order: list[str] = ["section", "pos"]) -> None:  # noqa: B006
    """Text files whose names' order is the lines' order; rows are cut into ranges, never into one task."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)
