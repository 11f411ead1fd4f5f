"""Labelled cases held against the rules: mismatches, confusion, accuracy, and the enforced and aspirational split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.functions import lexicon as lx

from .analytics import confusion
from .classify import classify
from .masking import mask

_c = F.col

# The detectors that a case may label, and the domains of its fields
LABELLED = {
    "causality": "d_causal", "market_terms": "d_market", "manipulation_framing": "d_manipulation", "action_language": "d_action",
    "target_price": "d_target", "position_sizing": "d_sizing", "trade_probability": "d_probability", "private_or_unobservable": "d_private",
}
REQUIRED = ["case_id", "text", "language", "mode", "source_type", "status"]
DOMAINS = {"language": ["en", "ko", "mixed"], "mode": ["finance", "general"], "source_type": lx.SOURCE_TYPES, "status": ["aspirational", "enforced"]}
EXPECTATIONS = ["detector_labels", "expected_claim_types", "expected_tiers", "masking"]
SCHEMA = (
    "case_id string, text string, language string, mode string, source_type string, status string, detector_labels map<string,boolean>,"
    " expected_claim_types array<string>, expected_tiers array<string>, masking struct<must_preserve array<string>, must_mask array<string>>"
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1), line: the non-blank lines of one file; a labelled set is small, its file is one row."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("pos", "line"))
    return lines.select((_c("pos") + 1).cast("long").alias("line_no"), F.trim("line").alias("line")).filter("line <> ''")


def case_problems(lines: DataFrame) -> DataFrame:
    """line_no, problem: every rule that a line breaks; a line that is no JSON object breaks that rule only."""
    rows = lines.withColumns({"keys": F.json_object_keys("line"), "doc": F.try_parse_json("line")})
    rows = rows.withColumn("ok", _c("keys").isNotNull() & F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False)))
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get("doc", f"$.{k}", "variant")), F.lit("VOID"))
    text = lambda k: F.try_variant_get("doc", f"$.{k}", "string")
    names = lambda k: F.json_object_keys(F.get_json_object("line", f"$.{k}"))
    items = lambda k: F.from_json(F.get_json_object("line", f"$.{k}"), "array<string>")
    alien = lambda a, known: F.coalesce(F.size(F.array_except(a, F.array(*map(F.lit, known)))) > 0, F.lit(False))
    is_list, is_object = lambda k: kind(k).startswith("ARRAY"), lambda k: kind(k).startswith("OBJECT")
    rules = [(~F.array_contains("keys", k), f"{k} is missing") for k in REQUIRED]
    rules += [(F.array_contains("keys", k) & ((kind(k) != "STRING") | (F.trim(text(k)) == "")), f"{k} must be a non-empty string") for k in ("case_id", "text")]
    rules += [(F.array_contains("keys", k) & ~F.coalesce(text(k).isin(d), F.lit(False)), f"{k} is outside its domain") for k, d in DOMAINS.items()]
    empty = lambda k: kind(k).isin("VOID", "ARRAY<VOID>", "OBJECT<>")
    rules.append((empty(EXPECTATIONS[0]) & empty(EXPECTATIONS[1]) & empty(EXPECTATIONS[2]) & empty(EXPECTATIONS[3]), "no expectation"))
    for k, known in (("detector_labels", list(LABELLED)), ("masking", ["must_preserve", "must_mask"])):
        rules += [((kind(k) != "VOID") & ~is_object(k), f"{k} must be an object"), (alien(names(k), known), f"{k} has unknown keys")]
    values = F.map_values(F.from_json(F.get_json_object("line", "$.detector_labels"), "map<string,string>"))
    rules.append((is_object("detector_labels") & F.exists(F.coalesce(values, F.array()), lambda v: ~F.coalesce(v.isin("true", "false"), F.lit(False))), "detector_labels must be boolean"))
    for k, known in (("expected_claim_types", lx.CLAIM_TYPES), ("expected_tiers", lx.RISK_TIERS)):
        rules += [((kind(k) != "VOID") & (~is_list(k) | (kind(k) == "ARRAY<VOID>")), f"{k} must be a non-empty list"), (is_list(k) & alien(items(k), known), f"{k} has unknown values")]
    rules += [(~kind(f"masking.{k}").isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>"), f"masking.{k} must be a list of strings") for k in ("must_preserve", "must_mask")]
    broken = F.when(~_c("ok"), F.array(F.lit("no JSON object"))).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules])))
    single = rows.select("line_no", F.explode(broken).alias("problem"))
    ids = rows.filter("ok").select("line_no", text("case_id").alias("case_id")).filter("case_id is not null")
    firsts = ids.groupBy("case_id").agg(F.min("line_no").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = ids.join(firsts, "case_id").filter("line_no > first")
    return single.union(again.select("line_no", F.concat(F.lit("duplicate case_id, first on line "), _c("first").cast("string")).alias("problem")))


def parse_cases(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("line", SCHEMA).alias("c")).select("c.*")


def evaluate(cases: DataFrame) -> DataFrame:
    """cases (SCHEMA) with predicted detectors (map), claim_type, risk_tier, type_match, tier_match (null without an
    expectation), violations (of masking), wrong_detectors and passed."""
    claims = cases.withColumns({"claim_text": _c("text"), "published_at": F.lit("2026-01-01"), "observable_state": F.lit("observable")})
    rows = mask(classify(claims), "claim_text", "mode", "safe_text")
    rows = rows.withColumn("predicted", F.create_map(*[x for k, d in LABELLED.items() for x in (F.lit(k), _c(d))]))
    labels = F.coalesce(F.map_entries("detector_labels"), F.array().cast("array<struct<key:string,value:boolean>>"))
    said_of = lambda e: F.coalesce(*[F.when(e["key"] == k, _c(d)) for k, d in LABELLED.items()])
    wrong = F.transform(F.filter(labels, lambda e: said_of(e) != e["value"]), lambda e: e["key"])
    gone = F.filter(F.coalesce(_c("masking.must_preserve"), F.array()), lambda s: ~F.contains(_c("safe_text"), s))
    left = F.filter(F.coalesce(_c("masking.must_mask"), F.array()), lambda s: F.contains(_c("safe_text"), s))
    said = F.concat(F.transform(gone, lambda s: F.concat(F.lit("lost: "), s)), F.transform(left, lambda s: F.concat(F.lit("left: "), s)))
    expects = lambda k: F.coalesce(F.size(k), F.lit(0)) > 0
    rows = rows.withColumns(
        {
            "wrong_detectors": F.array_sort(wrong),
            "type_match": F.when(expects("expected_claim_types"), F.array_contains("expected_claim_types", _c("claim_type"))),
            "tier_match": F.when(expects("expected_tiers"), F.array_contains("expected_tiers", _c("risk_tier"))),
            "violations": said,
        }
    )
    passed = (F.size("wrong_detectors") == 0) & F.coalesce("type_match", F.lit(True)) & F.coalesce("tier_match", F.lit(True)) & (F.size("violations") == 0)
    kept = [c for c in cases.columns]
    return rows.withColumn("passed", passed).select(*kept, "predicted", "claim_type", "risk_tier", "type_match", "tier_match", "violations", "wrong_detectors", "passed")


def detector_metrics(evaluated: DataFrame) -> DataFrame:
    """detector, language (null: overall), tp, fp, fn, tn, precision, recall, f1."""
    pairs = evaluated.select("language", "predicted", F.explode("detector_labels").alias("detector", "expected"))
    return confusion(pairs.select("language", "detector", "expected", F.element_at("predicted", _c("detector")).alias("predicted")), "language")


def accuracies(evaluated: DataFrame) -> DataFrame:
    """language (null: overall), totals and accuracies of claim types and tiers; null where nothing was expected."""
    rate = lambda k: F.avg(_c(k).cast("int"))
    return evaluated.rollup("language").agg(
        F.count("type_match").alias("claim_type_total"), F.count_if("type_match").alias("claim_type_correct"), rate("type_match").alias("claim_type_accuracy"),
        F.count("tier_match").alias("tier_total"), F.count_if("tier_match").alias("tier_correct"), rate("tier_match").alias("tier_accuracy"),
    )


def status_summary(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("status").agg(F.count("*").alias("total"), F.count_if("passed").alias("passing"), F.count_if(~_c("passed")).alias("failing"))


def violations(evaluated: DataFrame) -> DataFrame:
    """case_id, violations of the cases whose masks left or lost something."""
    return evaluated.filter(F.size("violations") > 0).select("case_id", F.array_join("violations", "; ").alias("violations"))


def failures(evaluated: DataFrame) -> DataFrame:
    """case_id, status, reason of the cases that fail."""
    parts = F.array(
        F.when(F.size("wrong_detectors") > 0, F.concat(F.lit("detectors: "), F.array_join("wrong_detectors", ", "))),
        F.when(~_c("type_match"), F.concat(F.lit("claim_type "), _c("claim_type"))),
        F.when(~_c("tier_match"), F.concat(F.lit("tier "), _c("risk_tier"))),
        F.when(F.size("violations") > 0, F.concat(F.lit("masking "), F.array_join("violations", ", "))),
    )
    return evaluated.filter(~_c("passed")).select("case_id", "status", F.array_join(F.array_compact(parts), "; ").alias("reason"))
