"""Review packets and the validation of external responses to them, for tables of any number of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.functions.rules import settle

from .analytics import packet_ids
from .classify import review_bucket, review_question, review_reason, verification_category
from .lineage import cut
from .masking import mask, safe_claims

_c = F.col

# Versions, required fields, safety checks and instructions
PACKET_VERSION, RESPONSE_VERSION = "llm-review-packet-v1", "mock-llm-review-v1"
FINDING_FIELDS = ["evidence_boundary", "must_not_conclude", "operator_next_step", "packet_id", "uncertainty_reason"]
SAFETY = {"contains_financial_advice": "false", "preserves_source_boundaries": "true", "fabricates_missing_evidence": "false"}
INSTRUCTIONS = {
    "high": "Treat as unresolved unless independent primary evidence is supplied.",
    "medium": "Treat as review-needed and preserve uncertainty.",
    "low": "Treat as low-risk only within the supplied source boundaries.",
}
# Conclusions and actions that a response may not state
BLOCKED = [
    r"\b(?:confirm(?:s|ed)?|verif(?:y|ies|ied)|proves?|proven|establish(?:es|ed)?|resolved)\b",
    r"\b(?:true cause|true reason|real reason)\b",
    r"\b(?:will|is going to|guaranteed to)\s+(?:rise|fall|rally|crash|go up|go down|outperform|underperform)\b",
    r"\b(?:buy|sell|short|long)\s+(?:now|this|the|[A-Z]{1,6}\b)",
    r"\b(?:accumulate|trim|add|reduce)\s+(?:shares?|exposure|position)\b",
    r"\b(?:go|move)\s+overweight\b",
    r"\bprice\s+(?:objective|level|target)\b",
    r"(?:매수|매도|손절|익절|목표가|목표\s*주가|비중\s*(?:확대|축소|조절|줄|늘)|수익률\s*\d)",
    r"(?:상승|하락)\s*여력\s*(?:은|는)?\s*\d",
    r"(?:공식\s*)?(?:확인|검증|입증|확정)(?:되었|됐|됨|됐다|했습니다|했다|된\s*것)",
    r"원인(?:이|으로)?\s*(?:확인|확정|규명)(?:되었|됐|됨|됐다|된\s*것)",
    r"전문가\s*분석(?:으로|에\s*따라)?\s*(?:확인|검증|입증|확정)",
]


def concludes(text: Column) -> Column:
    return text.rlike("(?iuU)" + "|".join(f"(?:{p})" for p in BLOCKED))


def negated(path: Column, text: Column) -> Column:
    """A safety instruction that says what not to conclude."""
    low = F.lower(text)
    return path.endswith("must_not_conclude") & (low.startswith("do not") | low.startswith("never") | low.contains("must not"))


#: The parser refuses documents of more levels as broken.
LEVELS = 1000


def _children(part: Column) -> Column:
    """The members of an object, or items of an array, with their paths; none of anything else."""
    under = lambda sign, v: F.struct(F.concat(part["path"], sign).alias("path"), v.alias("v"))
    members = F.transform(F.map_entries(part["v"].try_cast("map<string,variant>")), lambda e: under(F.concat(F.lit("."), e["key"]), e["value"]))
    items = F.transform(part["v"].try_cast("array<variant>"), lambda v, i: under(F.concat(F.lit("["), i.cast("string"), F.lit("]")), v))
    return F.coalesce(members, items, F.array().cast("array<struct<path:string,v:variant>>"))


def leaves(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, path, text: every string of the JSON documents at any depth; null and broken documents give none.

    Each document is taken apart level by level in its own row, so no level of all documents is dealt out or held: a task
    reads its documents and nothing else.  There are no more levels than signs that open one."""
    rows = settle(df.select(key, body), {"__text": _c(body).cast("string")})
    rows = settle(rows, {"__doc": F.try_parse_json("__text"), "__opened": F.regexp_count("__text", F.lit(r"[\[{]"))})
    is_string = lambda p: p["v"].try_cast("map<string,variant>").isNull() & p["v"].try_cast("array<variant>").isNull() & (F.schema_of_variant(p["v"]) == "STRING")
    strings = lambda parts: F.transform(F.filter(parts, is_string), lambda p: F.struct(p["path"].alias("path"), p["v"].cast("string").alias("text")))
    start = F.struct(
        F.array(F.struct(F.lit("$").alias("path"), _c("__doc").alias("v"))).alias("parts"), F.array().cast("array<struct<path:string,text:string>>").alias("found")
    )
    step = lambda held, _: F.struct(F.flatten(F.transform(held["parts"], _children)).alias("parts"), F.concat(held["found"], strings(held["parts"])).alias("found"))
    levels = F.sequence(F.lit(0), F.least(_c("__opened"), F.lit(LEVELS)))
    return rows.select(key, F.inline(F.aggregate(levels, start, step, lambda held: held["found"])))


def instruction(tier: Column) -> Column:
    return F.when(tier.isin("high", "critical"), INSTRUCTIONS["high"]).when(tier == "medium", INSTRUCTIONS["medium"]).otherwise(INSTRUCTIONS["low"])


def review_packets(claims: DataFrame, issue: str, order: str) -> DataFrame:
    """The index of claims to review: packet id, category, tier, bucket, masked text, instruction, reason, question."""
    rows = packet_ids(safe_claims(claims), issue, verification_category(), order)
    return rows.select(
        issue, order, "packet_id", "category", "source_name", "claim_type", "risk_tier", review_bucket(_c("risk_tier")).alias("review_bucket"),
        _c("safe_text").alias("claim_text_masked"), instruction(_c("risk_tier")).alias("review_instruction"), review_reason().alias("reason"), review_question().alias("verification_question"),
    )


def mock_findings(packets: DataFrame) -> DataFrame:
    """A finding for every packet (packet_id, source_name, risk_tier) that concludes nothing and so breaks no rule."""
    bound = F.concat(F.lit("Review only the supplied source-manifest artifacts for source `"), F.coalesce("source_name", F.lit("None")), F.lit("`; do not import outside knowledge."))
    return packets.select(
        "packet_id", bound.alias("evidence_boundary"), instruction(_c("risk_tier")).alias("uncertainty_reason"),
        F.lit("Check the verification packet and seek primary evidence before relying on this claim.").alias("operator_next_step"),
        F.lit("Do not conclude truth, causality, market action, expected return, or investment suitability.").alias("must_not_conclude"),
    )


def response_errors(responses: DataFrame, packets: DataFrame, key: str = "issue_id") -> DataFrame:
    """key, rule, detail: what is wrong with each response (key, body as JSON) to its packets (key, packet_id, risk_tier).

    A body that is null or no JSON object breaks one rule only.  A response whose packets are unknown altogether is
    not held to packet ids.  Findings are exploded, so one response may hold any number of them.  Bodies are stored
    first: what a later pass reads at a place in a list is then what an earlier one read there.
    """
    responses = cut(responses.select(key, "body"))
    known = packets.filter("packet_id <> ''").groupBy(key, "packet_id").agg(F.max_by("risk_tier", F.when(_c("risk_tier").isin("high", "critical"), 1).otherwise(0)).alias("risk_tier"))
    indexed = known.select(key).distinct().withColumn("indexed", F.lit(True))
    doc = F.try_parse_json("body")
    at = lambda p: F.try_variant_get("doc", p, "variant")
    kind = lambda p: F.coalesce(F.schema_of_variant(at(p)), F.lit("VOID"))
    text = lambda p: F.try_variant_get("doc", p, "string")
    rows = responses.select(key, "body", doc.alias("doc")).withColumn("ok", F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False)))
    good = rows.filter("ok")
    flag = lambda p, v: (kind(p) == "BOOLEAN") & F.coalesce(text(p) == v, F.lit(False))
    checks = [
        (F.coalesce(text("$.schema_version"), F.lit("")) != RESPONSE_VERSION, "schema_version"),
        (~F.coalesce(text("$.issue_id") == _c(key).cast("string"), F.lit(False)), "issue_id"),
        (~flag("$.advisory_only", "true"), "advisory_only"),
        (~kind("$.findings").startswith("ARRAY"), "findings is no list"),
        (~kind("$.safety_checks").startswith("OBJECT"), "safety_checks is no object"),
        *((~flag(f"$.safety_checks.{k}", v), f"safety_checks.{k}") for k, v in SAFETY.items()),
    ]
    top = good.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in checks]))).alias("rule"), F.lit("").alias("detail"))
    broken = rows.filter("not ok").select(key, F.lit("no JSON object").alias("rule"), F.lit("").alias("detail"))

    items = F.from_json(F.get_json_object("body", "$.findings"), "array<string>")
    found = good.select(key, F.posexplode(items).alias("pos", "finding")).withColumn("number", (_c("pos") + 1).cast("string"))
    objects = found.withColumn("keys", F.json_object_keys("finding"))
    no_object = objects.filter("keys is null").select(key, F.lit("finding is no object").alias("rule"), _c("number").alias("detail"))
    objects = objects.filter("keys is not null").withColumn("packet_id", F.get_json_object("finding", "$.packet_id"))
    lacking = F.array_except(F.array(*map(F.lit, FINDING_FIELDS)), "keys")
    missing = objects.filter(F.size(lacking) > 0).select(key, F.lit("finding lacks fields").alias("rule"), F.concat_ws(": ", "number", F.array_join(lacking, ", ")).alias("detail"))

    named = objects.select(key, "number", "pos", "packet_id", "finding").join(indexed, key, "left").join(known, [key, "packet_id"], "left")
    blank = F.coalesce(_c("packet_id"), F.lit("")) == ""
    unknown = _c("indexed").isNotNull() & _c("risk_tier").isNull()
    ids = named.select(key, F.when(unknown, "unknown packet_id").when(blank, "empty packet_id").alias("rule"), F.concat_ws(": ", "number", "packet_id").alias("detail")).filter("rule is not null")
    seen = named.filter(~unknown & ~blank).groupBy(key, "packet_id").agg(F.count("*").alias("n"))
    twice = seen.filter("n > 1").select(key, F.lit("duplicate packet_id").alias("rule"), _c("packet_id").alias("detail"))
    unseen = known.join(responses.select(key).distinct(), key, "left_semi").join(seen, [key, "packet_id"], "left_anti")
    unseen = unseen.select(key, F.when(_c("risk_tier").isin("high", "critical"), "missing high or critical packet_id").otherwise("missing packet_id").alias("rule"), _c("packet_id").alias("detail"))

    texts = cut(leaves(good, key, "body").filter((F.trim("text") != "") & ~negated(_c("path"), _c("text"))))  # taken apart once
    scanned = mask(texts.withColumn("mode", F.lit("finance")), "text", "mode", "safe")
    advice = scanned.filter("safe <> text").select(key, F.lit("blocked finance or advice language").alias("rule"), _c("path").alias("detail"))
    stated = texts.filter(concludes(_c("text"))).withColumn("pos", F.regexp_extract("path", r"^\$\.findings\[(\d+)\]", 1).try_cast("int"))
    upgrades = stated.select(key, "pos").distinct().join(named.filter(_c("risk_tier").isin("high", "critical")), [key, "pos"], "left_semi")
    upgrades = upgrades.select(key, F.lit("upgrades a high or critical claim").alias("rule"), (_c("pos") + 1).cast("string").alias("detail"))
    blocked = stated.select(key, F.lit("blocked confirmation or action language").alias("rule"), _c("path").alias("detail"))
    out = broken
    for part in (top, no_object, missing, ids, twice, unseen, advice, upgrades, blocked):
        out = out.unionByName(part)
    return out


def response_verdicts(responses: DataFrame, errors: DataFrame, key: str = "issue_id") -> DataFrame:
    """key, valid, n_errors of every response."""
    counts = errors.groupBy(key).agg(F.count("*").alias("n_errors"))
    out = responses.select(key).distinct().join(counts, key, "left")
    return out.select(key, _c("n_errors").isNull().alias("valid"), F.coalesce("n_errors", F.lit(0)).cast("long").alias("n_errors"))
