"""Work items of verification: what must, and what may, be checked, and what no answer may conclude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import hash16, packet_ids
from .classify import EXCLUDED_QUESTION, verification_category
from .lineage import cut
from .numbering import number_within

_c = F.col

# Sentences of the items
MUST_REASON = "Claim requires verification before downstream use."
MUST_BESIDE = " This source also contains excluded finance material; do not treat adjacent interpretation as advice or verified fact."
NICE_REASON = "Useful for context, but does not by itself upgrade the claim."
NICE_BESIDE = "Useful for context, but this source also contains excluded finance material; independent verification is recommended before downstream use."
UNSAFE = [
    ("finance_advice_or_prediction", "Do not conclude investment action, target, allocation, trade probability, or expected profit from this excluded claim."),
    ("rumor_or_unobservable_material", "Do not conclude that the social/community or unobservable claim is true without observable primary evidence."),
    ("unsupported_causality", "Do not conclude a definitive cause from this claim."),
    ("overstatement", "Do not state more than the source directly supports."),
]


def source_family() -> Column:
    """The kind of record that could settle a claim."""
    low = F.lower(F.coalesce("claim_text", F.lit("")))
    exchange = low.contains("exchange") | low.contains("turnover") | low.contains("net selling")
    flagged = F.arrays_overlap("risk_flags", F.array(F.lit("market_causality_claim"), F.lit("true_cause_market_claim")))
    return (
        F.when(_c("claim_type") == "excluded", "operator_policy_review")
        .when((_c("source_type") == "official") & exchange, "exchange_announcement")
        .when(_c("source_type") == "official", "regulator_notice")
        .when(flagged, "official_market_data")
        .when(_c("claim_type") == "unobservable", "observable_primary_source")
        .when(_c("source_type").isin("community", "social"), "primary_source_or_official_statement")
        .when(_c("source_type") == "company", "company_statement")
        .otherwise("official_statement")
    )


def official_query() -> Column:
    check = F.concat(F.lit("Check official or primary records for claim "), "claim_id", F.lit(" from "), F.coalesce("source_name", F.lit("source")), F.lit("."))
    return F.when(_c("claim_type") == "excluded", EXCLUDED_QUESTION).otherwise(check)


def _unsafe(i: int) -> Column:
    return (
        F.when(_c("claim_type") == "excluded", UNSAFE[0][i])
        .when(_c("claim_type").isin("rumor", "unobservable") | _c("source_type").isin("community", "social"), UNSAFE[1][i])
        .when(_c("claim_type") == "unverified_causality", UNSAFE[2][i])
        .otherwise(UNSAFE[3][i])
    )


def unsafe_risk() -> Column:
    return _unsafe(0)


def _ref() -> Column:
    return F.concat_ws("/", F.coalesce("source_name", F.lit("source")), F.coalesce("claim_id", F.lit("claim")))


def _item_parts(claims: DataFrame) -> tuple[Column, Column, Column, Column]:
    """The claim's category, and its item in each tier."""
    category, name = verification_category(), F.coalesce("source_name", F.lit("source"))
    note = F.coalesce("classification_notes", F.lit(MUST_REASON)) if "classification_notes" in claims.columns else F.lit(MUST_REASON)
    must = F.struct(
        F.lit("must_verify").alias("tier"),
        F.concat(F.lit("Whether the claim from "), name, F.lit(" is supported by observable primary or official evidence.")).alias("question"),
        F.concat(note, F.when(_c("beside_excluded"), MUST_BESIDE).otherwise("")).alias("reason"),
        source_family().alias("source_family_hint"),
        F.lit("timestamped_record").alias("expected_evidence_type"),
    )
    nice = F.struct(
        F.lit("nice_to_verify").alias("tier"),
        F.concat(F.lit("Whether an independent reputable source reports the same limited factual statement for "), name, F.lit(".")).alias("question"),
        F.when(_c("beside_excluded"), NICE_BESIDE).otherwise(NICE_REASON).alias("reason"),
        F.lit("independent_reporting").alias("source_family_hint"),
        F.lit("corroborating_report").alias("expected_evidence_type"),
    )
    unsafe = F.struct(
        F.lit("unsafe_to_conclude").alias("tier"), _unsafe(1).alias("question"), F.lit("").alias("reason"), F.lit("").alias("source_family_hint"), F.lit("").alias("expected_evidence_type")
    )
    return category, must, nice, unsafe


def packets(claims: DataFrame, order: str = "at") -> DataFrame:
    """The packet of each claim (a ledger row with beside_excluded and safe_text): its ids, how it stands, its masked text
    and what must, may and cannot be concluded about it, as lists."""
    category, must, nice, unsafe = _item_parts(claims)
    ref = [_c("claim_id").alias("claim_id"), _ref().alias("claim_ref")]
    item = lambda of, *more: F.struct(*ref, *[of[k].alias(k) for k in ITEM_KEYS], *more)
    unsafes = F.struct(*ref, unsafe["question"].alias("question"), unsafe_risk().alias("risk_if_answered"))
    weak, low = _c("category").isin("unsupported_weak", "rumor_manipulation"), _c("category") == "confirmed_low_risk"
    when = lambda cond, x: F.array_compact(F.array(F.when(cond, x)))
    asked = F.struct(
        F.lit("What observable source or record would be sufficient to support this claim?").alias("question"), F.when(weak, "must_verify").otherwise("nice_to_verify").alias("applies_to"),
        F.lit("operator_review_required").alias("deterministic_check"),
    )
    rows = packet_ids(claims, "issue_id", category, order)
    return rows.select(
        _c(order).alias("at"), "packet_id", "issue_id", "claim_id", "source_name", "source_type", "claim_type", "risk_tier", _c("safe_text").alias("claim_text_safe"),
        _c("safe_text").alias("claim_text_masked"), _c("category").alias("claim_category"), when(weak, item(must, official_query().alias("official_source_query"))).alias("must_verify"), when(low, item(nice)).alias("nice_to_verify"),
        when(weak | (_c("category") == "excluded_finance"), unsafes).alias("unsafe_to_conclude"), F.array(asked).alias("evidence_questions"),
    )


def work_items(claims: DataFrame, order: str) -> DataFrame:
    """claims (with beside_excluded) -> one row for each item: tier (must_verify, nice_to_verify, unsafe_to_conclude), at, claim_id,
    claim_ref, question, reason, source_family_hint, expected_evidence_type.  Weak claims and rumors must be verified
    and not be concluded from; excluded ones are only not to be concluded from; the rest is nice to verify."""
    category, must, nice, unsafe = _item_parts(claims)
    items = (
        F.when(category.isin("unsupported_weak", "rumor_manipulation"), F.array(must, unsafe))
        .when(category == "excluded_finance", F.array(unsafe))
        .otherwise(F.array(nice))
    )
    return claims.select(_c(order).alias("at"), "claim_id", _ref().alias("claim_ref"), F.explode(items).alias("item")).select("item.tier", "at", "claim_id", "claim_ref", "item.question", "item.reason", "item.source_family_hint", "item.expected_evidence_type")


ITEM_KEYS = ["question", "reason", "source_family_hint", "expected_evidence_type"]


def item_references(items: DataFrame) -> DataFrame:
    """tier, group_id, nth, claim_ref: the claims of each group of items, one row each, numbered in order.  A group of very
    many claims is as many rows, never a list."""
    fields = [F.lower(F.trim(F.coalesce(k, F.lit("")))) for k in ITEM_KEYS]
    each = items.groupBy("tier", hash16(F.concat_ws("\u0001", "tier", *fields)).alias("group_id"), "claim_ref").agg(F.min("at").alias("at"))
    return number_within(cut(each), ["group_id"], "at", "nth").select("tier", "group_id", "nth", "claim_ref")


def grouped_items(items: DataFrame) -> DataFrame:
    """Items of a tier that agree in the four fields, ignoring case and outer space, as one: the first one's fields, the
    number of claims and the references in order, as one line of a report holds them; tables take `item_references`."""
    keys = [F.lower(F.trim(F.coalesce(k, F.lit("")))).alias(f"__{k}") for k in ITEM_KEYS]
    each = items.groupBy("tier", *keys, "claim_ref").agg(F.min("at").alias("at"), F.min_by(F.struct(*ITEM_KEYS), "at").alias("first"))
    out = each.groupBy("tier", *[f"__{k}" for k in ITEM_KEYS]).agg(
        F.min_by("first", "at").alias("first"), F.count("*").alias("n"), F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "claim_ref"))).alias("refs")
    )
    return out.select("tier", "at", "first.*", "n", F.transform("refs", lambda r: r["claim_ref"]).alias("claim_refs"))


def question_counts(items: DataFrame) -> DataFrame:
    """For each tier the number of items, and of groups of them."""
    key = F.concat_ws("\u0001", *[F.lower(F.trim(F.coalesce(k, F.lit("")))) for k in ITEM_KEYS])
    return items.groupBy("tier").agg(F.count("*").alias("raw"), F.count_distinct(key).alias("grouped"))
