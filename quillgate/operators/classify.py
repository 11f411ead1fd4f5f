"""Flags, the decision table, risk tiers, review and the CASE expressions built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.functions import lexicon as lx
from quillgate.functions.detectors import DETECTORS, detect
from quillgate.functions.rules import once, settle

_c = F.col


def coerce_source_type(raw: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower case, dashes as underscores, aliases; what is no source type is `unknown`."""
    key = F.replace(F.lower(F.trim(raw)), F.lit("-"), F.lit("_"))
    for name, to in (aliases or {}).items():
        key = F.when(key == name, to).otherwise(key)
    return F.when(key.isin(lx.SOURCE_TYPES), key).otherwise("unknown")


@once
def flags(source_type: str = "source_type", mode: str = "mode", published_at: str = "published_at") -> Column:
    """Ordered distinct risk flags from the detector columns."""
    st, finance = _c(source_type), _c(mode) == "finance"
    moved = _c("d_market") | _c("d_motive")
    official_cause = (st == "official") & _c("d_causal") & moved
    elsewhere = st.isin("news", "analyst", "community", "social", "unknown", "user_note")
    rules = [
        (_c("d_causal"), "unsupported_causality"),
        (_c("d_framing"), "framing_risk"),
        (_c("d_loaded") | _c("d_manipulation"), "loaded_language"),
        (_c("d_certainty"), "strong_certainty_language"),
        (_c("d_action"), "action_recommendation_language"),
        (_c("d_private"), "private_or_inaccessible_source"),
        (_c("d_private"), "unobservable_evidence"),
        (st == "community", "community_source"),
        (st == "social", "social_source"),
        (F.coalesce(_c(published_at), F.lit("")).eqNullSafe("") & _c("d_recent"), "stale_or_missing_date"),
        (finance & ((_c("d_causal") & moved) | (_c("d_manipulation") & (moved | _c("d_flow")))), "market_causality_claim"),
        (finance & _c("d_causal") & _c("d_flow"), "flow_data_overinterpretation"),
        (finance & official_cause, "official_data_causality_mismatch"),
        (finance & (st == "analyst"), "analyst_interpretation"),
        (finance & st.isin("community", "social") & _c("d_market"), "community_market_signal_misuse"),
        (finance & (_c("d_action") | _c("d_hype")), "investment_advice_language"),
        (finance & _c("d_target"), "target_price_language"),
        (finance & _c("d_sizing"), "position_sizing_language"),
        (finance & _c("d_probability"), "trade_probability_language"),
        (finance & _c("d_true_cause"), "true_cause_market_claim"),
        ((finance & official_cause) | (elsewhere & F.when(finance, _c("d_market") | _c("d_causal")).otherwise(_c("d_causal"))), "needs_official_confirmation"),
    ]
    return F.array_distinct(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules])))


#: The decision table: guard, claim type, verification status, output level, confidence.  The first match wins.
@once
def decisions() -> list[tuple[Column, str, str, str, float]]:
    st, finance = _c("source_type"), _c("mode") == "finance"
    has = lambda *f: F.arrays_overlap(_c("risk_flags"), F.array(*map(F.lit, f)))
    crowd, noted = st.isin("community", "social"), st.isin("user_note", "unknown")
    causal, market, manip, number = _c("d_causal"), _c("d_market"), _c("d_manipulation"), _c("d_number")
    return [
        (finance & has(*lx.CRITICAL_FLAGS), "excluded", "blocked", "excluded", 0.9),
        (has("unobservable_evidence") | (_c("observable_state") == "unobservable"), "unobservable", "unobservable", "review_only", 0.2),
        (crowd & manip, "rumor", "unverified", "risk_bucket", 0.25),
        (crowd & causal, "unverified_causality", "unverified", "risk_bucket", 0.3),
        (crowd & has("framing_risk", "loaded_language", "strong_certainty_language"), "opinion_or_frame", "framing_risk", "risk_bucket", 0.35),
        (crowd, "reported_claim", "unverified", "reported_claim_bucket", 0.35),
        (
            (st == "official") & finance & causal & (market | _c("d_motive") | has("market_causality_claim", "flow_data_overinterpretation")),
            "unverified_causality", "unverified", "risk_bucket", 0.45,
        ),
        ((st == "official") & finance & market & number, "market_observation", "confirmed", "report_observation_bucket", 0.9),
        (st == "official", "official_reported_status", "reported", "report_observation_bucket", 0.8),
        ((st == "company") & causal & market, "unverified_causality", "unverified", "risk_bucket", 0.45),
        ((st == "company") & _c("d_self_serving"), "needs_official_source", "unverified", "review_only", 0.25),
        ((st == "company") & _c("d_forward_wide"), "interpretation", "likely", "interpretation_bucket", 0.4),
        (st == "company", "confirmed_fact", "confirmed", "report_fact_bucket", 0.75),
        ((st == "analyst") & finance & manip, "rumor", "unverified", "risk_bucket", 0.3),
        ((st == "analyst") & finance & causal & market & has("true_cause_market_claim"), "unverified_causality", "unverified", "risk_bucket", 0.4),
        (st == "analyst", "interpretation", "likely", "interpretation_bucket", 0.55),
        ((st == "news") & causal & (market | ~finance), "unverified_causality", "unverified", "risk_bucket", 0.4),
        ((st == "news") & finance & market & number, "market_observation", "reported", "report_observation_bucket", 0.55),
        ((st == "news") & has("framing_risk", "loaded_language"), "opinion_or_frame", "framing_risk", "risk_bucket", 0.4),
        (st == "news", "reported_claim", "reported", "reported_claim_bucket", 0.5),
        (noted & causal, "unverified_causality", "unverified", "risk_bucket", 0.3),
        (noted, "needs_official_source", "unverified", "review_only", 0.25),
    ]


# The note of each row of the decision table, in its order
DISALLOWED_REASON = "Finance mode blocks investment-action, price-level, allocation, and probability language."
NOTES = [
    DISALLOWED_REASON,
    "Claim depends on inaccessible or unobservable material.",
    "Community/social manipulation-style narrative is treated as rumor and requires review.",
    "Community/social causal claims cannot be confirmed facts.",
    "Community/social framing is treated as a signal, not fact.",
    "Community/social source is treated as unverified reported material.",
    "Official data can show what happened, but this causal statement still needs support.",
    "Official market data supports an observation, not motive.",
    "Official source status line is treated as cautious reported status.",
    "Company source does not confirm broad market causality.",
    "Company claim rests on internal/private evidence or an unverifiable third-party allegation; needs an official or primary source before it can be treated as fact.",
    "Company forward-looking, market-wide prediction is interpretation and cannot be a confirmed fact.",
    "Company source can support company-specific factual statements.",
    "Analyst manipulation-style framing remains unverified and requires review.",
    "Analyst true-cause market claims remain unverified.",
    "Analyst material is interpretation by default.",
    "News causal explanation needs primary or independent support.",
    "News reports a market observation; official source is preferred.",
    "News text contains framing risk.",
    "News is treated as reported material unless primary support is supplied.",
    "Unknown or user-provided causal claim needs verification.",
    "Source type is not strong enough for confirmation.",
]


@once
def _decided() -> Column:
    """The number of the first row of the table that holds."""
    out = None
    for i, rule in enumerate(decisions()):
        out = F.when(rule[0], F.lit(i)) if out is None else out.when(rule[0], F.lit(i))
    return out


@once
def _of_row(column: int) -> Column:
    return F.get(F.array(*[F.lit(r[column]) for r in decisions()]), _c("__row"))


@once
def risk_tier() -> Column:
    has = lambda f: F.arrays_overlap(_c("risk_flags"), F.array(*map(F.lit, f)))
    return (
        F.when((_c("mode") == "finance") & has(lx.CRITICAL_FLAGS), "critical")
        .when(_c("claim_type").isin(lx.HIGH_TYPES) | has(lx.HIGH_FLAGS), "high")
        .when(has(lx.MEDIUM_FLAGS), "medium")
        .otherwise("low")
    )


@once
def needs_review() -> Column:
    crowd = _c("source_type").isin("community", "social")
    return (
        _c("risk_tier").isin("high", "critical")
        | _c("output_level").isin("review_only", "excluded")
        | _c("claim_type").isin("unverified_causality", "unobservable")
        | ((_c("source_type") == "company") & (_c("claim_type") == "interpretation"))
        | (crowd & _c("claim_type").isin("opinion_or_frame", "rumor"))
    )


def normalised_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " ")), 256), 1, 16)


def classify(claims: DataFrame) -> DataFrame:
    """claims (claim_text, source_type, mode, published_at, observable_state, ...) with flags, type, status,
    level, confidence, notes, the reason if disallowed, tier, review, independent_source_count and normalized_claim_hash.  Detector columns stay."""
    out = settle(detect(claims), {"risk_flags": flags()})
    out = settle(out, {"__row": _decided()})
    notes = F.get(F.array(*map(F.lit, NOTES)), _c("__row"))
    decided = {"claim_type": _of_row(1), "verification_status": _of_row(2), "output_level": _of_row(3), "confidence": _of_row(4)}
    decided |= {"classification_notes": notes, "disallowed_reason": F.when(_c("__row") == 0, DISALLOWED_REASON)}
    out = settle(out, decided).drop("__row")
    out = settle(out, {"risk_tier": risk_tier()}).withColumn("needs_human_review", needs_review())
    fact = _c("claim_type").isin("confirmed_fact", "official_reported_status", "market_observation")
    return out.withColumns(
        {
            "independent_source_count": F.when(fact & _c("source_type").isin("official", "company"), 1).otherwise(0),
            "normalized_claim_hash": normalised_hash(_c("claim_text")),
        }
    )


def ledger(classified: DataFrame) -> DataFrame:
    """Without the detectors' columns."""
    return classified.drop(*DETECTORS)


# Buckets of a report
BUCKETS = {
    "confirmed_fact": "confirmed_facts", "official_reported_status": "official_reported_status",
    "market_observation": "market_observations", "reported_claim": "reported_claims", "interpretation": "interpretations",
    "opinion_or_frame": "opinion_frame_risks", "unverified_causality": "unverified_causality", "rumor": "rumors",
    "needs_official_source": "needs_official_source", "unobservable": "unobservable", "excluded": "excluded",
    "question_to_verify": "questions_to_verify",
}


def bucket(claim_type: Column) -> Column:
    out = None
    for k, v in BUCKETS.items():
        out = F.when(claim_type == k, v) if out is None else out.when(claim_type == k, v)
    return out.otherwise("excluded")


def review_bucket(tier: Column) -> Column:
    return (
        F.when(tier.isin("high", "critical"), "unsafe_or_high_risk_review_only")
        .when(tier == "medium", "review_needed")
        .otherwise("low_risk_within_source_boundary")
    )


@once
def verification_category() -> Column:
    return (
        F.when(_c("claim_type") == "excluded", "excluded_finance")
        .when(_c("claim_type").isin("rumor", "unobservable") | _c("source_type").isin("community", "social"), "rumor_manipulation")
        .when(_c("claim_type").isin("unverified_causality", "needs_official_source", "opinion_or_frame", "interpretation"), "unsupported_weak")
        .otherwise("confirmed_low_risk")
    )


def rumor_or_social() -> Column:
    return _c("claim_type").isin("rumor", "unobservable") | _c("source_type").isin("community", "social") | _c("d_manipulation")


def risky_unresolved() -> Column:
    return (
        _c("claim_type").isin("unverified_causality", "needs_official_source", "unobservable", "rumor", "excluded")
        | _c("risk_tier").isin("high", "critical")
        | _c("needs_human_review")
    )


# Reasons and questions of review items
REASONS = [
    ("true_cause_market_claim", "unsafe true-cause market claim"), ("unobservable_evidence", "unobservable evidence"),
    ("market_causality_claim", "unsupported market causality"), ("unsupported_causality", "unsupported causality"),
    ("needs_official_confirmation", "needs official confirmation"),
]
DISALLOWED = "finance advice or prediction language"
EXCLUDED_QUESTION = (
    "This finance claim is blocked by policy and remains excluded. If factual context is needed, capture a separate factual claim"
    " from a primary source."
)
QUESTIONS = [
    ("unobservable_evidence", "What observable source can replace or corroborate the inaccessible material?"),
    ("market_causality_claim", "What official or independent evidence supports this market-causality claim?"),
    ("needs_official_confirmation", "Which official or primary source can confirm the factual part of this claim?"),
]
LAST_QUESTION = "What source or context should be checked before trusting this claim?"


def _by_flag(first: Column, pairs: list[tuple[str, str]], last: str) -> Column:
    for flag, value in pairs:
        first = first.when(F.array_contains("risk_flags", flag), value)
    return first.otherwise(last)


@once
def review_reason() -> Column:
    return _by_flag(F.when(_c("claim_type") == "excluded", DISALLOWED), REASONS, "human review required")


@once
def review_question() -> Column:
    return _by_flag(F.when(_c("claim_type") == "excluded", EXCLUDED_QUESTION), QUESTIONS, LAST_QUESTION)
