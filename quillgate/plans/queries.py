"""Every query of the ledger engine over the driver's tables, whole, and the SQL that must give the same rows.

Claims are composed: a template sentence (which of them follows from the id) before the document's whole text, so
that the rules have something to find.  Sources, modes and dates follow from the document's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.functions import lexicon as lx
from quillgate.functions import strings
from quillgate.operators import analytics, bundle, claims, classify, goldset, masking, reviews, verification, viewer
from quillgate.operators.lineage import cut
from quillgate.operators.numbering import order_bounds
from quillgate.plans import reports, stated
from quillgate.sources import intake

TEMPLATES = [
    "The market fell because investors sold.", "Officials said the program is scheduled to start.", "Everyone knows this proves manipulation.",
    "The index closed at 2640 points.", "Buy now before it is too late.", "The target price was raised again.", "A private chat showed the plan.",
    "The true reason was donor pressure.", "Turnover rose due to net buying.", "The policy disaster is obvious.", "Our internal investigation ended.",
    "The outlook is market-wide and calm.", "Allocate 20% of your portfolio here.", "There is a 70% chance of a rise.", "The fund could return a large gain.",
    "A farmers market opened in town.", "The crash is inevitable.", "Shares are still under 800 dollars.", "Better hop on the ride.",
    "The real reason is hidden today.", "증시가 금리 인상 때문에 하락했다.", "외국인 순매도가 이어졌다.", "지금 매수하세요 종목 추천합니다.", "목표주가 5만원을 제시했다.",
    "비중을 삼십 프로 확대하세요.", "확률 70 이상이다.", "단톡방에서 들었다.", "작전주라는 말이 있다.", "진짜 이유는 따로 있다.", "원인은 아직 밝혀지지 않았다.",
    "업계 전반이 개선될 전망이다.", "오늘 코스피 지수가 올랐다.", "The report was filed on time.", "Insiders quietly sold shares before the news.",
    "No cause was stated for the delay.", "Media is hiding the evidence.", "The policy is not investment advice.", "The yield reached 4.25 percent.",
    "Analysts maintain an overweight on banks.", "The exchange published its notice.",
]


#: Notes of candidates, and first lines of packages, by id
CANDIDATE_NOTES = ["", "Press release", "a reddit thread", "Analyst memo", "Community blog", "memo on crypto", "Investor day", "stock forum"]
PACKAGE_HEADS = ["", "Issue ID: alpha 1 \nSources: 3\n", "- [a](b)\n* [c](d) [e](f)\n", "Analysis Run #1, analysis run 2\nLow-risk claim\n", "Med risk, HIGH-RISK\nsource count : 12\n"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores is dealt out to all of them first; larger ones are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def seed(spark: SparkSession, sf: str, plain: bool = False) -> DataFrame:
    """Documents as claims: with a template sentence before the text, or as they are."""
    prefixes = F.array(*map(F.lit, TEMPLATES))
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d+)$", 1).try_cast("int")
    kinds = F.array(*map(F.lit, lx.SOURCE_TYPES))
    return spread(table(spark, sf, "documents")).select(
        "doc_id",
        F.concat(*([] if plain else [F.get(prefixes, (F.pmod("doc_id", F.lit(len(TEMPLATES)))).cast("int")), F.lit(" ")]), F.coalesce("text", F.lit(""))).alias("claim_text"),
        F.coalesce("source", F.lit("none")).alias("source_name"),
        F.coalesce(F.get(kinds, F.pmod(number, F.lit(8))), F.lit("unknown")).alias("source_type"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, "general").otherwise("finance").alias("mode"),
        F.when(F.pmod("doc_id", F.lit(5)) != 0, F.lit("2026-01-01")).alias("published_at"),
        F.lit("observable").alias("observable_state"),
        F.when(F.pmod("doc_id", F.lit(2)) == 0, "before").otherwise("after").alias("issue_id"),
    )


_SEED = f"""seed AS (SELECT doc_id,
  (list_value({", ".join(map(_q, TEMPLATES))}))[(doc_id % {len(TEMPLATES)}) + 1] || ' ' || coalesce(text, '') AS claim_text,
  coalesce(source, 'none') AS source_name,
  coalesce((list_value({", ".join(map(_q, stated.SOURCE_TYPES))}))[(try_cast(regexp_extract(coalesce(source, ''), '(\\d+)$', 1) AS INT) % 8) + 1], 'unknown') AS source_type,
  CASE WHEN doc_id % 3 = 0 THEN 'general' ELSE 'finance' END AS mode,
  CASE WHEN doc_id % 5 <> 0 THEN '2026-01-01' END AS published_at,
  CASE WHEN doc_id % 2 = 0 THEN 'before' ELSE 'after' END AS issue_id FROM documents)"""


def _detected() -> str:
    cols = ",\n  ".join(f"{sql} AS {k}" for k, sql in stated.DETECTED.items())
    gone = "|".join(f"(?:{p})" for p in stated.DISCLAIMERS)
    return f"""base AS (SELECT *, lower(claim_text) AS low, regexp_replace(claim_text, '(?i){gone}', ' ', 'g') AS adv,
  lower(regexp_replace(claim_text, '(?i){gone}', ' ', 'g')) AS advlow FROM seed),
det AS (SELECT * EXCLUDE (low, adv, advlow), {cols} FROM base)"""


def _flag_sql() -> str:
    fin, moved = "mode = 'finance'", "(d_market OR d_motive)"
    official = f"(source_type = 'official' AND d_causal AND {moved})"
    rules = [
        ("d_causal", "unsupported_causality"), ("d_framing", "framing_risk"), ("d_loaded OR d_manipulation", "loaded_language"),
        ("d_certainty", "strong_certainty_language"), ("d_action", "action_recommendation_language"), ("d_private", "private_or_inaccessible_source"),
        ("d_private", "unobservable_evidence"), ("source_type = 'community'", "community_source"), ("source_type = 'social'", "social_source"),
        ("published_at IS NULL AND d_recent", "stale_or_missing_date"),
        (f"{fin} AND ((d_causal AND {moved}) OR (d_manipulation AND ({moved} OR d_flow)))", "market_causality_claim"),
        (f"{fin} AND d_causal AND d_flow", "flow_data_overinterpretation"), (f"{fin} AND {official}", "official_data_causality_mismatch"),
        (f"{fin} AND source_type = 'analyst'", "analyst_interpretation"),
        (f"{fin} AND source_type IN ('community', 'social') AND d_market", "community_market_signal_misuse"),
        (f"{fin} AND (d_action OR d_hype)", "investment_advice_language"), (f"{fin} AND d_target", "target_price_language"),
        (f"{fin} AND d_sizing", "position_sizing_language"), (f"{fin} AND d_probability", "trade_probability_language"),
        (f"{fin} AND d_true_cause", "true_cause_market_claim"),
        (f"({fin} AND {official}) OR (source_type IN ('news', 'analyst', 'community', 'social', 'unknown', 'user_note') AND CASE WHEN {fin} THEN d_market OR d_causal ELSE d_causal END)", "needs_official_confirmation"),
    ]
    items = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in rules)
    return f"flagged AS (SELECT *, [x for x in list_value({items}) if x IS NOT NULL] AS risk_flags FROM det)"


def _has(*names: str) -> str:
    return f"list_has_any(risk_flags, list_value({', '.join(map(_q, names))}))"


def _decision_sql() -> str:
    fin, crowd, noted = "mode = 'finance'", "source_type IN ('community', 'social')", "source_type IN ('user_note', 'unknown')"
    rows = [
        (f"{fin} AND {_has(*stated.CRITICAL_FLAGS)}", "excluded", "blocked", "excluded", 0.9), (_has("unobservable_evidence"), "unobservable", "unobservable", "review_only", 0.2),
        (f"{crowd} AND d_manipulation", "rumor", "unverified", "risk_bucket", 0.25), (f"{crowd} AND d_causal", "unverified_causality", "unverified", "risk_bucket", 0.3),
        (f"{crowd} AND {_has('framing_risk', 'loaded_language', 'strong_certainty_language')}", "opinion_or_frame", "framing_risk", "risk_bucket", 0.35),
        (crowd, "reported_claim", "unverified", "reported_claim_bucket", 0.35),
        (f"source_type = 'official' AND {fin} AND d_causal AND (d_market OR d_motive OR {_has('market_causality_claim', 'flow_data_overinterpretation')})", "unverified_causality", "unverified", "risk_bucket", 0.45),
        (f"source_type = 'official' AND {fin} AND d_market AND d_number", "market_observation", "confirmed", "report_observation_bucket", 0.9),
        ("source_type = 'official'", "official_reported_status", "reported", "report_observation_bucket", 0.8),
        ("source_type = 'company' AND d_causal AND d_market", "unverified_causality", "unverified", "risk_bucket", 0.45),
        ("source_type = 'company' AND d_self_serving", "needs_official_source", "unverified", "review_only", 0.25),
        ("source_type = 'company' AND d_forward_wide", "interpretation", "likely", "interpretation_bucket", 0.4),
        ("source_type = 'company'", "confirmed_fact", "confirmed", "report_fact_bucket", 0.75),
        (f"source_type = 'analyst' AND {fin} AND d_manipulation", "rumor", "unverified", "risk_bucket", 0.3),
        (f"source_type = 'analyst' AND {fin} AND d_causal AND d_market AND {_has('true_cause_market_claim')}", "unverified_causality", "unverified", "risk_bucket", 0.4),
        ("source_type = 'analyst'", "interpretation", "likely", "interpretation_bucket", 0.55),
        (f"source_type = 'news' AND d_causal AND (d_market OR NOT {fin})", "unverified_causality", "unverified", "risk_bucket", 0.4),
        (f"source_type = 'news' AND {fin} AND d_market AND d_number", "market_observation", "reported", "report_observation_bucket", 0.55),
        (f"source_type = 'news' AND {_has('framing_risk', 'loaded_language')}", "opinion_or_frame", "framing_risk", "risk_bucket", 0.4),
        ("source_type = 'news'", "reported_claim", "reported", "reported_claim_bucket", 0.5), (f"{noted} AND d_causal", "unverified_causality", "unverified", "risk_bucket", 0.3),
        (noted, "needs_official_source", "unverified", "review_only", 0.25),
    ]
    case = lambda i: "CASE " + " ".join(f"WHEN {r[0]} THEN {_q(r[i]) if isinstance(r[i], str) else f'CAST({r[i]} AS DOUBLE)'}" for r in rows) + " END"
    types = ", ".join(map(_q, stated.HIGH_TYPES))
    return f"""typed AS (SELECT *, {case(1)} AS claim_type, {case(2)} AS verification_status, {case(3)} AS output_level, {case(4)} AS confidence FROM flagged),
tiered AS (SELECT *, CASE WHEN {fin} AND {_has(*stated.CRITICAL_FLAGS)} THEN 'critical' WHEN claim_type IN ({types}) OR {_has(*stated.HIGH_FLAGS)} THEN 'high'
  WHEN {_has(*stated.MEDIUM_FLAGS)} THEN 'medium' ELSE 'low' END AS risk_tier FROM typed),
claims AS (SELECT *, (risk_tier IN ('high', 'critical') OR output_level IN ('review_only', 'excluded') OR claim_type IN ('unverified_causality', 'unobservable')
  OR (source_type = 'company' AND claim_type = 'interpretation') OR ({crowd} AND claim_type IN ('opinion_or_frame', 'rumor'))) AS needs_human_review,
  substr(sha256(trim(regexp_replace(lower(claim_text), '\\s+', ' ', 'g'))), 1, 16) AS normalized_claim_hash FROM tiered)"""


def _claims_sql() -> str:
    return f"WITH {_SEED}, {_detected()}, {_flag_sql()}, {_decision_sql()}"


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return classify.classify(seed(spark, sf))


def claims_by_type_tier(spark, sf):
    return classified(spark, sf).groupBy("source_type", "claim_type", "risk_tier").agg(F.count("*").alias("n"), F.count_if("needs_human_review").alias("n_review"))


def claim_ledger(spark, sf):
    return classified(spark, sf).select(
        "doc_id", "source_type", "mode", "claim_type", "verification_status", "output_level", "confidence", "risk_tier", "needs_human_review",
        F.array_join("risk_flags", ",").alias("flags"), "normalized_claim_hash",
    )


def flag_histogram(spark, sf):
    return classified(spark, sf).select(F.explode("risk_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def bucket_counts(spark, sf):
    return analytics.bucket_counts(classified(spark, sf))


def source_histograms(spark, sf):
    sets = [[F.col("source_type")], [F.col("observable_state")], [F.col("mode")]]
    cols = [F.col("source_type"), F.col("observable_state"), F.col("mode")]
    return seed(spark, sf).groupingSets(sets, *cols).agg(F.count("*").alias("n"))


def tier_and_type_counts(spark, sf):
    return classified(spark, sf).groupingSets([[F.col("risk_tier")], [F.col("claim_type")]], F.col("risk_tier"), F.col("claim_type")).agg(F.count("*").alias("n"))


def review_queue(spark, sf):
    rows = classified(spark, sf).filter("needs_human_review")
    return rows.select("doc_id", "risk_tier", classify.review_reason().alias("reason"), classify.review_question().alias("question"))


def grouped_review_items(spark, sf):
    rows = classified(spark, sf).filter("needs_human_review").select("source_name", "risk_tier", "doc_id", classify.review_reason().alias("reason"))
    return rows.groupBy("source_name", "risk_tier", "reason").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def line_first_wins(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).filter("line <> ''")
    return lines.groupBy("doc_id", F.lower("line").alias("key")).agg(F.min("pos").cast("int").alias("pos")).select("doc_id", "pos", F.sha2("key", 256).alias("key"))


def claim_split(spark, sf):
    return claims.extract_claims(spread(table(spark, sf, "documents")), ["doc_id"]).select("doc_id", "claim_no", "claim_id", "claim_text")


def plain_claims(spark, sf):
    """Documents themselves as claims, for what repeats between them."""
    return classify.classify(seed(spark, sf, plain=True))


def _bounds(spark, sf):
    """Of the ids, from the scan alone: nothing is classified for them."""
    return order_bounds(table(spark, sf, "documents"), "doc_id")


def exact_repetition(spark, sf):
    rows = cut(seed(spark, sf, plain=True).select("doc_id", "issue_id", classify.normalised_hash(F.col("claim_text")).alias("normalized_claim_hash")))
    return analytics.exact_repetition(rows, "issue_id", "doc_id", _bounds(spark, sf)).select("issue_id", "doc_id", "source_count", "duplicate_group_id")


def fuzzy_repetition(spark, sf):
    return analytics.fuzzy_repetition(plain_claims(spark, sf), "issue_id", "doc_id").select("issue_id", F.sha2("variant_key", 256).alias("variant"), "members", "first_member")


def repetition_ledger(spark, sf):
    """The ledger after the policy on repetition."""
    rows = analytics.with_variants(plain_claims(spark, sf))
    rows = cut(rows.select("issue_id", "doc_id", "risk_tier", "risk_flags", "independent_source_count", "normalized_claim_hash", "variant_key"))
    out = analytics.repetition_policy(rows, "issue_id", "doc_id", _bounds(spark, sf))
    return out.select("issue_id", "doc_id", "duplicate_group_id", "source_count", "independent_source_count", "risk_tier", F.array_join("risk_flags", ",").alias("flags"), "lineage_note")


def shared_flags(spark, sf):
    rows = cut(analytics.keyed(plain_claims(spark, sf).select("doc_id", "source_name", "claim_type", "claim_text", "risk_flags")).select("doc_id", "source_name", "risk_flags", "bundle_key"))
    return analytics.flag_shared(rows).select("doc_id", "bundle_duplicate_group_id", F.array_join("risk_flags", ",").alias("flags"))


def cross_source_groups(spark, sf):
    rows = cut(analytics.keyed(plain_claims(spark, sf).select("source_name", "claim_type", "claim_text")).select("source_name", "bundle_key"))
    return analytics.cross_source_groups(rows).select("group_id", "key", "claims", "sources", "n_sources")


EVENTS = ["flood", "train accident", "factory fire", "storm"]


REPORTS = ["{} people were injured after the flood.", "{} people were injured after the train accident.", "{} people were injured by the factory fire.", "{} people were treated after the storm."]
METRICS = [
    "회사 매출은 {}조 3,000억원으로 집계됐다.", "영업이익이 {}억원이라고 밝혔다.", "The benchmark lending rate reached {}.5 percent.", "Quarterly factory output totalled {},200 units.",
    "The mean depth of the well was {}.7 metres.",
]


def _split_claims(spark, sf, forms, number):
    """The claims with a figure of whole texts, each text led by a sentence with a number.  Sections without one are not taken apart."""
    form = F.get(F.array(*map(F.lit, forms)), F.pmod("doc_id", F.lit(len(forms))).cast("int"))
    lead = F.replace(form, F.lit("{}"), number.cast("string"))
    rows = spread(table(spark, sf, "documents")).select(F.coalesce("source", F.lit("none")).alias("source_name"), F.concat(lead, F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("text"))
    found = claims.extract_claims(claims.sections_with(rows, analytics.FIGURE), ["source_name"]).filter(F.col("claim_text").rlike(analytics.FIGURE))
    return found.select("source_name", "claim_text", F.lit("reported_claim").alias("claim_type"))


def casualty_divergence(spark, sf):
    return analytics.casualty_divergence(_split_claims(spark, sf, REPORTS, F.pmod("doc_id", F.lit(7)) + 11)).drop("sources")


def numeric_divergence(spark, sf):
    return analytics.numeric_divergence(_split_claims(spark, sf, METRICS, F.pmod("doc_id", F.lit(9)) + 3)).drop("shown", "sources")


def causal_variants(spark, sf):
    rows = classified(spark, sf).filter("claim_type = 'unverified_causality'").groupBy("source_type")
    return rows.agg(F.count("*").alias("claims"), F.count_distinct(F.substring("claim_text", 1, 120)).alias("variants")).filter("claims > 1 and variants > 1")


def bundle_compare(spark, sf):
    rows = plain_claims(spark, sf)
    return analytics.compare(rows.filter("issue_id = 'before'"), rows.filter("issue_id = 'after'"))


def verification_categories(spark, sf):
    rows = classified(spark, sf).withColumn("category", classify.verification_category())
    return rows.groupBy("category", classify.review_bucket(F.col("risk_tier")).alias("review_bucket")).agg(F.count("*").alias("n"), F.count_distinct("source_name").alias("sources"))


def numeric_items(spark, sf):
    """Review items of figures that sources give differently."""
    rows = cut(_split_claims(spark, sf, METRICS, F.pmod("doc_id", F.lit(9)) + 3))
    return bundle.numeric_review_items(bundle.numeric_conflicts(rows)).select("source_name", "risk_tier", "reason", F.sha2("verification_question", 256).alias("question"), "claim_ids")


def packet_ids(spark, sf):
    rows = cut(plain_claims(spark, sf).select("doc_id", "issue_id", "claim_type", "source_type", "normalized_claim_hash"))
    return analytics.packet_ids(rows, "issue_id", classify.verification_category(), "doc_id", _bounds(spark, sf)).select("doc_id", "category", "packet_id")


def excluded_sources(spark, sf):
    rows = classified(spark, sf).select("doc_id", "source_name", "claim_type")
    excluded = rows.filter("claim_type = 'excluded'").select("source_name").distinct()
    return rows.filter("claim_type <> 'excluded'").join(excluded, "source_name", "left_semi").select("doc_id", "source_name")


def unresolved_by_severity(spark, sf):
    order = F.when(F.col("risk_tier") == "critical", 0).when(F.col("risk_tier") == "high", 1).when(F.col("risk_tier") == "medium", 2).otherwise(3)
    return classified(spark, sf).filter(classify.risky_unresolved()).groupBy(order.alias("severity"), "risk_tier").agg(F.count("*").alias("n"))


def gate_violations(spark, sf):
    broken = classified(spark, sf).withColumn("claim_type", F.when(F.pmod("doc_id", F.lit(7)) == 0, "confirmed_fact").otherwise(F.col("claim_type")))
    broken = broken.withColumn("output_level", F.when(F.pmod("doc_id", F.lit(7)) == 0, "report_fact_bucket").otherwise(F.col("output_level")))
    return analytics.gate_violations(broken, "doc_id")


def orphan_rows(spark, sf):
    """Referential integrity: line items without an order, labels without a document, documents without a label."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    items = lines.join(table(spark, sf, "orders"), F.col("id") == F.col("o_orderkey"), "left_anti").select(F.lit("lineitem").alias("entity"), "id")
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("id")).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), "id", "left_anti")
    bare = table(spark, sf, "documents").select(F.col("doc_id").alias("id")).join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")
    rows = items.union(marks.select(F.lit("labels").alias("entity"), "id")).union(bare.select(F.lit("documents").alias("entity"), "id"))
    return rows.groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def _predictions(spark, sf):
    rows = classified(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    pairs = {"d_loaded": "toxic", "d_action": "toxic", "d_causal": "quality", "d_market": "quality"}
    one = lambda d, e: F.struct(F.lit(d).alias("detector"), (F.col(e) == 1).alias("expected"), F.col(d).alias("predicted"))
    return rows.select("mode", F.inline(F.array(*[one(d, e) for d, e in pairs.items()])))


def detector_confusion(spark, sf):
    return analytics.confusion(_predictions(spark, sf), "mode")


def tier_accuracy(spark, sf):
    rows = classified(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    match = (F.col("toxic") == 1) == F.col("risk_tier").isin("high", "critical")
    return rows.groupBy("source_type").agg(F.count("*").alias("total"), F.count_if(match).alias("passing"), F.avg(match.cast("int")).alias("accuracy"))


def manifest_duplicates(spark, sf):
    rows = seed(spark, sf).select("doc_id", "source_name", "source_type")
    return intake.duplicate_names(rows, ["source_type"], "source_name", "doc_id").select("doc_id", "source_name", F.col("nth").cast("long").alias("nth"), "first_at")


#: What a hostile manifest may try, by negative page ids, beside the pages' own addresses.
HOSTILE = [
    "http://[::1]/", "http://[::ffff:10.0.0.1]/x", "http://10.0.0.1.nip.io/", "http://localhost./", "http://127.0.0.1./", "http://198.18.0.1/", "http://ex ample.com/",
    "http://192.0.2.7/", "http://203.0.113.9/a", "http://app.10-0-0-1.sslip.io/", "http://0x7f.1/", "http://2130706433/", "http://[::7f00:1]/", "http://[fe80::1]:80/",
    "ftp://example.com/", "https://user:pw@example.com/", "https://example.com:8443/", "http:///nohost", "http://a.localhost/", "https://xn--caf-dma.example/", "https://café.example/",
    "https://8.8.8.8/", "https://[2606:4700::1111]/", "http://8.8.8.8.nip.io/", "", "javascript:alert(1)", "http://010.0.0.1/",
]


def url_policy(spark, sf):
    hostile = spark.createDataFrame([(-1 - i, u) for i, u in enumerate(HOSTILE)], "page_id long, url string")
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url").union(hostile)
    return pages.select("page_id", intake.url_problem(F.col("url")).alias("problem"))


def filename_hints(spark, sf):
    """File names made of the texts' own words, before a hint that follows from the id."""
    hints = F.get(F.array(*map(F.lit, ["official_notice", "reddit-thread", "board_post", "press wire", "research note", "plain"])), F.pmod("doc_id", F.lit(6)).cast("int"))
    name = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"[./\\\\\s]+", "-"), F.lit(" "), hints, F.lit(".txt"))
    kind, ignored = intake.filename_type(name)
    return table(spark, sf, "documents").select("doc_id", kind.alias("source_type"), ignored.alias("trusted_hint_ignored"))


def masked_claims(spark, sf):
    rows = classified(spark, sf).withColumn("claim_id", F.format_string("clm_%03d", "doc_id"))
    return masking.safe_claims(rows).select("doc_id", "claim_type", "safe_text")


def page_text(spark, sf):
    return intake.visible_text(table(spark, sf, "pages"), "page_id", "html")


def review_packet_index(spark, sf):
    rows = classified(spark, sf).withColumn("claim_id", F.col("doc_id").cast("string"))
    return reviews.review_packets(rows, "issue_id", "doc_id").select("doc_id", "packet_id", "category", "review_bucket", "reason", "verification_question")


def response_rules(spark, sf):
    """A response for each conversation, a finding for most turns, some twice: which rules are broken, how often.  The
    turns' own words are the findings' uncertainty."""
    turns = table(spark, sf, "conversations").filter("turn is not null and conv_id is not null")
    turns = turns.groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    packet = F.concat(F.lit("p"), F.col("turn").cast("string"))
    packets = turns.select("conv_id", packet.alias("packet_id"), F.when(F.pmod("turn", F.lit(3)) == 0, "high").otherwise("low").alias("risk_tier"))
    said = F.when(F.pmod("turn", F.lit(7)) == 2, "It was confirmed.").otherwise("one source")
    others = {"operator_next_step": "ask the agency", "must_not_conclude": "Do not treat it as proven."}
    words = F.concat(F.lit("Reported by one speaker: "), F.regexp_replace("text", r"[^\x20-\x7e]+", " "))
    finding = F.struct(packet.alias("packet_id"), said.alias("evidence_boundary"), words.alias("uncertainty_reason"), *[F.lit(v).alias(k) for k, v in others.items()])
    copies = F.explode(F.sequence(F.lit(1), F.when(F.pmod("turn", F.lit(5)) == 0, 2).otherwise(1)))
    found = turns.filter(F.pmod("turn", F.lit(4)) != 1).select("conv_id", finding.alias("f"), copies.alias("copy"))
    found = found.groupBy("conv_id").agg(F.array_sort(F.collect_list("f")).alias("findings"))
    safety = F.struct(*[F.lit(v == "true").alias(k) for k, v in reviews.SAFETY.items()])
    body = F.struct(
        F.lit(reviews.RESPONSE_VERSION).alias("schema_version"), F.col("conv_id").cast("string").alias("issue_id"), F.lit(True).alias("advisory_only"),
        F.coalesce("findings", F.array()).alias("findings"), safety.alias("safety_checks"),
    )
    responses = turns.select("conv_id").distinct().join(found, "conv_id", "left").select("conv_id", F.to_json(body).alias("body"))
    return reviews.response_errors(responses, packets, "conv_id").groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("responses"))


def gold_metrics(spark, sf):
    """Composed claims as labelled cases, of every detector that is labelled; the labels follow from the id."""
    labels = F.create_map(*[x for k, name in enumerate(goldset.LABELLED, 2) for x in (F.lit(name), F.pmod("doc_id", F.lit(k)) == 0)])
    cases = seed(spark, sf).select(
        F.col("doc_id").cast("string").alias("case_id"), F.col("claim_text").alias("text"), F.col("source_name").alias("language"), "mode", "source_type", F.lit("enforced").alias("status"),
        labels.alias("detector_labels"), F.lit(None).cast("array<string>").alias("expected_claim_types"), F.array(F.lit("low"), F.lit("medium")).alias("expected_tiers"),
        F.lit(None).cast("struct<must_preserve:array<string>,must_mask:array<string>>").alias("masking"),
    )
    return goldset.detector_metrics(goldset.evaluate(cases))


def _named_claims(spark, sf):
    return cut(classify.classify(seed(spark, sf)).select("doc_id", "issue_id", "source_name", "source_type", "mode", "claim_text", "claim_type", "risk_tier", "risk_flags", "needs_human_review", "classification_notes", "disallowed_reason", "d_manipulation"))


def summary_sections(spark, sf):
    """Where the bundle's summary puts each claim, and whether its source has excluded material beside it."""
    rows = bundle.with_caution(_named_claims(spark, sf).withColumn("section", bundle.section()))
    return rows.select("doc_id", "section", "beside_excluded", "classification_notes", "disallowed_reason")


def _work_items(spark, sf):
    rows = bundle.with_caution(_named_claims(spark, sf)).withColumn("claim_id", F.col("doc_id").cast("string"))
    return verification.work_items(rows, "doc_id")


def work_item_groups(spark, sf):
    rows = verification.grouped_items(_work_items(spark, sf))
    return rows.select("tier", "question", "reason", "source_family_hint", "expected_evidence_type", "n", F.sha2(F.array_join("claim_refs", "|"), 256).alias("refs"))


def question_counts(spark, sf):
    return verification.question_counts(_work_items(spark, sf))


def official_queries(spark, sf):
    rows = _named_claims(spark, sf).withColumn("claim_id", F.col("doc_id").cast("string"))
    return rows.select("doc_id", verification.source_family().alias("family"), verification.official_query().alias("query"), verification.unsafe_risk().alias("unsafe_risk"))


def compared_claims(spark, sf):
    """The maps of two bundles by status, as the comparison shows them."""
    rows = cut(plain_claims(spark, sf).select("doc_id", "issue_id", "source_name", "source_type", "claim_text", "claim_type", "risk_tier", "needs_human_review"))
    sides = [bundle.claim_map(rows.filter(F.col("issue_id") == name), "doc_id") for name in ("before", "after")]
    return bundle.compared_maps(*sides).select("status", "key", "claim_type", "risk_tier", "source_type", F.array_join("sources", ",").alias("sources"), "risky_unresolved")


def review_numbers(spark, sf):
    rows = cut(classified(spark, sf).filter("needs_human_review").select("issue_id", "doc_id"))
    return bundle.review_ids(rows, "issue_id", "doc_id", _bounds(spark, sf)).select("issue_id", "doc_id", "review_id")


def capture_names(spark, sf):
    """Documents as captures, named by their source and first word: file names apart, and names that came before."""
    word = F.regexp_extract(F.coalesce("text", F.lit("")), r"^\S{1,12}", 0)
    rows = table(spark, sf, "documents").select("doc_id", F.lit("issue").alias("issue_id"), F.concat_ws(" ", F.coalesce("source", F.lit("none")), word).alias("source_name"))
    files, again = bundle.capture_files(cut(rows), "doc_id")
    return files.select("doc_id", "file_name").union(again.select("doc_id", F.lit(None).cast("string").alias("file_name")))


def page_types(spark, sf):
    """Digests and sizes of pages, and whether fetched content of that size, and of a type that follows from the id, is refused."""
    content = F.col("html").cast("binary")
    kind = F.get(F.array(*map(F.lit, ["text/html; charset=utf-8", "application/pdf", " TEXT/Markdown", "application/xml", "image/svg+xml", ""])), F.pmod("page_id", F.lit(6)).cast("int"))
    facts = strings.digest(content)
    return table(spark, sf, "pages").select("page_id", facts["sha256"].alias("sha256"), facts["bytes"].cast("long").alias("bytes"), bundle.content_problem(kind, F.octet_length(content), 4096).alias("problem"), strings.slug(F.col("url")).alias("slug"))


def source_suggestions(spark, sf):
    """Pages as candidates: what their title, address and host suggest as name, type and mode."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-z]+://([^/]*)", 1)
    rows = spread(table(spark, sf, "pages")).select(
        "page_id", F.col("page_id").alias("at"), F.col("page_id").cast("string").alias("candidate_id"), title.alias("title"), "url", host.alias("publisher"),
        F.array(F.get(F.array(*map(F.lit, CANDIDATE_NOTES)), F.pmod("page_id", F.lit(len(CANDIDATE_NOTES))).cast("int"))).alias("warnings"),
    )
    return viewer.suggestions(rows).select("page_id", "suggested_name", "suggested_type", "suggested_mode")


def package_figures(spark, sf):
    """Documents as the texts of packages, each led by some lines of one."""
    heads = F.get(F.array(*map(F.lit, PACKAGE_HEADS)), F.pmod("doc_id", F.lit(len(PACKAGE_HEADS))).cast("int"))
    rows = spread(table(spark, sf, "documents")).select("doc_id", F.concat(F.coalesce(heads, F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))
    return viewer.package_figures(rows).drop("text")


def comparison_lines(spark, sf):
    return reports.comparison_report(bundle_compare(spark, sf), "Comparison").select("section", "pos", "line")


def report_lines(spark, sf):
    return reports.run_report(cut(classify.ledger(classified(spark, sf))), "doc_id", "Evidence report", detailed=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        claims_by_type_tier, claim_ledger, flag_histogram, bucket_counts, source_histograms, tier_and_type_counts, review_queue,
        grouped_review_items, line_first_wins, claim_split, exact_repetition, fuzzy_repetition, cross_source_groups, casualty_divergence,
        repetition_ledger, shared_flags, numeric_divergence, causal_variants, bundle_compare, verification_categories, packet_ids, excluded_sources, unresolved_by_severity,
        gate_violations, orphan_rows, detector_confusion, tier_accuracy, manifest_duplicates, url_policy, filename_hints, masked_claims,
        numeric_items, summary_sections, work_item_groups, question_counts, official_queries, compared_claims, review_numbers, capture_names, page_types,
        source_suggestions, package_figures,
        page_text, review_packet_index, response_rules, gold_metrics, comparison_lines, report_lines,
    )
}
