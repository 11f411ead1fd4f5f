"""Queries of single rules over the driver's tables, whole: coercion, escaping, normalising, overrides, cases and counts;
and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.functions import strings
from quillgate.functions.detectors import normalise
from quillgate.operators import bundle, classify, goldset, masking
from quillgate.plans import reports
from quillgate.sources import intake, manifests

from . import stated
from .oracle import _LABELLED
from .queries import _claims_sql, _named_claims, _q, classified, seed, spread, table

_c = F.col


def _pick(values: list[str], key: str = "doc_id") -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(key, F.lit(len(values))).cast("int"))


#: What manifests call types of sources, by id.
RAW_TYPES = ["Official", " user-note", "FORUM", "finance_commentary", "mixed", "blog", "", "Company ", "commentary", "social", "finance-commentary"]


def coerced_types(spark, sf):
    """Types as manifests write them, with and without aliases."""
    raw = _pick(RAW_TYPES)
    return table(spark, sf, "documents").select("doc_id", classify.coerce_source_type(raw).alias("plain"), classify.coerce_source_type(raw, intake.ALIASES).alias("aliased"))


def escaped_texts(spark, sf):
    """Whole texts as report lines, as metadata and as foreign paragraphs show them."""
    text = F.concat(_pick(["", "# ", "<b>[x](y)</b> `z` ", "a\\b\n# c "]), F.coalesce("text", F.lit("")))
    rows = spread(table(spark, sf, "documents")).select("doc_id", text.alias("t"))
    return rows.select("doc_id", *[F.sha2(c, 256).alias(n) for n, c in (("inline", masking.escape_inline(_c("t"))), ("metadata", strings.metadata(_c("t"))), ("paragraphs", strings.no_headings(_c("t"))))])


def normalised_texts(spark, sf):
    """Whole texts after a start with format characters, control characters and letters that look Latin."""
    start = _pick(["", "b​uy асt ", "a\x07b\tc\n", "﻿ουt "])
    return spread(table(spark, sf, "documents")).select("doc_id", F.sha2(normalise(F.concat(start, F.coalesce("text", F.lit("")))), 256).alias("text"))


def decoded_pages(spark, sf):
    """Pages as bytes with broken ones and line ends of two kinds, decoded."""
    content = F.concat(F.coalesce(F.col("html"), F.lit("")).cast("binary"), F.unhex(_pick(["", "0D0A", "610D62", "FF", "C3280A"], "page_id")))
    return table(spark, sf, "pages").select("page_id", F.sha2(strings.decoded(content), 256).alias("text"))


def overridden_types(spark, sf):
    """Documents as files, with types that overrides by name and by stem force on some of them."""
    docs = table(spark, sf, "documents").filter("doc_id is not null")
    name = F.concat(F.lit("File"), _c("doc_id").cast("string"), F.lit(".TXT"))
    files = docs.select("doc_id", name.alias("name"), F.lit("news").alias("source_type"))
    by_name = docs.filter("doc_id % 4 = 1").select(F.lower(name).alias("key"), F.lit("Official").alias("source_type"))
    by_stem = docs.filter("doc_id % 6 = 3").select(F.concat(F.lit("FILE"), _c("doc_id").cast("string")).alias("key"), F.lit("forum").alias("source_type"))
    return manifests.override_types(files, by_name.union(by_stem)).select("doc_id", "source_type")


def blocked_claims(spark, sf):
    """Excluded claims with the categories for which they are blocked."""
    return classified(spark, sf).filter("claim_type = 'excluded'").select("doc_id", reports.blocked_categories().alias("categories"))


def manifest_counts(spark, sf):
    """What a manifest says of each of two issues: sources, claims, claims to review."""
    sources = seed(spark, sf, plain=True).select("issue_id", "source_name").distinct()
    return bundle.counts(_named_claims(spark, sf), sources)


def _cases(spark, sf) -> DataFrame:
    """Documents as labelled cases; what is expected of each follows from its id, its language from its source."""
    labels = F.create_map(*[x for k, name in enumerate(goldset.LABELLED, 2) for x in (F.lit(name), F.pmod("doc_id", F.lit(40 * k)) == 1)])
    types = F.when(F.pmod("doc_id", F.lit(3)) != 0, F.array(F.lit("reported_claim"), F.lit("confirmed_fact"), F.lit("interpretation")))
    tiers = F.when(F.pmod("doc_id", F.lit(5)) != 0, F.array(F.lit("low"), F.lit("medium")))
    return goldset.evaluate(seed(spark, sf).select(
        _c("doc_id").cast("string").alias("case_id"), _c("claim_text").alias("text"), _c("source_name").alias("language"), "mode", "source_type",
        F.when(F.pmod("doc_id", F.lit(4)) == 0, "aspirational").otherwise("enforced").alias("status"), labels.alias("detector_labels"), types.alias("expected_claim_types"),
        tiers.alias("expected_tiers"), F.lit(None).cast("struct<must_preserve:array<string>,must_mask:array<string>>").alias("masking"),
    ))


def gold_accuracies(spark, sf):
    return goldset.accuracies(_cases(spark, sf))


def gold_statuses(spark, sf):
    return goldset.status_summary(_cases(spark, sf))


def gold_failures(spark, sf):
    """The cases that fail, and why."""
    return goldset.failures(_cases(spark, sf)).select("case_id", "status", F.sha2("reason", 256).alias("reason"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (coerced_types, escaped_texts, normalised_texts, decoded_pages, overridden_types, blocked_claims, manifest_counts, gold_accuracies, gold_statuses, gold_failures)
}

_RAW = ", ".join(map(_q, RAW_TYPES))
_KNOWN = ", ".join(map(_q, stated.SOURCE_TYPES))
_START = "coalesce([{}][1 + doc_id % 4], '')"
_CASE = f"""{_claims_sql()}, k AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'aspirational' ELSE 'enforced' END AS status,
  CASE WHEN doc_id % 3 <> 0 THEN claim_type IN ('reported_claim', 'confirmed_fact', 'interpretation') END AS type_ok, CASE WHEN doc_id % 5 <> 0 THEN risk_tier IN ('low', 'medium') END AS tier_ok,
  list_sort([x for x in [{", ".join(f"CASE WHEN {d} <> (doc_id % {40 * k} = 1) THEN '{name}' END" for k, (name, d) in enumerate(_LABELLED, 2))}] if x IS NOT NULL]) AS wrong FROM claims),
  p AS (SELECT *, len(wrong) = 0 AND coalesce(type_ok, true) AND coalesce(tier_ok, true) AS passed FROM k)"""
_CATEGORIES = [("investment_advice_language", "investment_action"), ("target_price_language", "price_target"), ("position_sizing_language", "allocation"), ("trade_probability_language", "probability_or_outcome")]
_LOOK = ("аеорсухкіѕјтАЕОРСУХКІЅТВНМοαερχκιντΟΑΕΡΧΚΙΤΒΗΜΝ", "aeopcyxkisjtAEOPCYXKISTBHMoaepxkivtOAEPXKITBHMN")
ORACLE_SQL: dict[str, str] = {
    "coerced_types": f"""WITH r AS (SELECT doc_id, replace(lower(trim([{_RAW}][1 + doc_id % {len(RAW_TYPES)}])), '-', '_') AS k FROM documents),
        a AS (SELECT *, CASE k WHEN 'finance_commentary' THEN 'analyst' WHEN 'commentary' THEN 'analyst' WHEN 'forum' THEN 'community' WHEN 'mixed' THEN 'unknown' ELSE k END AS other FROM r)
        SELECT doc_id, CASE WHEN k IN ({_KNOWN}) THEN k ELSE 'unknown' END AS plain, CASE WHEN other IN ({_KNOWN}) THEN other ELSE 'unknown' END AS aliased FROM a""",
    "escaped_texts": f"""WITH t AS (SELECT doc_id, {_START.format("'', '# ', '<b>[x](y)</b> `z` ', 'a' || chr(92) || 'b' || chr(10) || '# c '")} || coalesce(text, '') AS t FROM documents)
        SELECT doc_id, sha256(replace(replace(regexp_replace(t, '([\\[\\]`])', '\\\\\\1', 'g'), '<', '&lt;'), '>', '&gt;')) AS inline,
          sha256(regexp_replace(trim(regexp_replace(t, '[\\t-\\r \\x{{85}}\\p{{Z}}]+', ' ', 'g')), '([\\\\`\\[\\]()])', '\\\\\\1', 'g')) AS metadata, sha256(regexp_replace(t, '(?m)^#', '\\\\#', 'g')) AS paragraphs FROM t""",
    "normalised_texts": f"""WITH t AS (SELECT doc_id, {_START.format("'', 'b' || chr(8203) || 'uy ' || chr(1072) || chr(1089) || 't ', 'a' || chr(7) || 'b' || chr(9) || 'c' || chr(10), chr(65279) || chr(959) || chr(965) || 't '")} || coalesce(text, '') AS t FROM documents)
        SELECT doc_id, sha256(CASE WHEN strlen(t) = length(t) THEN regexp_replace(t, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g')
          ELSE translate(nfc_normalize(regexp_replace(t, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}\\p{{Cf}}]', '', 'g')), '{_LOOK[0]}', '{_LOOK[1]}') END) AS text FROM t""",
    "decoded_pages": """SELECT page_id, sha256(regexp_replace(coalesce(html, '') || CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN chr(10) WHEN 2 THEN 'a' || chr(10) || 'b' WHEN 3 THEN chr(65533) ELSE chr(65533) || '(' || chr(10) END,
        '\\r\\n?', chr(10), 'g')) AS text FROM pages""",
    "overridden_types": """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'official' WHEN doc_id % 6 = 3 THEN 'community' ELSE 'news' END AS source_type FROM documents WHERE doc_id IS NOT NULL""",
    "blocked_claims": f"""{_claims_sql()}, b AS (SELECT doc_id, array_to_string([x for x in [{", ".join(f"CASE WHEN list_contains(risk_flags, '{f}') THEN '{c}' END" for f, c in _CATEGORIES)}] if x IS NOT NULL], ', ') AS c
        FROM claims WHERE claim_type = 'excluded') SELECT doc_id, CASE WHEN c = '' THEN 'finance_policy_block' ELSE c END AS categories FROM b""",
    "manifest_counts": f"""{_claims_sql()} SELECT issue_id, count(DISTINCT source_name) AS source_count, count(*) AS claim_count, count_if(needs_human_review)::BIGINT AS review_count FROM claims GROUP BY 1""",
    "gold_accuracies": f"""{_CASE} SELECT source_name AS language, count(type_ok) AS claim_type_total, count_if(coalesce(type_ok, false))::BIGINT AS claim_type_correct, avg(type_ok::INT) AS claim_type_accuracy,
        count(tier_ok) AS tier_total, count_if(coalesce(tier_ok, false))::BIGINT AS tier_correct, avg(tier_ok::INT) AS tier_accuracy FROM p GROUP BY GROUPING SETS ((source_name), ())""",
    "gold_statuses": f"""{_CASE} SELECT status, count(*) AS total, count_if(passed)::BIGINT AS passing, count_if(NOT passed)::BIGINT AS failing FROM p GROUP BY 1""",
    "gold_failures": f"""{_CASE} SELECT doc_id::VARCHAR AS case_id, status, sha256(array_to_string([x for x in [CASE WHEN len(wrong) > 0 THEN 'detectors: ' || array_to_string(wrong, ', ') END,
        CASE WHEN NOT type_ok THEN 'claim_type ' || claim_type END, CASE WHEN NOT tier_ok THEN 'tier ' || risk_tier END] if x IS NOT NULL], '; ')) AS reason FROM p WHERE NOT passed""",
}
