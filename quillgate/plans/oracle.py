"""DuckDB SQL for the queries of quillgate.plans.queries."""

from __future__ import annotations

from quillgate.plans import stated
from quillgate.plans.queries import _SEED, _claims_sql, _has, _q
from quillgate.plans.split_sql import split

_C = _claims_sql()
#: The same rules over the documents themselves.
_P = _C.replace(_C[_C.index("(list_value('The market fell") : _C.index(" AS claim_text")], "coalesce(text, '')", 1)


# Fixed values of the rules on repetition, stated apart from the engine's own
FACT_LEVELS = ["report_fact_bucket", "report_observation_bucket"]
FUZZY_TYPES = ["reported_claim", "opinion_or_frame", "unverified_causality", "rumor", "unobservable"]
LIGHT_WORDS = ["a", "an", "the", "that", "this", "so", "and"]
_LEADS = [
    "^\\[[^\\]]+\\]\\s+", "^(?:a|an|the)\\s+(?:first|second|third|another)\\s+(?:social\\s+)?(?:account|post)\\s+(?:says|claimed|claims|repeats|repeated)\\s+that\\s+",
    "^(?:a|an|the)\\s+(?:social\\s+)?(?:account|post)\\s+(?:says|claimed|claims|repeats|repeated)\\s+", "^(?:another|second|third)\\s+account\\s+(?:says|claimed|claims|repeats|repeated)\\s+",
]


def _in(words: list[str]) -> str:
    return ", ".join(map(_q, words))


_CASE_REASON = (
    f"CASE WHEN claim_type = 'excluded' THEN {_q(stated.DISALLOWED)} "
    + " ".join(f"WHEN list_contains(risk_flags, '{f}') THEN {_q(v)}" for f, v in stated.REASONS)
    + " ELSE 'human review required' END"
)
_CASE_QUESTION = (
    f"CASE WHEN claim_type = 'excluded' THEN {_q(stated.EXCLUDED_QUESTION)} "
    + " ".join(f"WHEN list_contains(risk_flags, '{f}') THEN {_q(v)}" for f, v in stated.QUESTIONS)
    + f" ELSE {_q(stated.LAST_QUESTION)} END"
)
_CATEGORY = (
    "CASE WHEN claim_type = 'excluded' THEN 'excluded_finance' WHEN claim_type IN ('rumor', 'unobservable') OR source_type IN ('community', 'social')"
    " THEN 'rumor_manipulation' WHEN claim_type IN ('unverified_causality', 'needs_official_source', 'opinion_or_frame', 'interpretation')"
    " THEN 'unsupported_weak' ELSE 'confirmed_low_risk' END"
)
_RISKY = (
    "(claim_type IN ('unverified_causality', 'needs_official_source', 'unobservable', 'rumor', 'excluded') OR risk_tier IN ('high', 'critical')"
    " OR needs_human_review)"
)
_BUCKET = "CASE claim_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in stated.BUCKETS.items()) + " ELSE 'excluded' END"


def _variant(text: str, n: int) -> str:
    """Without lead-ins, punctuation and light words, cut to the first n words; null if none is left."""
    for lead in _LEADS:
        text = f"regexp_replace({text if text.startswith('regexp') else f'lower({text})'}, '{lead}', '')"
    words = f"regexp_split_to_array(trim(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g')), ' ')"
    return f"list_aggregate(list_slice([w for w in {words} if w NOT IN ({_in(LIGHT_WORDS)}) AND w <> ''], 1, {n}), 'string_agg', ' ')"


_KEY = f"""substr(sha256(claim_type || '|' || CASE WHEN source_type IN ('social', 'community') THEN coalesce({_variant("plain", 24)}, '') ELSE plain END), 1, 16)"""
_GATES = [
    ("trim(claim_text) = ''", "claim text is missing"),
    ("claim_type = 'confirmed_fact' AND source_type IN ('community', 'social')", "community or social claim is a confirmed fact"),
    (f"claim_type = 'confirmed_fact' AND {_has('unobservable_evidence')}", "confirmed fact is unobservable"),
    (f"claim_type = 'confirmed_fact' AND {_has('unsupported_causality')}", "confirmed fact is causal"),
    (f"claim_type = 'confirmed_fact' AND mode = 'finance' AND {_has('official_data_causality_mismatch')}", "confirmed fact mismatches official data"),
    (f"mode = 'finance' AND {_has(*stated.CRITICAL_FLAGS)} AND output_level NOT IN ('excluded', 'review_only')", "critical finance claim is not excluded"),
    (f"source_type IN ('community', 'social') AND output_level IN ({_in(FACT_LEVELS)})", "repetition by an untrusted source is in a fact bucket"),
]
_PAIRS = [("d_loaded", "toxic"), ("d_action", "toxic"), ("d_causal", "quality"), ("d_market", "quality")]


# What labelled cases call the detectors
_LABELLED = [
    ("causality", "d_causal"), ("market_terms", "d_market"), ("manipulation_framing", "d_manipulation"), ("action_language", "d_action"), ("target_price", "d_target"),
    ("position_sizing", "d_sizing"), ("trade_probability", "d_probability"), ("private_or_unobservable", "d_private"),
]


def _lead(forms: list[str], number: str) -> str:
    """Claims of whole texts, each text led by a sentence with a number."""
    lead = f"replace((list_value({_in(forms)}))[doc_id % {len(forms)} + 1], '{{}}', ({number})::VARCHAR)"
    return split(f"(SELECT coalesce(source, 'none') AS source_name, {lead} || chr(10) || chr(10) || coalesce(text, '') AS text FROM documents)", "source_name", "text")


_CASUALTY = "(regexp_matches(lower(claim_text), '\\bworkers?\\s+(?:were\\s+)?affected\\b|injured|treated|casualty|casualties|people'))"
_GROUPED = f"""x AS (SELECT issue_id, normalized_claim_hash AS h, count(*) AS c, row_number() OVER (PARTITION BY issue_id ORDER BY min(doc_id)) AS k FROM claims GROUP BY 1, 2),
xm AS (SELECT issue_id, count(*) AS multiple FROM x WHERE c > 1 GROUP BY 1),
xc AS (SELECT claims.*, c, printf('dup_%03d', k) AS exact_id, CASE WHEN source_type IN ('community', 'social') AND claim_type IN ({_in(FUZZY_TYPES)}) AND {_variant("claim_text", 20)} <> ''
  THEN {_variant("claim_text", 20)} END AS vk FROM claims JOIN x ON x.issue_id = claims.issue_id AND x.h = claims.normalized_claim_hash),
xf AS (SELECT issue_id, vk, count(*) AS members, bool_or(c > 1) AS taken, row_number() OVER (PARTITION BY issue_id ORDER BY min(doc_id)) AS k FROM xc WHERE vk IS NOT NULL GROUP BY 1, 2),
rep AS (SELECT xc.*, xf.members, CASE WHEN xf.members > 1 AND NOT xf.taken THEN printf('dup_fuzzy_%03d', xf.k + coalesce(xm.multiple, 0)) END AS fuzzy_id
  FROM xc LEFT JOIN xf ON xf.issue_id = xc.issue_id AND xf.vk = xc.vk LEFT JOIN xm ON xm.issue_id = xc.issue_id)"""

ORACLE_SQL: dict[str, str] = {
    "claims_by_type_tier": f"{_C} SELECT source_type, claim_type, risk_tier, count(*) AS n, count_if(needs_human_review)::BIGINT AS n_review FROM claims GROUP BY ALL",
    "claim_ledger": f"""{_C} SELECT doc_id, source_type, mode, claim_type, verification_status, output_level, confidence, risk_tier, needs_human_review,
        array_to_string(risk_flags, ',') AS flags, normalized_claim_hash FROM claims""",
    "flag_histogram": f"{_C} SELECT flag, count(*) AS n FROM (SELECT unnest(list_distinct(risk_flags)) AS flag FROM claims) GROUP BY flag",
    "bucket_counts": f"""{_C} SELECT b.bucket, coalesce(c.n, 0) AS n FROM (SELECT unnest(list_value({_in(sorted(stated.BUCKETS.values()))})) AS bucket) b
        LEFT JOIN (SELECT {_BUCKET} AS bucket, count(*) AS n FROM claims GROUP BY 1) c USING (bucket)""",
    "source_histograms": f"""WITH {_SEED}, s AS (SELECT *, 'observable' AS observable_state FROM seed)
        SELECT source_type, observable_state, mode, count(*) AS n FROM s GROUP BY GROUPING SETS ((source_type), (observable_state), (mode))""",
    "tier_and_type_counts": f"{_C} SELECT risk_tier, claim_type, count(*) AS n FROM claims GROUP BY GROUPING SETS ((risk_tier), (claim_type))",
    "review_queue": f"{_C} SELECT doc_id, risk_tier, {_CASE_REASON} AS reason, {_CASE_QUESTION} AS question FROM claims WHERE needs_human_review",
    "grouped_review_items": f"""{_C} SELECT source_name, risk_tier, {_CASE_REASON} AS reason, count(*) AS n, min(doc_id) AS first_doc FROM claims
        WHERE needs_human_review GROUP BY 1, 2, 3""",
    "line_first_wins": """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
        SELECT doc_id, min(pos)::INT AS pos, sha256(lower(trim(line))) AS key FROM l WHERE trim(line) <> '' GROUP BY doc_id, lower(trim(line))""",
    "exact_repetition": f"""WITH {_SEED}, r AS (SELECT s.issue_id, s.doc_id, substr(sha256(trim(regexp_replace(lower(coalesce(d.text, '')), '\\s+', ' ', 'g'))), 1, 16) AS h
        FROM seed s JOIN documents d USING (doc_id)),
        g AS (SELECT issue_id, h, count(*) AS c, row_number() OVER (PARTITION BY issue_id ORDER BY min(doc_id)) AS k FROM r GROUP BY issue_id, h)
        SELECT issue_id, doc_id, c AS source_count, CASE WHEN c > 1 THEN printf('dup_%03d', k) END AS duplicate_group_id FROM r JOIN g USING (issue_id, h)""",
    "fuzzy_repetition": f"""{_P}, v AS (SELECT issue_id, doc_id, {_variant("claim_text", 20)} AS k FROM claims
        WHERE source_type IN ('community', 'social') AND claim_type IN ({_in(FUZZY_TYPES)}))
        SELECT issue_id, sha256(k) AS variant, count(*) AS members, min(doc_id) AS first_member FROM v WHERE k <> '' GROUP BY issue_id, k HAVING count(*) > 1""",
    "cross_source_groups": f"""{_P}, v AS (SELECT source_name, substr(sha256({_variant("claim_text", 24)}), 1, 16) AS key FROM claims WHERE claim_type <> 'excluded' AND {_variant("claim_text", 24)} <> ''),
        g AS (SELECT key, count(*) AS claims, array_to_string(list_sort(list_distinct(list(source_name))), ',') AS sources, count(DISTINCT source_name) AS n_sources
          FROM v GROUP BY key HAVING count(*) > 1 AND count(DISTINCT source_name) > 1)
        SELECT printf('bundle_dup_%03d', row_number() OVER (ORDER BY key)) AS group_id, key, claims, sources, n_sources FROM g""",
    "casualty_divergence": f"""WITH {_lead(["{} people were injured after the flood.", "{} people were injured after the train accident.", "{} people were injured by the factory fire.", "{} people were treated after the storm."], "doc_id % 7 + 11")},
        r AS (SELECT source_name, replace(regexp_extract(claim_text, '\\b\\d+(?:,\\d{{3}})*(?:\\.\\d+)?\\b'), ',', '') AS value,
          trim(regexp_replace(string_split_regex(regexp_extract(lower(claim_text), '\\b(?:after|by)\\s+(?:the\\s+)?([a-z0-9][a-z0-9\\s-]{{0,80}})', 1), '[.;,:]')[1], '\\s+', ' ', 'g')) AS event
          FROM split_claims WHERE {_CASUALTY}),
        e AS (SELECT source_name, value, CASE WHEN event = '' THEN 'unscoped' ELSE event END AS event FROM r WHERE value <> '')
        SELECT event, array_to_string(list_sort(list_distinct(list(value))), ',') AS reported, count(DISTINCT value) AS n_values, count(DISTINCT source_name) AS n_sources
        FROM e GROUP BY event HAVING count(DISTINCT value) > 1 AND count(DISTINCT source_name) > 1""",
    "numeric_divergence": f"""WITH {_lead(["회사 매출은 {}조 3,000억원으로 집계됐다.", "영업이익이 {}억원이라고 밝혔다.", "The benchmark lending rate reached {}.5 percent.", "Quarterly factory output totalled {},200 units.", "The mean depth of the well was {}.7 metres."], "doc_id % 9 + 3")},
        c AS (SELECT source_name, claim_text, regexp_extract(claim_text, '(?:\\d[\\d,]*\\s*[조억만천]\\s*)+원?|\\d[\\d,]*\\s*원') AS ko,
          regexp_extract(claim_text, '(\\d+(?:\\.\\d+)?)\\s*(?:%|percent|퍼센트|프로)', 1) AS pct, replace(regexp_extract(claim_text, '\\d[\\d,]*(?:\\.\\d+)?'), ',', '') AS num,
          regexp_replace(regexp_replace(claim_text, '(?:\\d[\\d,]*\\s*[조억만천]\\s*)+원?|\\d[\\d,]*\\s*원', ' ', 'g'), '\\d[\\d,]*(?:\\.\\d+)?\\s*(?:%|percent|퍼센트|프로|명|원)?', ' ', 'g') AS rest
          FROM split_claims WHERE NOT {_CASUALTY}),
        p AS (SELECT *, regexp_extract_all(ko, '(\\d[\\d,]*)\\s*([조억만천])', 1) AS amounts, regexp_extract_all(ko, '(\\d[\\d,]*)\\s*([조억만천])', 2) AS units FROM c),
        m AS (SELECT source_name, CASE WHEN len(amounts) > 0 THEN list_sum([CAST(replace(a, ',', '') AS HUGEINT) * CASE units[i] WHEN '조' THEN 1000000000000 WHEN '억' THEN 100000000
              WHEN '만' THEN 10000 ELSE 1000 END for a, i in amounts])::HUGEINT WHEN ko <> '' THEN CAST(replace(regexp_extract(ko, '\\d[\\d,]*'), ',', '') AS HUGEINT)
            WHEN pct <> '' THEN trunc(pct::DOUBLE * 100)::HUGEINT WHEN num <> '' THEN trunc(num::DOUBLE)::HUGEINT END AS magnitude,
          list_sort(list_distinct(list_concat([w for w in [regexp_replace(k, '(?:은|는|이|가|을|를|의|에서|에|으로|로|와|과|도|만|고|며|라고|이라고)$', '') for k in regexp_extract_all(rest, '[가-힣]{{2,}}')]
              if length(w) >= 2 AND w NOT IN ('이다', '한다', '했다', '있다', '됐다', '라고', '밝혔', '집계', '달했', '기록')],
            [w for w in regexp_extract_all(lower(rest), '[a-z]{{3,}}') if w NOT IN ('the', 'and', 'was', 'were', 'are', 'that', 'with', 'for', 'from', 'reported', 'said', 'told', 'after', 'about', 'this')]))) AS tokens FROM p)
        SELECT array_to_string(tokens, '|') AS context, count(DISTINCT magnitude) AS n_values, count(DISTINCT source_name) AS n_sources, count(*) AS claims FROM m
        WHERE len(tokens) >= 2 AND magnitude IS NOT NULL GROUP BY tokens HAVING count(DISTINCT magnitude) > 1 AND count(DISTINCT source_name) > 1""",
    "claim_split": f"""WITH {split("documents", "doc_id", "text")} SELECT doc_id, claim_no::INT AS claim_no, printf('clm_%03d', claim_no) AS claim_id, claim_text FROM split_claims""",
    "repetition_ledger": f"""{_P}, {_GROUPED} SELECT issue_id, doc_id, CASE WHEN c > 1 THEN exact_id ELSE fuzzy_id END AS duplicate_group_id,
        CASE WHEN c = 1 AND fuzzy_id IS NOT NULL THEN members ELSE c END AS source_count,
        CASE WHEN claim_type IN ('confirmed_fact', 'official_reported_status', 'market_observation') AND source_type IN ('official', 'company') THEN 1 ELSE 0 END AS independent_source_count,
        CASE WHEN risk_tier = 'low' AND (c > 1 OR fuzzy_id IS NOT NULL) THEN 'medium' ELSE risk_tier END AS risk_tier,
        array_to_string(risk_flags || CASE WHEN c > 1 THEN ['repetition_without_lineage', 'source_laundering_risk'] WHEN fuzzy_id IS NOT NULL
          THEN ['repetition_without_lineage', 'source_laundering_risk', 'fuzzy_variant_grouped'] ELSE [] END, ',') AS flags,
        CASE WHEN c > 1 THEN 'Repeated text was detected; v0 does not treat repetition as independent corroboration.'
          WHEN fuzzy_id IS NOT NULL THEN 'Similar social/community assertion variants were grouped; repetition is not independent corroboration.' END AS lineage_note FROM rep""",
    "shared_flags": f"""{_P}, v AS (SELECT *, CASE WHEN claim_type <> 'excluded' AND {_variant("claim_text", 24)} <> '' THEN substr(sha256({_variant("claim_text", 24)}), 1, 16) END AS key FROM claims),
        g AS (SELECT key, printf('bundle_dup_%03d', row_number() OVER (ORDER BY key)) AS gid FROM v WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1 AND count(DISTINCT source_name) > 1)
        SELECT doc_id, gid AS bundle_duplicate_group_id, array_to_string(risk_flags || CASE WHEN gid IS NOT NULL THEN ['bundle_repetition_without_lineage', 'bundle_source_laundering_risk'] ELSE [] END, ',') AS flags
        FROM v LEFT JOIN g USING (key)""",
    "causal_variants": f"""{_C} SELECT source_type, count(*) AS claims, count(DISTINCT substr(claim_text, 1, 120)) AS variants FROM claims WHERE claim_type = 'unverified_causality'
        GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT substr(claim_text, 1, 120)) > 1""",
    "bundle_compare": f"""{_P}, p AS (SELECT *, trim(regexp_replace(lower(claim_text), '\\s+', ' ', 'g')) AS plain FROM claims), k AS (SELECT issue_id, {_KEY} AS key, {_RISKY} AS risky FROM p),
        b AS (SELECT key, bool_or(risky) AS r FROM k WHERE issue_id = 'before' GROUP BY key), a AS (SELECT key, bool_or(risky) AS r FROM k WHERE issue_id = 'after' GROUP BY key)
        SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'new' WHEN a.key IS NULL THEN 'disappeared' ELSE 'repeated' END AS status,
        (a.key IS NOT NULL AND b.key IS NOT NULL AND (a.r OR b.r)) AS still_unresolved FROM b FULL JOIN a ON a.key = b.key""",
    "verification_categories": f"""{_C} SELECT {_CATEGORY} AS category, CASE WHEN risk_tier IN ('high', 'critical') THEN 'unsafe_or_high_risk_review_only' WHEN risk_tier = 'medium' THEN 'review_needed'
        ELSE 'low_risk_within_source_boundary' END AS review_bucket, count(*) AS n, count(DISTINCT source_name) AS sources FROM claims GROUP BY 1, 2""",
    "packet_ids": f"""{_P}, p AS (SELECT doc_id, {_CATEGORY} AS category, issue_id, normalized_claim_hash FROM claims),
        b AS (SELECT doc_id, category, 'vreq_' || substr(sha256(issue_id || '|' || category || '|' || normalized_claim_hash), 1, 16) AS base FROM p),
        n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS nth FROM b)
        SELECT doc_id, category, CASE WHEN nth > 1 THEN base || '_' || nth ELSE base END AS packet_id FROM n""",
    "excluded_sources": f"""{_C} SELECT doc_id, source_name FROM claims WHERE claim_type <> 'excluded' AND source_name IN (SELECT source_name FROM claims WHERE claim_type = 'excluded')""",
    "unresolved_by_severity": f"""{_C} SELECT CASE risk_tier WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS severity, risk_tier, count(*) AS n
        FROM claims WHERE {_RISKY} GROUP BY 1, 2""",
    "gate_violations": f"""{_C}, x AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN 'confirmed_fact' ELSE claim_type END AS claim_type,
        CASE WHEN doc_id % 7 = 0 THEN 'report_fact_bucket' ELSE output_level END AS output_level) FROM claims)
        """ + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS rule FROM x WHERE {cond}" for cond, name in _GATES),
    "orphan_rows": """SELECT 'lineitem' AS entity, count(*) AS n, count(DISTINCT l_orderkey) AS ids FROM lineitem
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) HAVING count(*) > 0
        UNION ALL SELECT 'labels', count(*), count(DISTINCT doc_id) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) HAVING count(*) > 0
        UNION ALL SELECT 'documents', count(*), count(DISTINCT doc_id) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id) HAVING count(*) > 0""",
    "detector_confusion": f"""{_C}, p AS ({" UNION ALL ".join(f"SELECT mode, '{d}' AS detector, {e} = 1 AS expected, {d} AS predicted FROM claims JOIN labels USING (doc_id)" for d, e in _PAIRS)}),
        c AS (SELECT detector, mode, count_if(expected AND predicted)::BIGINT AS tp, count_if(NOT expected AND predicted)::BIGINT AS fp, count_if(expected AND NOT predicted)::BIGINT AS fn,
          count_if(NOT expected AND NOT predicted)::BIGINT AS tn FROM p GROUP BY GROUPING SETS ((detector), (detector, mode))),
        r AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c)
        SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM r""",
    "tier_accuracy": f"""{_C} SELECT source_type, count(*) AS total, count_if((toxic = 1) = (risk_tier IN ('high', 'critical')))::BIGINT AS passing,
        avg(((toxic = 1) = (risk_tier IN ('high', 'critical')))::INT) AS accuracy FROM claims JOIN labels USING (doc_id) GROUP BY 1""",
    "manifest_duplicates": f"""WITH {_SEED}, n AS (SELECT doc_id, source_name, row_number() OVER w AS nth, first_value(doc_id) OVER w AS first_at FROM seed
        WINDOW w AS (PARTITION BY source_type, lower(source_name) ORDER BY doc_id)) SELECT * FROM n WHERE nth > 1""",
    "url_policy": """WITH h AS (SELECT unnest(range(27)) AS i, unnest([
          'address not global', 'address not global', 'address not global', 'localhost', 'address not global', 'address not global', 'host not in ASCII form',
          'address not global', 'address not global', 'address not global', 'address not canonical', 'address not canonical', 'address not global', 'address not global',
          'scheme not allowed', 'credentials in url', 'port not allowed', 'missing host', 'localhost', NULL, 'host not in ASCII form', NULL, NULL, NULL, 'missing url', 'scheme not allowed', 'address not canonical']) AS problem),
        u AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages)
        SELECT -1 - i AS page_id, problem FROM h UNION ALL SELECT page_id, CASE WHEN coalesce(trim(url), '') = '' THEN 'missing url' WHEN NOT regexp_matches(url, '^https?:') THEN 'scheme not allowed'
          WHEN host = '' THEN 'missing host' WHEN contains(host, '@') THEN 'credentials in url' WHEN regexp_matches(host, ':\\d+$') AND NOT regexp_matches(host, ':(80|443)$') THEN 'port not allowed'
          WHEN regexp_matches(host, '(^|\\.)localhost$') THEN 'localhost' END FROM u""",
    "filename_hints": """WITH n AS (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[./\\\\\\s]+', '-', 'g') || ' ' ||
          (list_value('official_notice', 'reddit-thread', 'board_post', 'press wire', 'research note', 'plain'))[doc_id % 6 + 1]), '[^a-z0-9]+', ' ', 'g'), ' ') AS w FROM documents),
        k AS (SELECT doc_id, CASE WHEN list_has_any(w, ['official', 'exchange', 'regulator', 'agency', 'ministry', 'gov', 'government']) THEN 'official'
          WHEN list_has_any(w, ['social', 'tweet', 'xpost', 'x_post', 'reddit']) THEN 'social' WHEN list_has_any(w, ['community', 'forum', 'board', 'thread']) THEN 'community'
          WHEN list_has_any(w, ['news', 'article', 'wire', 'headline', 'press']) THEN 'news' WHEN list_has_any(w, ['analyst', 'commentary', 'opinion', 'research']) THEN 'analyst' END AS hint FROM n)
        SELECT doc_id, CASE WHEN hint = 'official' THEN 'unknown' ELSE coalesce(hint, 'unknown') END AS source_type, coalesce(hint = 'official', false) AS trusted_hint_ignored FROM k""",
    "response_rules": """WITH t AS (SELECT DISTINCT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 2 ELSE 1 END AS copies, turn % 4 <> 1 AS found, turn % 7 = 2 AS said, turn % 3 = 0 AS high
          FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        r AS (SELECT conv_id, 'duplicate packet_id' AS rule, 1 AS k FROM t WHERE found AND copies = 2
          UNION ALL SELECT conv_id, CASE WHEN high THEN 'missing high or critical packet_id' ELSE 'missing packet_id' END, 1 FROM t WHERE NOT found
          UNION ALL SELECT conv_id, 'blocked confirmation or action language', copies FROM t WHERE found AND said
          UNION ALL SELECT conv_id, 'upgrades a high or critical claim', copies FROM t WHERE found AND said AND high)
        SELECT rule, sum(k)::BIGINT AS n, count(DISTINCT conv_id) AS responses FROM r GROUP BY 1""",
    "gold_metrics": f"""{_C}, p AS ({" UNION ALL ".join(f"SELECT source_name AS language, '{name}' AS detector, doc_id % {k} = 0 AS expected, {d} AS predicted FROM claims" for k, (name, d) in enumerate(_LABELLED, 2))}),
        c AS (SELECT detector, language, count_if(expected AND predicted)::BIGINT AS tp, count_if(NOT expected AND predicted)::BIGINT AS fp, count_if(expected AND NOT predicted)::BIGINT AS fn,
          count_if(NOT expected AND NOT predicted)::BIGINT AS tn FROM p GROUP BY GROUPING SETS ((detector), (detector, language))),
        r AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c)
        SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM r""",
}
ORACLE_SQL["review_packet_index"] = f"""WITH i AS ({ORACLE_SQL["packet_ids"].replace(_P, _C)})
SELECT doc_id, packet_id, category, CASE WHEN risk_tier IN ('high', 'critical') THEN 'unsafe_or_high_risk_review_only' WHEN risk_tier = 'medium' THEN 'review_needed'
  ELSE 'low_risk_within_source_boundary' END AS review_bucket, {_CASE_REASON} AS reason, {_CASE_QUESTION} AS verification_question
FROM i JOIN ({_C} SELECT * FROM claims) USING (doc_id)"""
ORACLE_SQL["comparison_lines"] = f"""WITH k AS ({ORACLE_SQL["bundle_compare"]}), n AS (SELECT unnest([0, 1, 2]) AS pos, unnest(['new', 'repeated', 'disappeared']) AS status,
  unnest(['New claims', 'Repeated claims', 'Disappeared claims']) AS title)
SELECT 0 AS section, -1::BIGINT AS pos, '# Comparison' AS line UNION ALL SELECT 0, 0, '' UNION ALL
SELECT 1, n.pos, '- ' || title || ': ' || count(key) || ', still unresolved: ' || count_if(coalesce(still_unresolved, false)) FROM n LEFT JOIN k USING (status) GROUP BY n.pos, title"""

# The notes of the decision table in its order, stated apart from the engine's own
_NOTES = [
    "Finance mode blocks investment-action, price-level, allocation, and probability language.", "Claim depends on inaccessible or unobservable material.",
    "Community/social manipulation-style narrative is treated as rumor and requires review.", "Community/social causal claims cannot be confirmed facts.",
    "Community/social framing is treated as a signal, not fact.", "Community/social source is treated as unverified reported material.",
    "Official data can show what happened, but this causal statement still needs support.", "Official market data supports an observation, not motive.",
    "Official source status line is treated as cautious reported status.", "Company source does not confirm broad market causality.",
    "Company claim rests on internal/private evidence or an unverifiable third-party allegation; needs an official or primary source before it can be treated as fact.",
    "Company forward-looking, market-wide prediction is interpretation and cannot be a confirmed fact.", "Company source can support company-specific factual statements.",
    "Analyst manipulation-style framing remains unverified and requires review.", "Analyst true-cause market claims remain unverified.", "Analyst material is interpretation by default.",
    "News causal explanation needs primary or independent support.", "News reports a market observation; official source is preferred.", "News text contains framing risk.",
    "News is treated as reported material unless primary support is supplied.", "Unknown or user-provided causal claim needs verification.",
    "Source type is not strong enough for confirmation.",
]
#: A decided row by what tells the 22 apart once they are decided: type of source, of claim, and confidence.
_KIND = [
    ("claim_type = 'excluded'", 0), ("claim_type = 'unobservable'", 1), ("source_type IN ('community', 'social') AND claim_type = 'rumor'", 2),
    ("source_type IN ('community', 'social') AND claim_type = 'unverified_causality'", 3), ("source_type IN ('community', 'social') AND claim_type = 'opinion_or_frame'", 4),
    ("source_type IN ('community', 'social')", 5), ("source_type = 'official' AND claim_type = 'unverified_causality'", 6), ("source_type = 'official' AND claim_type = 'market_observation'", 7),
    ("source_type = 'official'", 8), ("source_type = 'company' AND claim_type = 'unverified_causality'", 9), ("source_type = 'company' AND claim_type = 'needs_official_source'", 10),
    ("source_type = 'company' AND claim_type = 'interpretation'", 11), ("source_type = 'company'", 12), ("source_type = 'analyst' AND claim_type = 'rumor'", 13),
    ("source_type = 'analyst' AND claim_type = 'unverified_causality'", 14), ("source_type = 'analyst'", 15), ("source_type = 'news' AND claim_type = 'unverified_causality'", 16),
    ("source_type = 'news' AND claim_type = 'market_observation'", 17), ("source_type = 'news' AND claim_type = 'opinion_or_frame'", 18), ("source_type = 'news'", 19),
    ("claim_type = 'unverified_causality'", 20),
]
_NOTE = "CASE " + " ".join(f"WHEN {c} THEN {_q(_NOTES[i])}" for c, i in _KIND) + f" ELSE {_q(_NOTES[21])} END"
_BESIDE = "(claim_type <> 'excluded' AND source_name IN (SELECT source_name FROM claims WHERE claim_type = 'excluded'))"
_CROWD = "(claim_type IN ('rumor', 'unobservable') OR source_type IN ('community', 'social'))"
_FAMILY = """CASE WHEN claim_type = 'excluded' THEN 'operator_policy_review' WHEN source_type = 'official' AND regexp_matches(lower(claim_text), 'exchange|turnover|net selling') THEN 'exchange_announcement'
  WHEN source_type = 'official' THEN 'regulator_notice' WHEN list_has_any(risk_flags, ['market_causality_claim', 'true_cause_market_claim']) THEN 'official_market_data'
  WHEN claim_type = 'unobservable' THEN 'observable_primary_source' WHEN source_type IN ('community', 'social') THEN 'primary_source_or_official_statement'
  WHEN source_type = 'company' THEN 'company_statement' ELSE 'official_statement' END"""
_UNSAFE = f"""CASE WHEN claim_type = 'excluded' THEN 'Do not conclude investment action, target, allocation, trade probability, or expected profit from this excluded claim.'
  WHEN {_CROWD} THEN 'Do not conclude that the social/community or unobservable claim is true without observable primary evidence.'
  WHEN claim_type = 'unverified_causality' THEN 'Do not conclude a definitive cause from this claim.' ELSE 'Do not state more than the source directly supports.' END"""
_ITEMS = f"""{_C}, k AS (SELECT *, {_CATEGORY} AS category, {_BESIDE} AS beside, {_NOTE} AS note, source_name || '/' || doc_id AS ref FROM claims),
items AS (SELECT 'must_verify' AS tier, doc_id, ref, 'Whether the claim from ' || source_name || ' is supported by observable primary or official evidence.' AS question,
    note || CASE WHEN beside THEN ' This source also contains excluded finance material; do not treat adjacent interpretation as advice or verified fact.' ELSE '' END AS reason,
    {_FAMILY} AS source_family_hint, 'timestamped_record' AS expected_evidence_type FROM k WHERE category IN ('unsupported_weak', 'rumor_manipulation')
  UNION ALL SELECT 'nice_to_verify', doc_id, ref, 'Whether an independent reputable source reports the same limited factual statement for ' || source_name || '.',
    CASE WHEN beside THEN 'Useful for context, but this source also contains excluded finance material; independent verification is recommended before downstream use.'
      ELSE 'Useful for context, but does not by itself upgrade the claim.' END, 'independent_reporting', 'corroborating_report' FROM k WHERE category = 'confirmed_low_risk'
  UNION ALL SELECT 'unsafe_to_conclude', doc_id, ref, {_UNSAFE}, '', '', '' FROM k WHERE category <> 'confirmed_low_risk')"""
ORACLE_SQL |= {
    "summary_sections": f"""{_C} SELECT doc_id, CASE WHEN claim_type = 'excluded' THEN 'excluded' WHEN {_CROWD} OR d_manipulation THEN 'rumor_social'
        WHEN risk_tier = 'low' AND claim_type IN ('confirmed_fact', 'official_reported_status', 'market_observation', 'reported_claim') THEN 'low_risk'
        WHEN claim_type IN ('unverified_causality', 'needs_official_source', 'interpretation', 'opinion_or_frame') THEN 'weak' ELSE 'other' END AS section,
        {_BESIDE} AS beside_excluded, {_NOTE} AS classification_notes, CASE WHEN claim_type = 'excluded' THEN {_q(_NOTES[0])} END AS disallowed_reason FROM claims""",
    "work_item_groups": f"""{_ITEMS} SELECT tier, question, reason, source_family_hint, expected_evidence_type, count(*) AS n, sha256(string_agg(ref, '|' ORDER BY doc_id)) AS refs
        FROM items GROUP BY 1, 2, 3, 4, 5""",
    "question_counts": f"""{_ITEMS} SELECT tier, count(*) AS raw, count(DISTINCT lower(question || '|' || reason || '|' || source_family_hint)) AS grouped FROM items GROUP BY 1""",
    "official_queries": f"""{_C} SELECT doc_id, {_FAMILY} AS family, CASE WHEN claim_type = 'excluded' THEN {_q("This finance claim is blocked by policy and remains excluded. If factual context is needed, capture a separate factual claim from a primary source.")}
        ELSE 'Check official or primary records for claim ' || doc_id || ' from ' || source_name || '.' END AS query, CASE WHEN claim_type = 'excluded' THEN 'finance_advice_or_prediction'
        WHEN {_CROWD} THEN 'rumor_or_unobservable_material' WHEN claim_type = 'unverified_causality' THEN 'unsupported_causality' ELSE 'overstatement' END AS unsafe_risk FROM claims""",
    "compared_claims": f"""{_P}, p AS (SELECT *, trim(regexp_replace(lower(claim_text), '\\s+', ' ', 'g')) AS plain FROM claims),
        k AS (SELECT *, {_KEY} AS key, {_RISKY} AS risky FROM p),
        m AS (SELECT issue_id, key, arg_min({{'t': claim_type, 'r': risk_tier, 's': source_type}}, doc_id) AS f, array_to_string(list_sort(list_distinct(list(source_name))), ',') AS sources,
          bool_or(risky) AS risky_unresolved FROM k GROUP BY 1, 2),
        b AS (SELECT * FROM m WHERE issue_id = 'before'), a AS (SELECT * FROM m WHERE issue_id = 'after'),
        j AS (SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'new' WHEN a.key IS NULL THEN 'disappeared' ELSE 'repeated' END AS status, coalesce(a.f, b.f) AS f,
          coalesce(a.sources, b.sources) AS sources, coalesce(a.risky_unresolved, b.risky_unresolved) AS risky_unresolved, (a.risky_unresolved OR b.risky_unresolved) AS open_risk FROM b FULL JOIN a ON a.key = b.key),
        s AS (SELECT * FROM j UNION ALL SELECT * REPLACE ('still_unresolved' AS status) FROM j WHERE status = 'repeated' AND open_risk)
        SELECT status, key, f.t AS claim_type, f.r AS risk_tier, f.s AS source_type, sources, risky_unresolved FROM s""",
    "review_numbers": f"""{_C} SELECT issue_id, doc_id, printf('rev_%03d', row_number() OVER (PARTITION BY issue_id ORDER BY doc_id)) AS review_id FROM claims WHERE needs_human_review""",
    "capture_names": """WITH c AS (SELECT doc_id, trim(concat_ws(' ', coalesce(source, 'none'), regexp_extract(coalesce(text, ''), '^\\S{1,12}'))) AS name FROM documents),
        n AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY doc_id) AS nth, regexp_replace(name, '[^a-zA-Z0-9_-]+', '_', 'g') AS slug FROM c),
        f AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_id) AS k FROM n WHERE nth = 1)
        SELECT doc_id, slug || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.txt' AS file_name FROM f UNION ALL SELECT doc_id, NULL FROM n WHERE nth > 1""",
    "page_types": """SELECT page_id, sha256(html) AS sha256, strlen(html)::BIGINT AS bytes, CASE WHEN page_id % 6 IN (1, 4, 5) THEN 'content type not allowed' WHEN strlen(html) > 4096 THEN 'content too large' END AS problem,
        CASE WHEN regexp_replace(trim(coalesce(url, '')), '[^a-zA-Z0-9_-]+', '_', 'g') = '' THEN 'issue' ELSE regexp_replace(trim(coalesce(url, '')), '[^a-zA-Z0-9_-]+', '_', 'g') END AS slug FROM pages""",
    "source_suggestions": """WITH c AS (SELECT page_id, regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) AS title, coalesce(url, '') AS url,
          ['', 'Press release', 'a reddit thread', 'Analyst memo', 'Community blog', 'memo on crypto', 'Investor day', 'stock forum'][1 + (page_id % 8)::INT] AS note FROM pages),
        t AS (SELECT page_id, lower(concat_ws(' ', title, url, regexp_extract(url, '^[a-z]+://([^/]*)', 1), page_id::VARCHAR, note)) AS seen,
          trim(regexp_replace(lower(CASE WHEN title = '' THEN page_id::VARCHAR ELSE title END), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM c)
        SELECT page_id, CASE WHEN name = '' THEN 'source_' || page_id ELSE name END AS suggested_name, CASE WHEN regexp_matches(seen, 'news|press|reuters|bloomberg|journal') THEN 'news'
          WHEN regexp_matches(seen, 'forum|reddit|twitter|discord|telegram') THEN 'social' WHEN regexp_matches(seen, 'analyst|research|report') THEN 'analyst'
          WHEN regexp_matches(seen, 'community|blog') THEN 'community' WHEN regexp_matches(seen, 'note|memo') THEN 'user_note'
          WHEN regexp_matches(seen, 'company|corporate|investor') THEN 'company' ELSE 'official' END AS suggested_type,
          CASE WHEN regexp_matches(seen, 'finance|stock|crypto') THEN 'finance' ELSE 'general' END AS suggested_mode FROM t""",
    "package_figures": """WITH p AS (SELECT doc_id, coalesce(['', 'Issue ID: alpha 1 ' || chr(10) || 'Sources: 3' || chr(10), '- [a](b)' || chr(10) || '* [c](d) [e](f)' || chr(10),
          'Analysis Run #1, analysis run 2' || chr(10) || 'Low-risk claim' || chr(10), 'Med risk, HIGH-RISK' || chr(10) || 'source count : 12' || chr(10)][1 + (doc_id % 5)::INT], '') || coalesce(text, '') AS t FROM documents),
        f AS (SELECT *, regexp_extract(t, '(Source Count|Sources|Total Sources)\\s*:\\s*(\\d+)', 2, 'i') AS n, trim(regexp_extract(t, 'Issue ID\\s*:\\s*([^\\n\\r]+)', 1, 'i')) AS i FROM p)
        SELECT doc_id, CASE WHEN i <> '' THEN i END AS stated_issue, CASE WHEN n <> '' THEN TRY_CAST(n AS BIGINT) ELSE len(regexp_extract_all(t, '(?m)^[-*]\\s+\\[.*?\\]\\(.*?\\)')) END AS sources,
          len(regexp_extract_all(t, '(?i)analysis run\\s*#?\\s*\\d+')) AS runs, len(regexp_extract_all(t, '(?i)low[- ]risk')) AS low, len(regexp_extract_all(t, '(?i)(medium|med)[- ]risk')) AS medium,
          len(regexp_extract_all(t, '(?i)high[- ]risk')) AS high, len(regexp_extract_all(t, '(?i)claim')) AS claims FROM f""",
}


def _numeric_items() -> str:
    """Figures that sources give differently, people counted by event and others by their words, as questions."""
    figures, people = ORACLE_SQL["numeric_divergence"], ORACLE_SQL["casualty_divergence"]
    head = figures[: figures.index("SELECT array_to_string(tokens")].rstrip()
    shown = r"""CASE WHEN ko <> '' THEN ko WHEN pct <> '' THEN regexp_extract(claim_text, '\d+(?:\.\d+)?\s*(?:%|percent|퍼센트|프로)') ELSE regexp_extract(claim_text, '\d[\d,]*(?:\.\d+)?') END"""
    head = head.replace("m AS (SELECT source_name,", f"m AS (SELECT source_name, trim(regexp_replace({shown}, '\\s+', ' ', 'g')) AS shown,", 1)
    events = people[people.index("r AS (SELECT source_name, replace(") : people.index("SELECT event, array_to_string")].rstrip()
    joined = lambda c, sep: f"array_to_string(list_sort(list_distinct(list({c}))), '{sep}')"
    several = lambda c: f"HAVING count(DISTINCT {c}) > 1 AND count(DISTINCT source_name) > 1"
    return f"""{head}, {events}, q AS (
      SELECT 'reported_people_count' AS metric, {joined("value", ",")} AS shown, {joined("source_name", ", ")} AS sources FROM e GROUP BY event {several("value")}
      UNION ALL SELECT 'reported_numeric_value', {joined("shown", ", ")}, {joined("source_name", ", ")} FROM m WHERE len(tokens) >= 2 AND magnitude IS NOT NULL GROUP BY tokens {several("magnitude")})
    SELECT 'source_divergence' AS source_name, 'medium' AS risk_tier, 'numeric divergence' AS reason,
      sha256('Which primary or official record explains the ' || metric || ' divergence across values (' || shown || ') and sources (' || sources || ')?') AS question, 'numeric:' || metric AS claim_ids FROM q"""


ORACLE_SQL["numeric_items"] = _numeric_items()
