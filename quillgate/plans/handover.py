"""Queries of the catalogue, its gates and what is handed on, over the driver's tables, whole; and their SQL.

Manifests, reviews, captures and paths follow from the tables' columns and ids; the SQL states what must come of them from
these columns, and not by way of the JSON or paths that the queries take apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate import catalogue
from quillgate.functions import json_schema, strings
from quillgate.operators import analytics, bundle, claims, classify, helpers, reviews, verification, viewer
from quillgate.operators.lineage import cut
from quillgate.session import shared_folder

from .oracle import _CASE_QUESTION, _CASE_REASON, _ITEMS
from .queries import _SEED, _claims_sql, _decision_sql, _detected, _flag_sql, _named_claims, _q, _work_items, seed, spread, table
from .split_sql import split

_c = F.col


def _mod(k: str, n: int) -> Column:
    return F.pmod(k, F.lit(n))


def _number() -> Column:
    return F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d+)$", 1).try_cast("int")


# classified claims of whole texts ---------------------------------------------------------------------------------------


def classified_claims(spark, sf):
    """Every claim that the splitter finds in the documents, classified as its source's."""
    head = ["doc_id", "issue_id", "source_name", "source_type", "mode", "published_at", "observable_state"]
    rows = seed(spark, sf, plain=True).select(*head, _c("claim_text").alias("text"))
    found = classify.classify(claims.extract_claims(rows, head).select(*head, "claim_no", "claim_text"))
    return found.select("doc_id", "claim_no", "claim_type", "risk_tier", "needs_human_review", F.array_join("risk_flags", ",").alias("flags"), "normalized_claim_hash")


_SPLIT_SEED = _SEED.replace(_SEED[_SEED.index("(list_value('The market fell") : _SEED.index(" AS claim_text")], "coalesce(text, '')", 1)
_SPLIT_CLAIMS = f"""WITH {split("documents", "doc_id", "text")}, {_SPLIT_SEED.replace("seed AS", "seed0 AS", 1)},
seed AS (SELECT s.* REPLACE (c.claim_text AS claim_text), c.claim_no FROM split_claims c JOIN seed0 s ON s.doc_id = c.doc_id), {_detected()}, {_flag_sql()}, {_decision_sql()}"""


# the catalogue ----------------------------------------------------------------------------------------------------------


def catalogued_claims(spark, sf):
    """The ledger of two issues, a run for each source, stored in a catalogue of the shared folder; of one issue the claims
    that its index names, with the modes of its manifest.  The index leaves out sources whose number ends in 4."""
    root = f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}"
    rows = classify.ledger(classify.classify(seed(spark, sf))).withColumns({"run_id": F.concat_ws("/", "issue_id", "source_name"), "source_id": F.lit("src_001"), "source_no": F.lit(1).cast("long"), "claim_no": _c("doc_id")})
    kept = rows.select("doc_id", "issue_id", "run_id", "source_id", "source_name", "source_type", "source_no", "claim_no", "claim_type", "risk_tier", "needs_human_review")
    catalogue.store("claims", kept, root)
    names = seed(spark, sf).select("issue_id", "source_name", "mode", _c("doc_id").alias("at"))
    catalogue.store("manifests", names, root)
    own = names.groupBy("issue_id", "source_name").agg(F.min_by("mode", "at").alias("mode"), F.min("at").alias("sequence"))
    catalogue.store("runs", own.filter("not endswith(source_name, '4')").withColumn("run_id", F.concat_ws("/", "issue_id", "source_name")), root)
    return catalogue.Catalogue(spark, root).collect("after").select("doc_id", "run_id", "source_name", "mode", "source_mode", "claim_type", "risk_tier")


def source_modes(spark, sf):
    """Documents as claims, with the mode that the last entry of their source in the manifest gives it."""
    rows = seed(spark, sf, plain=True).select("doc_id", "issue_id", "source_name", "mode")
    entries = rows.filter("doc_id % 11 <> 0 and not endswith(source_name, '5')").withColumnRenamed("doc_id", "at")
    out = catalogue.with_source_mode(rows, catalogue.source_modes(entries))
    return out.select("doc_id", "issue_id", "source_name", "source_mode", catalogue.mask_mode().alias("masked_as"))


def ledger_integrity(spark, sf):
    """Records of sources, some of them bad, some missing, and the documents as claims of them: what is wrong."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source_id"), F.coalesce(_mod("doc_id", 3), F.lit(0)).cast("string").alias("run_id"), _number().alias("k"))
    records = docs.filter("coalesce(k, 0) % 7 <> 3").groupBy("run_id", "source_id").agg(F.first("k").alias("k"), F.count("*").alias("n")).select(
        "run_id", F.when(F.coalesce(_mod("k", 10) == 9, F.lit(False)), " ").otherwise(_c("source_id")).alias("source_id"), F.when(_mod("k", 5) == 1, "odd").otherwise("news").alias("source_type"),
        F.when(_mod("k", 5) == 2, "").otherwise(_c("source_id")).alias("source_name"), F.when(_mod("k", 4) != 1, "finance").alias("mode"), F.when(_mod("k", 5) != 4, "2026-01-01").alias("captured_at"),
    )
    records = cut(records)
    lost = analytics.missing_sources(docs.select(_c("doc_id").alias("claim_id"), "run_id", "source_id"), records)
    return analytics.source_violations(records).unionByName(lost.select(F.lit("claim").alias("entity"), _c("claim_id").cast("string").alias("id"), F.lit("source is missing").alias("rule")))


# JSON -------------------------------------------------------------------------------------------------------------------


def _manifest_of_turn() -> Column:
    """A conversation's turn as an acquisition manifest, with faults that follow from its number."""
    t = lambda n: F.pmod(F.coalesce("turn", F.lit(0)), F.lit(n))
    name = F.when(t(7) == 2, "").otherwise(_c("role"))
    mode = F.when(t(9) == 4, "odd").when(t(2) == 0, "finance").otherwise("general")
    url = F.when(t(13) != 5, F.when(t(4) == 3, "ftp://x").otherwise(F.concat(F.lit("http://x/"), F.coalesce("turn", F.lit(0)).cast("string"))))
    one = lambda title: F.struct(name.alias("source_name"), F.lit("news").alias("source_type"), mode.alias("mode"), url.alias("url"), title.alias("title"))
    copies = F.when(t(10) == 6, 0).when(t(17) == 8, 21).otherwise(1)
    issue = F.when(t(11) != 3, F.when(t(5) == 0, "").otherwise(_c("conv_id").cast("string")))
    whole = lambda title: F.to_json(F.struct(issue.alias("issue_id"), F.array_repeat(one(title), copies).alias("sources")))
    return F.when(t(6) == 1, whole(F.lit(5))).otherwise(whole(_c("text")))


def schema_violations(spark, sf):
    """Which rules of the schema the manifests made of all turns break, where, and how often."""
    found = F.explode(json_schema.violations(_manifest_of_turn(), json_schema.SCHEMAS["acquisition-manifest"]))
    rows = spread(table(spark, sf, "conversations")).select(found.alias("v"))
    return rows.groupBy(F.regexp_replace("v.path", "[0-9]+", "*").alias("path"), _c("v.rule").alias("rule")).agg(F.count("*").alias("n"))


def json_leaves(spark, sf):
    """Strings of documents as nested JSON, with their paths; some documents are broken."""
    body = F.to_json(F.struct("doc_id", F.array(F.to_variant_object(F.struct(F.coalesce("lang", F.lit("")).alias("l"))), F.to_variant_object(F.struct("source", F.array("text", F.lit("x")).alias("t")))).alias("a"), F.lit(True).alias("b")))
    rows = spread(table(spark, sf, "documents")).select("doc_id", F.when(_mod("doc_id", 13) == 4, F.expr("'{' || text")).otherwise(body).alias("body"))
    return reviews.leaves(rows, "doc_id", "body").select("doc_id", "path", F.sha2("text", 256).alias("text"))


def imported_reviews(spark, sf):
    """Turns as reviews from outside: text, JSON objects, lists, numbers and strings, and broken JSON."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", "")
    turn = F.coalesce("turn", F.lit(0))
    k = F.pmod(turn, F.lit(5))
    text = F.when(k == 0, F.concat(F.lit('{"t":"'), plain, F.lit('"}'))).when(k == 1, F.concat(F.lit('["'), plain, F.lit('"]'))).when(k == 2, turn.cast("string")).when(k == 3, F.concat(F.lit('{"'), plain)).otherwise(F.concat(F.lit('"'), plain, F.lit('"')))
    name = F.concat(F.lit("r"), turn.cast("string"), F.when(F.pmod(turn, F.lit(3)) == 0, ".md").otherwise(".JSON"))
    rows = helpers.imported(spread(table(spark, sf, "conversations")).select("conv_id", "turn", name.alias("path"), text.alias("text")))
    return rows.select("conv_id", "turn", "review_id", F.sha2("raw_text", 256).alias("raw"), F.sha2("parsed_json", 256).alias("parsed"), "problem")


def helper_index(spark, sf):
    """Documents as a helper's index; two share a packet, of which the last is there counts, and some packets are missing."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.concat(F.lit("p"), (_c("doc_id") - _mod("doc_id", 2)).cast("string")).alias("packet_id"))
    tier = F.get(F.array(*map(F.lit, ["low", "medium", "high", "critical"])), _mod("doc_id", 4).cast("int"))
    ask = lambda *q: F.array(*[F.struct(x.alias("question")) for x in q])
    none = F.array().cast("array<struct<question:string>>")
    entries = docs.filter("doc_id % 3 <> 1").select(
        _c("doc_id").alias("at"), "packet_id", F.when(_mod("doc_id", 4) == 1, F.concat(F.lit(" Q "), _c("doc_id").cast("string"))).otherwise(" ").alias("verification_question"),
        F.when(_mod("doc_id", 5) == 0, ask(F.lit(""), F.concat(F.lit("M "), "source"))).otherwise(none).alias("must_verify"),
        F.when(_mod("doc_id", 7) != 0, ask(F.concat(F.lit("E "), "source"))).alias("evidence_questions"),
    )
    rows = helpers.review_index(docs.withColumn("risk_tier", tier), entries)
    return rows.select("doc_id", "packet_id", "review_bucket", "review_instruction", "verification_question")


# paths and names --------------------------------------------------------------------------------------------------------


def _page_path() -> Column:
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-z]+:/", "")
    starts = ["/data/in", "x/../y/.", "/other/../data/./in/..//in", "/data/inside", "../..", "/data/in/../.."]
    start = F.get(F.array(*map(F.lit, starts)), _mod("page_id", len(starts)).cast("int"))
    turn = F.when(_mod("page_id", 7) == 3, "/../../..").when(_mod("page_id", 7) == 5, "/.").otherwise("")
    return F.concat(start, rest, turn)


def manifest_paths(spark, sf):
    """Pages' addresses as files with detours: how a manifest in a folder names them, and how a report shows them."""
    path, base = _page_path(), F.lit("/data//in/.")
    stated_ = strings.manifest_path(path, base)
    return table(spark, sf, "pages").select("page_id", stated_["file_path"].alias("file_path"), stated_["warnings"].isNotNull().alias("warned"), strings.shown_path(path, base).alias("shown"))


def free_capture_names(spark, sf):
    """Documents as captures of eight issues, whose names fall together as slugs, after a log: the names of their files.
    Signs that a slug folds into one tell the names apart; they spell a number in binary, so that names stay short."""
    part = F.expr("1 + doc_id div 40")
    sep = F.when(part > 0, F.translate(F.bin(part), "01", "~#")).otherwise("")
    own = F.concat(F.lit("src"), sep, F.coalesce(_number(), F.lit(0)).cast("string"))
    last = F.when(_mod("doc_id", 4) == 2, F.concat(sep, F.lit("2"))).when(_mod("doc_id", 4) == 3, F.concat(sep, F.lit("4"))).otherwise("")
    issue = F.concat(F.lit("i"), _mod("doc_id", 8).cast("string")).alias("issue_id")
    docs = table(spark, sf, "documents").filter("doc_id is not null")
    log = docs.filter("doc_id % 17 = 5").select(issue, F.concat(F.lit("old "), _c("doc_id").cast("string")).alias("source_name"), F.concat(F.lit("/w/src_"), F.coalesce(_number(), F.lit(0)).cast("string"), F.lit("_"), (_mod("doc_id", 3) + 2).cast("string"), F.lit(".txt")).alias("file_path"))
    files, again = bundle.capture_files(cut(docs.select("doc_id", issue, F.concat(own, last).alias("source_name"))), "doc_id", log)
    return files.select("doc_id", "file_name").union(again.select("doc_id", F.lit(None).cast("string").alias("file_name")))


# work lists -------------------------------------------------------------------------------------------------------------


def work_item_references(spark, sf):
    """The claims of each group of work items, one row each."""
    return verification.item_references(_work_items(spark, sf)).select("tier", "group_id", "nth", "claim_ref")


def review_references(spark, sf):
    """The claims of each group of review items, one row each, with what the group asks."""
    rows = _named_claims(spark, sf).filter("needs_human_review")
    todo = rows.select("source_name", "risk_tier", classify.review_reason().alias("reason"), classify.review_question().alias("verification_question"), _c("doc_id").cast("string").alias("claim_id"), _c("doc_id").alias("at"))
    return bundle.review_references(todo).select("source_name", "risk_tier", "reason", "verification_question", "nth", "claim_id")


def _acquired(spark, sf) -> DataFrame:
    """Pages as acquired sources: some not fetched, some with warnings."""
    warned = F.when(_mod("page_id", 5) == 0, F.array(F.col("url"))).when(_mod("page_id", 5) == 1, F.array().cast("array<string>"))
    return table(spark, sf, "pages").select("page_id", F.when(_mod("page_id", 4) != 0, "fetched").when(_mod("page_id", 8) == 4, "http_error").alias("status"), warned.alias("warnings"))


def candidate_cards(spark, sf):
    """Pages as cards of a viewer: which an imported selection checks, as what, and which chips show them."""
    rows = _acquired(spark, sf).withColumn("candidate_id", _c("page_id").cast("string"))
    again = F.explode(F.sequence(F.lit(1), F.when(_mod("page_id", 6) == 0, 2).otherwise(1)))
    chosen = rows.filter("page_id % 3 = 0").select("page_id", again.alias("k"), "candidate_id").select(
        "candidate_id", (_c("page_id") * 2 - _c("k")).alias("at"), F.format_string("source %d of %s", "k", "candidate_id").alias("source_name"), F.lit("news").alias("source_type"),
        F.when(_c("k") == 1, "finance").otherwise("general").alias("mode"),
    )
    shown = F.array_join(F.array_compact(F.array(*[F.when(viewer.chip(n), F.lit(n)) for n in ("all", "fetched", "warning", "non-fetched")])), ",")
    return viewer.restored(rows, chosen).select("page_id", "checked", "source_name", "source_type", "mode", shown.alias("chips"))


def acquired_triage(spark, sf):
    return bundle.triage_counts(_acquired(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        classified_claims, catalogued_claims, source_modes, ledger_integrity, schema_violations, json_leaves, imported_reviews, helper_index, manifest_paths, free_capture_names,
        work_item_references, review_references, candidate_cards, acquired_triage,
    )
}

_MODES = "CASE WHEN doc_id % 3 = 0 THEN 'general' ELSE 'finance' END"
_FOLD = "list_reduce(list_prepend('', string_split({}, '/')), lambda a, p: CASE WHEN p IN ('', '.') THEN a WHEN p = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || p END)"
_TOLD = [
    ("high", "Treat as unresolved unless independent primary evidence is supplied."), ("medium", "Treat as review-needed and preserve uncertainty."),
    ("low", "Treat as low-risk only within the supplied source boundaries."),
]
_NUMBER = "coalesce(try_cast(regexp_extract(coalesce(source, ''), '(\\d+)$', 1) AS INT), 0)"
ORACLE_SQL: dict[str, str] = {
    "classified_claims": f"""{_SPLIT_CLAIMS} SELECT doc_id, claim_no::INT AS claim_no, claim_type, risk_tier, needs_human_review, array_to_string(risk_flags, ',') AS flags, normalized_claim_hash FROM claims""",
    "catalogued_claims": f"""{_claims_sql()}, own AS (SELECT issue_id, source_name, arg_min(mode, doc_id) AS m, arg_max(mode, doc_id) AS last FROM claims GROUP BY 1, 2)
        SELECT doc_id, c.issue_id || '/' || c.source_name AS run_id, c.source_name, m AS mode, last AS source_mode, claim_type, risk_tier FROM claims c JOIN own o ON c.issue_id = o.issue_id AND c.source_name = o.source_name
        WHERE c.issue_id = 'after' AND c.source_name NOT LIKE '%4'""",
    "source_modes": f"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'before' ELSE 'after' END AS issue_id, coalesce(source, 'none') AS source_name, {_MODES} AS mode FROM documents),
        l AS (SELECT issue_id, source_name, arg_max(mode, doc_id) AS source_mode FROM s WHERE doc_id % 11 <> 0 AND source_name NOT LIKE '%5' GROUP BY 1, 2)
        SELECT doc_id, s.issue_id, s.source_name, source_mode, CASE WHEN source_mode = 'finance' THEN 'finance' ELSE 'general' END AS masked_as FROM s LEFT JOIN l ON s.issue_id = l.issue_id AND s.source_name = l.source_name""",
    "ledger_integrity": f"""WITH d AS (SELECT doc_id, coalesce(source, 'none') AS sid, (doc_id % 3)::VARCHAR AS run, {_NUMBER} AS k FROM documents),
        r AS (SELECT DISTINCT run, CASE WHEN k % 10 = 9 THEN ' ' ELSE sid END AS sid, sid AS name, k FROM d WHERE k % 7 <> 3)
        SELECT 'source' AS entity, run || '/' || sid AS id, 'source_id is missing' AS rule FROM r WHERE trim(sid) = ''
        UNION ALL SELECT 'source', run || '/' || sid, 'unknown source type' FROM r WHERE trim(sid) <> '' AND k % 5 = 1
        UNION ALL SELECT 'source', run || '/' || sid, 'source_name is missing' FROM r WHERE trim(sid) <> '' AND k % 5 = 2
        UNION ALL SELECT 'source', run || '/' || sid, 'captured_at is missing' FROM r WHERE trim(sid) <> '' AND k % 5 = 4
        UNION ALL SELECT 'source', run || '/' || sid, 'unknown mode' FROM r WHERE k % 4 = 1
        UNION ALL SELECT 'claim', doc_id::VARCHAR, 'source is missing' FROM d WHERE k % 7 = 3 OR k % 10 = 9""",
    "schema_violations": """WITH t AS (SELECT coalesce(turn, 0) AS t, CASE WHEN coalesce(turn, 0) % 11 <> 3 THEN CASE WHEN coalesce(turn, 0) % 5 = 0 THEN '' ELSE conv_id::VARCHAR END END AS issue,
          CASE WHEN coalesce(turn, 0) % 7 = 2 THEN '' ELSE role END AS name, CASE WHEN coalesce(turn, 0) % 10 = 6 THEN 0 WHEN coalesce(turn, 0) % 17 = 8 THEN 21 ELSE 1 END AS n FROM conversations),
        v AS (SELECT '/' AS path, 'required' AS rule, 1 AS n FROM t WHERE issue IS NULL UNION ALL SELECT '/issue_id', 'minLength', 1 FROM t WHERE issue = ''
          UNION ALL SELECT '/sources', 'minItems', 1 FROM t WHERE n = 0 UNION ALL SELECT '/sources', 'maxItems', 1 FROM t WHERE n = 21
          UNION ALL SELECT '/sources/*', 'required', n FROM t WHERE name IS NULL UNION ALL SELECT '/sources/*/source_name', 'minLength', n FROM t WHERE name = ''
          UNION ALL SELECT '/sources/*/mode', 'enum', n FROM t WHERE t % 9 = 4 UNION ALL SELECT '/sources/*', 'required', n FROM t WHERE t % 13 = 5
          UNION ALL SELECT '/sources/*/url', 'pattern', n FROM t WHERE t % 13 <> 5 AND t % 4 = 3 UNION ALL SELECT '/sources/*/title', 'type', n FROM t WHERE t % 6 = 1)
        SELECT path, rule, sum(n)::BIGINT AS n FROM v GROUP BY 1, 2 HAVING sum(n) > 0""",
    "json_leaves": """WITH d AS (SELECT * FROM documents WHERE doc_id % 13 <> 4)
        SELECT doc_id, '$.a[0].l' AS path, sha256(coalesce(lang, '')) AS text FROM d UNION ALL SELECT doc_id, '$.a[1].source', sha256(source) FROM d WHERE source IS NOT NULL
        UNION ALL SELECT doc_id, '$.a[1].t[0]', sha256(text) FROM d WHERE text IS NOT NULL UNION ALL SELECT doc_id, '$.a[1].t[1]', sha256('x') FROM d""",
    "imported_reviews": """WITH p AS (SELECT conv_id, turn, coalesce(turn, 0) AS t, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g') AS s FROM conversations),
        x AS (SELECT *, CASE t % 5 WHEN 0 THEN '{"t":"' || s || '"}' WHEN 1 THEN '["' || s || '"]' WHEN 2 THEN t::VARCHAR WHEN 3 THEN '{"' || s ELSE '"' || s || '"' END AS raw FROM p)
        SELECT conv_id, turn, 'helper_review_' || substr(sha256(raw), 1, 16) AS review_id, sha256(CASE WHEN t % 3 = 0 THEN raw ELSE '' END) AS raw,
          sha256(CASE WHEN t % 3 = 0 OR t % 5 = 3 THEN '{}' WHEN t % 5 = 0 THEN raw ELSE '{"items":' || raw || '}' END) AS parsed, CASE WHEN t % 3 <> 0 AND t % 5 = 3 THEN 'broken JSON' END AS problem FROM x""",
    "helper_index": f"""WITH d AS (SELECT doc_id, coalesce(source, 'none') AS source, 'p' || (doc_id - doc_id % 2) AS packet_id, ['low', 'medium', 'high', 'critical'][1 + doc_id % 4] AS tier FROM documents),
        e AS (SELECT packet_id, arg_max(CASE WHEN doc_id % 4 = 1 THEN 'Q ' || doc_id WHEN doc_id % 5 = 0 THEN 'M ' || source WHEN doc_id % 7 <> 0 THEN 'E ' || source ELSE '' END, doc_id) AS q FROM d WHERE doc_id % 3 <> 1 GROUP BY 1)
        SELECT doc_id, d.packet_id, CASE WHEN tier IN ('high', 'critical') THEN 'unsafe_or_high_risk_review_only' WHEN tier = 'medium' THEN 'review_needed' ELSE 'low_risk_within_source_boundary' END AS review_bucket,
          CASE WHEN tier IN ('high', 'critical') THEN {_q(_TOLD[0][1])} WHEN tier = 'medium' THEN {_q(_TOLD[1][1])} ELSE {_q(_TOLD[2][1])} END AS review_instruction,
          CASE WHEN coalesce(q, '') = '' THEN 'What source or context must be checked before relying on this claim?' ELSE q END AS verification_question FROM d LEFT JOIN e ON d.packet_id = e.packet_id""",
    "manifest_paths": f"""WITH p AS (SELECT page_id, ['/data/in', 'x/../y/.', '/other/../data/./in/..//in', '/data/inside', '../..', '/data/in/../..'][1 + page_id % 6] || regexp_replace(coalesce(url, ''), '^[a-z]+:/', '') ||
          CASE page_id % 7 WHEN 3 THEN '/../../..' WHEN 5 THEN '/.' ELSE '' END AS path FROM pages),
        f AS (SELECT *, {_FOLD.format("CASE WHEN path LIKE '/%' THEN path ELSE '/data/in/' || path END")} AS met, {_FOLD.format("path")} AS alone FROM p),
        s AS (SELECT *, met = '/data/in' OR met LIKE '/data/in/%' AS inside FROM f)
        SELECT page_id, CASE WHEN met = '/data/in' THEN '.' WHEN inside THEN substr(met, 10) ELSE path END AS file_path, NOT inside AS warned,
          CASE WHEN met = '/data/in' THEN '.' WHEN inside THEN substr(met, 10) ELSE '<redacted-external-path>/' || CASE WHEN alone = '' THEN 'path' ELSE regexp_extract(alone, '([^/]*)$', 1) END END AS shown FROM s""",
    "work_item_references": f"""{_ITEMS}, e AS (SELECT tier, substr(sha256(concat_ws(chr(1), tier, lower(trim(question)), lower(trim(reason)), lower(trim(source_family_hint)), lower(trim(expected_evidence_type)))), 1, 16) AS group_id,
          ref, min(doc_id) AS k FROM items GROUP BY 1, 2, 3)
        SELECT tier, group_id, row_number() OVER (PARTITION BY group_id ORDER BY k) AS nth, ref AS claim_ref FROM e""",
    "review_references": f"""{_claims_sql()}, r AS (SELECT source_name, risk_tier, {_CASE_REASON} AS reason, {_CASE_QUESTION} AS verification_question, doc_id FROM claims WHERE needs_human_review)
        SELECT source_name, risk_tier, reason, verification_question, row_number() OVER (PARTITION BY source_name, risk_tier, reason, verification_question ORDER BY doc_id) AS nth, doc_id::VARCHAR AS claim_id FROM r""",
    "candidate_cards": """SELECT page_id, page_id % 3 = 0 AS checked, CASE WHEN page_id % 6 = 0 THEN 'source 2 of ' || page_id WHEN page_id % 3 = 0 THEN 'source 1 of ' || page_id END AS source_name,
        CASE WHEN page_id % 3 = 0 THEN 'news' END AS source_type, CASE WHEN page_id % 6 = 0 THEN 'general' WHEN page_id % 3 = 0 THEN 'finance' END AS mode,
        'all' || CASE WHEN page_id % 4 <> 0 THEN ',fetched' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN ',warning' ELSE '' END || CASE WHEN page_id % 4 = 0 THEN ',non-fetched' ELSE '' END AS chips FROM pages""",
    "acquired_triage": """SELECT count(*) AS attempted, count_if(page_id % 4 <> 0)::BIGINT AS fetched, count_if(page_id % 5 = 0)::BIGINT AS with_warnings, count_if(page_id % 4 = 0)::BIGINT AS not_fetched FROM pages""",
    "free_capture_names": f"""WITH RECURSIVE d AS (SELECT doc_id, 'i' || doc_id % 8 AS issue, {_NUMBER} AS k, repeat('#', (1 + doc_id // 40)::INT) AS sep FROM documents WHERE doc_id IS NOT NULL),
        l AS (SELECT issue, list('src_' || k || '_' || (2 + doc_id % 3)) AS used FROM d WHERE doc_id % 17 = 5 GROUP BY issue),
        n AS (SELECT doc_id, issue, 'src' || sep || k || CASE doc_id % 4 WHEN 2 THEN sep || '2' WHEN 3 THEN sep || '4' ELSE '' END AS name, 'src_' || k || CASE doc_id % 4 WHEN 2 THEN '_2' WHEN 3 THEN '_4' ELSE '' END AS slug FROM d),
        o AS (SELECT *, row_number() OVER (PARTITION BY issue, name ORDER BY doc_id) AS nth FROM n),
        c AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY doc_id) AS rn FROM o WHERE nth = 1),
        s(issue, rn, doc_id, stem, used) AS (SELECT i.issue, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, coalesce(l.used, []::VARCHAR[]) FROM (SELECT DISTINCT issue FROM c) i LEFT JOIN l ON l.issue = i.issue
          UNION ALL SELECT t.issue, t.rn, t.doc_id, t.stem, list_append(t.used, t.stem) FROM (SELECT c.issue, c.rn, c.doc_id, s.used, CASE WHEN NOT list_contains(s.used, c.slug) THEN c.slug ELSE c.slug || '_' ||
            list_filter(range(2, len(s.used) + 3), lambda x: NOT list_contains(s.used, c.slug || '_' || x))[1] END AS stem FROM s JOIN c ON c.issue = s.issue AND c.rn = s.rn + 1) t)
        SELECT doc_id, stem || '.txt' AS file_name FROM s WHERE doc_id IS NOT NULL UNION ALL SELECT doc_id, NULL FROM o WHERE nth > 1""",
}
