"""Numbering, response validation and labelled cases, by cases and against brute force."""

import json
import os
from collections import Counter

from pyspark.sql import functions as F

from quillgate.operators import goldset, numbering, reviews
from quillgate.plans import handover


def test_numbering_matches_brute_force(spark):
    rows = [(i * 7 % 1009, ["a", "b", None][min(i % 5, 2)], "x" if i % 3 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, k string, extra string")
    got = {r.id: (r.nth, r.first) for r in numbering.number_within(df, ["k", "extra"], "id", "nth", "first").collect()}
    groups = {}
    for i, *key in rows:
        groups.setdefault(tuple(key), []).append(i)
    want = {i: (n, min(ids)) for ids in groups.values() for n, i in enumerate(sorted(ids), 1)}
    assert got == want
    assert numbering.number_within(df.limit(0), ["k"], "id").count() == 0
    ties = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "id long, k string")
    assert sorted(r.nth for r in numbering.number_within(ties, ["k"], "id").collect()) == [1, 2, 3]


def _finding(pid, **more):
    return {"packet_id": pid, "evidence_boundary": "one source", "uncertainty_reason": "single report", "operator_next_step": "ask the agency",
            "must_not_conclude": "Do not treat it as proven.", **more}


def _body(findings, issue="i1", **more):
    safety = {"contains_financial_advice": False, "preserves_source_boundaries": True, "fabricates_missing_evidence": False}
    return {"schema_version": reviews.RESPONSE_VERSION, "issue_id": issue, "advisory_only": True, "findings": findings, "safety_checks": safety, **more}


def _errors(spark, body, packets=(("p1", "high"), ("p2", "low"))):
    text = body if body is None or isinstance(body, str) else json.dumps(body, ensure_ascii=False)
    responses = spark.createDataFrame([("i1", text)], "issue_id string, body string")
    table = spark.createDataFrame([("i1", *p) for p in packets], "issue_id string, packet_id string, risk_tier string")
    errors = reviews.response_errors(responses, table).cache()
    verdict = reviews.response_verdicts(responses, errors).first()
    got = Counter((r.rule, r.detail) for r in errors.collect())
    assert verdict.n_errors == sum(got.values()) and verdict.valid == (not got)
    return got


def test_good_response_passes(spark):
    assert _errors(spark, _body([_finding("p1"), _finding("p2")])) == {}


def test_ids(spark):
    got = _errors(spark, _body([_finding("p2"), _finding("p2"), _finding("p9"), _finding(""), "text"]))
    assert got == {
        ("duplicate packet_id", "p2"): 1, ("unknown packet_id", "3: p9"): 1, ("unknown packet_id", "4: "): 1, ("finding is no object", "5"): 1,
        ("missing high or critical packet_id", "p1"): 1,
    }
    assert _errors(spark, _body([_finding("p9")]), packets=()) == {}


def test_places_of_findings_hold_in_all_passes(spark):
    """A body whose list comes in another order each time it is worked out, as after a shuffle."""

    shell = _body([_finding(f"p{i}", **({"evidence_boundary": "It was confirmed."} if i == 0 else {})) for i in range(8)])
    dumps = json.dumps
    body = F.udf(lambda key: dumps(shell | {"issue_id": key, "findings": sorted(shell["findings"], key=lambda _: os.urandom(8))}), "string").asNondeterministic()
    keys = [f"i{k}" for k in range(20)]
    responses = spark.createDataFrame([(k,) for k in keys], "issue_id string").withColumn("body", body("issue_id"))
    packets = spark.createDataFrame([(k, f"p{i}", "low" if i else "high") for k in keys for i in range(8)], "issue_id string, packet_id string, risk_tier string")
    got = Counter(r.rule for r in reviews.response_errors(responses, packets).collect())
    assert got == {"blocked confirmation or action language": 20, "upgrades a high or critical claim": 20}


def test_shape_and_safety(spark):
    bad = _body([{"packet_id": "p1"}, _finding("p2")], issue="other", advisory_only="true")
    bad["safety_checks"] = {"contains_financial_advice": True, "preserves_source_boundaries": True}
    assert _errors(spark, bad) == {
        ("issue_id", ""): 1, ("advisory_only", ""): 1, ("safety_checks.contains_financial_advice", ""): 1,
        ("safety_checks.fabricates_missing_evidence", ""): 1,
        ("finding lacks fields", "1: evidence_boundary, must_not_conclude, operator_next_step, uncertainty_reason"): 1,
    }
    broken = spark.createDataFrame(list(enumerate((None, "", "{", "[1]", '"s"'))), "issue_id long, body string")
    none = spark.createDataFrame([], "issue_id long, packet_id string, risk_tier string")
    assert sorted((r.issue_id, r.rule) for r in reviews.response_errors(broken, none).collect()) == [(i, "no JSON object") for i in range(5)]


def test_text_scan_reaches_any_depth(spark):
    got = _errors(spark, _body([_finding("p1", operator_next_step="It was confirmed."), _finding("p2")], extra={"deep": [["You should sell now"]]}))
    assert got["upgrades a high or critical claim", "1"] == 1
    assert got["blocked confirmation or action language", "$.findings[0].operator_next_step"] == 1
    assert got["blocked finance or advice language", "$.extra.deep[0][0]"] == 1


CASE = {"case_id": "c1", "text": "Buy now.", "language": "en", "mode": "finance", "source_type": "news", "status": "enforced", "expected_tiers": ["critical"]}


def _problems(spark, *lines):
    rows = [(n, x if isinstance(x, str) else json.dumps(x)) for n, x in enumerate(lines, 1)]
    return {(r.line_no, r.problem) for r in goldset.case_problems(spark.createDataFrame(rows, "line_no long, line string")).collect()}


def test_case_schema(spark):
    assert _problems(spark, CASE) == set()
    assert _problems(spark, CASE, "{", "[]", {**CASE, "text": "x"}) == {(2, "no JSON object"), (3, "no JSON object"), (4, "duplicate case_id, first on line 1")}
    bare = {k: v for k, v in CASE.items() if k not in ("expected_tiers", "status")}
    assert _problems(spark, bare) == {(1, "status is missing"), (1, "no expectation")}
    wrong = {**CASE, "case_id": "c2", "language": "fr", "detector_labels": {"odd": 1}, "expected_tiers": [], "masking": {"must_mask": [1]}}
    assert _problems(spark, wrong) == {
        (1, "language is outside its domain"), (1, "detector_labels has unknown keys"), (1, "detector_labels must be boolean"),
        (1, "expected_tiers must be a non-empty list"), (1, "masking.must_mask must be a list of strings"),
    }


def test_evaluation(spark, tmp_path):
    cases = [
        {**CASE, "detector_labels": {"action_language": True, "causality": False}, "expected_claim_types": ["excluded"], "masking": {"must_mask": ["Buy"], "must_preserve": ["now"]}},
        {**CASE, "case_id": "c2", "text": "The program is scheduled to start.", "mode": "general", "status": "aspirational", "expected_tiers": ["high"],
         "detector_labels": {"causality": True}, "masking": {"must_mask": ["program"]}},
        {**CASE, "case_id": "c3", "text": "외국인 순매도가 이어졌다.", "language": "ko", "expected_tiers": None, "detector_labels": {"action_language": False}},
    ]
    path = tmp_path / "gold.jsonl"
    path.write_text("\n\n".join(json.dumps(c, ensure_ascii=False) for c in cases), encoding="utf-8")
    lines = goldset.read_lines(spark, str(path))
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == [1, 3, 5] and goldset.case_problems(lines).count() == 0
    out = goldset.evaluate(goldset.parse_cases(lines))
    assert {r.case_id: r.passed for r in out.collect()} == {"c1": True, "c2": False, "c3": True}
    assert goldset.failures(out).first().reason == "detectors: causality; tier low; masking left: program"
    m = {(r.detector, r.language): (r.tp, r.fp, r.fn, r.tn) for r in goldset.detector_metrics(out).collect()}
    assert m["causality", None] == (0, 0, 1, 1) and m["action_language", "ko"] == (0, 0, 0, 1) and m["action_language", None] == (1, 0, 0, 1)
    a = {r.language: r for r in goldset.accuracies(out).collect()}
    assert (a[None].tier_total, a[None].tier_correct, a[None].tier_accuracy) == (2, 1, 0.5) and a["ko"].tier_accuracy is None
    assert {r.status: (r.total, r.passing, r.failing) for r in goldset.status_summary(out).collect()} == {"enforced": (2, 2, 0), "aspirational": (1, 0, 1)}


def test_leaves_of_nested_documents(spark, sf):
    deep = '{"a":' * 400 + '"end"' + "}" * 400
    bodies = {
        1: '"alone"', 2: '{"a":["x",{"b":"y","c":[[],["z"]],"n":1,"t":true,"o":null}],"e":{},"s":""}', 3: "broken", 4: "7", 5: deep, 6: "[" * 1001 + '"x"' + "]" * 1001, 7: '[{"a.b":"[{[{"}, "\\u00e9"]', 8: None, 9: "null",
        10: "[" * 1000 + '"x"' + "]" * 1000, 11: '{"d":"2020-01-01","f":1.5}',
    }
    rows = spark.createDataFrame(list(bodies.items()), "id int, body string")
    found = reviews.leaves(rows, "id", "body")
    got = {(r.id, r.path, r.text) for r in found.collect()}
    want = {(1, "$", "alone"), (2, "$.a[0]", "x"), (2, "$.a[1].b", "y"), (2, "$.a[1].c[1][0]", "z"), (2, "$.s", ""), (5, "$" + ".a" * 400, "end"), (7, "$[0].a.b", "[{[{"), (7, "$[1]", "é"), (11, "$.d", "2020-01-01")}
    assert {g for g in got if g[0] not in (6, 10)} == want
    assert {g for g in got if g[0] in (6, 10)} == {(10, "$" + "[0]" * 1000, "x")}
    # A document is taken apart in its row: no level of all documents goes to another stage.
    assert "UnionLoop" not in handover.json_leaves(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
