"""From files to ledgers, reports and checks through the command line; manifests and their joins."""

import json

from quillgate import workspace as ws
from quillgate.__main__ import main
from quillgate.sources import manifests


def _lines(path):
    return "\n".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("part-*")))


def test_manifest_to_report_and_responses(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿The market fell because investors sold.\n\nBuy now before it is too late.\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("The [report] was filed on time.\n", encoding="utf-8")
    sources = [{"source_name": "wire", "source_type": "news", "mode": "finance", "file_path": "a.txt"}, {"source_type": "FORUM", "mode": "general", "file_path": "b.md"}]
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps({"issue_id": "i1", "sources": sources}), encoding="utf-8")
    out, out2 = str(tmp_path / "run"), str(tmp_path / "run2")
    assert main(["analyze-manifest", str(manifest), out], spark) == 0
    got = {r.claim_text: (r.source_name, r.source_type, r.claim_type) for r in ws.read_claims(spark, out).collect()}
    assert got == {
        "The market fell because investors sold.": ("wire", "news", "unverified_causality"), "Buy now before it is too late.": ("wire", "news", "excluded"),
        "The [report] was filed on time.": ("source_002", "community", "reported_claim"),
    }
    assert main(["validate-run", out], spark) == 0 and main(["report", out], spark) == 0
    text = _lines(tmp_path / "run" / "report")
    assert "## Rumors\n- None\n" in text and "- The \\[report\\] was filed on time. (source: source_002; type: reported_claim;" in text
    assert "[excluded-unsafe-finance-claim] (source: wire" in text and "Buy now" not in text and text.startswith("# Evidence report\n")

    assert main(["analyze-file", str(tmp_path / "b.md"), out2, "--issue", "i1", "--type", "community"], spark) == 0
    assert main(["compare", out, out2, str(tmp_path / "cmp")], spark) == 0
    assert "- Repeated claims: 1, still unresolved: 0" in _lines(tmp_path / "cmp" / "comparison_report")

    packets = ws.write_packets(spark, out2).collect()
    finding = {"packet_id": packets[0].packet_id, "evidence_boundary": "one post", "uncertainty_reason": "single post", "operator_next_step": "ask", "must_not_conclude": "Do not settle it."}
    safety = {"contains_financial_advice": False, "preserves_source_boundaries": True, "fabricates_missing_evidence": False}
    body = {"schema_version": "mock-llm-review-v1", "issue_id": "i1", "advisory_only": True, "findings": [finding], "safety_checks": safety}
    response = tmp_path / "r.json"
    response.write_text(json.dumps(body), encoding="utf-8")
    assert main(["validate-response", out2, str(response), str(tmp_path / "val")], spark) == 0
    response.write_text(json.dumps({**body, "advisory_only": 1}), encoding="utf-8")
    assert main(["validate-response", out2, str(response), str(tmp_path / "val")], spark) == 2
    assert _lines(tmp_path / "val" / "response_report").splitlines() == ["# Response validation", "## i1: FAIL", "- advisory_only"]


def test_bundle_reports(spark, tmp_path):
    (tmp_path / "a.txt").write_text("The bridge was closed on Friday.\n\nBuy now before it is too late.\n\n12 people were injured after the flood.\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("The bridge was closed on Friday.\n\n15 people were injured after the flood.\n", encoding="utf-8")
    sources = [{"source_name": n, "source_type": t, "mode": "finance", "file_path": f"{n}.txt"} for n, t in (("a", "news"), ("b", "forum"))]
    manifest, run = tmp_path / "m.json", tmp_path / "run"
    manifest.write_text(json.dumps({"issue_id": "i1", "sources": sources}), encoding="utf-8")
    assert main(["analyze-manifest", str(manifest), str(run)], spark) == 0
    ledger = ws.read_claims(spark, str(run)).collect()
    assert {(r.run_id, r.source_id, r.source_count) for r in ledger} == {("i1/a", "src_001", 1), ("i1/b", "src_001", 1)}
    assert {r.disallowed_reason is not None for r in ledger if r.claim_type == "excluded"} == {True} and all(r.classification_notes for r in ledger)
    for command in ("bundle-summary", "verification-packet", "operator-package"):
        assert main([command, str(run)], spark) == 0
    text = _lines(run / "bundle_summary")
    assert text.startswith("# Issue Bundle Operator Summary\n\n- Issue ID: i1\n- Source count: 2\n") and "Buy now" not in text
    assert "Cross-source repeated claim group bundle_dup_001" in text and "2 reported values for reported_people_count (12,15) across sources (a, b)" in text
    assert "Operator caution" in text and "numeric:reported_people_count (source_divergence): Which primary" in text
    assert text.index("## Low-Risk") < text.index("## Unsupported") < text.index("## Rumor") < text.index("## Excluded") < text.index("## Source Conflict") < text.index("## Follow-Up")
    assert "## Must verify\n- b/" in _lines(run / "verification_packet") and "## Excluded claims\n- a/clm_002" in _lines(run / "operator_package")
    (tmp_path / "review.md").write_text("# Confirmed\nBuy now <b>[x](y)</b>\n", encoding="utf-8")
    assert main(["import-review", str(tmp_path / "review.md"), str(tmp_path / "safe")], spark) == 0
    safe = spark.read.json(str(tmp_path / "safe")).first().safe_text
    assert safe.startswith("\\# Confirmed\n[blocked-investment-action] now &lt;b&gt;\\[x\\](y)")


def test_bad_manifest_is_refused(spark, tmp_path, capsys):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"issue_id": "i", "sources": [{"source_name": "A", "mode": "x", "file_path": "../a.txt"}, {"source_name": "a", "mode": "general", "file_path": "b.txt"}]}))
    assert main(["analyze-manifest", str(path), str(tmp_path / "o")], spark) == 2
    said = capsys.readouterr().err
    assert "mode is unknown" in said and "file_path: parent directory" in said and "duplicate source_name, first at 1" in said


def test_candidates_and_overrides(spark, tmp_path, capsys):
    c, s = tmp_path / "c.json", tmp_path / "s.json"
    c.write_text(json.dumps({"artifact_version": "v0.8C", "issue_id": "i", "candidates": [{"candidate_id": "C1", "url": "https://a.example/x", "title": " "}, {"candidate_id": "c2", "url": "https://b.example"}]}))
    pick = {"candidate_id": "C1", "source_name": "n", "source_type": "commentary", "mode": "general"}
    s.write_text(json.dumps({"confirm_reviewed": True, "issue_id": "i", "selected_candidates": [pick]}))
    assert main(["select-candidates", str(c), str(s), str(tmp_path / "acq")], spark) == 0
    r = spark.read.json(str(tmp_path / "acq")).first()
    assert (r.url, r.source_type) == ("https://a.example/x", "analyst") and "title" not in r
    s.write_text(json.dumps({"confirm_reviewed": True, "issue_id": "i", "selected_candidates": [{**pick, "candidate_id": "c1"}]}))
    assert main(["select-candidates", str(c), str(s), str(tmp_path / "acq")], spark) == 2 and "no such candidate" in capsys.readouterr().err
    s.write_text(json.dumps({"confirm_reviewed": "yes", "issue_id": "i", "selected_candidates": [pick]}))
    assert main(["select-candidates", str(c), str(s), str(tmp_path / "acq")], spark) == 2 and "confirm_reviewed must be true" in capsys.readouterr().err
    files = spark.createDataFrame([("A.txt", "news"), ("b.txt", "news"), ("c.txt", "news")], "name string, source_type string")
    over = spark.createDataFrame([("a.TXT", "Official"), ("b", "user-note"), ("B.txt", "odd")], "key string, source_type string")
    assert {r.name: r.source_type for r in manifests.override_types(files, over).collect()} == {"A.txt": "official", "b.txt": "unknown", "c.txt": "news"}


def test_logs_and_indexes(spark, tmp_path, capsys):
    log = tmp_path / "log.json"
    assert main(["capture-index", str(log), str(tmp_path / "none")], spark) == 0 and _lines(tmp_path / "none").endswith("## Captured Sources\n- None\n")
    log.write_text(json.dumps([{"source_name": "b [x]", "issue_id": "i", "file_path": "b.txt", "source_url": "https://a.example"}, {"source_name": "A", "title": "T", "mode": "general", "runtime_fetching": True}]))
    assert main(["capture-index", str(log), str(tmp_path / "cap")], spark) == 0
    text = _lines(tmp_path / "cap")
    assert text.index("### 1. A\n") < text.index("- Title: T") < text.index("### 2. b \\[x\\]\n") < text.index("- Local file: `b.txt`") < text.index("https://a.example (metadata only; not fetched)")
    assert text.count("- Runtime fetching: True") == 1 and text.count("- Runtime fetching: False") == 1
    log.write_text(json.dumps([{"source_name": "z", "status": "fetched", "http_status": "200", "content_length_bytes": 5, "warnings": ["w (1)"]}, {"source_name": "a", "status": "failed"}]))
    assert main(["acquisition-index", str(log), str(tmp_path / "got"), "--issue", "i7"], spark) == 0
    text = _lines(tmp_path / "got")
    assert "- Issue ID: i7\n" in text and text.index("### 1. z") < text.index("- Content length: 5 bytes") < text.index("- Warnings: w \\(1\\)") < text.index("### 2. a") < text.index("- HTTP status: not available")
    log.write_text("{}")
    assert main(["capture-index", str(log), str(tmp_path / "bad")], spark) == 2 and "JSON array" in capsys.readouterr().err
    assert main(["validate-run", str(tmp_path / "nowhere")], spark) == 2 and "missing artifact: claims, review_items" in capsys.readouterr().err
    assert main(["operator-checklist", str(tmp_path / "todo")], spark) == 0 and _lines(tmp_path / "todo").startswith("# Issue Bundle Operator Review Checklist\n\n## ")
