"""Runs of many sources in the catalogue, its gates, and what an issue is handed on as."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillgate import catalogue
from quillgate import workspace as ws
from quillgate.__main__ import main
from quillgate.functions import json_schema

SAYS = {
    "a.txt": "The bridge was closed on Friday.\n\nBuy now before it is too late.\n\n12 people were injured after the flood.\n",
    "b.txt": "The bridge was closed on Friday.\n\n15 people were injured after the flood.\n\nThe market fell because investors sold.\n",
    "c.md": "The exchange published its notice.\n\nBuy now before it is too late.\n",
}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """A catalogue of three manifests, run together."""
    top = tmp_path_factory.mktemp("issues")
    for name, text in SAYS.items():
        (top / name).write_text(text, encoding="utf-8")
    source = lambda n, t, f, mode="finance", **more: {"source_name": n, "source_type": t, "mode": mode, "file_path": f, **more}
    manifests = {
        "one": [source("zeta", "news", "a.txt"), source("alpha", "forum", "b.txt", title="B [x]")], "two": [source("alpha", "official", "c.md", "general")],
        "three": [source("zeta", "news", "b.txt", "general"), source("gamma", "social", "a.txt", "general")],
    }
    for issue, sources in manifests.items():
        (top / f"{issue}.json").write_text(json.dumps({"issue_id": issue, "sources": sources}))
    assert ws.bundle_manifests(spark, [str(top / f"{i}.json") for i in manifests], str(top / "cat")) == list(manifests)
    return top


def test_bundle_run_writes_the_catalogue(spark, root):
    held = catalogue.Catalogue(spark, f"{root}/cat")
    claims = held.collect("one")
    got = [(r.source_name, r.claim_text, r.mode, r.source_mode) for r in claims.orderBy("at").collect()]
    assert [g[:2] for g in got] == [(n, t) for n, f in (("zeta", "a.txt"), ("alpha", "b.txt")) for t in SAYS[f].strip().split("\n\n")]  # the manifest's order
    assert {g[2:] for g in got} == {("finance", "finance")}
    plan = held.table("claims", "one", "one/zeta")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(issue" in plan and "run#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {r[0] for r in held.table("claims", "one").select(F.regexp_extract(F.input_file_name(), "/issue=([^/]*)/", 1)).distinct().collect()} == {"one"}
    run = held.run("one", "one/alpha")
    assert run["manifest"].first().claim_count == 3 and run["claims"].count() == 3 and run["sources"].first().title == "B [x]"
    assert [r.review_id for r in run["reviews"].orderBy("review_id").collect()] == [f"rev_{i:03d}" for i in range(1, run["manifest"].first().review_count + 1)]
    # A run that comes again replaces its own partitions; what the index no longer names is in no report.
    (root / "again.json").write_text(json.dumps({"issue_id": "three", "sources": [{"source_name": "zeta", "source_type": "news", "mode": "finance", "file_path": "c.md"}]}))
    assert main(["bundle-run", str(root / "again.json"), str(root / "cat")], spark) == 0
    assert [r.claim_text for r in held.collect("three").orderBy("at").collect()] == SAYS["c.md"].strip().split("\n\n") and held.collect("one").count() == 6
    index = json.load(open(root / "cat/issues/three/bundle_run_index.json", encoding="utf-8"))
    assert index["issue_id"] == "three" and [(r["source_name"], r["claim_count"]) for r in index["runs"]] == [("zeta", 2)]
    with pytest.raises(ValueError, match="no such issue"):
        ws.issue_of(spark, f"{root}/cat", "four")


def test_manifests_are_refused(spark, root, capsys):
    bad = root / "bad.json"
    (root / "latin.txt").write_bytes(b"caf\xe9")
    (root / "link.txt").symlink_to(root / "a.txt")
    (root / "inner").mkdir()
    (root / "inner" / "out").symlink_to(root)
    for path, said in (("latin.txt", "byte 0xe9 at offset 3"), ("link.txt", "symbolic link"), ("none.txt", "file not found"), (f"{root}/a.txt", "absolute path"), ("out/a.txt", "leaves the manifest's folder")):
        place = root / "inner" / "bad.json" if path.startswith("out/") else bad
        place.write_text(json.dumps({"issue_id": "x", "sources": [{"source_name": "s", "source_type": "news", "mode": "general", "file_path": path}]}))
        assert main(["bundle-run", str(place), str(root / "nowhere")], spark) == 2 and said in capsys.readouterr().err
    bad.write_text(json.dumps({"issue_id": "abs", "sources": [{"source_name": "s", "source_type": "news", "mode": "general", "file_path": f"{root}/a.txt"}]}))
    assert [r.text for r in ws.manifest_sources(spark, str(bad), allow_absolute=True).collect()] == [SAYS["a.txt"]]


def test_integrity_with_a_hot_source(spark):
    sources = [("r", "s0", "news", "hot", "finance", "t"), ("r", "s1", "odd", " ", "general", None), ("r", None, "news", "n", "x", "t"), ("q", "s0", "news", "other run", "general", "t")]
    src = spark.createDataFrame(sources, "run_id string, source_id string, source_type string, source_name string, mode string, captured_at string")
    bad = {(r.id, r.rule) for r in catalogue.analytics.source_violations(src).collect()}
    assert bad == {("r/s1", "unknown source type"), ("r/s1", "source_name is missing"), ("r/s1", "captured_at is missing"), ("r/<missing>", "source_id is missing"), ("r/<missing>", "unknown mode")}
    keys = [("r", "s0")] * 3000 + [("r", "gone")] * 2000 + [("q", "s1"), ("q", "s0"), (None, "s0"), ("r", None)]
    claims = spark.createDataFrame([(str(i), *k) for i, k in enumerate(keys)], "claim_id string, run_id string, source_id string")
    assert {int(r.claim_id) for r in catalogue.analytics.missing_sources(claims, src).collect()} == {*range(3000, 5000), 5000, 5002, 5003}


def test_modes_of_sources_decide_masks(spark):
    manifest = spark.createDataFrame([("i", 1, "a", "finance"), ("i", 3, "a", "general"), ("i", 2, "b", "finance"), ("i", 4, "", "general"), ("j", 9, "a", "finance")], "issue_id string, at long, source_name string, mode string")
    claims = spark.createDataFrame([("i", "a"), ("i", "b"), ("i", "c"), ("j", "a"), ("i", None)], "issue_id string, source_name string")
    rows = catalogue.with_source_mode(claims, catalogue.source_modes(manifest)).withColumn("mask", catalogue.mask_mode()).collect()
    assert {(r.issue_id, r.source_name, r.source_mode, r.mask) for r in rows} == {
        ("i", "a", "general", "general"), ("i", "b", "finance", "finance"), ("i", "c", None, "general"), ("j", "a", "finance", "finance"), ("i", None, None, "general"),
    }


def test_packages_of_an_issue(spark, root, tmp_path):
    cat = str(root / "cat")
    place = ws.write_issue(spark, cat, "one", before="two")
    out = root / "cat/issues/one"
    index = json.load(open(out / "PACKAGE_INDEX.json", encoding="utf-8"))
    for a in index["artifacts"]:
        with open(a["path"], "rb") as f:
            content = f.read()
        assert (a["content_hash_sha256"], a["bytes"]) == (hashlib.sha256(content).hexdigest(), len(content)), a["name"]
    lines = open(place, encoding="utf-8").read()
    assert "- verification_packet: verification/verification_packet.json (sha256: " in lines and "comparison_summary" in lines
    packet = json.load(open(out / "verification/verification_packet.json", encoding="utf-8"))
    assert packet["packet_count"] == 6 == len(packet["packets"]) and [p["source_name"] for p in packet["packets"]] == ["zeta"] * 3 + ["alpha"] * 3
    by = {p["claim_type"]: p for p in packet["packets"]}
    assert by["excluded"]["must_verify"] == [] and by["excluded"]["unsafe_to_conclude"][0]["risk_if_answered"] == "finance_advice_or_prediction" and "Buy" not in by["excluded"]["claim_text_masked"]
    assert by["unverified_causality"]["must_verify"][0]["claim_ref"].startswith("alpha/clm_")
    asked = json.load(open(out / "verification/numeric_questions.json", encoding="utf-8"))["numeric_divergence_questions"]
    assert packet["numeric_divergence_question_count"] == 1 == len(asked) and "values (12,15) and sources (alpha, zeta)" in asked[0]["question"]
    counts = packet["question_grouping"]
    assert counts["must_verify_raw_count"] == sum(len(p["must_verify"]) for p in packet["packets"]) and counts["unsafe_to_conclude_raw_count"] == sum(len(p["unsafe_to_conclude"]) for p in packet["packets"])
    helper = json.load(open(out / "helper_review/helper_review_packet.json", encoding="utf-8"))
    assert [e["packet_id"] for e in helper["review_claim_index"]] == [p["packet_id"] for p in packet["packets"]]
    review = json.load(open(out / "llm_review/llm_review_packet.json", encoding="utf-8"))
    asked = {e["packet_id"]: e["verification_question"] for e in review["review_claim_index"]}
    assert all(asked[p["packet_id"]] == [*p["must_verify"], *p["evidence_questions"]][0]["question"] for p in packet["packets"])
    assert "### 2. alpha" in open(out / "analysis_source_index.md", encoding="utf-8").read()
    # The packet and the mock review hold to their schemas, and the review breaks no rule.
    assert main(["mock-llm-review", cat, "--issue", "one"], spark) == 0
    for name, schema in (("llm_review_packet", "llm-review-packet"), ("mock_llm_review", "external-review-response")):
        assert main(["validate-artifact", str(out / f"llm_review/{name}.json"), str(tmp_path / name), "--schema", schema], spark) == 0
    body = open(out / "llm_review/mock_llm_review.json", encoding="utf-8").read()
    known = spark.createDataFrame([("one", p["packet_id"], p["risk_tier"]) for p in packet["packets"]], "issue_id string, packet_id string, risk_tier string")
    from quillgate.operators import reviews

    assert reviews.response_errors(spark.createDataFrame([("one", body)], "issue_id string, body string"), known).collect() == []
    # Once more, and nothing differs.
    again = ws.packages.Issue(catalogue.Catalogue(spark, cat), "one", str(tmp_path / "again"))
    again.manifest()
    again.verification()
    again.helper_packet()
    was = {a["name"]: a["content_hash_sha256"] for a in index["artifacts"]}
    assert len(again.files) == 7 and all(hashlib.sha256(open(p, "rb").read()).hexdigest() == was[name] for name, p in again.files.items())
    broken = tmp_path / "broken.json"
    broken.write_text(json.dumps({**json.loads(body), "advisory_only": "true"}))
    assert main(["validate-artifact", str(broken), str(tmp_path / "v"), "--schema", "external-review-response"], spark) == 2
    assert json.loads((tmp_path / "v").read_text())["errors"] == [{"path": "/advisory_only", "rule": "const", "detail": "true"}]


def test_folders_captures_and_acquisitions(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in {"official_note.txt": "The exchange published its notice.", "forum_x.md": "Rumor says so.", "Plain.txt": "A report was filed."}.items():
        (folder / name).write_text(text, encoding="utf-8")
    (folder / "source_type_overrides.json").write_text(json.dumps({"source_types": {"plain": "Company"}}))
    assert main(["bundle-create", str(folder), str(tmp_path / "bundle.json"), "--issue", "f", "--type", "news", "--mode", "finance"], spark) == 0
    made = json.load(open(tmp_path / "bundle.json", encoding="utf-8"))
    assert [(s["source_name"], s["source_type"], s["file_path"], s["warnings"]) for s in made["sources"]] == [
        ("forum_x", "community", "in/forum_x.md", None), ("official_note", "news", "in/official_note.txt", ["trusted_filename_hint_ignored"]), ("Plain", "company", "in/Plain.txt", None),
    ]
    assert main(["issue-package", str(folder), str(tmp_path / "cat"), "--issue", "f", "--mode", "finance"], spark) == 0
    assert (tmp_path / "cat/issues/f/PACKAGE_INDEX.md").exists()
    work = tmp_path / "work"
    for name, ok in (("My Source!", True), ("my source! ", False), ("My Source?", True)):
        assert main(["capture-source", str(work), str(folder / "Plain.txt"), "--issue", "f", "--name", name, "--type", "forum"], spark) == (0 if ok else 2)
    assert "duplicate source_name" in capsys.readouterr().err
    assert sorted(p.name for p in (work / "captured_sources").iterdir()) == ["My_Source_.txt", "My_Source__2.txt"]
    log = json.load(open(work / "capture_log.json", encoding="utf-8"))
    text = (work / "captured_sources/My_Source_.txt").read_bytes()
    assert [e["source_name"] for e in log] == ["My Source!", "My Source?"] and log[0]["content_hash_sha256"] == hashlib.sha256(text).hexdigest() and log[0]["source_type"] == "community"
    assert main(["capture-manifest", str(work)], spark) == 0
    assert main(["capture-manifest", str(work), "--to", str(work / "deep/m.json")], spark) == 0
    near, far = (json.load(open(work / p, encoding="utf-8"))["sources"] for p in ("analysis_sources.json", "deep/m.json"))
    assert [s["file_path"] for s in near] == ["captured_sources/My_Source_.txt", "captured_sources/My_Source__2.txt"] and near[0]["warnings"] is None
    assert far[0]["file_path"] == f"{work}/captured_sources/My_Source_.txt" and far[0]["warnings"] == ["absolute_path_requires_allow_absolute_flag"]
    assert [r.file_path for r in ws.manifest_sources(spark, str(work / "analysis_sources.json")).orderBy("at").collect()] == [s["file_path"] for s in near]
    records = [{"source_name": n, "source_type": "news", "mode": "general", "status": s, "file_path": p, "fetched_at": "t", "citation_note": c} for n, s, p, c in (("b", "fetched", f"{tmp_path}/x/../b.txt", "seen"), ("A", "fetched", "/q/a.txt", None), ("c", "http_error", "", None))]
    (tmp_path / "acq.json").write_text(json.dumps({"issue_id": "f", "records": records}))
    assert main(["acquisition-manifest", str(tmp_path / "acq.json"), str(tmp_path / "an.json")], spark) == 2
    assert main(["acquisition-manifest", "--confirm-reviewed", str(tmp_path / "acq.json"), str(tmp_path / "an.json")], spark) == 0
    got = json.load(open(tmp_path / "an.json", encoding="utf-8"))["sources"]
    assert [(s["source_name"], s["file_path"], bool(s["warnings"])) for s in got] == [("A", "/q/a.txt", True), ("b", "b.txt", False)] and got[1]["citation_note"].startswith("seen | Direct URL")


def test_imported_reviews(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name, text in {"a.json": '[{"q": 1}, "x"]', "b.JSON": '{"k": {"n": null}}', "c.md": "# Buy now", "d.json": "7"}.items():
        (inbox / name).write_text(text, encoding="utf-8")
    assert main(["import-helper-review", str(inbox), str(tmp_path / "out"), "--reviewer", "r"], spark) == 0
    rows = {r.path.rsplit("/", 1)[1]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert json.loads(rows["a.json"].parsed_json) == {"items": [{"q": 1}, "x"]} and json.loads(rows["d.json"].parsed_json) == {"items": 7} and rows["c.md"].parsed_json == "{}"
    assert rows["c.md"].raw_text == "# Buy now" and rows["c.md"].safe_text.startswith("\\# [blocked") and rows["c.md"].review_id == "helper_review_" + hashlib.sha256(b"# Buy now").hexdigest()[:16]
    assert main(["import-review", str(inbox), str(tmp_path / "out")], spark) == 0
    (inbox / "e.json").write_text("{broken")
    assert main(["import-helper-review", str(inbox), str(tmp_path / "out")], spark) == 2


def test_schema_keywords(spark):
    schema = {
        "type": "object", "required": ["a"], "additionalProperties": False, "description": "all keywords",
        "properties": {
            "a": {"type": ["integer", "null"], "minimum": 1, "maximum": 9}, "b": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string", "minLength": 1, "maxLength": 3, "pattern": "^x"}},
            "c": {"enum": ["p", 1, None, True]}, "it's": {"type": "number", "const": 2.5}, "d": {"additionalProperties": {"type": "boolean"}},
        },
    }
    docs = {
        '{"a": 5, "b": ["x", "xyz"], "c": "p", "it\'s": 2.5, "d": {"q": true}}': [], '{"a": null, "c": null}': [], '{"a": 0, "c": true}': [("/a", "minimum")], '{"a": 10.5}': [("/a", "type"), ("/a", "maximum")],
        '{"b": [], "z": 1}': [("/", "required"), ("/b", "minItems"), ("/", "additionalProperties")], '{"a": 1, "b": ["x", "", "yyyyy", 5]}': [("/b", "maxItems"), ("/b/1", "minLength"), ("/b/1", "pattern"), ("/b/2", "maxLength"), ("/b/2", "pattern"), ("/b/3", "type")],
        '{"a": 1, "c": "1", "it\'s": "2.5", "d": {"q": 1, "r": false}}': [("/c", "enum"), ("/it's", "type"), ("/it's", "const"), ("/d/q", "type")], "[]": [("/", "type")], "{": [("/", "json")],
    }
    df = spark.createDataFrame([(k,) for k in docs], "body string")
    for r in df.select("body", json_schema.violations(F.col("body"), schema).alias("v")).collect():
        assert sorted((v.path, v.rule) for v in r.v) == sorted(docs[r.body]), r.body
    with pytest.raises(ValueError, match="unknown keywords oneOf"):
        json_schema.compiled({"oneOf": []})
