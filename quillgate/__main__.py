"""The command line: python -m quillgate COMMAND ...; ends with 0, or 2 on a known error or a failed check."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillgate import workspace as ws
from quillgate.operators import classify
from quillgate.sources import intake, manifests


def _analyze_file(spark, a) -> bool:
    texts = intake.read_texts(spark, a.path)
    if not texts.filter("not is_valid").isEmpty():
        raise ValueError("not UTF-8")
    fixed = {"issue_id": a.issue, "source_name": a.name, "source_type": a.type, "mode": a.mode, "published_at": a.published}
    row = texts.select("text", *[F.lit(v).cast("string").alias(k) for k, v in fixed.items()])
    ws.write_run(ws.classify_sources(row.withColumn("source_type", classify.coerce_source_type(F.col("source_type")))), a.out)
    return True


def _analyze_manifest(spark, a) -> bool:
    ws.write_run(ws.classify_sources(ws.manifest_sources(spark, a.path)), a.out)
    return True


def _show(df) -> bool:
    for line in df.toJSON().toLocalIterator():
        print(line)
    return df.isEmpty()


def _select(spark, a) -> bool:
    heads = [manifests.header_problem(spark, a.path, "artifact_version", manifests.CANDIDATE_VERSION), manifests.header_problem(spark, a.other, "confirm_reviewed", "true")]
    if any(heads):
        raise ValueError("; ".join(filter(None, heads)))
    candidates = manifests.read_sources(spark, a.path, manifests.CANDIDATE, "candidates")
    chosen = manifests.read_sources(spark, a.other, manifests.SELECTION, "selected_candidates")
    ws._refuse(manifests.problems(candidates, ["candidate_id"], ["candidate_id"], url="url"), "candidates")
    ws._refuse(manifests.problems(chosen, ["candidate_id", "source_name", "source_type"], ["candidate_id", "source_name"], cap=manifests.MAX_ACQUIRED), "selection")
    rows, unmatched = manifests.select_candidates(candidates, chosen)
    ws._refuse(unmatched.select("candidate_id"), "no such candidate")
    rows.drop("at").write.mode("overwrite").json(a.out)
    return True


def _capture(spark, a) -> bool:
    texts = intake.read_texts(spark, a.other)
    if not texts.filter("not is_valid").isEmpty():
        raise ValueError("not UTF-8")
    fixed = {"issue_id": a.issue, "source_name": a.name, "source_type": a.type, "mode": a.mode, "published_at": a.published}
    row = texts.select(F.lit(1).cast("long").alias("at"), "text", *[F.lit(v).cast("string").alias(k) for k, v in fixed.items()])
    return _show(ws.capture(spark, a.path, row.withColumn("source_type", classify.coerce_source_type(F.col("source_type"), intake.ALIASES)))) or True


def _bundles(spark, a) -> bool:
    *paths, root = a.paths
    if not paths:
        raise ValueError("a manifest and the catalogue's folder")
    for issue in ws.bundle_manifests(spark, paths, root, allow_absolute=a.allow_absolute):
        made = ws.issue_of(spark, root, issue)
        made.manifest()
        made.summary()
    return True


def _analysis(spark, a) -> bool:
    (issue,) = ws.bundle_manifests(spark, [a.path], a.out, allow_absolute=a.allow_absolute)
    return bool(ws.write_issue(spark, a.out, issue, a.before))


def _of_folder(a) -> dict:
    return {"mode": a.mode, "kind": a.type, "overrides": a.overrides}


def _responses(spark, a) -> bool:
    return ws.validate_responses(spark, ws.write_packets(spark, a.path), a.other, a.out)


COMMANDS = {
    "analyze-file": (_analyze_file, "path out"),
    "analyze-manifest": (_analyze_manifest, "path out"),
    "validate-run": (lambda s, a: _show(ws.validate_run(s, a.path)), "path"),
    "list-review": (lambda s, a: _show(ws.read_claims(s, a.path).filter("needs_human_review").select("claim_id", "risk_tier", "claim_type")) or True, "path"),
    "report": (lambda s, a: bool(ws.write_report(s, a.path, detailed=a.detailed)), "path"),
    "compare": (lambda s, a: bool(ws.compare_runs(s, a.path, a.other, a.out)), "path other out"),
    "bundle-summary": (lambda s, a: bool(ws.write_summary(s, a.path)), "path"),
    "verification-packet": (lambda s, a: bool(ws.write_verification(s, a.path)), "path"),
    "operator-package": (lambda s, a: bool(ws.write_package(s, a.path)), "path"),
    "operator-checklist": (lambda s, a: bool(ws.write_checklist(s, a.out)), "out"),
    "capture-index": (lambda s, a: bool(ws.write_captures(s, a.path, a.out)), "path out"),
    "acquisition-index": (lambda s, a: bool(ws.write_acquisitions(s, a.path, a.out, a.issue)), "path out"),
    "import-review": (lambda s, a: bool(ws.import_reviews(s, a.path, a.out)), "path out"),
    "review-packet": (lambda s, a: ws.write_packets(s, a.path) is not None, "path"),
    "validate-response": (_responses, "path other out"),
    "eval-goldset": (lambda s, a: ws.evaluate_gold(s, a.path, a.out, a.enforce), "path out"),
    "select-candidates": (_select, "path other out"),
    "bundle-create": (lambda s, a: bool(ws.create_bundle(s, a.path, a.issue, a.out, **_of_folder(a))), "path out"),
    "bundle-run": (_bundles, "paths"),
    "issue-package": (lambda s, a: bool(ws.folder_package(s, a.path, a.issue, a.out, a.before, **_of_folder(a))), "path out"),
    "analysis-package": (_analysis, "path out"),
    "helper-packet": (lambda s, a: bool(ws.issue_of(s, a.path, a.issue).helper_packet()), "path"),
    "llm-review-packet": (lambda s, a: bool(ws.issue_of(s, a.path, a.issue).review_packet()), "path"),
    "mock-llm-review": (lambda s, a: bool(ws.issue_of(s, a.path, a.issue).mock_review()), "path"),
    "import-helper-review": (lambda s, a: bool(ws.import_reviews(s, a.path, a.out, a.reviewer, a.model)), "path out"),
    "capture-source": (_capture, "path other"),
    "capture-manifest": (lambda s, a: bool(ws.capture_manifest(s, a.path, a.to)), "path"),
    "acquisition-manifest": (lambda s, a: bool(ws.acquisition_manifest(s, a.path, a.out, a.confirm_reviewed)), "path out"),
    "candidate-index": (lambda s, a: bool(ws.write_candidates(s, a.path, a.out)), "path out"),
    "validate-artifact": (lambda s, a: ws.validate_artifacts(s, a.path, a.schema, a.out), "path out"),
    "validate-acquisition": (
        lambda s, a: _show(manifests.problems(manifests.read_sources(s, a.path, manifests.ACQUISITION), ["source_name", "url"], ["source_name"], url="url", cap=manifests.MAX_ACQUIRED)),
        "path",
    ),
}


OPTIONS = {
    "issue": "issue", "name": "source", "type": "unknown", "mode": "general", "published": None, "before": None, "overrides": None, "to": None,
    "reviewer": "helper", "model": "unknown", "schema": "acquisition-manifest",
}


def run() -> None:
    sys.exit(main())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="quillgate")
    top.add_argument("--debug", action="store_true")
    subs = top.add_subparsers(dest="command", required=True)
    for name, (_, places) in COMMANDS.items():
        sub = subs.add_parser(name)
        for place in places.split():
            sub.add_argument(place, nargs="+" if place == "paths" else None)
        for option, default in OPTIONS.items():
            sub.add_argument(f"--{option}", default=default)
        for flag in ("allow-absolute", "confirm-reviewed"):
            sub.add_argument(f"--{flag}", action="store_true")
        sub.add_argument("--detailed", action="store_true")
        sub.add_argument("--enforce", action="store_true")
    args = top.parse_args(argv)
    session = spark or SparkSession.builder.appName("quillgate").getOrCreate()
    try:
        return 0 if COMMANDS[args.command][0](session, args) else 2
    except (ValueError, OSError) as e:
        if args.debug:
            raise
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
