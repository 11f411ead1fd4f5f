"""Runs from sources to ledgers and reports: the functions behind the command line."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate import catalogue
from quillgate.functions import json_schema, strings
from quillgate.operators import analytics, bundle, claims, classify, goldset, helpers, reviews
from quillgate.operators.lineage import cut
from quillgate.plans import checklist, indexes, packages, reports, summary
from quillgate.sinks.artifacts import write_artifact
from quillgate.sinks.texts import write_texts
from quillgate.sources import folder, intake, manifests

_c = F.col
LEDGER = [
    "issue_id", "run_id", "source_id", "source_name", "source_no", "claim_no", "claim_id", "claim_text", "source_type", "mode", "claim_type", "verification_status", "output_level", "confidence",
    "risk_flags", "risk_tier", "needs_human_review", "independent_source_count", "normalized_claim_hash", "published_at", "observable_state",
    "classification_notes", "disallowed_reason", "duplicate_group_id", "source_count", "lineage_note",
]


def now() -> str:
    """The time by the clock, to the second, as ledgers state it."""
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def classify_sources(sources: DataFrame) -> DataFrame:
    """sources (issue_id, source_name, source_type, mode, published_at, text), names unique within an issue, to claims,
    after the policy on repetition within each source's run.  The classified claims are written once in between.
    `at`, if there, is the sources' order, and stays as source_no."""
    keys = ["issue_id", "source_name"]
    sources = sources.withColumn("source_no", _c("at").cast("long") if "at" in sources.columns else F.lit(1).cast("long")).drop("at")
    found = claims.extract_claims(sources.select(*keys, "text"), keys).select(*keys, "claim_no", "claim_id", "claim_text")
    rows = found.join(sources.drop("text"), keys).withColumn("observable_state", F.lit("observable"))
    run = F.concat_ws("/", "issue_id", "source_name")
    known = classify.ledger(classify.classify(rows)).withColumns({"run_id": run, "source_id": F.lit("src_001")})
    return analytics.repetition_policy(cut(known), "run_id", "claim_no")


def manifest_sources(spark: SparkSession, manifest: str, base: str | None = None, allow_absolute: bool = False) -> DataFrame:
    """The sources of a manifest with their texts, `at` their order; a manifest that breaks a rule raises ValueError.

    Paths lie in the manifest's folder, and no link leads out of it; absolute ones must be allowed.  Files that are links,
    missing or no UTF-8 are named with what is wrong.
    """
    rows = manifests.normalise_sources(manifests.read_sources(spark, manifest, manifests.BUNDLE))
    rows = rows.withColumn("file_path", F.when(_c("file_path").rlike(r"^([A-Za-z]:|\\\\)"), _c("file_path")).otherwise(F.replace("file_path", F.lit("\\"), F.lit("/"))))
    _refuse(manifests.problems(rows, ["file_path"], ["source_name"], path="file_path", allow_absolute=allow_absolute), "manifest")
    root = Path(base or Path(manifest).parent).resolve()
    listed = [r.file_path for r in rows.orderBy("at").select("file_path").collect()]  # a manifest is a small control file
    if not listed:
        raise ValueError(f"{manifest}: no sources")
    if out := [p for p in listed if not p.startswith("/") and not (root / p).is_symlink() and not (root / p).resolve().is_relative_to(root)]:
        raise ValueError("leaves the manifest's folder: " + ", ".join(out[:20]))
    texts = folder.read_files(spark, [p if p.startswith("/") else f"{root}/{p}" for p in listed])
    if bad := folder.problems(texts):
        raise ValueError("; ".join(bad))
    return rows.join(texts.select("at", "text"), "at")


def _refuse(problems: DataFrame, what: str) -> None:
    """Raise with the first twenty problems, if any."""
    if found := [" ".join(str(v) for v in r) for r in problems.limit(20).collect()]:
        raise ValueError(f"{what}: " + "; ".join(found))


def write_run(classified: DataFrame, out: str) -> None:
    """The claims' ledger and the review items as JSON lines."""
    classified.select(*LEDGER).write.mode("overwrite").json(f"{out}/claims")
    todo = read_claims(classified.sparkSession, out).filter("needs_human_review")
    items = todo.select("issue_id", "source_name", "claim_id", "risk_tier", classify.review_reason().alias("reason"), classify.review_question().alias("verification_question"))
    items.write.mode("overwrite").json(f"{out}/review_items")


def read_claims(spark: SparkSession, out: str) -> DataFrame:
    schema = ", ".join(f"{c} {_KINDS.get(c, 'string')}" for c in LEDGER)
    return spark.read.schema(schema).json(f"{out}/claims", mode="FAILFAST")


_KINDS = {"source_count": "long", "source_no": "long", "claim_no": "long", "confidence": "double", "risk_flags": "array<string>", "needs_human_review": "boolean", "independent_source_count": "int"}


def _ordered(rows: DataFrame) -> DataFrame:
    """claims with `at`, their order: by the manifest's order of sources, then by the text's."""
    return rows.withColumn("at", catalogue.claim_order())


REQUIRED = ["claims", "review_items"]


def validate_run(spark: SparkSession, out: str) -> DataFrame:
    """The gates that the run's claims break; a run without one of its tables raises ValueError."""
    if missing := [x for x in REQUIRED if not manifests.exists(spark, f"{out}/{x}")]:
        raise ValueError("missing artifact: " + ", ".join(missing))
    return analytics.gate_violations(read_claims(spark, out), "claim_id")


def write_report(spark: SparkSession, out: str, title: str = "Evidence report", detailed: bool = False) -> str:
    """The run's report, and its warnings, of which the gates give none; ValueError if a gate is broken."""
    _refuse(validate_run(spark, out), "gates")
    reports.write_lines(reports.run_report(_ordered(read_claims(spark, out)), "at", title, detailed), f"{out}/report")
    reports.write_lines(reports._text(spark, 0, ["# Warnings", "", "- None"]), f"{out}/warnings")
    return f"{out}/report"


def compare_runs(spark: SparkSession, before: str, after: str, out: str) -> str:
    """The comparison's rows and its report: counts first, then the claims of each status."""
    old, new = (_ordered(read_claims(spark, x)) for x in (before, after))
    compared = analytics.compare(old, new)
    compared.write.mode("overwrite").json(f"{out}/comparison")
    counts = reports.comparison_report(spark.read.schema("key string, status string, still_unresolved boolean").json(f"{out}/comparison"), "Comparison")
    lines = summary.comparison(old, new)
    reports.write_lines(counts.unionByName(lines.withColumn("section", _c("section") + 2)), f"{out}/comparison_report")
    return f"{out}/comparison_report"


def _issue(claims: DataFrame) -> str:
    row = claims.select("issue_id").first()
    return (row and row[0]) or "issue"


def write_summary(spark: SparkSession, out: str) -> str:
    """The bundle's summary, with its groups of shared texts and its conflicts of figures as JSON lines."""
    claims = _ordered(read_claims(spark, out))
    analytics.cross_source_groups(claims).drop("example").write.mode("overwrite").json(f"{out}/cross_run_duplicates")
    bundle.numeric_conflicts(claims).write.mode("overwrite").json(f"{out}/numeric_conflicts")
    reports.write_lines(summary.bundle_summary(claims, _issue(claims)), f"{out}/bundle_summary")
    return f"{out}/bundle_summary"


def write_verification(spark: SparkSession, out: str) -> str:
    claims = _ordered(read_claims(spark, out))
    reports.write_lines(summary.verification_lines(claims, _issue(claims)), f"{out}/verification_packet")
    return f"{out}/verification_packet"


def write_checklist(spark: SparkSession, out: str) -> str:
    reports.write_lines(checklist.checklist(spark), out)
    return out


def write_captures(spark: SparkSession, log: str, out: str) -> str:
    """The index of a log of captures, by name."""
    reports.write_lines(indexes.capture_index(manifests.read_log(spark, log, manifests.CAPTURE, by_name=True)), out)
    return out


def write_acquisitions(spark: SparkSession, log: str, out: str, issue: str) -> str:
    """The index of a log of acquired sources, in its order."""
    reports.write_lines(indexes.acquisition_index(manifests.read_log(spark, log, manifests.ACQUIRED), issue), out)
    return out


def write_package(spark: SparkSession, out: str) -> str:
    claims = _ordered(read_claims(spark, out))
    reports.write_lines(summary.operator_package(claims, _issue(claims)), f"{out}/operator_package")
    return f"{out}/operator_package"


def import_reviews(spark: SparkSession, path: str, out: str, reviewer: str = "helper", model: str = "unknown") -> str:
    """Foreign reviews, one row a file, as JSON lines: texts are kept and made safe, JSON of any shape becomes an object."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,json}").load(path)
    texts = raw.select("path", strings.decoded(_c("content")).alias("text"))
    rows = cut(helpers.imported(texts))
    _refuse(rows.filter("problem is not null").select("path", "problem"), "import")
    fixed = {"reviewer_name": F.lit(reviewer), "model_name": F.lit(model), "advisory_only": F.lit(True), "cannot_upgrade_claims": F.lit(True), "deterministic_core_is_final_authority": F.lit(True)}
    shown = summary.imported_review(rows.withColumns(fixed), "raw_text")
    shown.select("path", "review_id", "source_sha256", *fixed, "raw_text", "parsed_json", "safe_text").write.mode("overwrite").json(out)
    return out


def write_packets(spark: SparkSession, out: str) -> DataFrame:
    packets = reviews.review_packets(_ordered(read_claims(spark, out)), "issue_id", "at")
    packets.write.mode("overwrite").json(f"{out}/packets")
    return spark.read.schema(packets.schema).json(f"{out}/packets")


def validate_responses(spark: SparkSession, packets: DataFrame, responses: str, out: str) -> bool:
    """responses: a file or folder of JSON documents, one each; True if all are valid."""
    raw = spark.read.text(responses, wholetext=True).select(_c("value").alias("body"))
    rows = raw.withColumn("issue_id", F.coalesce(F.get_json_object("body", "$.issue_id"), F.lit("")))
    errors = reviews.response_errors(rows, packets.select("issue_id", "packet_id", "risk_tier"))
    errors.write.mode("overwrite").json(f"{out}/response_errors")
    errors = spark.read.schema("issue_id string, rule string, detail string").json(f"{out}/response_errors")
    verdicts = reviews.response_verdicts(rows, errors)
    reports.write_lines(reports.verdict_report(verdicts, errors, "issue_id"), f"{out}/response_report", ["k", "o"])
    return verdicts.filter("not valid").isEmpty()


def evaluate_gold(spark: SparkSession, path: str, out: str, enforce: bool = False) -> bool:
    """Metrics and failures of a labelled set; with `enforce`, False if an enforced case fails."""
    lines = goldset.read_lines(spark, path)
    _refuse(goldset.case_problems(lines).orderBy("line_no", "problem"), "labelled set, line")
    evaluated = goldset.evaluate(goldset.parse_cases(lines)).cache()
    for name, df in (
        ("detectors", goldset.detector_metrics(evaluated)), ("accuracies", goldset.accuracies(evaluated)),
        ("statuses", goldset.status_summary(evaluated)), ("failures", goldset.failures(evaluated)),
    ):
        df.write.mode("overwrite").json(f"{out}/gold_{name}")
    packages.write_lines(reports.gold_report(*(f(evaluated) for f in (goldset.status_summary, goldset.failures, goldset.detector_metrics, goldset.accuracies, goldset.violations))), f"{out}/eval_report.md")
    write_artifact(goldset.detector_metrics(evaluated), f"{out}/eval_report.json", ["detector", "language"], "json", {"case_count": evaluated.count()}, "detectors")
    good = evaluated.filter("status = 'enforced' and not passed").isEmpty()
    evaluated.unpersist()
    return good or not enforce


# the catalogue --------------------------------------------------------------------------------------------------------


def bundle_run(spark: SparkSession, sources: DataFrame, root: str, captured_at: str | None = None) -> DataFrame:
    """Classify sources (of any number of issues, with `at`) into the catalogue at `root`; the index of the runs stored.

    Nothing is stored if the ledgers break a rule: ValueError names the first of them.
    """
    held = cut(sources.withColumns({c: F.lit(None).cast("string") for c in manifests.OPTIONAL if c not in sources.columns}))
    found = cut(classify_sources(held).select(*LEDGER))
    records = catalogue.source_ledger(held, captured_at or now())
    _refuse(catalogue.broken(found, records).orderBy("entity", "id", "rule"), "gates")
    index = cut(catalogue.run_index(found, records))
    catalogue.store("manifests", held.drop("text"), root)
    catalogue.store("sources", records, root)
    catalogue.store("claims", found, root)
    catalogue.store("reviews", catalogue.review_ledger(found), root)
    catalogue.store("runs", index, root)
    return index


def bundle_manifests(spark: SparkSession, paths: list[str], root: str, captured_at: str | None = None, allow_absolute: bool = False) -> list[str]:
    """Run the manifests named, each an issue of its own, together; the issues' names."""
    parts = [manifest_sources(spark, p, allow_absolute=allow_absolute) for p in paths]
    names = [_issue(p) for p in parts]
    if len(set(names)) < len(names):
        raise ValueError("manifests must be of different issues")
    bundle_run(spark, reduce(DataFrame.unionByName, parts), root, captured_at)
    return names


def issue_of(spark: SparkSession, root: str, issue: str) -> packages.Issue:
    found = catalogue.Catalogue(spark, root)
    if found.table("runs", issue).isEmpty():
        raise ValueError(f"no such issue: {issue}")
    return packages.Issue(found, issue, f"{root}/issues/{issue}")


def write_issue(spark: SparkSession, root: str, issue: str, before: str | None = None) -> str:
    """All artifacts of an issue, the register of them last."""
    made = issue_of(spark, root, issue)
    made.manifest()
    made.summary()
    made.verification()
    made.helper_packet()
    made.review_packet()
    if before:
        made.comparison(before)
    return made.package()


def folder_manifest(spark: SparkSession, path: str, issue: str, mode: str = "finance", kind: str = "unknown", overrides: str | None = None) -> DataFrame:
    """The sources of a folder's texts as a manifest names them: types by override, else by a hint in the file's name that
    raises no trust, else `kind`.  Names are the files' stems."""
    files = folder.read_folder(spark, path).select("at", "name", "problem", F.col("path").alias("file_path"))
    if bad := [f"{r.name}: {r.problem}" for r in files.filter("problem is not null").limit(20).collect()]:
        raise ValueError("; ".join(bad))
    hint, ignored = intake.filename_type(_c("name"))
    rows = files.withColumns({"source_type": F.when(hint != "unknown", hint).otherwise(F.lit(kind)), "ignored": ignored})
    place = overrides or f"{path.rstrip('/')}/source_type_overrides.json"
    if overrides or intake.exists(spark, place):
        rows = manifests.override_types(rows, manifests.read_overrides(spark, place))
    warned = F.when(_c("ignored") & ~_c("source_type").isin(intake.TRUSTED), F.array(F.lit("trusted_filename_hint_ignored")))
    return rows.select(F.lit(issue).alias("issue_id"), "at", F.regexp_replace("name", r"\.[^.]*$", "").alias("source_name"), classify.coerce_source_type(_c("source_type")).alias("source_type"), F.lit(mode).alias("mode"), "file_path", warned.alias("warnings"))


def create_bundle(spark: SparkSession, path: str, issue: str, out: str, **options) -> str:
    """A folder's manifest as a file; paths are relative to it where they can be."""
    rows = folder_manifest(spark, path, issue, **options)
    base = F.lit(str(Path(out).resolve().parent))
    rows = rows.withColumn("file_path", strings.manifest_path(_c("file_path"), base)["file_path"])
    return write_artifact(rows, out, ["at"], "json", {"issue_id": issue}, "sources", ["source_name", "source_type", "mode", "file_path", "warnings"])


def folder_package(spark: SparkSession, path: str, issue: str, root: str, before: str | None = None, **options) -> str:
    """A folder's texts as an issue of the catalogue, with all its artifacts."""
    rows = folder_manifest(spark, path, issue, **options)
    texts = folder.read_folder(spark, path).select("at", "text")
    bundle_run(spark, rows.join(texts, "at").withColumn("published_at", F.lit(None).cast("string")), root)
    return write_issue(spark, root, issue, before)


# captures and acquisitions ----------------------------------------------------------------------------------------------


def capture(spark: SparkSession, workspace: str, texts: DataFrame, captured_at: str | None = None) -> DataFrame:
    """Keep texts (at, issue_id, source_name, source_type, mode, text and what else their manifest says) in the workspace,
    each in a file of its own, and add them to its log.  ValueError if a name is there already."""
    log_path = f"{workspace.rstrip('/')}/capture_log.json"
    log = cut(manifests.read_log(spark, log_path, manifests.CAPTURE))
    if bad := [r.source_name for r in texts.filter(_c("text").rlike(r"^\s*[A-Za-z][A-Za-z0-9+.-]*://") & (F.length(F.trim("text")) < 200)).limit(20).collect()]:
        raise ValueError("text looks like a URL: " + ", ".join(bad))
    files, again = bundle.capture_files(texts, "at", log)
    _refuse(again.select(F.lit("duplicate source_name"), "source_name"), "capture")
    plain = F.regexp_replace("text", "\r\n?", "\n")
    kept = cut(files.withColumns({"text": plain, "file_path": F.concat(F.lit(f"{workspace.rstrip('/')}/captured_sources/"), "file_name")}))
    write_texts(kept, "file_path", "text")
    fixed = {"captured_at": F.lit(captured_at or now()), "acquisition_method": F.lit("local_capture_helper"), "content_hash_sha256": F.sha2(_c("text"), 256), "runtime_fetching": F.lit(False)}
    new = kept.withColumns(fixed)
    last = log.agg(F.coalesce(F.max("at"), F.lit(0)).alias("n")).first().n
    names = [f.split()[0] for f in manifests.CAPTURE.split(", ")]
    rows = log.select("at", *names).unionByName(new.withColumn("at", _c("at") + last).select("at", *[c for c in names if c in new.columns]), allowMissingColumns=True)
    write_artifact(cut(rows), log_path, ["at"], "json", columns=names)
    return kept.select("source_name", "file_path")


def capture_manifest(spark: SparkSession, workspace: str, out: str | None = None) -> str:
    """The log of captures as a manifest, by name; files outside the manifest's folder keep their path, with a warning."""
    log = manifests.read_log(spark, f"{workspace.rstrip('/')}/capture_log.json", manifests.CAPTURE)
    issues = [r[0] for r in log.select(F.trim("issue_id")).filter("trim(issue_id) <> ''").distinct().limit(2).collect()]
    if len(issues) != 1:
        raise ValueError("the capture log must hold exactly one issue_id" if issues else "the capture log is missing or empty")
    place = out or f"{workspace.rstrip('/')}/analysis_sources.json"
    return _write_manifest(log, place, {"issue_id": issues[0]})


def _write_manifest(rows: DataFrame, place: str, head: dict) -> str:
    stated = strings.manifest_path(_c("file_path"), F.lit(str(Path(place).resolve().parent)))
    rows = rows.withColumns({"warnings": stated["warnings"], "file_path": stated["file_path"]})
    columns = ["source_name", "source_type", "mode", "file_path", *manifests.OPTIONAL, "warnings"]
    return write_artifact(rows, place, [F.lower("source_name"), "file_path"], "json", head, "sources", [c for c in columns if c in rows.columns])


def acquisition_manifest(spark: SparkSession, log: str, out: str, reviewed: bool) -> str:
    """The fetched sources of a log of acquisitions ({issue_id, records}) as a manifest.  They must be reviewed."""
    if not reviewed:
        raise ValueError("review must be confirmed")
    whole = spark.read.schema(f"issue_id string, records array<struct<{manifests.ACQUIRED}>>").json(log, multiLine=True)
    issue = whole.select(F.trim("issue_id")).first()[0]
    rows = bundle.fetched(whole.select(F.explode("records").alias("r")).select("r.*"))
    if not issue or rows.isEmpty():
        raise ValueError("no fetched records" if issue else "issue_id is missing")
    note = "Direct URL acquisition artifact reviewed before local analysis manifest conversion. Acquisition does not verify source truth."
    rows = rows.withColumns({"captured_at": _c("fetched_at"), "acquisition_method": F.lit("direct_url"), "citation_note": F.concat_ws(" | ", F.nullif("citation_note", F.lit("")), F.lit(note))})
    return _write_manifest(rows.drop("warnings"), out, {"issue_id": issue})


def validate_artifacts(spark: SparkSession, path: str, schema: str, out: str) -> bool:
    """Hold JSON files to a schema; what is wrong goes to `out` as JSON lines.  True if nothing is."""
    if schema not in json_schema.SCHEMAS:
        raise ValueError(f"schema is one of {', '.join(json_schema.SCHEMAS)}")
    docs = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("artifact_file"), F.make_valid_utf8(_c("content").cast("string")).alias("body"))
    found = cut(docs.select("artifact_file", F.lit(schema).alias("schema_name"), json_schema.violations(_c("body"), json_schema.SCHEMAS[schema]).alias("errors")))
    write_artifact(found.withColumn("valid", F.size("errors") == 0), out, ["artifact_file"])
    return found.filter(F.size("errors") > 0).isEmpty()


def write_candidates(spark: SparkSession, path: str, out: str) -> str:
    """The index of search candidates, in their order."""
    if wrong := manifests.header_problem(spark, path, "artifact_version", manifests.CANDIDATE_VERSION):
        raise ValueError(wrong)
    rows = manifests.read_sources(spark, path, manifests.CANDIDATE, "candidates")
    _refuse(manifests.problems(rows, ["candidate_id"], ["candidate_id"], url="url"), "candidates")
    head = spark.read.text(path, wholetext=True).select(*[F.coalesce(strings.metadata(F.get_json_object("value", f"$.{k}")), F.lit("")).alias(k) for k in ("issue_id", "query", "provider", "generated_at")]).first()
    return packages.write_lines(indexes.candidate_index(rows, head.issue_id, head.query, head.provider, head.generated_at), out)
