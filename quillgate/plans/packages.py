"""What an issue of the catalogue is handed on as: packets, packages and their registers, as tables and their files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.catalogue import Catalogue, mask_mode
from quillgate.functions.strings import digest, shown_path
from quillgate.operators import analytics, bundle, helpers, reviews, verification
from quillgate.operators.lineage import cut
from quillgate.operators.masking import safe_claims
from quillgate.sinks.artifacts import write_artifact

from . import checklist, indexes, reports, summary

_c = F.col

POLICY = {"verification_does_not_upgrade_claims": True, "no_web_fetching": True, "no_external_api_in_product_logic": True, "excluded_finance_claims_remain_masked": True}
BOUNDARIES = {
    k: True for k in (
        "advisory_only", "cannot_upgrade_claims", "deterministic_core_is_final_authority", "no_truth_adjudication", "no_financial_advice", "no_investment_or_trading_recommendations",
        "missing_evidence_requires_uncertainty",
    )
}
# What reviewers are told, and the form of their answer
TOLD = [
    "Use only the supplied packet and referenced local artifacts.", "Do not state or imply that any claim is true unless the supplied evidence directly supports that narrow statement.",
    "When evidence is missing, inaccessible, social-only, or rumor-like, preserve uncertainty.",
    "Do not provide investment, trading, allocation, target-price, expected-return, or action recommendations.",
    "Return structured findings with evidence_boundary, uncertainty_reason, and operator_next_step.",
]
CHECKED = {"contains_financial_advice": False, "preserves_source_boundaries": True, "fabricates_missing_evidence": False}
ANSWER = {
    "schema_version": reviews.RESPONSE_VERSION, "issue_id": "string", "advisory_only": True,
    "findings": [{k: "string" for k in ("packet_id", "evidence_boundary", "uncertainty_reason", "operator_next_step", "must_not_conclude")}], "safety_checks": CHECKED,
}


def write_lines(lines: DataFrame, path: str) -> str:
    """A report's ordered lines as one text file."""
    return write_artifact(lines, path, [c for c in ("section", "pos") if c in lines.columns], kind="text", columns=["line"])


@dataclass
class Issue:
    """An issue's claims, masked by their manifest's modes and written once; every artifact is made from them."""

    catalogue: Catalogue
    issue: str
    out: str

    def __post_init__(self):
        self.spark: SparkSession = self.catalogue.spark
        self.claims = cut(self.catalogue.collect(self.issue))
        self.packets = cut(verification.packets(safe_claims(bundle.with_caution(self.claims), mode=mask_mode())))
        self.files: dict[str, str] = {}

    def _done(self, name: str, path: str) -> str:
        self.files[name] = path
        return path

    def manifest(self) -> None:
        """The manifest's sources and the index of runs, as JSON."""
        sources, runs = self.catalogue.table("manifests", self.issue), self.catalogue.table("runs", self.issue)
        held = bundle.counts(self.claims, sources).first()
        head = {"issue_id": self.issue, "source_count": held.source_count, "claim_count": held.claim_count, "review_count": held.review_count}
        self._done("bundle_manifest", write_artifact(sources.drop("issue", "issue_id"), f"{self.out}/bundle_manifest.json", ["at"], "json", head, "sources"))
        self._done("bundle_run_index", write_artifact(runs.drop("issue"), f"{self.out}/bundle_run_index.json", ["sequence"], "json", {"issue_id": self.issue}, "runs"))

    def summary(self) -> str:
        """The bundle's summary with its groups of shared texts and conflicts of figures."""
        shared, figures = analytics.cross_source_groups(self.claims).drop("example"), bundle.numeric_conflicts(self.claims)
        self._done("cross_run_duplicates", write_artifact(shared, f"{self.out}/bundle_cross_run_duplicates.json", ["group_id"], "json", {"issue_id": self.issue}, "groups"))
        self._done("numeric_conflicts", write_artifact(figures, f"{self.out}/bundle_numeric_conflicts.json", ["metric", "context"], "json", {"issue_id": self.issue}, "conflicts"))
        return self._done("bundle_summary", write_lines(summary.bundle_summary(self.claims, self.issue), f"{self.out}/bundle_operator_summary.md"))

    def verification(self) -> str:
        """The verification packet as JSON and text."""
        counts = verification.question_counts(verification.work_items(bundle.with_caution(self.claims), "at")).collect()  # a row for each tier
        grouping = {f"{r.tier}_{kind}_count": n for r in sorted(counts, key=lambda r: r.tier) for kind, n in (("raw", r.raw), ("grouped", r.grouped))}
        figures = cut(bundle.numeric_conflicts(self.claims))
        asked = bundle.numeric_review_items(figures).select(
            _c("claim_ids").alias("question_id"), "risk_tier", _c("verification_question").alias("question"), F.lit("Multiple sources report different numeric values for the same metric.").alias("reason"),
            F.lit("official_or_primary_numeric_record").alias("source_family_hint"), F.lit("timestamped_record").alias("expected_evidence_type"),
        )
        self._done("numeric_questions", write_artifact(asked, f"{self.out}/verification/numeric_questions.json", ["question_id", "question"], "json", {"issue_id": self.issue}, "numeric_divergence_questions"))
        head = {"issue_id": self.issue, "packet_count": self.packets.count(), "numeric_divergence_question_count": figures.count(), "question_grouping": grouping, "policy": POLICY}
        self._done("verification_packet", write_artifact(self.packets, f"{self.out}/verification/verification_packet.json", ["at"], "json", head, "packets", [c for c in self.packets.columns if c != "at"]))
        return self._done("verification_report", write_lines(summary.verification_lines(self.claims, self.issue), f"{self.out}/verification/verification_packet.md"))

    def helper_packet(self) -> str:
        """What a helper gets: questions, and the index of packets with their masked texts."""
        index = helpers.claim_index(self.packets)
        n = self.claims.agg(F.count("*").alias("claims"), F.count_if("needs_human_review").alias("reviews")).first()
        head = {
            "packet_id": f"helper_packet_{self.issue}", "issue_id": self.issue, "advisory_only": True, "deterministic_core_is_final_authority": True, "helper_must_not_upgrade_claims": True,
            "run_count": self.catalogue.table("runs", self.issue).count(), "claim_count": n.claims, "review_item_count": n.reviews, "review_questions": helpers.HELPER_QUESTIONS,
        }
        shown = [c for c in index.columns if c != "at"]
        self._done("helper_review_packet", write_artifact(index, f"{self.out}/helper_review/helper_review_packet.json", ["at"], "json", head, "review_claim_index", shown))
        line = F.concat(F.lit("- "), "packet_id", F.lit(": "), "claim_text_masked", F.lit(" (category: "), "claim_category", F.lit("; risk: "), "risk_tier", F.lit(")"))
        top = ["# Advisory Helper Review Packet", "", f"- Issue ID: {self.issue}", "- Advisory only: true", "- Deterministic core is final authority: true", "- Helper output cannot upgrade claims.", ""]
        asked = ["## Review Questions", *[f"- {q}" for q in helpers.HELPER_QUESTIONS], "", "## Best-Effort Sanitized Claim Index", ""]
        warned = ["- Mask coverage is best-effort; if investment-action verbs, price targets, allocation, probability, or expected-profit wording appears here, do not paste it into an external helper."]
        lines = reports._text(self.spark, 0, [*top, *asked, *warned]).unionByName(index.select(F.lit(1).alias("section"), _c("at").alias("pos"), line.alias("line")))
        return self._done("helper_review_report", write_lines(lines, f"{self.out}/helper_review/helper_review_packet.md"))

    def review_packet(self) -> str:
        """The packet for reviewers: the helper's index with each packet's question, bucket and instruction."""
        rows = helpers.review_index(helpers.claim_index(self.packets), self.packets)
        shown = ["packet_id", "source_name", "claim_text_masked", "claim_category", "risk_tier", "review_bucket", "review_instruction", "verification_question", "must_not_conclude"]
        head = {
            "schema_version": reviews.PACKET_VERSION, "packet_id": f"llm_packet_{self.issue}", "issue_id": self.issue,
            "purpose": "Ask an LLM or reviewer to critique source/evidence boundaries without upgrading claims.", "boundaries": BOUNDARIES, "reviewer_instructions": TOLD, "required_output_schema": ANSWER,
        }
        rows = cut(rows)
        top = ["# LLM Review Packet", "", f"- Schema: {reviews.PACKET_VERSION}", f"- Issue ID: {self.issue}", "- Advisory only: true", "- Deterministic core is final authority: true"]
        top += ["- No financial advice or investing/trading recommendations.", "", "## Reviewer Instructions", *[f"- {x}" for x in TOLD], "", "## Sanitized Review Claim Index"]
        line = F.concat(F.lit("- "), "packet_id", F.lit(": "), "claim_text_masked", F.lit(" (source: "), "source_name", F.lit("; risk: "), "risk_tier", F.lit("; bucket: "), "review_bucket", F.lit(")"))
        each = F.array(line, F.concat(F.lit("  - Verification question: "), "verification_question"), F.concat(F.lit("  - Must not conclude: "), "must_not_conclude"))
        said = rows.select(F.lit(1).alias("section"), "at", F.posexplode(each).alias("k", "line")).select("section", (_c("at") * 4 + _c("k")).alias("pos"), "line")
        lines = reports._text(self.spark, 0, top).unionByName(said).unionByName(reports._text(self.spark, 2, ["", "## Required Output", "", "Return JSON matching `required_output_schema`."]))
        self._done("review_packet_report", write_lines(lines, f"{self.out}/llm_review/llm_review_packet.md"))
        return self._done("review_packet", write_artifact(rows, f"{self.out}/llm_review/llm_review_packet.json", ["at"], "json", head, "review_claim_index", shown))

    def mock_review(self) -> str:
        """A review that concludes nothing, in the form that reviewers must give."""
        safe = {**CHECKED, "missing_evidence_produces_uncertainty": True, "usable_by_operator": True}
        head = {"schema_version": reviews.RESPONSE_VERSION, "issue_id": self.issue, "advisory_only": True, "deterministic_core_is_final_authority": True, "safety_checks": safe}
        found = reviews.mock_findings(self.packets)
        top = ["# Mock LLM Review", "", f"- Schema: {reviews.RESPONSE_VERSION}", f"- Issue ID: {self.issue}", "- Advisory only: true", "- Deterministic core is final authority: true", "- Safety checks: passed", "", "## Findings"]
        named = [("Evidence boundary", "evidence_boundary"), ("Uncertainty reason", "uncertainty_reason"), ("Operator next step", "operator_next_step"), ("Must not conclude", "must_not_conclude")]
        each = F.array(F.concat(F.lit("### "), "packet_id"), F.lit(""), *[F.concat(F.lit(f"- {label}: "), c) for label, c in named], F.lit(""))
        lines = found.select(_c("packet_id").alias("k"), F.posexplode(each).alias("pos", "line")).select(F.lit(1).alias("section"), "k", _c("pos").cast("long").alias("pos"), "line")
        lines = reports._text(self.spark, 0, top).withColumn("k", F.lit("")).unionByName(lines)
        self._done("mock_review_report", write_artifact(lines, f"{self.out}/llm_review/mock_llm_review.md", ["section", "k", "pos"], "text", columns=["line"]))
        return self._done("mock_review", write_artifact(found, f"{self.out}/llm_review/mock_llm_review.json", ["packet_id"], "json", head, "findings"))

    def comparison(self, before: str) -> str:
        """The comparison with another issue of the catalogue."""
        lines = summary.comparison(self.catalogue.collect(before), self.claims)
        return self._done("comparison_summary", write_lines(lines, f"{self.out}/comparison_summary.md"))

    def package(self) -> str:
        """The final package, and the register of all files made before it."""
        self._done("operator_checklist", write_lines(checklist.checklist(self.spark), f"{self.out}/operator_review_checklist.md"))
        index = indexes.analysis_index(self.catalogue.table("manifests", self.issue), self.issue)
        self._done("analysis_source_index", write_lines(index, f"{self.out}/analysis_source_index.md"))
        self._done("final_operator_package", write_lines(summary.operator_package(self.claims, self.issue), f"{self.out}/final_operator_package.md"))
        found = register(self.spark, self.files)
        write_artifact(found, f"{self.out}/PACKAGE_INDEX.json", ["name"], "json", {"issue_id": self.issue, "path_display_policy": "relative to package output root or redacted"}, "artifacts")
        return write_lines(package_index(found, self.out), f"{self.out}/PACKAGE_INDEX.md")


def register(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """name, path, content_hash_sha256, bytes of files that were written; one that is not there has neither digest nor size."""
    named = spark.createDataFrame(sorted(files.items()), "name string, path string")
    read = spark.read.format("binaryFile").load(list(files.values())) if files else spark.createDataFrame([], "path string, content binary")
    held = digest(_c("content"))
    facts = read.select(F.regexp_replace("path", "^file:/+", "/").alias("__path"), held["sha256"].alias("content_hash_sha256"), held["bytes"].cast("long").alias("bytes"))
    return named.join(facts, F.regexp_replace("path", "^file:/+", "/") == _c("__path"), "left").drop("__path")


def package_index(registered: DataFrame, base: str) -> DataFrame:
    """Lines of a package's index: each file as seen from the package's folder, its digest and size."""
    shown = shown_path(F.regexp_replace("path", "^file:/+", "/"), base)
    line = F.concat(F.lit("- "), "name", F.lit(": "), shown, F.coalesce(F.concat(F.lit(" (sha256: "), "content_hash_sha256", F.lit("; bytes: "), _c("bytes").cast("string"), F.lit(")")), F.lit(" (not generated)")))
    head = reports._text(registered.sparkSession, 0, ["# Operator Package Index", "", "- Path display: relative to package output root or redacted."])
    return head.unionByName(registered.select(F.lit(1).alias("section"), F.dense_rank().over(_by_name()).cast("long").alias("pos"), line.alias("line")))


def _by_name():
    """A register has a row for each kind of file, a few dozen."""
    from pyspark.sql import Window

    return Window.orderBy("name")
