"""Indexes of acquired and captured sources as ordered tables of lines.  A log is one JSON array, a control file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.functions.strings import metadata
from quillgate.operators.masking import mask

from .reports import _text

_c = F.col

# Heads of the indexes, and the labels of their fields in order
ACQUISITION_HEAD = [
    "- Status: ACQUISITION ONLY - NOT VERIFIED.", "- Boundary: direct operator-provided HTTP(S) URLs are fetched before the local analysis runtime.",
    "- Review gate: inspect frozen artifacts and warnings before converting fetched records to `analysis_sources.json`.",
    "- Fetching content does not verify source truth, claim truth, or finance conclusions.", "", "## Source Records",
]
CAPTURE_HEAD = [
    "- Boundary: local capture only. No URLs are fetched by this helper.", "- Source URLs are operator-supplied metadata only.",
    "- Capture metadata is not truth verification and does not upgrade any claim.", "", "## Captured Sources",
]
ALWAYS, IF_SET = "always", "if set"
ACQUISITION_FIELDS = [
    ("Source type", "source_type", ALWAYS), ("Mode", "mode", ALWAYS), ("Source URL", "source_url", ALWAYS), ("Fetch status", "status", ALWAYS), ("Fetched at", "fetched_at", ALWAYS),
    ("HTTP status", "http_status", "not available"), ("Response content type", "content_type", "not available"),
    ("Frozen local file", "file_path", "code"), ("Content SHA-256", "content_hash_sha256", "code"), ("Content length", "content_length_bytes", "bytes"),
]
CAPTURE_FIELDS = [
    ("Issue ID", "issue_id", ALWAYS), ("Source type", "source_type", ALWAYS), ("Mode", "mode", ALWAYS), ("Local file", "file_path", "code always"), ("Captured at", "captured_at", ALWAYS),
    ("Acquisition method", "acquisition_method", ALWAYS), ("Content SHA-256", "content_hash_sha256", "code always"), ("Runtime fetching", "runtime_fetching", "flag"),
]
# Heads and tails of the indexes of analyses and candidates
ANALYSIS_HEAD = [
    "- Runtime boundary: local files only; source URLs are stored as metadata and are not fetched.",
    "- Acquisition responsibility: the human/operator or orchestrator is responsible for collecting source excerpts before runtime analysis.",
]
ANALYSIS_TAIL = [
    "", "## Citation Note Guidance", "", "- Citation notes are operator-supplied provenance metadata only.", "- Citation notes are not verified by the runtime and do not upgrade any claim.",
    "- For community, social, private, deleted, or finance-related sources, note whether primary records were available in the local excerpt.",
    "- If a citation note references a URL, that URL is metadata only and is not fetched by the runtime.", "", "## Boundary Notice", "",
    "- This runtime does not search the web, fetch URLs, call external APIs, call LLMs, use MCP/connectors, or run automation.",
    "- The package summarizes only the local `.txt` and `.md` files listed above.", "- Source metadata can guide follow-up verification, but it does not verify or upgrade any claim.",
]
ANALYSIS_FIELDS = [("Source type", "source_type", ALWAYS), ("Mode", "mode", ALWAYS), ("Local file", "file_path", "code always")]
ANALYSIS_CITED = [("Title", "title"), ("Publisher", "publisher"), ("Published at", "published_at"), ("Captured at", "captured_at"), ("Acquisition method", "acquisition_method"), ("Citation note", "citation_note")]
GUIDANCE = "- Citation note guidance: add provenance and whether primary records were available for this community/social source."
CANDIDATE_HEAD = [
    "- Status: CANDIDATES ONLY - NOT VERIFIED.", "- Selection gate: an operator must review and select candidates before direct URL acquisition.",
    "- Candidate presence is not verification, endorsement, truth adjudication, or finance advice.", "", "## Candidates",
]
CANDIDATE_TAIL = [
    "", "## Next Step", "", "- Create an explicit search-candidate selection JSON with candidate IDs, source metadata, and `confirm_reviewed: true`.",
    "- Convert only selected candidates into the existing direct URL acquisition manifest.", "- Search candidates do not bypass acquisition review or local analysis safety gates.",
]
CANDIDATE_CITED = [("Title", "title"), ("Snippet", "snippet"), ("Publisher", "publisher"), ("Published at", "published_at"), ("Provider result ID", "provider_result_id")]
CITED = [("Title", "title"), ("Publisher", "publisher"), ("Published at", "published_at"), ("Citation note", "citation_note")]


def _field(label: str, name: str, kind: str) -> Column:
    """The line of a field, or null where there is none to show."""
    value = _c(name).cast("string")
    said = F.coalesce(value, F.lit("")) != ""
    start = F.lit(f"- {label}: ")
    if kind == "flag":
        return F.concat(start, F.when(F.coalesce(_c(name), F.lit(False)), "True").otherwise("False"))
    if kind == "bytes":
        return F.concat(start, value, F.lit(" bytes"))
    if kind.startswith("code"):
        line = F.concat(start, F.lit("`"), F.coalesce(value, F.lit("None")), F.lit("`"))
        return line if kind == "code always" else F.when(said, line)
    if kind == "not available":
        return F.concat(start, F.when(said, metadata(value)).otherwise(kind))
    line = F.concat(start, metadata(value))
    return line if kind == ALWAYS else F.when(said, line)


def source_index(
    records: DataFrame, title: str, head: list[str], fields: list[tuple[str, str, str]], last: list[Column], cited: list[tuple[str, str]] | None = None, name: str = "source_name", tail: list[str] | None = None
) -> DataFrame:
    """Lines (section, pos, line) of an index: its head, then for each record (`at` from 1) a heading with its name and its
    fields, then its tail.  Names and citations are masked by the record's mode; a null mode is general; no record gives
    "- None"."""
    spark = records.sparkSession
    plain = lambda c: F.struct(c.alias("line"), F.lit(None).cast("string").alias("raw"))
    foreign = lambda start, name: F.struct(start.alias("line"), F.coalesce(_c(name).cast("string"), F.lit("")).alias("raw"))
    heading = foreign(F.concat(F.lit("### "), _c("at").cast("string"), F.lit(". ")), name)
    said = [F.when(F.coalesce(n, F.lit("")) != "", foreign(F.lit(f"- {label}: "), n)) for label, n in cited or CITED]
    cells = [plain(F.lit("")), heading, plain(F.lit("")), *[F.when(f.isNotNull(), plain(f)) for f in (*[_field(*x) for x in fields], *last)]]
    cells = [*cells[: 3 + len(fields)], *said, *cells[3 + len(fields) :]]
    rows = records.withColumn("mode", F.coalesce("mode", F.lit("general")))
    rows = rows.select(_c("at").cast("int").alias("section"), "mode", F.posexplode(F.array_compact(F.array(*cells))).alias("pos", "cell")).select("section", "mode", "pos", "cell.*")
    safe = mask(rows, "raw", "mode", "safe")  # one pass for all foreign fields
    lines = safe.select("section", "pos", F.when(_c("raw").isNull(), _c("line")).otherwise(F.concat("line", metadata(_c("safe")))).alias("line"))
    none = spark.createDataFrame([(1, 0, "- None")], "section int, pos long, line string").join(records.select(F.lit(1).alias("section")).limit(1), "section", "left_anti")
    parts = _text(spark, 0, [f"# {title}", "", *head]).unionByName(lines.withColumn("pos", _c("pos").cast("long"))).unionByName(none)
    return parts.unionByName(_text(spark, (1 << 31) - 1, tail)) if tail else parts


def acquisition_index(records: DataFrame, issue: str) -> DataFrame:
    warned = F.when(F.size("warnings") > 0, F.concat(F.lit("- Warnings: "), F.array_join(F.transform("warnings", metadata), ", ")))
    return source_index(records, "Direct URL Acquisition Index", [f"- Issue ID: {issue}", *ACQUISITION_HEAD], ACQUISITION_FIELDS, [warned])


def capture_index(records: DataFrame) -> DataFrame:
    address = F.when(F.coalesce("source_url", F.lit("")) != "", F.concat(F.lit("- Source URL: "), metadata(_c("source_url")), F.lit(" (metadata only; not fetched)")))
    return source_index(records, "Capture Source Index", CAPTURE_HEAD, CAPTURE_FIELDS, [address])


def analysis_index(records: DataFrame, issue: str) -> DataFrame:
    """The index of an analysis' sources in the manifest's order."""
    bare = (F.coalesce("citation_note", F.lit("")) == "") & _c("source_type").isin("community", "social")
    address = F.when(F.coalesce("source_url", F.lit("")) != "", F.concat(F.lit("- Source URL: "), metadata(_c("source_url")), F.lit(" (metadata only; not fetched)")))
    head = [f"- Issue ID: {issue}", *ANALYSIS_HEAD, "", "## Sources"]
    return source_index(records, "Analysis Source Index", head, ANALYSIS_FIELDS, [F.when(bare, GUIDANCE), address], ANALYSIS_CITED, tail=ANALYSIS_TAIL)


def candidate_index(records: DataFrame, issue: str, query: str = "", provider: str = "", generated: str = "") -> DataFrame:
    """The index of search candidates (candidate_id, url, what is cited, warnings), all masked as finance."""
    rows = records.withColumn("mode", F.lit("finance"))
    warned = F.when(F.size("warnings") > 0, F.concat(F.lit("- Warnings: "), F.array_join(F.transform("warnings", metadata), ", "))) if "warnings" in records.columns else F.lit(None).cast("string")
    head = [f"- Issue ID: {issue}", f"- Query: {query}", f"- Provider: {provider}", f"- Generated at: {generated}", *CANDIDATE_HEAD]
    return source_index(rows, "Search Candidate Index", head, [("URL", "url", ALWAYS)], [warned], CANDIDATE_CITED, name="candidate_id", tail=CANDIDATE_TAIL)
