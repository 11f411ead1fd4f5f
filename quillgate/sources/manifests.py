"""Manifests, candidates and selections: one row a source, the rules that it breaks, and the joins between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.operators.classify import coerce_source_type

from .intake import ALIASES, duplicate_names, exists, path_problem, url_problem

_c = F.col

# Artifact version, the cap on sources to acquire, and the note of selected candidates
CANDIDATE_VERSION = "v0.8C"
MAX_ACQUIRED = 20
MODES = ["general", "finance"]
OPTIONAL = ["source_url", "title", "publisher", "published_at", "captured_at", "acquisition_method", "citation_note"]
BUNDLE = "source_name string, source_type string, mode string, file_path string, " + ", ".join(f"{c} string" for c in OPTIONAL)
ACQUISITION = "source_name string, source_type string, mode string, url string, title string, publisher string, published_at string, citation_note string"
CANDIDATE = "candidate_id string, url string, title string, snippet string, publisher string, published_at string, provider_result_id string"
CAPTURE = BUNDLE + ", issue_id string, content_hash_sha256 string, runtime_fetching boolean"
ACQUIRED = (
    "source_name string, source_type string, mode string, source_url string, status string, fetched_at string, http_status string, content_type string, file_path string, "
    "content_hash_sha256 string, content_length_bytes long, title string, publisher string, published_at string, citation_note string, warnings array<string>"
)
SELECTION = "candidate_id string, source_name string, source_type string, mode string, citation_note string"


def read_sources(spark: SparkSession, path: str, source: str, field: str = "sources") -> DataFrame:
    """issue_id, at (from 1), the source's fields; blank optional fields are null."""
    whole = spark.read.schema(f"issue_id string, {field} array<struct<{source}>>").json(path, multiLine=True)
    rows = whole.select("issue_id", F.posexplode(field).alias("pos", "s"))
    names = [f.split()[0] for f in source.split(", ")]
    return rows.select("issue_id", (_c("pos") + 1).cast("long").alias("at"), *[F.when(F.trim(f"s.{n}") != "", F.trim(f"s.{n}")).alias(n) for n in names])


def header_problem(spark: SparkSession, path: str, field: str, wanted: str) -> str | None:
    """What is wrong with a field in a control file's head, if anything: `wanted` is its value as JSON text."""
    row = spark.read.text(path, wholetext=True).select(F.get_json_object("value", f"$.{field}").alias("v")).first()
    return None if row and row.v == wanted else f"{field} must be {wanted}"


def read_log(spark: SparkSession, path: str, record: str, by_name: bool = False) -> DataFrame:
    """The records of a log, a JSON array in one file, with `at` from 1: in the file's order or by lower-case name.
    A missing file has none; anything but an array raises ValueError."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"at int, {record}")
    whole = spark.read.text(path, wholetext=True)
    if not whole.filter(~F.ltrim("value").startswith("[")).isEmpty():
        raise ValueError(f"{path} must hold a JSON array")
    rows = F.from_json("value", f"array<struct<{record}>>", {"mode": "FAILFAST"})
    if by_name:
        name = lambda x: F.lower(F.coalesce(x["source_name"], F.lit("")))
        rows = F.array_sort(rows, lambda a, b: F.when(name(a) < name(b), -1).when(name(a) > name(b), 1).otherwise(0))
    return whole.select(F.posexplode(rows).alias("pos", "r")).select((_c("pos") + 1).alias("at"), "r.*")


def normalise_sources(rows: DataFrame) -> DataFrame:
    """Sources with known types and a name each: source_001 and so on where there is none."""
    name = F.coalesce("source_name", F.format_string("source_%03d", "at"))
    return rows.withColumns({"source_name": name, "source_type": coerce_source_type(F.coalesce("source_type", F.lit("")), ALIASES)})


def problems(rows: DataFrame, required: list[str], unique: list[str], path: str | None = None, url: str | None = None, cap: int | None = None, allow_absolute: bool = False) -> DataFrame:
    """issue_id, at, problem: what is wrong with each row; second and later rows of a unique field, ignoring case."""
    rules: list[Column] = [F.when(F.coalesce(F.trim(k), F.lit("")) == "", F.lit(f"{k} is missing")) for k in required]
    if "mode" in rows.columns:
        rules.append(F.when(~F.coalesce(_c("mode").isin(MODES), F.lit(False)), "mode is unknown"))
    if path:
        rules.append(F.concat(F.lit(f"{path}: "), path_problem(_c(path), allow_absolute)))
    if url:
        rules.append(F.concat(F.lit(f"{url}: "), url_problem(_c(url))))
    if cap:
        rules.append(F.when(_c("at") > cap, f"more than {cap} sources"))
    out = rows.select("issue_id", "at", F.explode(F.array_compact(F.array(*rules))).alias("problem"))
    for k in unique:
        again = duplicate_names(rows.filter(_c(k).isNotNull()), ["issue_id"], k, "at")
        out = out.union(again.select("issue_id", "at", F.concat(F.lit(f"duplicate {k}, first at "), _c("first_at").cast("string")).alias("problem")))
    return out


def select_candidates(candidates: DataFrame, selections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The acquisition manifest's rows of the selected candidates, and selections without a candidate.  Ids match as
    they are written."""
    on = ["issue_id", "candidate_id"]
    chosen = selections.withColumn("source_type", coerce_source_type(_c("source_type"), ALIASES))
    met = chosen.join(candidates.drop("at"), on).select("issue_id", "at", "source_name", "source_type", "mode", "url", "title", "publisher", "published_at", "citation_note", "candidate_id")
    return met, selections.join(candidates, on, "left_anti")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """key, source_type of an override file: an object of names and types, or one that holds it under source_types."""
    whole = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.from_json(F.get_json_object("value", "$.source_types"), "map<string,string>"), F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}))
    return whole.select(F.explode(inner).alias("key", "source_type"))


def override_types(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """files (name, source_type) with overrides (key, source_type): by file name, else by stem, ignoring case."""
    wanted = overrides.groupBy(F.lower("key").alias("key")).agg(F.max("source_type").alias("forced"))
    by_name = wanted.select(_c("key").alias("k1"), _c("forced").alias("f1"))
    by_stem = wanted.select(_c("key").alias("k2"), _c("forced").alias("f2"))
    stem = F.regexp_replace(F.lower("name"), r"\.[^.]*$", "")
    rows = files.join(by_name, F.lower("name") == _c("k1"), "left").join(by_stem, stem == _c("k2"), "left")
    return rows.withColumn("source_type", coerce_source_type(F.coalesce("f1", "f2", "source_type"), ALIASES)).drop("k1", "f1", "k2", "f2")

