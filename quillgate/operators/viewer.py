"""What the viewer works out beside the pipeline: suggestions for candidates, restored selections, filters of acquired
sources, and the figures in the text of a package."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_c = F.col

# Words that suggest a source's type, the first type with a word in the text wins; words of finance
SUGGESTED_TYPES = [
    ("news", ["news", "press", "reuters", "bloomberg", "journal"]), ("social", ["forum", "reddit", "twitter", "discord", "telegram"]),
    ("analyst", ["analyst", "research", "report"]), ("community", ["community", "blog"]), ("user_note", ["note", "memo"]),
    ("company", ["company", "corporate", "investor"]),
]
DEFAULT_TYPE = "official"
FINANCE_WORDS = ["finance", "stock", "crypto"]

# Patterns of figures in a package's text
ISSUE_ID = r"(?i)Issue ID\s*:\s*([^\n\r]+)"
SOURCE_COUNT = r"(?i)(?:Source Count|Sources|Total Sources)\s*:\s*(\d+)"
LISTED_LINK = r"(?m)^[-*]\s+\[.*?\]\(.*?\)"
COUNTED = {"runs": r"(?i)Analysis Run\s*#?\s*(\d+)", "low": r"(?i)low[- ]risk", "medium": r"(?i)medium[- ]risk|med[- ]risk", "high": r"(?i)high[- ]risk", "claims": r"(?i)claim"}


def _any(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def suggestions(candidates: DataFrame) -> DataFrame:
    """candidates (candidate_id, at, title, url, publisher, warnings) with suggested_name, suggested_type and
    suggested_mode.  Null and empty titles give way to the id; a name without a letter or digit is source_ and `at`."""
    title = F.when(F.coalesce("title", F.lit("")) != "", _c("title")).otherwise(F.coalesce("candidate_id", F.lit("")))
    name = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_")
    name = F.regexp_replace(name, "^_|_$", "")
    parts = [F.coalesce(k, F.lit("")) for k in ("title", "url", "publisher", "candidate_id")]
    rows = candidates.withColumn("__seen", F.lower(F.concat_ws(" ", *parts, F.array_join("warnings", " "))))
    kinds = reduce(lambda w, t: w.when(_any(_c("__seen"), t[1]), t[0]), SUGGESTED_TYPES[1:], F.when(_any(_c("__seen"), SUGGESTED_TYPES[0][1]), SUGGESTED_TYPES[0][0]))
    return rows.withColumns({
        "suggested_name": F.when(name == "", F.concat(F.lit("source_"), _c("at").cast("string"))).otherwise(name),
        "suggested_type": kinds.otherwise(DEFAULT_TYPE), "suggested_mode": F.when(_any(_c("__seen"), FINANCE_WORDS), "finance").otherwise("general"),
    }).drop("__seen")


def restored(candidates: DataFrame, selections: DataFrame) -> DataFrame:
    """candidates with `checked` and the source_name, source_type and mode of the first imported selection (by `at`) of
    their id; candidates that none names stay, unchecked."""
    first = selections.groupBy(_c("candidate_id").alias("__id")).agg(F.min_by(F.struct("source_name", "source_type", "mode"), "at").alias("__s"))
    out = candidates.drop("source_name", "source_type", "mode").join(first, _c("candidate_id") == _c("__id"), "left")
    return out.select("*", _c("__id").isNotNull().alias("checked"), "__s.*").drop("__id", "__s")


def chip(name: str) -> Column:
    """Does the chip all, fetched, warning or non-fetched show an acquired source (status, warnings)?"""
    got = F.coalesce(_c("status") == "fetched", F.lit(False))
    warned = F.coalesce(F.size("warnings") > 0, F.lit(False))
    return {"all": F.lit(True), "fetched": got, "warning": warned, "non-fetched": ~got}[name]


def package_figures(texts: DataFrame, text: str = "text") -> DataFrame:
    """Figures that the text of a package states: issue id (null if none), sources, runs, risk words, claims.  Without a
    stated number of sources the listed links count; one too large for a long is null.  A null text states nothing."""
    body = F.coalesce(text, F.lit(""))
    stated = F.regexp_extract(body, SOURCE_COUNT, 1)
    issue = F.trim(F.regexp_extract(body, ISSUE_ID, 1))
    sources = F.when(stated != "", stated.try_cast("long")).otherwise(F.regexp_count(body, F.lit(LISTED_LINK)).cast("long"))
    counted = {k: F.regexp_count(body, F.lit(p)).cast("long") for k, p in COUNTED.items()}
    return texts.withColumns({"stated_issue": F.when(issue != "", issue), "sources": sources, **counted})
