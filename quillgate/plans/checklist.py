"""The checklist of a bundle's operator, as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .reports import _text

# The checklist
CHECKLIST = """# Issue Bundle Operator Review Checklist

## Before Trusting a Bundle Summary

- Confirm every expected local source file is present in `bundle_manifest.json`.
- Confirm every source has the intended `source_type` and `mode`.
- Confirm `bundle_run_index.json` shows validation passed for each source.
- Review `bundle_operator_summary.md` before using any claim downstream.

## Meaning of Key Labels

- Unsupported: the text contains a claim that needs primary or independent support.
- Rumor: social/community or manipulation-style material that must not be treated as fact.
- Excluded finance claim: finance advice, target, allocation, probability, or trade-outcome language blocked from report text.
- Conflict: multiple sources produce divergent causal explanations or repeated claims without lineage.

## Escalate to Human/Web Verification When

- A claim affects financial, legal, medical, or operational decisions.
- A claim is high or critical risk.
- A source is private, deleted, inaccessible, or only repeated through social/community channels.
- A bundle summary reports source divergence or cross-run repeated social/community claims.
- A fact must be confirmed against an official or primary source.
"""


def checklist(spark: SparkSession) -> DataFrame:
    return _text(spark, 0, CHECKLIST.splitlines())
