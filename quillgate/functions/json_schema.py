"""JSON Schema compiled to Columns: what is wrong with each document of a table, and where.

A schema is data.  Each of its keywords becomes a predicate over a VARIANT, so any number of documents are checked in the
JVM at once; only keywords that are known here are taken, an unknown one is an error when the schema is compiled.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

VIOLATION = "array<struct<path:string,rule:string,detail:string>>"
_TYPES = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}
_NOTES = {"$schema", "$id", "title", "description"}
_KNOWN = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength", "pattern", "minimum", "maximum"}


def _kind(v: Column) -> Column:
    """OBJECT<..., ARRAY<..., STRING, BOOLEAN, BIGINT, DECIMAL(..), DOUBLE or VOID; a JSON null is VOID."""
    return F.schema_of_variant(v)


def _is(kind: Column, name: str) -> Column:
    if name in ("object", "array"):
        return kind.startswith(_TYPES[name])
    if name == "integer":
        return kind == "BIGINT"
    if name == "number":
        return (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    return kind == _TYPES[name]


def _equals(v: Column, kind: Column, value: Any) -> Column:
    """Is the variant this plain value?  Of equal text, but another type, it is not."""
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
    if value is None:
        return kind == "VOID"
    if isinstance(value, str):
        return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(value))
    if isinstance(value, (int, float)):
        return _is(kind, "number") & (F.try_variant_get(v, "$", "double") == F.lit(float(value)))
    raise ValueError("const and enum hold plain values")


def _wrong(cond: Column, path: Column, rule: str, detail: Column | str) -> Column:
    """One violation if the condition holds; a null one does not."""
    said = F.struct(F.when(path == "", "/").otherwise(path).alias("path"), F.lit(rule).alias("rule"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
    return F.when(F.coalesce(cond, F.lit(False)), F.array(said)).otherwise(F.array().cast(VIOLATION))


def _name(key: str) -> str:
    """The path of a property; paths quote a name by one of two signs."""
    sign = '"' if "'" in key else "'"
    if sign in key:
        raise ValueError(f"a property's name may not hold both quotation marks: {key}")
    return f"$[{sign}{key}{sign}]"


def compiled(schema: dict, at: str = "#") -> Callable[[Column, Column], Column]:
    """A function of a variant and its path ('' at the top) that gives its violations.  Each keyword binds values of its
    own type only, as the standard says; a missing value is no violation but of `required`."""
    unknown = set(schema) - _KNOWN - _NOTES
    if unknown:
        raise ValueError(f"{at}: unknown keywords {', '.join(sorted(unknown))}")
    children = {k: compiled(s, f"{at}/properties/{k}") for k, s in schema.get("properties", {}).items()}
    more = schema.get("additionalProperties", True)
    other = compiled(more, f"{at}/additionalProperties") if isinstance(more, dict) else None
    each = compiled(schema["items"], f"{at}/items") if "items" in schema else None

    def check(v: Column, path: Column) -> Column:
        kind = _kind(v)
        text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        number = F.when(_is(kind, "number"), F.try_variant_get(v, "$", "double"))
        object_, array = _is(kind, "object"), _is(kind, "array")
        parts = []
        if "type" in schema:
            names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            good = _is(kind, names[0])
            for n in names[1:]:
                good = good | _is(kind, n)
            parts.append(_wrong(~good, path, "type", " or ".join(names)))
        if "const" in schema:
            parts.append(_wrong(~_equals(v, kind, schema["const"]), path, "const", json.dumps(schema["const"])))
        if "enum" in schema:
            found = _equals(v, kind, schema["enum"][0])
            for x in schema["enum"][1:]:
                found = found | _equals(v, kind, x)
            parts.append(_wrong(~found, path, "enum", json.dumps(schema["enum"])))
        for key, cond in (
            ("minLength", lambda n: F.length(text) < n), ("maxLength", lambda n: F.length(text) > n), ("pattern", lambda p: ~text.rlike(p)),
            ("minimum", lambda n: number < n), ("maximum", lambda n: number > n),
        ):
            if key in schema:
                parts.append(_wrong(cond(schema[key]), path, key, str(schema[key])))
        if each or "minItems" in schema or "maxItems" in schema:
            items = F.when(array, F.try_variant_get(v, "$", "array<variant>"))
            if "minItems" in schema:
                parts.append(_wrong(F.size(items) < schema["minItems"], path, "minItems", str(schema["minItems"])))
            if "maxItems" in schema:
                parts.append(_wrong(F.size(items) > schema["maxItems"], path, "maxItems", str(schema["maxItems"])))
            if each:
                inner = F.transform(items, lambda x, i: each(x, F.concat(path, F.lit("/"), i.cast("string"))))
                parts.append(F.coalesce(F.flatten(inner), F.array().cast(VIOLATION)))
        keys = F.when(object_, F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
        for k in schema.get("required", []):
            parts.append(_wrong(~F.array_contains(keys, k), path, "required", k))
        for k, of in children.items():
            has = F.array_contains(keys, k)
            here = of(F.try_variant_get(v, _name(k), "variant"), F.concat(path, F.lit(f"/{k}")))
            parts.append(F.when(F.coalesce(has, F.lit(False)), here).otherwise(F.array().cast(VIOLATION)))
        if more is not True:
            extra = F.array_except(keys, F.array(*map(F.lit, children)).cast("array<string>"))
            if other is None:
                parts.append(_wrong(F.size(extra) > 0, path, "additionalProperties", F.array_join(F.array_sort(extra), ", ")))
            else:
                held = F.try_variant_get(v, "$", "map<string,variant>")
                inner = F.transform(extra, lambda k: other(F.element_at(held, k), F.concat(path, F.lit("/"), k)))
                parts.append(F.coalesce(F.flatten(inner), F.array().cast(VIOLATION)))
        return F.concat(*parts) if parts else F.array().cast(VIOLATION)

    return check


def violations(body: Column, schema: dict) -> Column:
    """What is wrong with JSON documents, as an array of (path, rule, detail): /a/0/b is a path, / the document.  Null and
    broken documents break the rule `json`."""
    doc = F.try_parse_json(body.cast("string"))
    return F.when(doc.isNull(), F.array(F.struct(F.lit("/").alias("path"), F.lit("json").alias("rule"), F.lit("no JSON document").alias("detail")))).otherwise(compiled(schema)(doc, F.lit("")))


# The schemas of the artifacts that cross the engine's border
_TEXT, _SOME, _MAYBE = {"type": "string"}, {"type": "string", "minLength": 1}, {"type": ["string", "null"]}
_YES, _NO = {"const": True}, {"const": False}
SCHEMAS = {
    "acquisition-manifest": {
        "type": "object", "required": ["issue_id", "sources"], "additionalProperties": True,
        "properties": {
            "issue_id": _SOME, "analysis_request": _TEXT,
            "sources": {"type": "array", "minItems": 1, "maxItems": 20, "items": {
                "type": "object", "required": ["source_name", "source_type", "mode", "url"], "additionalProperties": True,
                "properties": {
                    "source_name": _SOME, "source_type": _TEXT, "mode": {"enum": ["general", "finance"]}, "url": {"type": "string", "pattern": "^https?://"},
                    "title": _TEXT, "publisher": _TEXT, "published_at": _TEXT, "citation_note": _TEXT,
                },
            }},
        },
    },
    "external-review-response": {
        "type": "object", "required": ["schema_version", "issue_id", "advisory_only", "findings", "safety_checks"], "additionalProperties": True,
        "properties": {
            "schema_version": {"const": "mock-llm-review-v1"}, "issue_id": _TEXT, "advisory_only": _YES,
            "findings": {"type": "array", "items": {
                "type": "object", "required": ["packet_id", "evidence_boundary", "uncertainty_reason", "operator_next_step", "must_not_conclude"], "additionalProperties": True,
                "properties": {"packet_id": _SOME, "evidence_boundary": _TEXT, "uncertainty_reason": _TEXT, "operator_next_step": _TEXT, "must_not_conclude": _TEXT},
            }},
            "safety_checks": {
                "type": "object", "required": ["contains_financial_advice", "preserves_source_boundaries", "fabricates_missing_evidence"], "additionalProperties": True,
                "properties": {"contains_financial_advice": _NO, "preserves_source_boundaries": _YES, "fabricates_missing_evidence": _NO},
            },
        },
    },
    "llm-review-packet": {
        "type": "object", "required": ["schema_version", "packet_id", "issue_id", "boundaries", "review_claim_index", "required_output_schema"], "additionalProperties": True,
        "properties": {
            "schema_version": {"const": "llm-review-packet-v1"}, "packet_id": _SOME, "issue_id": _MAYBE, "purpose": _TEXT,
            "boundaries": {
                "type": "object", "required": ["advisory_only", "cannot_upgrade_claims", "deterministic_core_is_final_authority", "no_financial_advice"], "additionalProperties": True,
                "properties": {k: _YES for k in (
                    "advisory_only", "cannot_upgrade_claims", "deterministic_core_is_final_authority", "no_financial_advice", "no_investment_or_trading_recommendations",
                    "missing_evidence_requires_uncertainty",
                )},
            },
            "review_claim_index": {"type": "array", "items": {
                "type": "object", "required": ["packet_id", "risk_tier", "review_bucket", "verification_question", "must_not_conclude"], "additionalProperties": True,
                "properties": {
                    "packet_id": _SOME, "source_name": _MAYBE, "claim_text_masked": _MAYBE, "claim_category": _MAYBE, "risk_tier": _MAYBE, "review_bucket": _TEXT,
                    "review_instruction": _TEXT, "verification_question": _SOME, "must_not_conclude": _SOME,
                },
            }},
            "verification_questions": {"type": "array"}, "required_output_schema": {"type": "object"},
        },
    },
}
