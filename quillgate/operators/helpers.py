"""What helpers and reviewers are given, and what comes back from them: joins by packet, and JSON of any shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import hash16
from .classify import review_bucket
from .reviews import instruction

_c = F.col

# Where a packet's question may stand, in this order, and what is asked where there is none
QUESTION_LISTS = ["must_verify", "evidence_questions", "nice_to_verify", "unsafe_to_conclude"]
NO_QUESTION = "What source or context must be checked before relying on this claim?"
NOT_TO_CONCLUDE = "Do not conclude truth, causality, market action, expected return, or investment suitability."
# What a helper is asked of the packet as a whole
HELPER_QUESTIONS = [
    "Are any verification questions phrased as if an unverified claim is already true?",
    "Are any excluded finance claims leaking advice, target, allocation, probability, or expected-profit wording?",
    "Are source-family hints too broad or misleading for the evidence requested?",
    "Are rumor, social, private, or deleted-source claims clearly advisory-only?",
]


def _said(text: Column) -> Column:
    """The text without outer space, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def first_question(columns: list[str]) -> Column:
    """The packet's own question, else the first that its lists ask, in their order.  `columns`: those that packets have;
    null where none asks."""
    own = [_said(_c("verification_question"))] if "verification_question" in columns else []
    asked = lambda k: F.get(F.filter(F.transform(k, lambda i: _said(i["question"])), lambda q: q.isNotNull()), F.lit(0))
    return F.coalesce(*own, *[asked(k) for k in QUESTION_LISTS if k in columns], F.lit(None).cast("string"))


def claim_index(packets: DataFrame) -> DataFrame:
    """What a helper sees of each packet: its masked text, category, source and tier."""
    masked = F.coalesce(F.nullif("claim_text_masked", F.lit("")), "claim_text_safe")
    return packets.select("at", "packet_id", "claim_text_safe", masked.alias("claim_text_masked"), "claim_category", "source_name", "risk_tier")


def review_index(helper: DataFrame, packets: DataFrame, order: str = "at") -> DataFrame:
    """The helper's index (packet_id, risk_tier, ...) with each packet's question.  A packet that is not there, or asks
    nothing, gives the last question; of packets of one id the last one counts.  Packets are told apart before they meet
    the index, one row an id."""
    asked = packets.filter("packet_id <> ''").groupBy("packet_id").agg(F.max_by(F.struct(first_question(packets.columns).alias("q")), order).alias("last"))
    rows = helper.join(asked.select("packet_id", _c("last.q").alias("__q")), "packet_id", "left")
    return rows.withColumns(
        {
            "review_bucket": review_bucket(_c("risk_tier")), "review_instruction": instruction(_c("risk_tier")),
            "verification_question": F.coalesce("__q", F.lit(NO_QUESTION)), "must_not_conclude": F.lit(NOT_TO_CONCLUDE),
        }
    ).drop("__q")


def imported(files: DataFrame, name: str = "path", text: str = "text") -> DataFrame:
    """Reviews from outside, one row a file: review_id and source_sha256 (of the text), raw_text (of what is no JSON),
    parsed_json (JSON text of an object: what is another kind of value is one under `items`) and problem.

    Names that end in .json hold JSON; if it is broken, problem says so.  A null text is an empty one.
    """
    raw = F.coalesce(_c(text), F.lit(""))
    is_json = F.lower(_c(name)).endswith(".json")
    doc = F.when(is_json, F.try_parse_json(raw))
    object_ = F.schema_of_variant(doc).startswith("OBJECT")
    kept = F.when(object_, F.to_json(doc)).when(doc.isNotNull(), F.concat(F.lit('{"items":'), F.to_json(doc), F.lit("}"))).otherwise("{}")
    return files.withColumns(
        {
            "review_id": F.concat(F.lit("helper_review_"), hash16(raw)), "source_sha256": F.sha2(raw, 256),
            "raw_text": F.when(is_json, "").otherwise(raw), "parsed_json": kept, "problem": F.when(is_json & doc.isNull(), "broken JSON"),
        }
    )
