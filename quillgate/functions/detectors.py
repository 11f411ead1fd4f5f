"""The detectors, as rules over two columns: `text` (normalised) and `lower`; and normalisation itself."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillgate.session import prepare

from . import lexicon as lx
from .rules import Hits, Not, all_of, any_of, bounded, once, pattern, patterns, phrases, settle, substrings

market = any_of(
    phrases(lx.MARKET),
    all_of(bounded("market"), Not(pattern(lx.PHYSICAL_MARKET, "lower"))),
    pattern(lx.MARKET_SESSION_KO, "text", lx.MARKET_SESSION_KO.replace("(?<![가-힣])", "(?:^|[^가-힣])")),
    patterns(lx.MARKET_SLANG_KO),
)
causal = all_of(
    Not(substrings(lx.NO_CAUSE, "lower")),
    Not(patterns(lx.NO_CAUSE_KO_PATTERNS)),
    any_of(phrases(lx.CAUSAL_PHRASES), substrings(lx.CAUSAL_KO), patterns(lx.CAUSAL_KO_PATTERNS)),
)
number = pattern(r"\d")
flow = substrings(lx.FLOW, "lower")
motive = phrases(lx.MOTIVE)
private = any_of(
    phrases(lx.PRIVATE),
    all_of(substrings(["삭제된"]), substrings(["캡처"])),
    all_of(substrings(["지워진", "삭제된"]), substrings(["오픈채팅"])),
)
private_more = substrings(lx.PRIVATE_MORE, "lower")
manipulation = any_of(
    phrases(lx.MANIPULATION),
    patterns(lx.HIDING, "lower"),
    substrings(lx.MANIPULATION_KO),
    patterns(lx.MANIPULATION_KO_PATTERNS),
    pattern(lx.INSIDERS, "lower"),
    all_of(pattern(lx.COLLUSION), substrings(lx.COLLUSION_CUES)),
    all_of(pattern(lx.COVERUP), substrings(lx.COVERUP_CUES)),
    all_of(substrings(lx.WEAK_KO), substrings(lx.WEAK_CUES)),
    all_of(*(pattern(p, "lower") for p in lx.RIGGED)),
)
finance_context = any_of(substrings(lx.CONTEXT_KO), market)
rating = any_of(*(bounded(p) for p in lx.RATINGS))
_trade_ko = [
    pattern(rf"(?<![순공])(?<!순\s)(?<!공\s)매\s*{w}\s*{lx.ADVICE_KO_TRADE}", "text", rf"(?:^|[^순공\s]|(?:^|[^순공])\s)매\s*{w}\s*{lx.ADVICE_KO_TRADE}")
    for w in ("수", "도")
]
_plain_ko = [p for p in lx.ADVICE_KO if "(?" not in p or "(?:" in p and "(?<" not in p and "(?!" not in p]
action = any_of(
    phrases(lx.ADVICE),
    *(bounded(p) for p in lx.LONG_SHORT),
    pattern(rf"(?<![a-z]){lx.EXPOSURE}", "lower", rf"(?:^|[^a-z]){lx.EXPOSURE}"),
    phrases(lx.BUYING),
    *_trade_ko,
    patterns(_plain_ko),
    pattern(r"사라(?![가-힣])", "text", r"사라(?:[^가-힣]|$)"),
    pattern(r"(?<![A-Za-z])(?:long|short)\s*잡", "text", r"(?:^|[^A-Za-z])(?:long|short)\s*잡"),
    all_of(finance_context, patterns(lx.ADVICE_KO_CONTEXT)),
    *(all_of(*map(pattern, ps)) for ps in lx.EUPHEMISMS_KO),
    phrases(lx.URGENCY),
    rating,
)
hype = pattern("(?i)(?:" + "|".join(lx.HYPE) + ")")
price_projection = any_of(pattern(lx.PRICE_TICKER), pattern("(?i)" + lx.PRICE_FLOOR))
target_price = any_of(
    phrases(lx.TARGET),
    pattern(lx.TARGET_KO, "text", lx.TARGET_KO.replace("(?=", "(?:")),
    price_projection,
)
_mix = rf"(?<!(?:{lx.PRODUCT_MIX})\s{{0,20}})"
sizing = any_of(
    substrings(lx.SIZING, "lower"),
    pattern(_mix + lx.SIZING_KO + lx.SIZING_ENDS, "text", lx.SIZING_KO + lx.SIZING_ENDS),
    bounded(lx.PORTFOLIO),
)
probability = any_of(
    patterns(lx.ODDS_KO),
    all_of(pattern(lx.NINE_IN_TEN), substrings(lx.NINE_CUES)),
    patterns(lx.ODDS, "lower"),
    substrings(lx.ODDS_PHRASES, "lower"),
)
future_return = any_of(patterns(lx.RETURNS_KO), patterns(lx.RETURNS, "lower"))
framing = phrases(lx.LOADED + lx.FRAME_MORE)
loaded = phrases(lx.LOADED)
certainty = phrases(lx.CERTAINTY)
true_cause = any_of(phrases(lx.TRUE_CAUSE), substrings(lx.TRUE_CAUSE_KO))
#: Words between boundaries, so that "now" is no part of "know".
recent = any_of(phrases(lx.RECENT), substrings(lx.RECENT_KO))
self_serving = any_of(substrings(lx.SELF_SERVING, "lower"), substrings(lx.SELF_SERVING_KO))
forward_wide = all_of(
    any_of(pattern(lx.FORWARD, "lower"), pattern(lx.FORWARD_KO)), any_of(substrings(lx.BROAD_KO), pattern(lx.BROAD, "lower"))
)

#: Every detector's name, rule, and whether advice disclaimers are taken out before it.
DETECTORS = {
    "d_causal": causal, "d_market": market, "d_flow": flow, "d_motive": motive, "d_manipulation": manipulation, "d_framing": framing,
    "d_loaded": loaded, "d_certainty": certainty, "d_action": action, "d_private": any_of(private, private_more), "d_recent": recent,
    "d_hype": hype, "d_target": target_price, "d_sizing": sizing, "d_probability": any_of(probability, future_return),
    "d_true_cause": true_cause, "d_number": number, "d_self_serving": self_serving, "d_forward_wide": forward_wide,
}


HITS = Hits([*(p for rule in DETECTORS.values() for p in rule.patterns()), "|".join(f"(?:{p})" for p in lx.DISCLAIMERS)])


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array((t if t is None else unicodedata.normalize("NFKC", t) for t in map(pa.StringScalar.as_py, texts)), pa.string())


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def cleaned(text: Column) -> Column:
    """Format and control characters dropped, but line feed and tab."""
    return F.when(is_ascii(text), F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f]", "")).otherwise(F.regexp_replace(text, r"[\p{Cf}\p{Cc}&&[^\n\t]]", ""))


def composed(clean: Column, folded: Column) -> Column:
    """Of a cleaned text and its compatibility form: look-alike letters folded to Latin; ASCII texts as they are."""
    return F.when(is_ascii(clean), clean).otherwise(F.translate(folded, lx.LOOKALIKES, lx.LOOK_LIKE))


def normalise(text: Column) -> Column:
    """Format and control characters dropped (but line feed and tab), compatibility forms and split syllables
    composed, look-alike letters folded to Latin.  ASCII texts stay within the JVM."""
    prepare()
    clean = cleaned(text)
    return composed(clean, _nfkc(F.when(~is_ascii(clean), clean)))


def read(df: DataFrame, text: Column, hits: Hits, out: str, places: str) -> DataFrame:
    """df with `out`, the normalised text, and `places`, those of the literals of `hits` that it holds lower-cased."""
    rows = settle(df, {"__clean": cleaned(text)})
    rows = rows.withColumn("__read", hits.read(F.col("__clean"), (lx.LOOKALIKES, lx.LOOK_LIKE)))
    return settle(rows, {out: F.coalesce("__read.folded", "__clean"), places: F.col("__read.hits")}).drop("__clean", "__read")


DISCLAIMER = "|".join(f"(?:{p})" for p in lx.DISCLAIMERS)


def without_disclaimers(text: Column, hits: Column) -> Column:
    return F.when(HITS.may_match(hits, DISCLAIMER), F.regexp_replace(text, "(?iuUd)" + DISCLAIMER, " ")).otherwise(text)


@once
def _detected() -> dict[str, Column]:
    """Every detector over the columns that `detect` lays down."""
    cols = {"text": F.col("__text"), "lower": F.col("__lower"), "hits": F.col("__hits"), "rules": HITS}
    advice = {
        "text": F.col("__advice"), "lower": F.coalesce("__advice_lower", "__lower"), "hits": F.coalesce("__advice_hits", "__hits"), "rules": HITS,
    }
    return {k: r.column(advice if k == "d_action" else cols) for k, r in DETECTORS.items()}


def detect(df: DataFrame, text: str = "claim_text") -> DataFrame:
    """df with a boolean column for each detector.  Null texts match nothing."""
    base = read(df, F.coalesce(F.col(text), F.lit("")), HITS, "__text", "__hits")
    base = settle(base, {"__lower": F.lower("__text")})
    base = settle(base, {"__advice": without_disclaimers(F.col("__text"), F.col("__hits"))})
    base = base.withColumn("__advice_lower", F.when(F.col("__advice") != F.col("__text"), F.lower("__advice")))
    # Texts with a disclaimer are few; theirs is not looked through again, all patterns of advice run on it.
    base = base.withColumn("__advice_hits", F.when(F.col("__advice_lower").isNotNull(), HITS.every()))
    out = settle(base, _detected())
    return out.drop("__text", "__lower", "__advice", "__advice_lower", "__hits", "__advice_hits")
