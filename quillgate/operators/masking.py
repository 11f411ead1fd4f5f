"""Masking of advice-like language, and escaping, as one gated chain of replacements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.functions import detectors as dt
from quillgate.functions import lexicon as lx
from quillgate.functions.rules import Hits, once, settle

# What stands in for masked language
ACTION, PRICE, RISK, PROFIT = "[blocked-investment-action]", "[blocked-price-level]", "[blocked-risk-order]", "[blocked-profit-order]"
ODDS, TRADE, RETURN = "[blocked-probability-language]", "[blocked-trade-outcome-language]", "[blocked-return-projection]"
RATING, URGENCY, TRADING = "[blocked-investment-rating]", "[blocked-urgency-language]", "[blocked-trading-action]"
ALLOCATION, CAUSE, HYPE = "[blocked-allocation-language]", "[redacted-unsupported-true-cause-claim]", "[blocked-finance-hype-action]"
RECOMMENDATION, EXCLUDED = "[blocked-investment-recommendation]", "[excluded-unsafe-finance-claim]"
GENERAL = [
    (r"\b(?:buy|buys|buying|bought)\b", ACTION), (r"\b(?:sell)\b", ACTION), (r"\b(?:shorts|shorting|shorted)\b", ACTION),
    (r"\b(?:longs|longing|longed)\b", ACTION), (r"\b(?:target price|price target|upside target|downside target)\b", PRICE),
    (r"\bstop[\s-]?loss\b", RISK), (r"\btake[\s-]?profit\b", PROFIT), (r"\b\d{1,3}\s*%\s*(?:chance|probability|odds)\b", ODDS),
    (r"\b\d{1,3}\s*percent\s*(?:chance|probability|odds)\b", ODDS),
    (r"\bchance\s*of\s*(?:a\s*)?profitable trade(?:\s+this\s+(?:week|month|quarter|year))?\b", ODDS),
    (r"\bprofitable trade(?:\s+this\s+(?:week|month|quarter|year))?\b", TRADE),
    (r"\b\d+(?:\.\d+)?x\s+(?:returns?|gains?|profits?|upsides?)\b", RETURN),
]
_B = lambda p: rf"(?<![a-z0-9])(?:{p})(?![a-z0-9])"
FINANCE = [
    (_B("buy|sell"), ACTION), *((_B(p), ACTION) for p in lx.LONG_SHORT), (rf"(?<![a-z]){lx.EXPOSURE}", ACTION),
    *((rf"(?<![순공])(?<!순\s)(?<!공\s)매\s*{w}\s*{lx.ADVICE_KO_TRADE}", ACTION) for w in ("수", "도")),
    *((p, ACTION) for p in lx.ADVICE_KO if not p.startswith("비중") and "short" not in p), *((_B(p), RATING) for p in lx.RATINGS),
    (_B(r"load\s+up"), ACTION), (_B(r"act\s+now"), URGENCY), (_B(r"before\s+(?:it\s+is|it's)\s+too\s+late"), URGENCY),
    (_B(r"last\s+chance"), URGENCY), (_B(r"don'?t\s+miss\s+out"), URGENCY), (_B(r"get\s+in\s+before"), URGENCY), (_B("entry|exit"), TRADING),
    (_B("stop loss"), RISK), (_B("take profit"), PROFIT), (_B("|".join(lx.TARGET)), PRICE), (lx.TARGET_KO, PRICE),
    (_B("position size|position sizing|allocate|allocating|allocation") + r"(?!-language)", ALLOCATION), (_B(lx.PORTFOLIO), ALLOCATION),
    (_B(r"\d{1,3}\s*%\s*(?:chance|probability|odds)"), ODDS), (_B(r"\d{1,3}\s*percent\s*(?:chance|probability|odds)"), ODDS),
    (r"확률\s*\d+", ODDS), (r"\d+\s*(?:%|프로|퍼센트)\s*확률", ODDS), (r"승률\s*\d+\s*%?", ODDS),
    (r"열\s*에\s*아홉(?=[^.!?]*(?:오르|먹|수익|익절|승률|번다|자리|종목))", ODDS),
    (_B(r"chance\s*of\s*(?:a\s*)?profitable trade(?:\s+this\s+(?:week|month|quarter|year))?"), ODDS),
    (_B(r"profitable trade(?:\s+this\s+(?:week|month|quarter|year))?"), TRADE), (r"(?:nearly|almost)\s+always\s+(?:\w+\s+){0,4}profitab\w*", ODDS),
    (_B(r"\d+(?:\.\d+)?x\s+(?:return|gain|profit|upside)"), RETURN), (r"수익률\s*\d", RETURN), (r"\d+\s*(?:%|프로|퍼센트)\s*수익률", RETURN),
    (r"\d+배\s*(?:수익|상승)", RETURN),
    (r"(?<![a-z0-9])(?:could|may|might|should|expected to|projected to)\s+(?:produce|return|yield|generate|deliver)\b.*\b(?:return|gain|profit|upside)(?![a-z0-9])", RETURN),
    (_B(r"(?:return|gain|profit|upside)\s+within\s+\d+\s+(?:day|days|week|weeks|month|months|year|years)"), RETURN),
    (_B("true reason|real reason|true cause"), CAUSE), (r"(?:진짜|실제)\s*(?:이유|원인)", CAUSE),
]
FINANCE_LATE = [
    (rf"(?<!(?:{lx.PRODUCT_MIX})\s{{0,20}}){lx.SIZING_KO}{lx.SIZING_MASK_ENDS}", ALLOCATION), (lx.PRICE_FLOOR, PRICE), *((p, HYPE) for p in lx.HYPE),
    (r"[^.\n。]*권고(?:한다|합니다|했다|하라|하며|하고|하는|할|를|을)?", RECOMMENDATION),
]
CONTEXT = [
    (r"조심(?:들)?(?:하|해|하세요|해야)", URGENCY),
    *((p, ACTION) for p in lx.ADVICE_KO_CONTEXT if not p.startswith(("조심", "권고"))),
]
HITS = Hits([dt.DISCLAIMER, lx.PRICE_TICKER, *(p for p, _ in GENERAL + FINANCE + FINANCE_LATE + CONTEXT), *dt.finance_context.patterns()])


def _chain(text: Column, masks: list[tuple[str, str]]) -> Column:
    """All masks in order; each runs only where one of its literals occurs."""

    def one(t: Column, m: tuple[str, str]) -> Column:
        done, gate = lambda x: F.regexp_replace(x, F.lit("(?iuUd)" + m[0]), F.lit(m[1])), HITS.may_match(F.col("__hits"), m[0])
        # An array of one names the text, so that the masks before it are not copied into both branches.
        return done(t) if gate is None else F.get(F.transform(F.array(t), lambda x: F.when(gate, done(x)).otherwise(x)), F.lit(0))

    return reduce(one, masks, text)


@once
def _masks(kind: str) -> Column:
    """A chain of masks over __masked, gated by __hits."""
    return _chain(F.col("__masked"), {"general": GENERAL, "finance": FINANCE, "late": FINANCE_LATE, "context": CONTEXT}[kind])


@once
def _in_context() -> Column:
    """Is the text about finance at all?"""
    return dt.finance_context.column({"text": F.col("__plain"), "lower": F.col("__low"), "hits": F.col("__hits"), "rules": HITS})


def mask(df: DataFrame, text: str, mode: str, out: str) -> DataFrame:
    """df with `out`: text masked for its mode (finance where null).  Advice disclaimers survive; tokens that masks
    leave are not masked again.  Null stays null."""
    held, gap = "(?iuUd)" + dt.DISCLAIMER, "\ue000"
    finance = F.coalesce(F.col(mode), F.lit("finance")) == "finance"
    df = dt.read(df, F.col(text), HITS, "__plain", "__hits")
    df = settle(df, {"__plain": F.when(dt.is_ascii(F.col("__plain")), F.col("__plain")).otherwise(F.regexp_replace("__plain", r"[\ue000-\uf8ff]", ""))})
    df = settle(df, {"__low": F.lower("__plain")})
    some = HITS.may_match(F.col("__hits"), dt.DISCLAIMER)
    none = F.array().cast("array<string>")
    df = settle(df, {
        "__kept": F.when(some, F.regexp_extract_all("__plain", F.lit(held), 0)).otherwise(none),
        "__masked": F.when(some, F.regexp_replace("__plain", held, gap)).otherwise(F.col("__plain")),
    })
    df = settle(df, {"__masked": _masks("general")})
    # The ticker is held to capitals.
    ticker = HITS.may_match(F.col("__hits"), lx.PRICE_TICKER)
    df = settle(df, {"__masked": F.when(ticker, F.regexp_replace("__masked", "(?Ud)" + lx.PRICE_TICKER, PRICE)).otherwise(F.col("__masked"))})
    # Projections between the long chains keep each generated method small.
    df = settle(df, {"__masked": F.when(finance, _masks("finance")).otherwise(F.col("__masked"))})
    df = settle(df, {"__masked": F.when(finance, _masks("late")).otherwise(F.col("__masked"))})
    df = settle(df, {"__masked": F.when(finance & _in_context(), _masks("context")).otherwise(F.col("__masked"))})
    pieces = F.split("__masked", gap)
    whole = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.when(i < F.size(pieces) - 1, F.coalesce(F.get("__kept", i), F.lit(""))).otherwise(""))), "")
    return df.withColumn(out, F.when(F.col("__plain").isNotNull(), whole)).drop("__plain", "__kept", "__masked", "__low", "__hits")


def escape_inline(text: Column) -> Column:
    """Brackets and backticks escaped, angle brackets as entities."""
    return F.replace(F.replace(F.regexp_replace(text, r"([\[\]`])", r"\\$1"), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def safe_claims(df: DataFrame, text: str = "claim_text", out: str = "safe_text", mode: Column | None = None) -> DataFrame:
    """The output gate: excluded claims give a placeholder with their reference, others are escaped, then masked by `mode`
    (the column of that name if none is given)."""
    rows = df.withColumns({"__raw": escape_inline(F.col(text)), "__mode": F.col("mode") if mode is None else mode})
    masked = mask(rows, "__raw", "__mode", out).drop("__raw", "__mode")
    reference = F.concat(F.lit(EXCLUDED + " id="), F.col("source_name"), F.lit("/"), F.col("claim_id"))
    return masked.withColumn(out, F.when(F.col("claim_type") == "excluded", reference).otherwise(F.col(out)))
