"""Documents to claims: a line state machine as gaps and islands, all in Catalyst.

Each line gets a kind; lines that flush start a new island; the text lines of an island are one paragraph, which
is split into sentences.  Order and first-wins distinctness come from explicit positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgate.functions.rules import settle

# Page furniture of forums, in the order in which it is removed (twice)
NOISE = [
    r"로그인\s+회원가입\s*\|\s*아이디\s+비번찾기", r"(?:증권포럼|재테크포럼|보험포럼)\s*입니다\.", r"\b(?:재테크포럼|보험포럼)\b", r"파워링크\s+등록안내",
    r"등록일\s+\d{4}-\d{2}-\d{2}\s+\d{1,2}:\d{2}\s+조회수\s+\d{1,3}(?:[,.]\d{3})*", r"등록일\s+\d{4}-\d{2}-\d{2}\s+\d{1,2}:\d{2}",
    r"조회수\s+\d{1,3}(?:[,.]\d{3})*", r"^\d+\s+추천하기\s+다른의견\s+\d+\s*\|\s*신고\s*", r"추천하기\s+다른의견\s+\d+\s*\|\s*신고",
    r"첨부파일\s+.*?\s+목록보기", r"목록보기\s+\d+\s+\d+", r"^\d+\s+\d+\s+\d+\s+", r"^\d+\s+\d+\s+",
    r"\d{1,2}:\d{2}:\d{2}\s+댓글주소복사(?:\s+\d+\s+\d+)?", r"댓글주소복사", r"△\s*이전글\s*▽\s*다음글", r"△\s*이전글\s*▽\s*다음글\s*목록보기",
    r"\s+\d{1,2}:\d{2}:\d{2}$", r"(?:작성일|등록일)\s*:?\s*\d{4}-\d{2}-\d{2}(?:\s+\d{1,2}:\d{2})?", r"작성자\s*:?\s*\S{1,20}",
    r"(?:조회수|조회|추천|댓글|스크랩|신고|목록)\s*:?\s*\d{1,3}(?:[,.]\d{3})*",
]
UI_ONLY = [
    r"^\|$", r"^신고$", r"^첨부파일$", r"^목록보기$", r"^\d{1,3}$", r"^\d+\s+\d+$", r"^추천하기\s+다른의견\s+\d+$", r"^댓글주소복사$",
    r"^△\s*이전글\s*▽\s*다음글$", r"^[\w.-]+\.(?:jpg|jpeg|png|gif|webp)$", r"^Screenshot_.*$",
]
# Labels and counts of posts, what is left of a line of them, and words of their footers
META_LABEL = "작성일|등록일|작성자"
META_COUNT = r"(?:조회수|조회|추천|댓글|스크랩|신고|목록)\s*:?\s*\d"
META_TOKEN = (
    r"(?:작성일|등록일|작성자)\s*:?\s*\S*|\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}(?::\d{2})?"
    r"|(?:조회수|조회|추천|댓글|스크랩|신고|목록)\s*:?\s*\d{1,3}(?:[,.]\d{3})*"
)
FOOTER = "좋아요|스크랩|신고|공유|목록|이전글|다음글|추천하기"
ABBREVIATIONS = [
    "U.S.", "U.K.", "vs.", "Inc.", "Corp.", "Ltd.", "Co.", "No.", "Mr.", "Ms.", "Mrs.", "Dr.", "Prof.", "St.", "Jr.", "Sr.",
    "e.g.", "i.e.", "etc.", "a.m.", "p.m.",
]
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
#: Characters of a claim at least; of a reply at least; words of a heading at most.
LEAST, LEAST_REPLY = 8, 10
_HOLD = "\u0001"
#: Blank lines, which end every paragraph.  Others that count as blank only leave sections together.
_SECTION_BREAK = r"\n(?:[ \t\r]*+\n)++"
#: What every pattern of the chain needs: a word of the furniture, numbers in front, or a time at the end.
_NOISE_WORD = r"로그인|포럼|파워링크|추천|첨부파일|목록|댓글|이전글|작성|신고|스크랩|조회|등록일"
_NOISE_NUMBER = r"^\s*[0-9\p{Nd}]+\s+\p{Nd}|\p{Nd}:\p{Nd}\p{Nd}\s*$"
#: Texts without a Hangul syllable hold no word of furniture, label or footer; one class is faster to look for.
_HANGUL = "[가-힣]"


def _sub(c: Column, p: str, to: str = " ") -> Column:
    return F.regexp_replace(c, "(?Ud)" + p, to)


def squeeze(c: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(_sub(c, r"\s\s+|[^\S ]"))  # single spaces stay as they are


def strip_noise(c: Column) -> Column:
    """The noise chain runs only where something that it needs occurs.  It is cut into short methods by lambdas."""

    def step(t: Column, part: list[str]) -> Column:
        return F.get(F.transform(F.array(t), lambda x: reduce(_sub, part, x)), F.lit(0))

    chain = NOISE + NOISE
    cleaned = reduce(step, [chain[i : i + 6] for i in range(0, len(chain), 6)], c)
    return squeeze(F.when((c.rlike(_HANGUL) & c.rlike(_NOISE_WORD)) | c.rlike(_NOISE_NUMBER), cleaned).otherwise(c))


def _words(c: Column) -> Column:
    return F.size(F.split(squeeze(c), " "))


def _lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    trimmed = lambda x: F.regexp_replace(x, r"(?U)^[\s\u001c-\u001f]+|[\s\u001c-\u001f]+$", "")
    raw = df.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), LINE_BREAK)).alias("pos", "raw"))
    raw = settle(raw, {"raw": trimmed(F.col("raw"))})
    r, ends = F.col("raw"), F.col("raw").rlike("[.!?。！？]$")
    raw = settle(
        raw,
        {
            "blank": r == "",
            "table": r.contains("  ") & r.rlike(r"(?U)\d") & ~ends & (_words(r) <= 6),
            "chrome": r.rlike(_HANGUL)
            & (
                r.rlike(META_LABEL) & r.rlike("(?U)" + META_COUNT) & (F.length(_sub(_sub(r, META_TOKEN, ""), r"[\s:|/,.\-]", "")) <= 2)
            )
            | (r.rlike(_HANGUL) & r.rlike(FOOTER) & (_sub(_sub(r, FOOTER, ""), r"[\d,.\s|/·:\-]", "") == "")),
            "clean": strip_noise(r),
        },
    )
    c, label = F.col("clean"), r"(?Ud)^([^\s:]{1,20}?)(님)?\s*:\s*(.+)$"
    rest = F.trim(F.regexp_extract(c, label, 3))
    reply = c.contains(":") & c.rlike(label) & ((F.regexp_extract(c, label, 2) != "") | F.regexp_extract(c, label, 1).rlike(r"^[A-Za-z0-9_.\-]{1,20}$"))
    raw = settle(raw, {"trivial": reply & (F.length(rest) < LEAST_REPLY), "line": F.when(reply, rest).otherwise(c)})
    x = F.col("line")
    ends = x.rlike("[.!?。！？]$")
    capitals = x.rlike("[A-Za-z]") & ~x.rlike(r"(?U)\p{Ll}|\p{Lo}|\p{Lm}|\p{Lt}") & ~ends & (_words(x) <= 5)
    bullet = r"(?Ud)^(?:[-*•]|\d+[.)])\s+(.*)$"
    item = F.trim(F.regexp_extract(x, bullet, 1))
    kind = (
        F.when(F.col("blank"), "flush")
        .when(F.col("table"), "emit")
        .when(F.col("chrome") | (c == ""), "flush")
        .when(F.col("trivial") | x.rlike("(?iuUd)^(?:" + "|".join(p[1:] for p in UI_ONLY) + ")"), "drop")
        .when((x.endswith(":") & (_words(x) <= 8)) | capitals, "flush")
        .when(x.rlike(bullet), "emit")
        .otherwise("text")
    )
    payload = F.when(F.col("table"), c).when(x.rlike(bullet), item).otherwise(x)
    return settle(raw, {"kind": kind, "payload": payload}).select(*keys, "pos", "kind", "payload")


def hold_abbreviations(c: Column) -> Column:
    names = "|".join(a[:-1].replace(".", r"\.") for a in sorted(ABBREVIATIONS, key=lambda a: (-len(a), a)))
    return _sub(F.regexp_replace(c, rf"(?iuU)\b({names})\.", f"$1{_HOLD}"), r"\b([SN])\.(?=\s(?:Korea|Africa)\b)", f"$1{_HOLD}")


def sentences(paragraph: Column) -> Column:
    parts = F.split(hold_abbreviations(strip_noise(paragraph)), r"(?U)(?<=[.!?。！？])\s+")
    one = lambda p: F.btrim(F.replace(p, F.lit(_HOLD), F.lit(".")), F.lit(" \t"))
    trim = lambda p: F.when(
        p.startswith("-") & p.rlike(r"(?U)^-[\d$€£¥₩]"), F.concat(F.lit("-"), F.btrim(F.substring(p, 2, 1 << 30), F.lit(" \t-*")))
    ).otherwise(F.btrim(p, F.lit(" \t-*")))
    return F.filter(F.transform(parts, lambda p: trim(one(p))), lambda p: F.length(p) >= LEAST)


def sections_with(df: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """df, of each text only the sections between blank lines in which the pattern, of one character, occurs.  No claim
    runs over a blank line, so the claims with such a character are the same before and after; their numbers are not."""
    kept = F.filter(F.split(text, _SECTION_BREAK), lambda s: s.rlike(pattern))
    return df.withColumn(text, F.array_join(kept, "\n\n"))


def extract_claims(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, claim_no (from 1, in order of extraction), claim_id, claim_text; of claims that differ only in case
    the first.  A null or blank text gives none.  Each row of df is a document of its own: null or repeated keys do
    not run together, and number their claims apart."""
    named, row = keys, "__row"
    df = df.select(*keys, text).withColumn(row, F.monotonically_increasing_id())
    keys = [*named, row]
    lines = _lines(df, keys, text).filter("kind <> 'drop'")
    order = Window.partitionBy(row).orderBy("pos")
    lines = lines.withColumn("island", F.sum(F.when(F.col("kind") != "text", 1).otherwise(0)).over(order))
    # A line that flushes or emits opens its island; the text lines after it are the island's paragraph.
    told = lines.filter("kind <> 'flush'").groupBy(*keys, "island", (F.col("kind") == "text").alias("para"))
    blocks = told.agg(F.min("pos").alias("at"), F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("rows"))
    whole = F.concat_ws(" ", F.transform("rows", lambda r: r["payload"]))
    emitted = F.filter(F.array(whole), lambda x: F.length(x) >= LEAST)
    claims = blocks.select(*keys, "at", F.posexplode(F.when(F.col("para"), sentences(whole)).otherwise(emitted)).alias("n", "claim_text"))
    claims = claims.withColumn("claim_text", squeeze(F.col("claim_text"))).filter("claim_text <> ''")
    first = F.row_number().over(Window.partitionBy(row, F.lower("claim_text")).orderBy("at", "n"))
    kept = claims.withColumn("first", first).filter("first = 1")
    number = F.row_number().over(Window.partitionBy(row).orderBy("at", "n"))
    return kept.select(*named, number.alias("claim_no"), F.format_string("clm_%03d", number).alias("claim_id"), "claim_text")
