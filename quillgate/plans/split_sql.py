"""DuckDB SQL that splits documents into claims, written apart from the engine's own splitter: its patterns stand here as
text, in the dialect of an engine without look-around, whose classes are spelled out."""

from __future__ import annotations

from functools import reduce

_WS = r"[\t-\r \x{85}\p{Z}]"
_NWS = r"[^\t-\r \x{85}\p{Z}]"
_D = r"\p{Nd}"

# Page furniture of forums, in the order in which it is removed (twice); S white space, D a digit, N none of S
_NOISE = [
    r"로그인S+회원가입S*\|S*아이디S+비번찾기", r"(?:증권포럼|재테크포럼|보험포럼)S*입니다\.", r"(?:재테크포럼|보험포럼)", r"파워링크S+등록안내",
    r"등록일S+D{4}-D{2}-D{2}S+D{1,2}:D{2}S+조회수S+D{1,3}(?:[,.]D{3})*", r"등록일S+D{4}-D{2}-D{2}S+D{1,2}:D{2}", r"조회수S+D{1,3}(?:[,.]D{3})*",
    r"^D+S+추천하기S+다른의견S+D+S*\|S*신고S*", r"추천하기S+다른의견S+D+S*\|S*신고", r"첨부파일S+.*?S+목록보기", r"목록보기S+D+S+D+", r"^D+S+D+S+D+S+", r"^D+S+D+S+",
    r"D{1,2}:D{2}:D{2}S+댓글주소복사(?:S+D+S+D+)?", r"댓글주소복사", r"△S*이전글S*▽S*다음글", r"△S*이전글S*▽S*다음글S*목록보기", r"S+D{1,2}:D{2}:D{2}$",
    r"(?:작성일|등록일)S*:?S*D{4}-D{2}-D{2}(?:S+D{1,2}:D{2})?", r"작성자S*:?S*N{1,20}", r"(?:조회수|조회|추천|댓글|스크랩|신고|목록)S*:?S*D{1,3}(?:[,.]D{3})*",
]
_UI_ONLY = (
    r"^\|$|^신고$|^첨부파일$|^목록보기$|^D{1,3}$|^D+S+D+$|^추천하기S+다른의견S+D+$|^댓글주소복사$|^△S*이전글S*▽S*다음글$"
    r"|^[\p{L}\p{M}\p{Nd}\p{Pc}.-]+\.(?:jpg|jpeg|png|gif|webp)$|^Screenshot_.*$"
)
_ABBREVIATIONS = r"Prof|Corp|U\.S|U\.K|e\.g|i\.e|a\.m|p\.m|Inc|Ltd|Mrs|etc|vs|Co|No|Mr|Ms|Dr|St|Jr|Sr"


def _p(pattern: str) -> str:
    """The pattern as a SQL string, its S, N and D (outside words) spelled out."""
    out, i = "", 0
    while i < len(pattern):
        c, before = pattern[i], pattern[i - 1] if i else ""
        following = pattern[i + 1 : i + 2]
        if c in "SND" and before != "\\" and not (following.isascii() and following.isalpha() and following not in "SND"):
            out += {"S": _WS, "N": _NWS, "D": _D}[c]
        else:
            out += c
        i += 1
    return "'" + out.replace("'", "''") + "'"


def _sub(x: str, pattern: str, to: str = "' '", flags: str = "g") -> str:
    return f"regexp_replace({x}, {_p(pattern)}, {to}, '{flags}')"


def _squeeze(x: str) -> str:
    return f"trim({_sub(x, 'S+')})"


def _words(x: str) -> str:
    return f"len(string_split({_squeeze(x)}, ' '))"


def _clean(x: str) -> str:
    return _squeeze(reduce(_sub, _NOISE + _NOISE, x))


def split(documents: str, keys: str, text: str) -> str:
    """Common table expressions that end in `split_claims` (keys, rn, claim_no, claim_text); `documents` is a table
    expression with the columns `keys` and `text`."""
    label = r"'^([^\t-\r :\x{85}\p{Z}]{1,20}?)(님)?" + _WS + "*:" + _WS + "*(.+)$'"
    bullet = _p(r"^(?:[-*•]|D+[.)])S+(.*)$")
    edges = r"'^[\t-\r \x{1c}-\x{1f}\x{85}\p{Z}]+|[\t-\r \x{1c}-\x{1f}\x{85}\p{Z}]+$'"
    meta = r"(?:작성일|등록일|작성자)S*:?S*N*|D{4}-D{2}-D{2}|D{1,2}:D{2}(?::D{2})?|(?:조회수|조회|추천|댓글|스크랩|신고|목록)S*:?S*D{1,3}(?:[,.]D{3})*"
    footer = "좋아요|스크랩|신고|공유|목록|이전글|다음글|추천하기"
    held = f"""regexp_replace(regexp_replace(para, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{Nd}}_])({_ABBREVIATIONS})\\.', '\\1\\2' || chr(1), 'g'), '(^|[^\\p{{L}}\\p{{M}}\\p{{Nd}}_])([SN])\\.({_WS}(?:Korea|Africa)\\b)', '\\1\\2' || chr(1) || '\\3', 'g')"""
    return f"""sd AS (SELECT {keys}, row_number() OVER () AS rn, coalesce({text}, '') AS body FROM {documents}),
sl0 AS (SELECT {keys}, rn, unnest(regexp_split_to_array(body, '\\r\\n|[\\n\\r\\v\\f\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS raw0,
  unnest(range(len(regexp_split_to_array(body, '\\r\\n|[\\n\\r\\v\\f\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')))) AS pos FROM sd),
sl1 AS MATERIALIZED (SELECT {keys}, rn, pos, regexp_replace(raw0, {edges}, '', 'g') AS raw FROM sl0),
sl2 AS MATERIALIZED (SELECT *, raw = '' AS blank,
  regexp_matches(raw, '\\p{{Nd}}') AND NOT regexp_matches(raw, '[.!?。！？]$') AND contains(raw, '  ') AND {_words("raw")} <= 6 AS tab,
  (regexp_matches(raw, '작성일|등록일|작성자') AND regexp_matches(raw, {_p('(?:조회수|조회|추천|댓글|스크랩|신고|목록)S*:?S*D')})
    AND length(regexp_replace({_sub("raw", meta, "''")}, {_p(r"[S:|/,.-]").replace(_WS, _WS[1:-1])}, '', 'g')) <= 2)
  OR (regexp_matches(raw, '{footer}') AND regexp_replace(regexp_replace(raw, '{footer}', '', 'g'), '[0-9,.\\s|/·:-]', '', 'g') = '') AS chrome,
  {_clean("raw")} AS clean FROM sl1),
sl3 AS MATERIALIZED (SELECT *, regexp_matches(clean, {label}) AND (regexp_extract(clean, {label}, 2) <> '' OR regexp_matches(regexp_extract(clean, {label}, 1), '^[A-Za-z0-9_.-]{{1,20}}$')) AS reply,
  trim(regexp_extract(clean, {label}, 3)) AS rest FROM sl2),
sl4 AS MATERIALIZED (SELECT *, reply AND length(rest) < 10 AS trivial, CASE WHEN reply THEN rest ELSE clean END AS x FROM sl3),
sl5 AS MATERIALIZED (SELECT {keys}, rn, pos, CASE WHEN blank THEN 'flush' WHEN tab THEN 'emit' WHEN chrome OR clean = '' THEN 'flush'
  WHEN trivial OR regexp_matches(x, '(?i)' || {_p(_UI_ONLY)}) THEN 'drop'
  WHEN (ends_with(x, ':') AND {_words("x")} <= 8) OR (regexp_matches(x, '[A-Za-z]') AND NOT regexp_matches(x, '\\p{{Ll}}|\\p{{Lo}}|\\p{{Lm}}|\\p{{Lt}}')
    AND NOT regexp_matches(x, '[.!?。！？]$') AND {_words("x")} <= 5) THEN 'flush'
  WHEN regexp_matches(x, {bullet}) THEN 'emit' ELSE 'text' END AS kind,
  CASE WHEN tab THEN clean WHEN regexp_matches(x, {bullet}) THEN trim(regexp_extract(x, {bullet}, 1)) ELSE x END AS payload FROM sl4),
sb0 AS (SELECT *, sum(CASE WHEN kind <> 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY rn ORDER BY pos) AS island FROM sl5 WHERE kind <> 'drop'),
sb AS MATERIALIZED (SELECT {keys}, rn, island, kind = 'text' AS is_para, min(pos) AS at0, string_agg(payload, ' ' ORDER BY pos) AS para0 FROM sb0 WHERE kind <> 'flush' GROUP BY ALL),
sp AS MATERIALIZED (SELECT {keys}, rn, at0, is_para, CASE WHEN is_para THEN {_clean("para0")} ELSE para0 END AS para FROM sb),
ss0 AS MATERIALIZED (SELECT {keys}, rn, at0, CASE WHEN is_para THEN list_transform(string_split(regexp_replace({held}, '([.!?。！？]){_WS}+', '\\1' || chr(2), 'g'), chr(2)),
  lambda p: trim(replace(p, chr(1), '.'), chr(9) || ' ')) ELSE list_value(para) END AS parts, is_para FROM sp),
ss1 AS (SELECT {keys}, rn, at0, unnest(parts) AS p, unnest(range(len(parts))) AS n, is_para FROM ss0),
ss2 AS (SELECT {keys}, rn, at0, n, CASE WHEN NOT is_para THEN p WHEN regexp_matches(p, '^-[\\p{{Nd}}$€£¥₩]') THEN '-' || trim(substr(p, 2), chr(9) || ' -*')
  ELSE trim(p, chr(9) || ' -*') END AS p FROM ss1),
ss3 AS (SELECT {keys}, rn, at0, n, {_squeeze("p")} AS claim_text FROM ss2 WHERE length(p) >= 8),
ss4 AS (SELECT *, row_number() OVER (PARTITION BY rn, lower(claim_text) ORDER BY at0, n) AS nth FROM ss3 WHERE claim_text <> ''),
split_claims AS MATERIALIZED (SELECT {keys}, rn, row_number() OVER (PARTITION BY rn ORDER BY at0, n) AS claim_no, claim_text FROM ss4 WHERE nth = 1)"""
