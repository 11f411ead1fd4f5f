"""What the SQL of the ledger queries holds the engine to: words, patterns and sentences, stated apart from the
engine's own lists, so that a change of those shows, and joined to conditions by the code below.  Patterns are in the dialect
of an engine without look-around."""

from __future__ import annotations

# Phrases between neighbours that are no letters or digits of ASCII, by what they tell
CAUSES = [
    "because", "caused", "triggered", "led to", "as a result", "therefore", "due to", "the reason", "the real reason", "true cause", "true reason",
    "explains the move", "immediately reacted",
]
MARKETS = [
    "stock", "stocks", "shares", "index", "exchange", "turnover", "volume", "foreign investors", "institutional investors", "net selling", "net buying",
    "selloff", "rally", "yield", "currency", "fund managers", "funds", "short interest", "yields", "equities", "bonds", "treasuries", "futures",
    "코스피", "코스닥", "증시", "주가", "주식", "지수", "환율", "금리", "채권", "선물", "외국인", "기관", "개미", "개인 투자자", "거래소", "상장", "순매수", "순매도",
    "공매도", "매도세", "매수세", "매물", "거래량", "시가총액", "급락", "급등", "폭락", "폭등", "랠리", "하락장", "상승장", "펀드", "종목", "반도체", "업종", "섹터",
    "투자심리", "투자 심리",
]
MOTIVES = ["investors sold", "funds sold", "overseas desks", "global desks", "policy headline", "translated policy", "market commentary"]
MANIPULATIONS = [
    "everyone knows this proves manipulation", "allegedly shows", "coordinating exits", "market drop was planned", "the market was planned", "media is hiding",
    "media hiding", "hiding the evidence", "cover up", "this proves manipulation", "proves manipulation", "obvious manipulation", "insiders coordinated",
    "insiders coordinated to force liquidations", "no primary records", "no primary records were posted",
]
LOADED = [
    "shock", "bombshell", "disaster", "panic", "collapse", "crash", "treason", "traitor", "rigged", "manipulated", "propaganda", "destroyed confidence",
    "폭락", "패닉", "충격", "붕괴", "대참사", "폭탄",
]
FRAMES = ["far right", "far left", "policy disaster", "political risk"]
CERTAIN = [
    "true reason", "real reason", "confirmed truth", "everyone knows", "no doubt", "guaranteed", "certain", "inevitable", "this proves", "obvious",
    "무조건", "확실하다", "확실합니다", "분명하다", "누가 봐도", "틀림없", "100프로", "100퍼",
]
ACTIONS = ["buy", "sell", "entry", "exit", "stop loss", "take profit", "position size", "position sizing", "allocate", "allocating", "allocation", "trade this"]
BUYING = ["buys", "buying", "bought"]
URGENT = ["act now", "before it is too late", "before it's too late", "dont miss out", "don't miss out", "get in before", "last chance", "load up"]
PRIVATE = [
    "private chat", "private group", "members-only", "member-only", "closed community", "deleted post", "deleted comments", "inaccessible", "paywalled",
    "internal desk", "proprietary", "단톡방", "카톡방", "텔레그램방", "텔레그램 방", "리딩방", "유료방", "삭제된 글", "삭제된 게시글", "삭제된 댓글", "지워진 글",
    "비공개 카페", "회원 전용", "유료 기사", "내부 메신저",
]
RECENT = ["today", "yesterday", "current", "now", "recent", "latest"]
TARGETS = ["target price", "price target", "upside target", "downside target"]
TRUE_CAUSES = ["true reason", "real reason", "true cause", "the market moved because", "caused the selloff"]

# Words anywhere
NO_CAUSES = ["did not state a cause", "did not provide a cause", "without stating a cause", "no cause was stated"]
CAUSES_KO = ["때문에", "때문이", "탓에", "탓이다", "덕분에", "힘입어", "영향으로", "여파로", "원인이다", "원인은", "이유는", "이유다"]
FLOWS = [
    "foreign investors", "institutional investors", "net selling", "net buying", "fund managers", "flows", "sold heavily", "selling", "investors sold",
    "coordinating exits", "외국인 순매도", "외국인 순매수", "기관 순매도", "기관 순매수", "수급",
]
MANIPULATIONS_KO = ["작전주", "주가조작", "시세조종", "개미털기", "은폐"]
COLLUSION_CUES = ["개미", "물량", "주가", "종목", "매집", "시세", "주식"]
COVERUP_CUES = ["정부", "당국", "발표", "통계청", "금융위", "감독원", "한국은행", "수치"]
WEAK, WEAK_CUES = ["작전", "세력", "조작", "내부자"], ["무조건", "확실하다", "확실합니다", "분명하다", "누가 봐도", "틀림없", "100프로", "100퍼"]
CONTEXT = [
    "환율", "주식", "주가", "증시", "코스피", "코스닥", "지수", "종목", "매매", "수익", "수익률", "투자", "펀드", "선물", "채권", "금리", "외국인", "기관", "개미", "시장",
    "증권", "넥장", "익절", "손절", "매수", "매도", "공매도", "순매수", "순매도",
]
PRIVATE_MORE = ["deleted screenshot", "deleted staff message", "staff message", "internal chat", "inaccessible comments", "locked group", "member-only forum"]
RECENT_KO = ["오늘", "어제", "방금", "최근", "현재", "오늘자"]
SIZES = ["position size", "position sizing", "allocate", "allocating", "allocation"]
NINE_CUES = ["오르", "먹", "수익", "익절", "승률", "번다", "자리", "종목"]
ODDS_WORDS = ["trade probability", "probability of success"]
TRUE_CAUSES_KO = ["진짜 이유", "진짜 원인", "실제 이유", "실제 원인"]
SELF_SERVING = [
    "our internal", "our own investigation", "our investigation", "internal investigation", "internal probe", "we proved", "we have proof", "proved that", "we confirmed that",
]
SELF_SERVING_KO = ["우리 내부", "내부 조사", "자체 조사", "내부 조사 결과", "입증했다"]
WIDE_KO = ["업계", "전반", "시장 전체", "종목 전체", "전 종목", "전체 종목", "산업 전반"]

# patterns
NO_CAUSE_PATTERNS = [r"원인을?\s*밝히지\s*않", r"이유를?\s*밝히지\s*않", r"원인(?:은|이|을)?.{0,10}밝혀지지\s*않", r"이유(?:는|가|를)?.{0,10}밝혀지지\s*않"]
CAUSE_PATTERNS = [r"(?:으로|로)\s*인해", r"(?:으로|로)\s*인한"]
PHYSICAL_MARKET = r"(?:farmers?'?|flea|fish|street|night|wet|meat|flower|super|open[\s-]?air)\s*market"
SESSION = r"(?:^|[^가-힣])장\s*(?:초반|중반|후반|막판|초|중|후|시작|마감)"
MARKET_SLANG = [r"물렸(?:다|는데|음|어|네|고)", r"존버"]
HIDING = [
    r"\b(?:everyone knows|we all know)\b.*\b(?:hiding|covering up|concealing)\b",
    r"\b(?:hiding|covering up|concealing)\b.*\b(?:real\s+)?(?:crash|risk|truth|evidence)\b",
]
MANIPULATION_PATTERNS = [r"개미.{0,3}털", r"짜고\s*치", r"미리\s*알고\s*팔", r"언론이.{0,20}숨기", r"증거를\s*숨기"]
INSIDERS = r"insiders?\s+(?:\w+\s+){0,3}(?:dumped|sold|unloaded)\s+(?:\w+\s+){0,4}before"
COLLUSION = r"세력.{0,10}짜고"
COVERUP = r"축소\s*(?:해서|하여|해)?\s*발표|숫자(?:를|가)?\s*축소|통계(?:를|가)?\s*축소|수치(?:를|가)?\s*축소"
RIGGED = [r"\b(?:manipulation|manipulated|manipulating|rigged|rigging)\b", r"\b(?:this proves|proves|obvious|everyone knows)\b"]
LONG_SHORT = [
    r"go(?:ing)?\s+long", r"go(?:ing)?\s+short", r"short\s+the", r"long\s+the", r"(?:long|short)\s+position", r"(?:long|short)\s+(?:the\s+)?(?:stock|shares|index)",
    r"shorting",
]
EXPOSURE = (
    r"(?:^|[^a-z])(?:increas\w*|rais\w*|add(?:s|ed|ing)?\s+to|boost\w*|upp?ed|up)\s+(?:(?:your|their|his|her|my|our|the|its)\s+)?"
    r"(?:market\s+|equity\s+|portfolio\s+)?exposure\s+to\s+(?:this|that|the)\s+(?:name|stock|stocks|share|shares|position|sector|trade|company|ticker)"
)
TRADES = [rf"(?:^|[^순공\s]|(?:^|[^순공])\s)매\s*{w}\s*(?:하|해|는|를|가|추천|의견)" for w in ("수", "도")]
ADVICE = [
    r"풀매수", r"풀매도", r"몰빵", r"손절(?:하|해|은|을|각)?", r"익절(?:하|해|은|을|각)?", r"사세요", r"파세요", r"사라(?:[^가-힣]|$)", r"팔아라",
    r"(?:^|[^A-Za-z])(?:long|short)\s*잡", r"비중\s*(?:확대|축소|조절|줄|늘)", r"주식\s*안\s*합니다", r"주식안합니다", r"사고\s*팔고",
]
ADVICE_IN_CONTEXT = [
    r"조심(?:들)?(?:하|해|하세요|해야)", r"다\s*던졌(?:다|어요|습니다)?", r"던졌(?:다|어요|습니다)?", r"들어가라", r"들어가세요", r"지금\s*들어가", r"올라타", r"강력\s*추천",
    r"(?:매수|매도|종목)\s*추천", r"추천(?:합니다|해요|해라|하라|드립니다|드려요|한다|하는|했)", r"권고(?:한다|합니다|했다|하라|하며|하고|하는|할|를|을)?",
]
EUPHEMISMS = [
    (r"담[아을]야?\s*할?\s*자리", r"빚내|저점|분할|매수|물타기|풀매수"), (r"타이밍", r"지금이|바로\s*그|바로\s*지금", r"놓치"),
    (r"물타기", r"들어갑니|들어갈|가시죠|가즈아|같이\s*가"),
]
RATINGS = [
    r"(?:overweight|underweight|outperform|underperform)\s+(?:rating|view|call|stance)",
    r"(?:maintain|maintains|maintained|upgrade|upgrades|downgrade|downgrades|initiate|initiates)\s+(?:an?\s+)?(?:overweight|underweight|outperform|underperform)",
    r"(?:strong\s+buy|buy\s+rating|sell\s+rating|hold\s+rating)",
]
HYPE = [r"\bbetter\s+(?:hop|jump|get)\s+(?:on|in)\b", r"\bhop\s+on\s+the\s+ride\b", r"\bgo(?:es|ing)?\s+to\s+the\s+moon\b"]
TARGET_PATTERNS = r"목\s*표\s*주\s*가|目標價|목\s*표\s*가(?:[^.!?\n]{0,15}(?:만원|천원|원|억|상향|하향|제시|유지|도달|달성|돌파|\d))"
TICKER = r"\b[A-Z]{1,6}\b\s+(?i:(?:is\s+)?(?:going\s+to|goes\s+to|will\s+(?:go\s+to|reach|hit)|to))\s+\$?\d{2,6}(?:,\d{3})?(?:\.\d+)?\b"
FLOOR = r"(?i)\b(?:while\s+it\s+is\s+)?still\s+under\s+\$?\d{2,6}(?:,\d{3})?(?:\.\d+)?\b"
WEIGHT = r"비중\s*(?:을|를|이|은|는)?\s*(?:크게\s*|소폭\s*|대폭\s*)?(?:[영공일이삼사오육륙칠팔구십백천만억조\d]+\s*(?:프로|퍼센트|퍼|%)?\s*)?(?:확대|축소|조절)"
PRODUCTS = r"(?:제품군|매출액|제품|매출|사업|부문|원가)\s{0,20}"
PORTFOLIO = r"\d{1,3}\s*(?:%|percent)\s+of\s+(?:a\s+|the\s+|your\s+|my\s+)?portfolio"
ODDS_KO = [r"확률\s*\d+", r"\d+\s*(?:%|프로|퍼센트)\s*확률", r"승률\s*\d+"]
NINE_IN_TEN = r"열\s*에\s*아홉"
ODDS = [
    r"(?:nearly|almost)\s+always\s+(?:\w+\s+){0,4}profit", r"\b\d{1,3}\s*%\s*(?:chance|probability|odds)\b", r"\b\d{1,3}\s*percent\s*(?:chance|probability|odds)\b",
    r"\b\d{1,3}\s*percent\s*chance\s*of\s*(?:a\s*)?profitable trade\b",
]
RETURNS_KO = [r"수익률\s*\d", r"\d+\s*(?:%|프로|퍼센트)?\s*수익률", r"\d+배\s*(?:수익|상승)", r"목표\s*수익률\s*\d"]
RETURNS = [
    r"\b\d+(?:\.\d+)?x\s+(?:return|gain|profit|upside)\b",
    r"\b(?:could|may|might|should|expected to|projected to)\s+(?:produce|return|yield|generate|deliver)\b.*\b(?:return|gain|profit|upside)\b",
    r"\b(?:return|gain|profit|upside)\s+within\s+\d+\s+(?:day|days|week|weeks|month|months|year|years)\b",
]
FORWARD = r"\b(?:will|expected to|is expected|are expected|projected to|going to|likely to|forecasts?|outlook)\b"
FORWARD_KO = r"것(?:이다|으로|이라|입니다|이라고)|전망|될\s*것|개선될|호전될|악화될"
WIDE = r"\b(?:sector-?wide|market-?wide|industry-?wide|entire (?:market|sector|industry)|across the (?:market|sector|industry|board))\b"


def _has(on: str, pattern: str) -> str:
    return f"regexp_matches({on}, '" + pattern.replace("'", "''") + "')"


def _some(on: str, *parts: str) -> str:
    """Any of the words or patterns, anywhere."""
    return _has(on, "|".join(f"(?:{p})" for p in parts))


def _apart(on: str, *parts: str) -> str:
    """Any of them between neighbours that are no letters or digits."""
    return _has(on, f"(?:^|[^a-z0-9])(?:{'|'.join(parts)})(?:[^a-z0-9]|$)")


def _any(*conditions: str) -> str:
    return "(" + " OR ".join(conditions) + ")"


def _all(*conditions: str) -> str:
    return "(" + " AND ".join(conditions) + ")"


def _market(text: str, low: str) -> str:
    place = _all(_apart(low, "market"), f"NOT {_has(low, PHYSICAL_MARKET)}")
    return _any(_apart(low, *MARKETS), place, _has(text, SESSION), _some(text, *MARKET_SLANG))


def _action(text: str, low: str) -> str:
    """Over the text without disclaimers."""
    context = _any(_some(text, *CONTEXT), _market(text, low))
    hidden = [_all(*[_has(text, p) for p in ps]) for ps in EUPHEMISMS]
    return _any(
        _apart(low, *ACTIONS), _apart(low, *LONG_SHORT), _has(low, EXPOSURE), _apart(low, *BUYING), _some(text, *TRADES), _some(text, *ADVICE),
        _all(context, _some(text, *ADVICE_IN_CONTEXT)), *hidden, _apart(low, *URGENT), _apart(low, *RATINGS),
    )


_T, _L = "claim_text", "low"
#: Each detector over claim_text and low (lower case), action over adv and advlow, which lack disclaimers.
DETECTED = {
    "d_causal": _all(f"NOT {_some(_L, *NO_CAUSES)}", f"NOT {_some(_T, *NO_CAUSE_PATTERNS)}", _any(_apart(_L, *CAUSES), _some(_T, *CAUSES_KO), _some(_T, *CAUSE_PATTERNS))),
    "d_market": _market(_T, _L),
    "d_flow": _some(_L, *FLOWS),
    "d_motive": _apart(_L, *MOTIVES),
    "d_manipulation": _any(
        _apart(_L, *MANIPULATIONS), _some(_L, *HIDING), _some(_T, *MANIPULATIONS_KO), _some(_T, *MANIPULATION_PATTERNS), _has(_L, INSIDERS),
        _all(_has(_T, COLLUSION), _some(_T, *COLLUSION_CUES)), _all(_has(_T, COVERUP), _some(_T, *COVERUP_CUES)), _all(_some(_T, *WEAK), _some(_T, *WEAK_CUES)),
        _all(*[_has(_L, p) for p in RIGGED]),
    ),
    "d_framing": _apart(_L, *LOADED, *FRAMES),
    "d_loaded": _apart(_L, *LOADED),
    "d_certainty": _apart(_L, *CERTAIN),
    "d_action": _action("adv", "advlow"),
    "d_private": _any(_apart(_L, *PRIVATE), _all(_has(_T, "삭제된"), _has(_T, "캡처")), _all(_some(_T, "지워진", "삭제된"), _has(_T, "오픈채팅")), _some(_L, *PRIVATE_MORE)),
    "d_recent": _any(_apart(_L, *RECENT), _some(_T, *RECENT_KO)),
    "d_hype": _has(_T, "(?i)(?:" + "|".join(HYPE) + ")"),
    "d_target": _any(_apart(_L, *TARGETS), _has(_T, TARGET_PATTERNS), _has(_T, TICKER), _has(_T, FLOOR)),
    # A share of products is no share of a portfolio; such are taken out first.
    "d_sizing": _any(_some(_L, *SIZES), _has(f"regexp_replace({_T}, '{PRODUCTS}{WEIGHT}', ' ', 'g')", WEIGHT), _apart(_L, PORTFOLIO)),
    "d_probability": _any(
        _some(_T, *ODDS_KO), _all(_has(_T, NINE_IN_TEN), _some(_T, *NINE_CUES)), _some(_L, *ODDS), _some(_L, *ODDS_WORDS), _some(_T, *RETURNS_KO), _some(_L, *RETURNS),
    ),
    "d_true_cause": _any(_apart(_L, *TRUE_CAUSES), _some(_T, *TRUE_CAUSES_KO)),
    "d_number": _has(_T, r"\d"),
    "d_self_serving": _any(_some(_L, *SELF_SERVING), _some(_T, *SELF_SERVING_KO)),
    "d_forward_wide": _all(_any(_has(_L, FORWARD), _has(_T, FORWARD_KO)), _any(_some(_T, *WIDE_KO), _has(_L, WIDE))),
}

# Advice disclaimers
DISCLAIMERS = [
    'not\\s+a\\s+recommendation\\s+to\\s+buy\\s+or\\s+sell',
    'is\\s+not\\s+(?:investment|financial)\\s+advice',
    'not\\s+intended\\s+as\\s+(?:investment\\s+)?advice',
    'for\\s+informational\\s+purposes\\s+only',
    '투자\\s*권유가?\\s*아(?:닙니다|니며|님)',
    '정보\\s*제공\\s*목적',
]
# Types of sources
SOURCE_TYPES = [
    'official',
    'company',
    'news',
    'analyst',
    'community',
    'social',
    'user_note',
    'unknown',
]
# Flags by tier
CRITICAL_FLAGS = [
    'investment_advice_language',
    'target_price_language',
    'position_sizing_language',
    'trade_probability_language',
]
# Flags by tier
HIGH_FLAGS = [
    'market_causality_claim',
    'true_cause_market_claim',
    'unobservable_evidence',
    'private_or_inaccessible_source',
]
# Flags by tier
MEDIUM_FLAGS = [
    'unsupported_causality',
    'framing_risk',
    'loaded_language',
    'strong_certainty_language',
    'needs_official_confirmation',
]
# Types of the high tier
HIGH_TYPES = [
    'unverified_causality',
    'unobservable',
    'excluded',
    'rumor',
]
# Buckets of a report, reasons and questions of review items
BUCKETS = {
    'confirmed_fact': 'confirmed_facts',
    'official_reported_status': 'official_reported_status',
    'market_observation': 'market_observations',
    'reported_claim': 'reported_claims',
    'interpretation': 'interpretations',
    'opinion_or_frame': 'opinion_frame_risks',
    'unverified_causality': 'unverified_causality',
    'rumor': 'rumors',
    'needs_official_source': 'needs_official_source',
    'unobservable': 'unobservable',
    'excluded': 'excluded',
    'question_to_verify': 'questions_to_verify',
}
# reasons
REASONS = [
    ('true_cause_market_claim', 'unsafe true-cause market claim'),
    ('unobservable_evidence', 'unobservable evidence'),
    ('market_causality_claim', 'unsupported market causality'),
    ('unsupported_causality', 'unsupported causality'),
    ('needs_official_confirmation', 'needs official confirmation'),
]
# questions
QUESTIONS = [
    ('unobservable_evidence', 'What observable source can replace or corroborate the inaccessible material?'),
    ('market_causality_claim', 'What official or independent evidence supports this market-causality claim?'),
    ('needs_official_confirmation', 'Which official or primary source can confirm the factual part of this claim?'),
]
DISALLOWED = 'finance advice or prediction language'
EXCLUDED_QUESTION = 'This finance claim is blocked by policy and remains excluded. If factual context is needed, capture a separate factual claim from a primary source.'
LAST_QUESTION = 'What source or context should be checked before trusting this claim?'
