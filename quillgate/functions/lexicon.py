"""Fixed values of the detectors: words, phrases and patterns that results depend on.

Phrases are matched on lower-cased text between non-alphanumeric ASCII neighbours, substrings anywhere.
Patterns are written once, in a form that Java's engine takes with Unicode classes switched on.
"""

# causality
CAUSAL_PHRASES = [
    "because", "caused", "triggered", "led to", "as a result", "therefore", "due to", "the reason", "the real reason",
    "true cause", "true reason", "explains the move", "immediately reacted",
]
NO_CAUSE = ["did not state a cause", "did not provide a cause", "without stating a cause", "no cause was stated"]
CAUSAL_KO = ["때문에", "때문이", "탓에", "탓이다", "덕분에", "힘입어", "영향으로", "여파로", "원인이다", "원인은", "이유는", "이유다"]
CAUSAL_KO_PATTERNS = [r"(?:으로|로)\s*인해", r"(?:으로|로)\s*인한"]
NO_CAUSE_KO_PATTERNS = [
    r"원인을?\s*밝히지\s*않", r"이유를?\s*밝히지\s*않", r"원인(?:은|이|을)?.{0,10}밝혀지지\s*않", r"이유(?:는|가|를)?.{0,10}밝혀지지\s*않",
]

# Certainty, loaded and framing language
CERTAINTY = [
    "true reason", "real reason", "confirmed truth", "everyone knows", "no doubt", "guaranteed", "certain", "inevitable",
    "this proves", "obvious", "무조건", "확실하다", "확실합니다", "분명하다", "누가 봐도", "틀림없", "100프로", "100퍼",
]
LOADED = [
    "shock", "bombshell", "disaster", "panic", "collapse", "crash", "treason", "traitor", "rigged", "manipulated", "propaganda",
    "destroyed confidence", "폭락", "패닉", "충격", "붕괴", "대참사", "폭탄",
]
FRAME_MORE = ["far right", "far left", "policy disaster", "political risk"]

# Private or unobservable evidence
PRIVATE = [
    "private chat", "private group", "members-only", "member-only", "closed community", "deleted post", "deleted comments",
    "inaccessible", "paywalled", "internal desk", "proprietary", "단톡방", "카톡방", "텔레그램방", "텔레그램 방", "리딩방", "유료방",
    "삭제된 글", "삭제된 게시글", "삭제된 댓글", "지워진 글", "비공개 카페", "회원 전용", "유료 기사", "내부 메신저",
]
PRIVATE_MORE = [
    "deleted screenshot", "deleted staff message", "staff message", "internal chat", "inaccessible comments", "locked group",
    "member-only forum",
]

# Market, flow and motive
MARKET = [
    "stock", "stocks", "shares", "index", "exchange", "turnover", "volume", "foreign investors", "institutional investors",
    "net selling", "net buying", "selloff", "rally", "yield", "currency", "fund managers", "funds", "short interest", "yields",
    "equities", "bonds", "treasuries", "futures", "코스피", "코스닥", "증시", "주가", "주식", "지수", "환율", "금리", "채권", "선물", "외국인",
    "기관", "개미", "개인 투자자", "거래소", "상장", "순매수", "순매도", "공매도", "매도세", "매수세", "매물", "거래량", "시가총액", "급락", "급등",
    "폭락", "폭등", "랠리", "하락장", "상승장", "펀드", "종목", "반도체", "업종", "섹터", "투자심리", "투자 심리",
]
PHYSICAL_MARKET = r"(?:farmers?'?|flea|fish|street|night|wet|meat|flower|super|open[\s-]?air)\s*market"
MARKET_SESSION_KO = r"(?<![가-힣])장\s*(?:초반|중반|후반|막판|초|중|후|시작|마감)"
MARKET_SLANG_KO = [r"물렸(?:다|는데|음|어|네|고)", r"존버"]
FLOW = [
    "foreign investors", "institutional investors", "net selling", "net buying", "fund managers", "flows", "sold heavily", "selling",
    "investors sold", "coordinating exits", "외국인 순매도", "외국인 순매수", "기관 순매도", "기관 순매수", "수급",
]
MOTIVE = ["investors sold", "funds sold", "overseas desks", "global desks", "policy headline", "translated policy", "market commentary"]

# manipulation
MANIPULATION = [
    "everyone knows this proves manipulation", "allegedly shows", "coordinating exits", "market drop was planned",
    "the market was planned", "media is hiding", "media hiding", "hiding the evidence", "cover up", "this proves manipulation",
    "proves manipulation", "obvious manipulation", "insiders coordinated", "insiders coordinated to force liquidations",
    "no primary records", "no primary records were posted",
]
HIDING = [
    r"\b(?:everyone knows|we all know)\b.*\b(?:hiding|covering up|concealing)\b",
    r"\b(?:hiding|covering up|concealing)\b.*\b(?:real\s+)?(?:crash|risk|truth|evidence)\b",
]
MANIPULATION_KO = ["작전주", "주가조작", "시세조종", "개미털기", "은폐"]
MANIPULATION_KO_PATTERNS = [r"개미.{0,3}털", r"짜고\s*치", r"미리\s*알고\s*팔", r"언론이.{0,20}숨기", r"증거를\s*숨기"]
INSIDERS = r"insiders?\s+(?:\w+\s+){0,3}(?:dumped|sold|unloaded)\s+(?:\w+\s+){0,4}before"
COLLUSION, COLLUSION_CUES = r"세력.{0,10}짜고", ["개미", "물량", "주가", "종목", "매집", "시세", "주식"]
COVERUP = r"축소\s*(?:해서|하여|해)?\s*발표|숫자(?:를|가)?\s*축소|통계(?:를|가)?\s*축소|수치(?:를|가)?\s*축소"
COVERUP_CUES = ["정부", "당국", "발표", "통계청", "금융위", "감독원", "한국은행", "수치"]
WEAK_KO, WEAK_CUES = ["작전", "세력", "조작", "내부자"], ["무조건", "확실하다", "확실합니다", "분명하다", "누가 봐도", "틀림없", "100프로", "100퍼"]
RIGGED = [r"\b(?:manipulation|manipulated|manipulating|rigged|rigging)\b", r"\b(?:this proves|proves|obvious|everyone knows)\b"]

# Advice, action and urgency
DISCLAIMERS = [
    r"not\s+a\s+recommendation\s+to\s+buy\s+or\s+sell", r"is\s+not\s+(?:investment|financial)\s+advice",
    r"not\s+intended\s+as\s+(?:investment\s+)?advice", r"for\s+informational\s+purposes\s+only", r"투자\s*권유가?\s*아(?:닙니다|니며|님)",
    r"정보\s*제공\s*목적",
]
ADVICE = [
    "buy", "sell", "entry", "exit", "stop loss", "take profit", "position size", "position sizing", "allocate", "allocating",
    "allocation", "trade this",
]
LONG_SHORT = [
    r"go(?:ing)?\s+long", r"go(?:ing)?\s+short", r"short\s+the", r"long\s+the", r"(?:long|short)\s+position",
    r"(?:long|short)\s+(?:the\s+)?(?:stock|shares|index)", r"shorting",
]
EXPOSURE = (
    r"(?:increas\w*|rais\w*|add(?:s|ed|ing)?\s+to|boost\w*|upp?ed|up)\s+(?:(?:your|their|his|her|my|our|the|its)\s+)?"
    r"(?:market\s+|equity\s+|portfolio\s+)?exposure\s+to\s+(?:this|that|the)\s+"
    r"(?:name|stock|stocks|share|shares|position|sector|trade|company|ticker)"
)
BUYING = ["buys", "buying", "bought"]
ADVICE_KO_TRADE = r"(?:하|해|는|를|가|추천|의견)"
ADVICE_KO = [
    "풀매수", "풀매도", "몰빵", r"손절(?:하|해|은|을|각)?", r"익절(?:하|해|은|을|각)?", "사세요", "파세요", r"사라(?![가-힣])", "팔아라",
    r"(?<![A-Za-z])long\s*잡", r"(?<![A-Za-z])short\s*잡", r"비중\s*(?:확대|축소|조절|줄|늘)", r"주식\s*안\s*합니다", "주식안합니다", r"사고\s*팔고",
]
ADVICE_KO_CONTEXT = [
    r"조심(?:들)?(?:하|해|하세요|해야)", r"다\s*던졌(?:다|어요|습니다)?", r"던졌(?:다|어요|습니다)?", "들어가라", "들어가세요", r"지금\s*들어가", "올라타",
    r"강력\s*추천", r"(?:매수|매도|종목)\s*추천", r"추천(?:합니다|해요|해라|하라|드립니다|드려요|한다|하는|했)",
    r"권고(?:한다|합니다|했다|하라|하며|하고|하는|할|를|을)?",
]
CONTEXT_KO = [
    "환율", "주식", "주가", "증시", "코스피", "코스닥", "지수", "종목", "매매", "수익", "수익률", "투자", "펀드", "선물", "채권", "금리", "외국인", "기관",
    "개미", "시장", "증권", "넥장", "익절", "손절", "매수", "매도", "공매도", "순매수", "순매도",
]
EUPHEMISMS_KO = [
    (r"담[아을]야?\s*할?\s*자리", r"빚내|저점|분할|매수|물타기|풀매수"),
    (r"타이밍", r"지금이|바로\s*그|바로\s*지금", r"놓치"),
    (r"물타기", r"들어갑니|들어갈|가시죠|가즈아|같이\s*가"),
]
URGENCY = [
    "act now", "before it is too late", "before it's too late", "dont miss out", "don't miss out", "get in before", "last chance",
    "load up",
]
RATINGS = [
    r"(?:overweight|underweight|outperform|underperform)\s+(?:rating|view|call|stance)",
    r"(?:maintain|maintains|maintained|upgrade|upgrades|downgrade|downgrades|initiate|initiates)\s+(?:an?\s+)?(?:overweight|underweight|outperform|underperform)",
    r"(?:strong\s+buy|buy\s+rating|sell\s+rating|hold\s+rating)",
]

# Price targets, sizing, probability, returns, hype
TARGET = ["target price", "price target", "upside target", "downside target"]
TARGET_KO = r"목\s*표\s*주\s*가|目標價|목\s*표\s*가(?=[^.!?\n]{0,15}(?:만원|천원|원|억|상향|하향|제시|유지|도달|달성|돌파|\d))"
SIZING = ["position size", "position sizing", "allocate", "allocating", "allocation"]
SIZING_KO = r"비중\s*(?:을|를|이|은|는)?\s*(?:크게\s*|소폭\s*|대폭\s*)?(?:[영공일이삼사오육륙칠팔구십백천만억조\d]+\s*(?:프로|퍼센트|퍼|%)?\s*)?"
SIZING_ENDS, SIZING_MASK_ENDS = "(?:확대|축소|조절)", "(?:확대|축소|조절|줄|늘)"
PRODUCT_MIX = "제품군|매출액|제품|매출|사업|부문|원가"
PORTFOLIO = r"\d{1,3}\s*(?:%|percent)\s+of\s+(?:a\s+|the\s+|your\s+|my\s+)?portfolio"
ODDS_KO = [r"확률\s*\d+", r"\d+\s*(?:%|프로|퍼센트)\s*확률", r"승률\s*\d+"]
NINE_IN_TEN, NINE_CUES = r"열\s*에\s*아홉", ["오르", "먹", "수익", "익절", "승률", "번다", "자리", "종목"]
ODDS = [
    r"(?:nearly|almost)\s+always\s+(?:\w+\s+){0,4}profit", r"\b\d{1,3}\s*%\s*(?:chance|probability|odds)\b",
    r"\b\d{1,3}\s*percent\s*(?:chance|probability|odds)\b", r"\b\d{1,3}\s*percent\s*chance\s*of\s*(?:a\s*)?profitable trade\b",
]
ODDS_PHRASES = ["trade probability", "probability of success"]
RETURNS_KO = [r"수익률\s*\d", r"\d+\s*(?:%|프로|퍼센트)?\s*수익률", r"\d+배\s*(?:수익|상승)", r"목표\s*수익률\s*\d"]
RETURNS = [
    r"\b\d+(?:\.\d+)?x\s+(?:return|gain|profit|upside)\b",
    r"\b(?:could|may|might|should|expected to|projected to)\s+(?:produce|return|yield|generate|deliver)\b.*\b(?:return|gain|profit|upside)\b",
    r"\b(?:return|gain|profit|upside)\s+within\s+\d+\s+(?:day|days|week|weeks|month|months|year|years)\b",
]
#: The ticker is held to capitals; see README on the quirk that this mends.
PRICE_TICKER = r"\b[A-Z]{1,6}\b\s+(?i:(?:is\s+)?(?:going\s+to|goes\s+to|will\s+(?:go\s+to|reach|hit)|to))\s+\$?\d{2,6}(?:,\d{3})?(?:\.\d+)?\b"
PRICE_FLOOR = r"\b(?:while\s+it\s+is\s+)?still\s+under\s+\$?\d{2,6}(?:,\d{3})?(?:\.\d+)?\b"
HYPE = [r"\bbetter\s+(?:hop|jump|get)\s+(?:on|in)\b", r"\bhop\s+on\s+the\s+ride\b", r"\bgo(?:es|ing)?\s+to\s+the\s+moon\b"]
TRUE_CAUSE = ["true reason", "real reason", "true cause", "the market moved because", "caused the selloff"]
TRUE_CAUSE_KO = ["진짜 이유", "진짜 원인", "실제 이유", "실제 원인"]
RECENT, RECENT_KO = ["today", "yesterday", "current", "now", "recent", "latest"], ["오늘", "어제", "방금", "최근", "현재", "오늘자"]

# Guards of company sources
SELF_SERVING = [
    "our internal", "our own investigation", "our investigation", "internal investigation", "internal probe", "we proved",
    "we have proof", "proved that", "we confirmed that",
]
SELF_SERVING_KO = ["우리 내부", "내부 조사", "자체 조사", "내부 조사 결과", "입증했다"]
FORWARD = r"\b(?:will|expected to|is expected|are expected|projected to|going to|likely to|forecasts?|outlook)\b"
FORWARD_KO = r"것(?:이다|으로|이라|입니다|이라고)|전망|될\s*것|개선될|호전될|악화될"
BROAD = r"\b(?:sector-?wide|market-?wide|industry-?wide|entire (?:market|sector|industry)|across the (?:market|sector|industry|board))\b"
BROAD_KO = ["업계", "전반", "시장 전체", "종목 전체", "전 종목", "전체 종목", "산업 전반"]

# Letters that look Latin, and what they fold to
LOOKALIKES = "аеорсухкіѕјтАЕОРСУХКІЅТВНМοαερχκιντΟΑΕΡΧΚΙΤΒΗΜΝ"
LOOK_LIKE = "aeopcyxkisjtAEOPCYXKISTBHMoaepxkivtOAEPXKITBHMN"

# Enumerations of the ledger
SOURCE_TYPES = ["official", "company", "news", "analyst", "community", "social", "user_note", "unknown"]
CLAIM_TYPES = [
    "confirmed_fact", "official_reported_status", "market_observation", "reported_claim", "interpretation", "opinion_or_frame",
    "unverified_causality", "rumor", "needs_official_source", "unobservable", "excluded", "question_to_verify",
]
VERIFICATION_STATUSES = ["confirmed", "reported", "likely", "unverified", "disputed", "framing_risk", "unobservable", "blocked"]
OUTPUT_LEVELS = [
    "report_fact_bucket", "report_observation_bucket", "reported_claim_bucket", "interpretation_bucket", "risk_bucket", "review_only",
    "excluded",
]
RISK_TIERS = ["low", "medium", "high", "critical"]
CRITICAL_FLAGS = ["investment_advice_language", "target_price_language", "position_sizing_language", "trade_probability_language"]
HIGH_FLAGS = ["market_causality_claim", "true_cause_market_claim", "unobservable_evidence", "private_or_inaccessible_source"]
MEDIUM_FLAGS = ["unsupported_causality", "framing_risk", "loaded_language", "strong_certainty_language", "needs_official_confirmation"]
HIGH_TYPES = ["unverified_causality", "unobservable", "excluded", "rumor"]
