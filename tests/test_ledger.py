"""Micro-cases of the rules, the splitter, masks and analytics."""

import pytest

from quillgate.functions.detectors import DETECTORS, detect
from quillgate.functions.rules import triggers
from quillgate.operators import analytics, claims, classify, masking
from quillgate.sources import intake

CASES = [
    ("The true reason for the delay was donor pressure.", "news", "general", "unverified_causality", "medium|high"),
    ("The program is scheduled to start on Monday.", "news", "general", "reported_claim", "low"),
    ("A deleted post in a private chat mentioned it.", "news", "general", "unobservable", "high"),
    ("The index closed at 2650 points.", "official", "finance", "market_observation", "low"),
    ("The market fell because investors sold.", "official", "finance", "unverified_causality", "high"),
    ("Buy it with a target price and a position size, 70% chance.", "user_note", "finance", "excluded", "critical"),
    ("Everyone knows this proves manipulation.", "social", "finance", "rumor", "high"),
    ("The crash is inevitable.", "community", "finance", "opinion_or_frame", "medium"),
    ("The benchmark rate was set at 4.25 percent.", "official", "finance", "official_reported_status", "low"),
    ("b​uy this stock", "news", "finance", "excluded", "critical"),
    ("sеll this stock", "news", "finance", "excluded", "critical"),
    ("ｂｕｙ this stock", "news", "finance", "excluded", "critical"),
    (None, "company", "finance", "confirmed_fact", "low"),
]


def _claims(spark, rows):
    schema = "claim_text string, source_type string, mode string, published_at string, observable_state string"
    return spark.createDataFrame([(*r, "2026-01-01", "observable") for r in rows], schema)


def test_decisions(spark):
    got = classify.classify(_claims(spark, [c[:3] for c in CASES])).collect()
    by_text = {(r.claim_text, r.source_type): r for r in got}
    for text, kind, _, claim_type, tiers in CASES:
        r = by_text[text, kind]
        assert r.claim_type == claim_type, text
        assert r.risk_tier in tiers.split("|"), text


@pytest.mark.parametrize(
    "text, on, off",
    [
        ("회사의 목표가 분명하다", [], ["d_target"]),
        ("목표가 5만원", ["d_target"], []),
        ("제품 비중을 확대", [], ["d_sizing"]),
        ("비중을 삼십 프로 확대하세요", ["d_sizing"], []),
        ("순매수하는 외국인", ["d_market"], ["d_action"]),
        ("not a recommendation to buy or sell", [], ["d_action"]),
        ("a farmers market opened", [], ["d_market"]),
        ("we know it well", [], ["d_recent"]),
        ("the ratio rose to 2640", ["d_number"], ["d_target"]),
        ("수요 감소로 인해 하락", ["d_causal"], []),
        ("확인해 보세요", [], ["d_causal"]),
    ],
)
def test_detectors(spark, text, on, off):
    r = detect(spark.createDataFrame([(text,)], "claim_text string")).first()
    assert all(r[d] for d in on) and not any(r[d] for d in off), [d for d in DETECTORS if r[d]]


def test_triggers_are_necessary():
    assert triggers(r"(?:buy|sell)\s+now") in ({"now"}, frozenset({"buy", "sell"}), frozenset({"now"}))
    assert triggers(r"\d+") is None


def test_splitter(spark):
    text = (
        "OVERVIEW NOTES\nThe U.S. economy grew 3% in Q1. Mr. Smith said so vs. plan.\ncontinued with S. Korea in it\n\n"
        "Revenue   12   15\n- bullet item number one\n1) second bullet item\nshort\n작성자: kim 조회수 1,204\n"
        "user_1: this reply is long enough to keep\nuser_2: short\nHeading words here:\n-3.5% was the change today.\n"
        "the u.s. economy grew 3% in q1.\n"
    )
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.claim_id, r.claim_text) for r in claims.extract_claims(df, ["doc_id"]).orderBy("claim_no").collect()]
    assert [g[2] for g in got] == [
        "The U.S. economy grew 3% in Q1.", "Mr. Smith said so vs. plan.", "continued with S. Korea in it", "Revenue 12 15",
        "bullet item number one", "second bullet item", "this reply is long enough to keep", "-3.5% was the change today.",
    ]
    assert {g[0] for g in got} == {1} and got[-1][1] == "clm_008"


def test_masks(spark):
    rows = [
        ("You should buy now, 70% chance of gain.", "finance", "reported_claim"),
        ("This is not a recommendation to buy or sell. Please sell.", "finance", "reported_claim"),
        ("The harvest was good [see note] <b>", "general", "reported_claim"),
        ("제품 비중을 확대", "finance", "reported_claim"),
        ("buy it", "finance", "excluded"),
        (None, "finance", "reported_claim"),
    ]
    df = spark.createDataFrame([(*r, "src", "clm_001") for r in rows], "claim_text string, mode string, claim_type string, source_name string, claim_id string")
    got = {r.claim_text: r.safe_text for r in masking.safe_claims(df).filter("claim_type <> 'excluded'").collect()}
    assert got[rows[0][0]] == "You should [blocked-investment-action] now, [blocked-probability-language] of gain."
    assert got[rows[1][0]] == "This is not a recommendation to buy or sell. Please [blocked-investment-action]."
    assert got[rows[2][0]] == "The harvest was good \\[see note\\] &lt;b&gt;"
    assert got[rows[3][0]] == "제품 비중을 확대" and got[None] is None
    assert masking.safe_claims(df).filter("claim_type = 'excluded'").first().safe_text == "[excluded-unsafe-finance-claim] id=src/clm_001"
    again = masking.mask(spark.createDataFrame([("[blocked-allocation-language] allocation", "finance")], "t string, mode string"), "t", "mode", "o").first().o
    assert again == "[blocked-allocation-language] [blocked-allocation-language]"


def test_amounts(spark):
    df = spark.createDataFrame([("매출 12조 3,000억원",), ("5,000원이다",), ("rose 4.5 percent",), ("about 1,200 units",), ("none",)], "t string")
    got = [r[0] for r in df.select(analytics.magnitude(df.t)).collect()]
    assert [None if x is None else int(x) for x in got] == [12_300_000_000_000, 5000, 450, 1200, None]


def test_metrics_are_null_on_zero(spark):
    df = spark.createDataFrame([("d", "finance", False, False)], "detector string, mode string, expected boolean, predicted boolean")
    r = analytics.confusion(df, "mode").filter("mode is null").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.f1) == (0, 0, 0, 1, None, None, None)


def test_urls_and_paths(spark):
    rows = [("https://a.example/x", None), ("ftp://a.example", "scheme not allowed"), ("http://u@a.example", "credentials in url"), ("http://10.0.0.1/", "address not global"), ("http://a.example:8080", "port not allowed"), ("http://localhost", "localhost"), (None, "missing url"), ("http://0x7f.1/", "address not canonical")]
    df = spark.createDataFrame(rows, "u string, want string")
    assert all(r.want == r.got for r in df.select("want", intake.url_problem(df.u).alias("got")).collect())
    paths = [("a/b.txt", None), ("../b.txt", "parent directory"), ("/etc/x.txt", "absolute path"), ("C:\\x.txt", "windows absolute path"), ("a.pdf", "suffix not allowed"), ("http://x/y.txt", "looks like a url")]
    df = spark.createDataFrame(paths, "p string, want string")
    assert all(r.want == r.got for r in df.select("want", intake.path_problem(df.p).alias("got")).collect())


def test_visible_text(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='sidebar'><div>in</div>side</div><p>One &amp; two</p><script>x</script><p>Three</body>"
    got = intake.visible_text(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"), "page_id", "html").collect()
    assert {r.page_id: r.text for r in got} == {1: "One & two\nThree", 2: ""}
