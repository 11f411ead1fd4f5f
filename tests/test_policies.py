"""Rules on repetition, addresses, numbering, rows with null or repeated keys, and the bundle's tables."""

import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from quillgate.functions import detectors, rules, strings
from quillgate.functions.detectors import DETECTORS, HITS
from quillgate.operators import analytics, bundle, claims, joins, numbering, verification
from quillgate.plans import queries
from quillgate.sources import intake


def _claim(i, text, run="r", source="s", kind="social", claim_type="reported_claim", tier="low"):
    return (i, run, source, kind, claim_type, text, tier, [], 1, f"h{text.lower()}")


NAMES = (
    "at long, issue_id string, source_name string, source_type string, claim_type string, claim_text string, risk_tier string, risk_flags array<string>, independent_source_count int,"
    " normalized_claim_hash string"
)


def test_repetition_policy(spark):
    rows = [
        _claim(1, "Alone stays alone here"), _claim(2, "Same words twice"), _claim(3, "same words twice", source="t"), _claim(4, "The bridge fell down"),
        _claim(5, "A bridge, so fell down!", kind="community"), _claim(6, "Same words, twice"), _claim(7, "The bridge fell down", run=None), _claim(8, "the bridge fell down", run=None),
        _claim(9, "Gone now entirely", claim_type="unobservable"), _claim(10, "So gone now entirely", claim_type="unobservable"), _claim(11, "Needed it is", claim_type="needs_official_source"),
        _claim(12, "So needed it is", claim_type="needs_official_source"), _claim(13, "...", kind="social"), _claim(14, "?!", kind="social"), _claim(15, "The bridge fell down", kind="news", claim_type="interpretation", tier="high"),
    ]
    got = {r.at: r for r in analytics.repetition_policy(spark.createDataFrame(rows, NAMES), "issue_id", "at").collect()}
    assert len(got) == len(rows)
    # 4 and 15 are equal texts, so 5 finds its variant taken; 6 is a variant of the taken 2 and 3.
    assert [got[i].duplicate_group_id for i in (1, 2, 3, 5, 6)] == [None, "dup_002", "dup_002", None, None]
    assert got[4].duplicate_group_id == got[15].duplicate_group_id == "dup_003" and got[15].risk_tier == "high"
    assert got[7].duplicate_group_id == got[8].duplicate_group_id == "dup_001" and got[7].source_count == 2  # a null run is a run
    assert got[9].duplicate_group_id == got[10].duplicate_group_id and got[9].duplicate_group_id.startswith("dup_fuzzy_")
    assert got[9].risk_flags == ["repetition_without_lineage", "source_laundering_risk", "fuzzy_variant_grouped"] and got[9].risk_tier == "medium"
    assert got[2].risk_flags == ["repetition_without_lineage", "source_laundering_risk"] and got[2].lineage_note.startswith("Repeated text")
    assert got[11].duplicate_group_id is got[12].duplicate_group_id is None  # no type for variants
    assert got[13].duplicate_group_id is got[14].duplicate_group_id is None  # no word, no variant


def test_shared_texts_need_a_word(spark):
    rows = spark.createDataFrame([_claim(1, "!!!", source="a"), _claim(2, "...", source="b"), _claim(3, "One text", source="a"), _claim(4, "one text!", source="b")], NAMES)
    assert [(r.claims, r.sources) for r in analytics.cross_source_groups(rows).collect()] == [(2, "a,b")]
    flagged = {r.at: r for r in analytics.flag_shared(rows).collect()}
    assert flagged[3].bundle_duplicate_group_id == "bundle_dup_001" and flagged[1].risk_flags == [] and len(flagged[4].risk_flags) == 2


@pytest.mark.parametrize("text, want", [("2.7 units", 2), ("1,234.9 items", 1234), ("4.25 percent", 425), ("1조 2억원", 10**12 + 2 * 10**8), ("no figure", None)])
def test_amounts_are_cut(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(analytics.magnitude(F.col("t")).alias("m")).first()
    assert row.m == want


def test_addresses():
    refused = ["[::1]", "[::ffff:10.0.0.1]", "10.0.0.1.nip.io", "localhost.", "127.0.0.1.", "198.18.0.1", "ex ample.com", "192.0.2.1", "203.0.113.1", "a.10-0-0-1.sslip.io", "0x7f.1", "[fe80::1]", "[::", "é.com"]
    assert all(intake.host_problem(h) for h in refused)
    assert not any(intake.host_problem(h) for h in ["example.com", "8.8.8.8", "[2606:4700::1111]", "8.8.8.8.nip.io", "xn--caf-dma.example"])


def test_numbering_of_sparse_and_hashed_orders(spark):
    rng = random.Random(1)
    for orders in ([rng.getrandbits(60) for _ in range(3000)], [10**15 + i for i in range(3000)], [i**4 for i in range(3000)]):
        df = spark.createDataFrame([(o, "a" if i % 3 else "b") for i, o in enumerate(orders)], "o long, k string")
        got = numbering.number_within(df, ["k"], "o", "nth", "first")
        for k in "ab":
            mine = sorted((r.o, r.nth, r.first) for r in got.filter(F.col("k") == k).collect())
            assert [n for _, n, _ in mine] == list(range(1, len(mine) + 1)) and {f for _, _, f in mine} == {mine[0][0]}
        assert len(numbering.order_bounds(df, "o")) > 500  # blocks of about as many rows, however the values lie


def test_hot_groups_are_joined_whole(spark):
    rows = spark.range(4000).selectExpr("id", "if(id % 2 = 0, null, cast(id as string)) as k")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = joins.join_groups(rows, groups, ["k"], "n")
    assert got.count() == 4000 and got.filter("k is null and n = 2000").count() == 2000 and got.filter("n = 1").count() == 2000


def test_documents_with_null_and_repeated_ids_stay_apart(spark):
    texts = ["First document says this. And then that as well.", "Second document says other things.", None, "Third has no id at all.", "Fourth has none either."]
    df = spark.createDataFrame(list(zip([1, 1, 2, None, None], texts)), "doc_id long, text string")
    got = sorted((r.claim_text, r.claim_no) for r in claims.extract_claims(df, ["doc_id"]).collect())
    assert got == sorted([("First document says this.", 1), ("And then that as well.", 2), ("Second document says other things.", 1), ("Third has no id at all.", 1), ("Fourth has none either.", 1)])


def test_orphans_are_told_from_the_whole_table(spark, sf, tmp_path):
    for name in ("lineitem", "orders", "labels", "documents"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderkey > 9").write.parquet(str(tmp_path / "some"))
    shutil.rmtree(tmp_path / "orders.parquet", ignore_errors=True)
    (tmp_path / "orders.parquet").unlink(missing_ok=True)
    (tmp_path / "some").rename(tmp_path / "orders.parquet")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_orderkey <= 9")
    got = {r.entity: (r.n, r.ids) for r in queries.orphan_rows(spark, str(tmp_path)).collect()}
    assert got["lineitem"] == (lines.count(), lines.select("l_orderkey").distinct().count()) and "lineitem" not in {r.entity for r in queries.orphan_rows(spark, sf).collect()}


def test_every_match_holds_a_literal():
    """What the automaton looks for is in every text that a pattern matches, for texts made of the patterns' own words."""
    words = HITS.words
    rng = random.Random(5)
    import re

    cases = [p for rule in DETECTORS.values() for p in rule.patterns() if rules.triggers(p) and "{0,20}" not in p]
    for p in cases:
        for _ in range(40):
            text = " ".join(rng.sample(words, 4))
            if re.search(p.replace("(?i:", "(?:").replace("(?i)", ""), text, re.I):
                assert any(w in text.lower() for w in rules.triggers(p)), p
    assert rules.triggers("(?:ab|cd)x?|ef") == {"ab", "cd", "ef"} and rules.triggers(r"a?\d+") is None and rules.triggers("(?<!ab)cd(?=ef)") == {"cd"}


def test_sections_items_and_maps(spark):
    names = "at long, issue_id string, source_name string, claim_id string, source_type string, claim_type string, risk_tier string, claim_text string, risk_flags array<string>, needs_human_review boolean, d_manipulation boolean"
    rows = [
        (1, "x", "a", "c1", "news", "reported_claim", "low", "Quiet news of the day", [], False, False), (2, "x", "a", "c2", "news", "excluded", "critical", "Buy it now", [], True, False),
        (3, "x", "b", "c1", "social", "rumor", "high", "They say so", [], True, True), (4, "x", "b", "c2", "news", "interpretation", "medium", "It may be", [], True, False),
        (5, "x", None, "c3", "official", "reported_claim", "medium", "Turnover rose", [], False, False),
    ]
    df = spark.createDataFrame(rows, names)
    placed = {r.at: (r.section, r.beside_excluded) for r in bundle.with_caution(df).withColumn("section", bundle.section()).collect()}
    assert placed == {1: ("low_risk", True), 2: ("excluded", False), 3: ("rumor_social", False), 4: ("weak", False), 5: ("other", False)}
    items = verification.work_items(bundle.with_caution(df), "at")
    counts = {r.tier: (r.raw, r.grouped) for r in verification.question_counts(items).collect()}
    assert counts == {"must_verify": (2, 2), "nice_to_verify": (2, 2), "unsafe_to_conclude": (3, 3)}
    assert {r.tier: r.n for r in verification.grouped_items(items).filter("tier <> 'must_verify'").collect()}["unsafe_to_conclude"] == 1
    after = bundle.claim_map(df.filter("at > 1"), "at")
    got = sorted((r.status, r.claim_text) for r in bundle.compared_maps(bundle.claim_map(df.filter("at < 4"), "at"), after).collect())
    assert got == sorted([("disappeared", "Quiet news of the day"), ("repeated", "Buy it now"), ("repeated", "They say so"), ("still_unresolved", "Buy it now"), ("still_unresolved", "They say so"), ("new", "It may be"), ("new", "Turnover rose")])
    reviews = df.withColumn("reason", F.lit("r")).withColumn("verification_question", F.lit("q"))
    assert {(r.source_name, r.risk_tier): r.claim_ids for r in bundle.grouped_reviews(reviews).collect()}["b", "high"] == "c1"
    runs = spark.createDataFrame([("x", "named", "general")], "run_id string, source_name string, mode string")
    assert {(r.source_name, r.mode) for r in bundle.collect(df.withColumn("run_id", F.col("issue_id")).withColumn("mode", F.lit(None).cast("string")), runs).collect()} == {("named", "general")}


def test_captures(spark):
    rows = [(1, "i", "Source #1"), (2, "i", "Source@1"), (3, "i", "source #1"), (4, "j", "Source #1"), (5, "i", "  "), (6, "i", "Source 1")]
    files, again = bundle.capture_files(spark.createDataFrame(rows, "at long, issue_id string, source_name string"), "at")
    assert {r.at: r.file_name for r in files.collect()} == {1: "Source_1.txt", 2: "Source_1_2.txt", 4: "Source_1.txt", 5: "issue.txt", 6: "Source_1_3.txt"}
    assert [r.at for r in again.collect()] == [3]
    got = spark.createDataFrame([("fetched", "p", ["w"]), ("failed", None, []), ("fetched", "", None)], "status string, file_path string, warnings array<string>")
    assert bundle.fetched(got).count() == 1 and bundle.triage_counts(got).first().asDict() == {"attempted": 3, "fetched": 2, "with_warnings": 1, "not_fetched": 1}


def test_strings(spark):
    row = spark.createDataFrame([("/b/x/y.txt", "/c/z.md", "a [b]\n (c)", "# h\nx # y", bytearray(b"a\r\nb\xff"), 0.5)], "p string, q string, t string, h string, c binary, m double").select(
        strings.shown_path(F.col("p"), "/b").alias("p"), strings.shown_path(F.col("q"), "/b").alias("q"), strings.metadata(F.col("t")).alias("t"), strings.no_headings(F.col("h")).alias("h"),
        strings.decoded(F.col("c")).alias("c"), strings.metric(F.col("m")).alias("m"), strings.metric(F.lit(None)).alias("n"), strings.slug(F.lit(" a/b ")).alias("s"),
    ).first()
    assert row.asDict() == {"p": "x/y.txt", "q": "<redacted-external-path>/z.md", "t": "a \\[b\\] \\(c\\)", "h": "\\# h\nx # y", "c": "a\nb\ufffd", "m": "0.500", "n": "n/a", "s": "a_b"}


def _plain_variant(text, tokens):
    out = text.lower()
    for p in analytics.LEAD_INS:
        out = re.sub(p, "", out)
    return " ".join([w for w in re.sub(r"[\W_]+", " ", out).split() if w not in analytics.LIGHT_WORDS][:tokens])


def test_variants_of_long_texts(spark):
    words = [f"word{i}" for i in range(400)]
    texts = [
        " ".join(words), "[" + "x " * 900 + "] The first post says that " + " ".join(words), "[never closed " + " ".join(words), "the " * 900 + " ".join(words), " " * 3000 + " ".join(words),
        "Another account" + " " * 3000 + "repeated " + " ".join(words), "few " + "... " * 900 + "words", "long" * 900 + " " + " ".join(words), "A Σ. " + " ".join(words), "Σ" + "'" * 3000 + "a " + " ".join(words), "The account says so", "",
    ]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for tokens in (20, 24):
        got = {r.t: r.v for r in rows.select("t", analytics.variant(F.col("t"), tokens).alias("v")).collect()}
        assert got == {t: _plain_variant(t, tokens) for t in texts} | {None: None}


@pytest.mark.parametrize("query", ["shared_flags", "cross_source_groups"])
def test_shared_texts_are_taken_apart_once(spark, sf, query):
    plan = queries.QUERIES[query](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert r"[\W_]+" not in plan and "claim_text" not in plan  # keys are stored, and no text with them


def test_repetition_reads_stored_rows(spark, sf):
    plan = queries.repetition_ledger(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert r"[\W_]+" not in plan and "claim_text" not in plan and plan.count("Aggregate") < 4  # groups are stored, and variants with the rows


def test_look_alike_letters_are_folded_by_the_worker(spark):
    texts = ["Вuy nоw", "plain buy", "가나 ﬁve​", "Вuy", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = detectors.read(df, F.col("t"), HITS, "out", "hits")
    want = {r.t: r.w for r in df.select("t", detectors.normalise(F.col("t")).alias("w")).collect()}
    assert {r.t: r.out for r in got.collect()} == want and want["Вuy nоw"] == "Buy now"
    assert "translate(" not in got._jdf.queryExecution().optimizedPlan().toString()  # nothing is left to do after it
