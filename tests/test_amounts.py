"""Amounts of any length and script."""

import pytest
from pyspark.sql import functions as F

from quillgate.operators import analytics, bundle


@pytest.mark.parametrize(
    "text, want",
    [
        ("A token 909955422195631 was shown", 909955422195631), ("half 0.9999999 done", 0), ("rate 92233720368547758.08%", 9223372036854775808), ("token 909955422195631329054", int(float("909955422195631329054"))), ("x " + "9" * 37, int(float("9" * 37))), ("매출은 ３조 ２억원이다", 3 * 10**12 + 2 * 10**8),
        ("값은 ５,０００원이다", 5000), ("매출 3 조원", 3 * 10**12), ("value ٣٤", 34), ("token 9007199254740993", 9007199254740992), ("x " + "9" * 60, None), ("매출 " + "9" * 30 + "조원", None),
        ("rate " + "9" * 60 + "%", None), ("x " + "9" * 400, None), ("매출 " + "9" * 39 + "원", None), ("1만 " * 20000, 20000 * 10**4), ("x " + "7" * 100_000, None), ("약,5조 2,000억원, 3원", 5 * 10**12 + 2000 * 10**8), ("1.2.5% up", 250),
    ],
)
def test_odd_amounts(spark, text, want):
    t = F.col("t")
    row = spark.createDataFrame([(text,)], "t string").select(analytics.magnitude(t).alias("m"), analytics.amount_key(t).alias("k")).first()
    assert row.m == want and row.k is not None and (want is None or row.k == str(want))


def _rows(spark, rows):
    return spark.createDataFrame(rows, "source_name string, claim_text string").withColumn("claim_type", F.lit("reported_claim"))


def test_divergence_of_long_amounts(spark):
    long = "1" * 45
    rows = [("a", f"token value {long}"), ("b", f"token value {long}2"), ("a", f"배당 총액 {long}원"), ("b", f"배당 총액 {long},0원"), ("a", f"net rate {long}%"), ("b", f"net rate 0{long} %"), ("a", "순이익 규모 ３조원"), ("b", "순이익 규모 4조원")]
    got = {r.context: (r.n_values, r.n_sources, r.claims) for r in analytics.numeric_divergence(_rows(spark, rows)).collect()}
    assert got == {"token|value": (2, 2, 2), "배당|총액": (2, 2, 2), "규모|순이익": (2, 2, 2)}


def test_items_of_long_amounts(spark):
    rows = _rows(spark, [("a", "token value " + "1" * 40), ("b", "token value " + "2" * 40), ("a", "9 people were injured by fire."), ("b", "8 people were injured by fire.")])
    got = bundle.numeric_review_items(bundle.numeric_conflicts(rows)).select("claim_ids", "verification_question").collect()
    assert sorted(r.claim_ids for r in got) == ["numeric:reported_numeric_value", "numeric:reported_people_count"] and any("1" * 40 + ", " + "2" * 40 in r.verification_question for r in got)
