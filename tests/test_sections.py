"""Sections without a figure are left out before texts are taken apart for their figures."""

from pyspark.sql import functions as F

from quillgate.operators import analytics, claims
from quillgate.plans import queries


def test_sections_keep_their_claims(spark):
    texts = [
        "Output was 5 units.\n\nNo figure is in this part.\nNor in this line.\n \t\nOutput WAS 5 units.\r\n\r\nThe rate is\n４ percent now.", "One line with 3 mills\nand its second half.\n\n\n\nUser_1: Nine mills of 9 shut today.\n \nA last one of 7.",
        "\n\nLeads with blanks 1 to 2.\n\r\n", "No figure at all.\n\nNor here, ever.", "", None, "Tail of 8 lines\r\n\n- item one of 2 things\n- an item without\n\n" + "\n" * 5000 + "Far below stand 6 trees.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = lambda d: [(r.doc_id, r.claim_text) for r in claims.extract_claims(d, ["doc_id"]).filter(F.col("claim_text").rlike(analytics.FIGURE)).orderBy("doc_id", "claim_no").collect()]
    less = claims.sections_with(df, analytics.FIGURE)
    assert of(less) == of(df) and len(of(df)) == 9
    assert less.filter("text like '%No figure%' or text like '%Nor %'").count() == 0


def test_only_claims_with_a_figure_are_stored(spark, sf):
    rows = queries._split_claims(spark, sf, queries.METRICS, F.pmod("doc_id", F.lit(9)) + 3)
    assert rows.count() >= spark.read.parquet(f"{sf}/documents.parquet").count() and rows.filter(~F.col("claim_text").rlike(analytics.FIGURE)).isEmpty()
