"""The splitter's gates change no claim: white space, furniture and labels at their edges."""

from pyspark.sql import functions as F

from quillgate.operators import claims


def test_squeeze_equals_the_plain_form(spark):
    texts = ["a b", " a  b ", "a\tb", "a\t b", " a  b", "a \n", "", "　", "x\u001cy", "a​b", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.trim(F.regexp_replace("t", r"(?Ud)\s+", " "))
    assert [r[0] == r[1] or r[0] is r[1] is None for r in rows.select(claims.squeeze(F.col("t")), plain).collect()] == [True] * len(texts)


def test_gated_lines(spark):
    text = "Reuters_1: The index fell again today.\n신고\nScreenshot_2026 x\nphoto.JPG\n작성자 홍길동 조회 12\n좋아요 3 | 공유 1\nRate  3.5  4.5\n12 34 The mill reopened on Monday.\nIt ended late. 10:11:12\n- -5% was the change seen."
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r.claim_text for r in claims.extract_claims(rows, ["doc_id"]).orderBy("claim_no").collect()]
    assert got == ["The index fell again today.", "Rate 3.5 4.5", "The mill reopened on Monday.", "It ended late.", "-5% was the change seen."]
