"""Texts are looked through by one Python worker a pass, in bounded batches."""

from pyspark.sql import functions as F

from quillgate.functions import detectors
from quillgate.operators import classify, masking


def _claims(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, claim_text string")
    return rows.select("*", F.lit("news").alias("source_type"), F.lit("finance").alias("mode"), F.lit("2026-01-01").alias("published_at"), F.lit("observable").alias("observable_state"))


def _workers(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")


def test_one_worker_for_each_pass(spark):
    rows = classify.classify(_claims(spark, ["Buy now."]))
    assert _workers(rows) == 1
    assert _workers(masking.mask(_claims(spark, ["Buy now."]), "claim_text", "mode", "safe")) == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20


def test_odd_texts_are_read_as_normalised(spark):
    texts = [None, "", "Bu​y now", "Buy nоw", "ＢＵＹ now", "target price", "This is not investment advice. Buy now.",
             "This is not investment advice.", "target price", "매수하세요"]
    rows = _claims(spark, texts)
    got = [(r.d_action, r.d_target) for r in detectors.detect(rows).orderBy("id").collect()]
    assert got == [(False, False), (False, False), (True, False), (True, False), (True, False), (False, False), (True, False), (False, False), (False, True), (got[9][0], False)]
    plain = detectors.detect(rows.withColumn("claim_text", detectors.normalise(F.col("claim_text"))))
    assert [(r.d_action, r.d_target) for r in plain.orderBy("id").collect()] == got
    safe = [r.safe for r in masking.mask(rows, "claim_text", "mode", "safe").orderBy("id").collect()]
    assert safe[0] is None and safe[2] == safe[3] == safe[4] and "blocked" in safe[2] and "blocked-price-level" in safe[5] and safe[7] == texts[7]
