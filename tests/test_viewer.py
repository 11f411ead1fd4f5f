"""Suggestions, restored selections, chips and the figures of packages, by cases."""

from pyspark.sql import functions as F

from quillgate.operators import viewer
from quillgate.plans.checklist import checklist


def test_suggestions(spark):
    rows = [("c1", 1, "Daily News: Stocks!", None, None, ["x"]), ("c2", 2, None, "http://a/Reddit", None, None), ("--", 3, "", None, "Corporate", []), ("c4", 4, "Plan", None, None, ["memo"]), (None, 5, None, None, None, None)]
    got = viewer.suggestions(spark.createDataFrame(rows, "candidate_id string, at long, title string, url string, publisher string, warnings array<string>")).collect()
    assert {r.at: (r.suggested_name, r.suggested_type, r.suggested_mode) for r in got} == {
        1: ("daily_news_stocks", "news", "finance"), 2: ("c2", "social", "general"), 3: ("source_3", "company", "general"), 4: ("plan", "user_note", "general"), 5: ("source_5", "official", "general"),
    }


def test_restored(spark):
    cards = spark.createDataFrame([("a",), ("b",), (None,)], "candidate_id string")
    chosen = spark.createDataFrame([("a", 2, "late", "news", "general"), ("a", 1, "first", "social", "finance"), ("z", 3, "none", "news", "general")], "candidate_id string, at long, source_name string, source_type string, mode string")
    got = {r.candidate_id: (r.checked, r.source_name, r.mode) for r in viewer.restored(cards, chosen).collect()}
    assert got == {"a": (True, "first", "finance"), "b": (False, None, None), None: (False, None, None)}


def test_chips(spark):
    rows = spark.createDataFrame([(1, "fetched", ["w"]), (2, "failed", []), (3, None, None)], "at long, status string, warnings array<string>")
    shown = {n: [r.at for r in rows.filter(viewer.chip(n)).orderBy("at").collect()] for n in ("all", "fetched", "warning", "non-fetched")}
    assert shown == {"all": [1, 2, 3], "fetched": [1], "warning": [1], "non-fetched": [2, 3]}


def test_figures(spark):
    rows = [(1, "issue id : x y \nTotal sources: 4\n- [a](b)"), (2, "- [a](b) c\n* [d](e)\n [f](g)"), (3, None), (4, "Sources: 99999999999999999999"), (5, "Analysis run 1, Analysis Run # 2; low risk, MED-RISK, high-risk claims")]
    got = {r.at: tuple(r)[2:] for r in viewer.package_figures(spark.createDataFrame(rows, "at long, text string")).orderBy("at").collect()}
    assert got == {1: ("x y", 4, 0, 0, 0, 0, 0), 2: (None, 2, 0, 0, 0, 0, 0), 3: (None, 0, 0, 0, 0, 0, 0), 4: (None, None, 0, 0, 0, 0, 0), 5: (None, 0, 2, 1, 1, 1, 1)}


def test_checklist(spark):
    lines = [r.line for r in checklist(spark).orderBy("pos").collect()]
    assert lines[0].startswith("# ") and sum(x.startswith("- ") for x in lines) == 13 and checklist(spark).filter(F.col("line").startswith("## ")).count() == 3
