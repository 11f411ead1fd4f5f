"""First free names against a scan in order."""

import random

import duckdb
from pyspark.sql import functions as F

from quillgate.operators import bundle, names
from quillgate.plans import handover


def scan(captures, taken):
    used, out = {}, {}
    for issue, stem in taken:
        used.setdefault(issue, set()).add(stem)
    for issue, slug, at in sorted(captures, key=lambda c: c[2]):
        held, n, name = used.setdefault(issue, set()), 1, slug
        while name in held:
            n += 1
            name = f"{slug}_{n}"
        held.add(name)
        out[issue, slug, at] = name
    return out


def test_free_names_by_brute_force(spark):
    rng = random.Random(11)
    captures, taken = [], []
    for issue in ["i", None, *[f"r{k}" for k in range(40)]]:
        slugs = ["a", "a_2", "a_3", "a_2_2", "a_4", "b", "b_02", "b_1", "a_2_3", "c_5", "c"]
        few = rng.sample(slugs, rng.randrange(1, len(slugs)))
        captures += [(issue, rng.choice(few), 0) for _ in range(rng.randrange(1, 14))]
        taken += [(issue, rng.choice([*slugs, "a_5", "b_2", "b_3", "a_2_2", "c_5_2"])) for _ in range(rng.randrange(4))]
    captures += [("deep", "x", 0)] * 30 + [("deep", f"x_{n}", 0) for n in range(2, 40, 3)] + [("deep", "x_5", 0)] * 3
    rng.shuffle(captures)
    captures = [(i, s, at * 10) for at, (i, s, _) in enumerate(captures)]
    rows = names.free_names(spark.createDataFrame(captures, "issue string, slug string, at long"), spark.createDataFrame(taken * 2, "issue string, stem string")).collect()
    assert {(r.issue, r.slug, r["at"]): r.stem for r in rows} == scan(captures, taken)
    none = spark.createDataFrame([], "issue string, slug string, at long")
    assert names.free_names(none, spark.createDataFrame(taken, "issue string, stem string")).count() == 0


def test_captures_after_a_log(spark):
    log = spark.createDataFrame([("i", "Old Name", "/w/captured/Old_Name.txt"), ("i", "x", "/w/a_2.txt"), ("j", "new", "/w/new.txt")], "issue_id string, source_name string, file_path string")
    rows = spark.createDataFrame([(1, "i", "old name "), (2, "i", "a"), (3, "i", "A"), (4, "i", "a!"), (5, "i", "new"), (6, "i", "Old@Name")], "at long, issue_id string, source_name string")
    files, again = bundle.capture_files(rows, "at", log)
    assert {r["at"]: r.file_name for r in files.collect()} == {2: "a.txt", 4: "a_.txt", 5: "new.txt", 6: "Old_Name_2.txt"}
    assert sorted(r["at"] for r in again.collect()) == [1, 3]
    assert files.columns == [*rows.columns, "file_name"] and again.filter(F.col("at") == 9).count() == 0


def test_names_of_the_query_stay_short(spark, sf, tmp_path, monkeypatch):
    """The query's own names must not grow with the ids; files are named as the SQL says, whatever the ids' size."""
    shifted = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 120").withColumn("doc_id", F.col("doc_id") + 400_000)
    shifted.write.parquet(f"{tmp_path}/documents.parquet")
    held, files = [], bundle.capture_files
    monkeypatch.setattr(bundle, "capture_files", lambda rows, *more: held.append(rows) or files(rows, *more))
    got = {tuple(r) for r in handover.free_capture_names(spark, str(tmp_path)).select("doc_id", "file_name").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(handover.ORACLE_SQL["free_capture_names"]).fetchall())
    assert held[0].agg(F.max(F.length("source_name"))).first()[0] < 64
