"""The artifact sink and the folder source."""

import json
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from quillgate.sinks import artifacts
from quillgate.sources import folder, intake


def test_artifacts_are_stated_byte_for_byte(spark, tmp_path):
    rows = [{"b": i % 7, "a": f"é{i}", "n": None if i % 3 else [{"z": 1, "y": "한"}]} for i in range(300)]
    df = spark.createDataFrame(rows, "b int, a string, n array<struct<z:int,y:string>>")
    want = sorted(rows, key=lambda r: (r["b"], json.dumps({"a": r["a"], "b": r["b"], **({"n": r["n"]} if r["n"] else {})}, ensure_ascii=False, separators=(",", ":"))))
    path = str(tmp_path / "deep" / "x.jsonl")
    for parts in (1, 9):
        artifacts.write_artifact(df.repartition(parts), path, ["b"])
        with open(path, encoding="utf-8") as f:
            assert f.read() == "".join(json.dumps(r, ensure_ascii=False, sort_keys=True) + "\n" for r in want)
    assert os.listdir(tmp_path / "deep") == ["x.jsonl"]
    small = df.filter("b = 1").select("b", "a").limit(3).orderBy("a")
    listed = [{"b": r.b, "a": r.a} for r in small.collect()]
    for head, field, whole in (({"issue_id": "i"}, "runs", {"issue_id": "i", "runs": listed}), ({}, "", listed)):
        artifacts.write_artifact(small, path, ["a"], kind="json", head=head, field=field)
        with open(path, encoding="utf-8") as f:
            assert f.read() == json.dumps(whole, ensure_ascii=False, indent=2) + "\n"
        artifacts.write_artifact(small.limit(0), path, ["a"], kind="json", head=head, field=field)
        with open(path, encoding="utf-8") as f:
            assert f.read() == json.dumps({**head, field: []} if field else [], indent=2) + "\n"
    artifacts.write_artifact(df.filter("a = 'é6'"), path, kind="object")
    with open(path, encoding="utf-8") as f:
        assert f.read() == json.dumps(rows[6], ensure_ascii=False, indent=2) + "\n"
    with pytest.raises(Exception, match="one row, not 300"):
        artifacts.write_artifact(df, path, kind="object")
    assert os.listdir(tmp_path / "deep") == ["x.jsonl"]
    artifacts.write_artifact(spark.createDataFrame([(1, "b"), (2, None), (0, "a")], "i int, t string").orderBy("i").select("t"), path, [F.col("t").desc()], kind="text")
    with open(path, encoding="utf-8") as f:
        assert f.read() == "b\na\n\n"


def test_an_artifact_survives_a_failed_task(tmp_path):
    """A task of the write dies in its first attempt; the file is that of an undisturbed run."""
    code = f"""
        import os, sys
        from pyspark.sql import SparkSession, functions as F
        from quillgate.sinks.artifacts import write_artifact
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
        @F.udf("long")
        def dies_once(x):
            if x == 70 and not os.path.exists("{tmp_path}/died"):
                open("{tmp_path}/died", "w").close()
                os._exit(1)
            return x
        df = spark.range(100).withColumn("t", F.concat(F.lit("row "), F.col("id").cast("string")))
        write_artifact(df, "{tmp_path}/a.jsonl", ["id"])
        by = F.col("id")
        from quillgate.sinks import artifacts
        spark.dataSource.register(artifacts.ArtifactSource)
        rows = df.repartitionByRange(3, by).sortWithinPartitions(by).withColumn("id", dies_once("id"))
        rows.write.format("quillgate-artifact").mode("append").options(path="{tmp_path}/b.jsonl", kind="jsonl").save()
    """
    env = {**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env=env, cwd="/", capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert (tmp_path / "died").exists()
    assert (tmp_path / "a.jsonl").read_bytes() == (tmp_path / "b.jsonl").read_bytes() and len((tmp_path / "a.jsonl").read_text().splitlines()) == 100
    assert sorted(os.listdir(tmp_path)) == ["a.jsonl", "b.jsonl", "died"]


def test_folder_source(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbfwith a mark\r\n")
    (tmp_path / "A.MD").write_text("한글", encoding="utf-8")
    (tmp_path / "c.txt").write_bytes(b"ab\xffc")
    (tmp_path / "d.txt").write_bytes(b"\xef\xbb\xbfab\xfe")
    (tmp_path / "e.csv").write_text("no")
    (tmp_path / "sub.txt").mkdir()
    (tmp_path / "link.txt").symlink_to(tmp_path / "b.txt")
    for group in (0, 1):
        df = folder.read_folder(spark, str(tmp_path), group)
        assert df.rdd.getNumPartitions() == (4 if group else 1)
        got = [tuple(r) for r in df.orderBy("at").select("at", "name", "text", "problem").collect()]
        assert got == [(1, "A.MD", "한글", None), (2, "b.txt", "with a mark\r\n", None), (3, "c.txt", None, "not UTF-8: byte 0xff at offset 2"), (4, "d.txt", None, "not UTF-8: byte 0xfe at offset 5")]
    named = folder.read_files(spark, [f"{tmp_path}/link.txt", f"{tmp_path}/none.txt", f"{tmp_path}/b.txt"])
    assert folder.problems(named) == [f"{tmp_path}/link.txt: symbolic link", f"{tmp_path}/none.txt: file not found"]
    (tmp_path / "empty").mkdir()
    assert folder.read_folder(spark, str(tmp_path / "empty")).count() == 0
    assert intake.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0


def test_the_core_runs_from_another_folder(tmp_path):
    """Workers import the package though neither the working folder nor PYTHONPATH holds it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
        import sys
        sys.path.insert(0, {root!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        from quillgate.operators import reviews
        from quillgate.sources import intake
        from quillgate.functions.detectors import detect
        docs = spark.createDataFrame([("Äußerst market fell because of x", "http://10.0.0.1.nip.io/")], "claim_text string, url string")
        assert detect(docs).first().d_causal
        assert docs.select(intake.url_problem(docs.url)).first()[0] == "address not global"
        assert intake.visible_text(docs, "url", "claim_text").count() == 1
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
