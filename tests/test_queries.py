"""Each query against its SQL, the import without the corpus operators, and sources and streams."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.oracle import connect, differs
from tracelode.plans import catalogue
from tracelode.sources import jsonl as J

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_query_equals_its_sql(spark, con, name):
    said = differs(spark, con, SF, catalogue.QUERIES[name], catalogue.ORACLES[name])
    assert said in ("", "no rows"), said


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_import_without_the_corpus_operators(tmp_path):
    for d in ("tracelode", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{d}") else shutil.copy)(f"{ROOT}/{d}", tmp_path / d)
    shutil.rmtree(tmp_path / "tracelode/llm", ignore_errors=True)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and 'pipeline' not in e.queries()"], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_import_without_a_library_of_the_corpus_operators():
    run = subprocess.run([sys.executable, "-c", "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries()"], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_json_lines(spark, tmp_path):
    at = f"file://{tmp_path}/a"
    df = spark.createDataFrame([("u1", 1, "x"), ("u2", 2, "ü")], "_uid string, _private int, text string")
    J.write(df, at, frozen=True)
    back = J.read_strict(spark, at, "_uid string, text string")
    assert sorted(back.collect()) == [("u1", "x"), ("u2", "ü")]
    with pytest.raises(Exception, match="(?i)exist"):
        J.write(df, at, frozen=True)
    (tmp_path / "torn.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": ')
    assert sorted(r["a"] for r in J.read_tolerant(spark, f"file://{tmp_path}/torn.jsonl", "a int").collect()) == [1, 2]
    with pytest.raises(Exception):  # noqa: B017
        J.read_strict(spark, f"file://{tmp_path}/torn.jsonl", "a int").collect()
    assert {r["suite"] for r in J.read_suites(spark, f"file://{tmp_path}/*.jsonl", "a int").collect()} == {"torn"}
    J.write_meta(spark, at, {"n": 2})
    J.write_meta(spark, at, {"n": 3})
    assert J.read_meta(spark, at) == {"n": 3}


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    for v in (1, 2, 3):
        J.publish(spark.range(v), root, v)
    assert J.current(spark, root).count() == 3
    assert J.prune(spark, root, 1) == [1, 2] and J.current(spark, root).count() == 3


def test_markdown_and_replies(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "card.md").write_text("# T\n## One\n<!-- no -->text\n## Two\n```\na\nb\n```\n")
    s = {r["title"]: r["body"] for r in J.sections(spark, f"file://{tmp_path}/card.md").collect()}
    assert s["One"].strip() == "text" and list(s) == ["One", "Two"]
    assert spark.createDataFrame([(s["Two"],)], "b string").select(J.fenced("b")).first()[0] == "a\nb\n"
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('So: {"a": 2} ok',), ("none",)], "t string")
    assert [r[0] and r[0]["a"] for r in df.select(J.tolerant_json(F.col("t"), "a int")).collect()] == [1, 2, None]


def test_stream_state(spark, tmp_path):
    from tracelode.streaming import follow as V

    at = f"{tmp_path}/in"
    spark.createDataFrame([("r", i, 4, 20.0 if i % 3 else 1.0) for i in range(9)], "run string, step long, n long, std double").coalesce(1).write.parquet(at)
    rows = spark.readStream.schema("run string, step long, n long, std double").parquet(at)
    q = V.annealed_budget(rows, least_std=10.0).writeStream.outputMode("update").format("memory").queryName("budgets").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("budgets").first()
    assert r["moves"] == 6 and abs(r["budget"] - 400 * 0.995**6) < 1e-9


def test_windowed_stream(spark, tmp_path):
    from tracelode.streaming import follow as V

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    V.windowed_rates(spark, f"{tmp_path}/in", events.schema, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0


def test_failed_keys_are_scored_when_they_come_again(spark, tmp_path):
    from pyspark.sql import functions as F

    from tracelode.streaming import follow as V

    root = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1.0), (2, -1.0), (2, -1.0), (1, 1.0)], "id long, value double").write.parquet(f"{root}/in")
    score = lambda b: b.withColumn("score", F.when(F.col("value") > 0, F.col("value")))
    run = lambda: V.follow(spark, f"{root}/in", "id long, value double", score, f"{root}/out", f"{root}/ck", ["id"]).awaitTermination()
    run()
    assert [(r["id"], r["score"]) for r in spark.read.parquet(f"{root}/out").collect()] == [(1, 1.0)]
    assert [r["id"] for r in spark.read.parquet(f"{root}/out_errors").collect()] == [2]
    spark.createDataFrame([(2, 5.0), (1, 7.0)], "id long, value double").write.mode("append").parquet(f"{root}/in")
    run()
    assert sorted((r["id"], r["score"]) for r in spark.read.parquet(f"{root}/out").collect()) == [(1, 1.0), (2, 5.0)]
    assert V.retried(spark, score, f"{root}/out", ["id"]).collect() == []


def test_requests_workers_and_rounds(spark):
    from pyspark.sql import functions as F

    from tracelode.streaming import follow as V

    steps = lambda *x: spark.createDataFrame([(i,) for i in x], "step long")
    got = {r["step"]: (r["state"], r["rows"]) for r in V.answered(steps(1, 2, 3), steps(1, 1, 2), steps(1)).collect()}
    assert got == {1: ("answered", 2), 2: ("writing", 1), 3: ("waiting", 0)}
    beats = spark.createDataFrame([("a", 100.0), ("a", 160.0), ("b", 10.0)], "worker string, s double").select("worker", F.col("s").cast("timestamp").alias("ts"))
    workers = spark.createDataFrame([("a",), ("b",), ("c",)], "worker string")
    got = {r["worker"]: (r["age"], r["state"]) for r in V.staleness(workers, beats, F.lit(170.0).cast("timestamp"), 60.0).collect()}
    assert got == {"a": (10.0, "alive"), "b": (160.0, "stale"), "c": (None, "never started")}
    assert [V.audit_due(n, m) for n, m in ((49, 0), (100, 5), (1000, 0), (100, 90))] == [0, 15, 40, 0]


def test_cards(spark):
    card = "# T\n### Exemplar 1\none\n### Exemplar 2\ntwo\n---\n\n## End\nend\n"
    df = spark.createDataFrame([(card,)], "t string")
    few, more = df.select(J.without_exemplars("t", 2), J.with_exemplars("t", ["new"])).first()
    assert few == "# T\n### Exemplar 1\none\n---\n\n## End\nend\n"
    assert more == card.rstrip() + "\n\n### Exemplar 3\n\nnew\n"
