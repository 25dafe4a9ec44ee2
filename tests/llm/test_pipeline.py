import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(1)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("an", "el", "ist", "om", "ur")]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, item = "a line that many documents share", prose(30)
    docs, labels = [], []
    for i in range(300):
        text = prose(r.randint(40, 120))
        if i % 10 == 1:
            text = " ".join(x + (" vilest" if k % 9 == 0 else "") for k, x in enumerate(text.split()))
        if i % 10 == 2:
            text += "\n" + shared
        if i % 10 == 3:
            text = item + " " + text
        if i % 10 == 4:
            text = docs[i - 4][1] + " end"
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(i % 10 == 1)))
    docs += [(300, None, None, None, None), (301, "", "en", "s", 0), (0, docs[0][1], "en", "s", 1)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_each_stage_does_its_work(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "byte-level BPE":
            assert out.columns == docs.columns
        rows = out.collect()
        seen.append((name, rows))
        docs = spark.createDataFrame(rows, out.schema)
    kept = [{r["doc_id"] for r in rows} for _, rows in seen]
    assert not any(i % 10 == 1 for i in kept[0] if i < 300) and len(kept[0]) == 272
    lines = [r["doc_id"] for r in seen[1][1] if "many documents share" in (r["text"] or "")]
    assert lines == [2] and kept[1] == kept[0]
    assert not any(i % 10 == 4 for i in kept[2] if i < 300) and {300, 301} <= kept[2]
    assert sum(r["doc_id"] == 0 for r in seen[2][1]) == 1
    assert not any(i % 10 == 3 for i in kept[3] if i < 300) and any(i % 10 == 0 for i in kept[3])
    assert all(len(r["ids"]) == r["n_tokens"] for r in seen[4][1]) and kept[4] == kept[3]


def test_run_is_all_stages(spark, sf_dir):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    rows = P.run(spark, sf_dir).select("doc_id", "n_tokens").collect()
    assert len(rows) > 180 and "pipeline" in entry.queries()


def test_columns_named_like_the_results_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "'mine' AS score", "7 AS n_lines", "'g' AS `group`", "1.5D AS n_hit", "'k' AS kept", "array(1) AS segments")
    want = {"score": "mine", "n_lines": 7, "group": "g", "n_hit": 1.5, "kept": "k", "segments": [1]}
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == v for r in rows for c, v in want.items())
