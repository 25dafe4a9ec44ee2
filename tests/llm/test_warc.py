import gzip
import heapq
import os
import random
from collections import Counter

from tracelode.llm import warc as X


def pages(n=300):
    r = random.Random(1)
    out = [(i, f"http://www.h{r.randint(0, 5)}.example.org/p{r.randint(0, 9)}?b=2&a={r.randint(0, 3)}#x", r.choice(["<p>same</p>", "", f"<p>own {i} é</p>" * r.randint(1, 50)])) for i in range(n)]
    return out + [(n, None, None), (n + 1, "not a url\r\nWith: header", "x\r\n\r\ny"), (None, "http://h0.example.org/", "<p>same</p>"), (5, "http://again/", "<p>same</p>")]


def test_records_come_back_in_order(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    out = sorted(X.capture_histories(df, path=f"file://{tmp_path}/w").collect(), key=lambda r: (r["range"], r["place"]))
    assert len(out) == len(rows)
    heads = {}
    for i, _, h in rows:
        if i is not None:
            heads[h or ""] = max(i, heads.get(h or "", -1))
    count = Counter(h or "" for _, _, h in rows)
    want = sorted(((i, len((h or "").encode()), X.base32_sha1((h or "").encode()), *(("response", None) if i == heads[h or ""] or count[h or ""] == 1 else ("revisit", heads[h or ""]))) for i, _, h in rows), key=str)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=str) == want
    keys = [(r["url_key"], r["captured_at"], -1 if r["page_id"] is None else r["page_id"]) for r in out]
    assert keys == sorted(keys)
    # any reader of gzip finds the records, and each alone at its place
    files = {r["file"].removeprefix("file://") for r in out}
    assert sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files) == len(rows)
    r = out[10]
    with open(r["file"].removeprefix("file://"), "rb") as f:
        f.seek(r["file_offset"])
        assert gzip.decompress(f.read(r["file_length"])).startswith(b"WARC/1.1\r\n")
    assert all(os.path.getsize(f) > 0 for f in files)


def test_many_runs_are_merged_in_passes(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(6)
    archives = X.write_archives(df, f"file://{tmp_path}/w", file_bytes=2000)
    runs = X.index_archives(archives, f"file://{tmp_path}/i", run_records=10)
    assert runs.count() > 20
    out = sorted(X.merge_runs(runs, f"file://{tmp_path}/i", fan_in=3, range_records=40).collect(), key=lambda r: (r["range"], r["place"]))
    keys = [(r["url_key"], r["captured_at"]) for r in out]
    assert len(out) == len(pages()) and keys == sorted(keys) and len({r["range"] for r in out}) > 1


def test_loser_tree():
    r = random.Random(2)
    for k in range(0, 12):
        streams = [sorted([r.randint(0, 30)] for _ in range(r.randint(0, 9))) for _ in range(k)]
        assert list(X.LoserTree([iter(s) for s in streams])) == list(heapq.merge(*streams)) if k else True


def test_small_payloads_and_no_pages(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "v", "long enough"), (4, "v", "long enough")], "page_id long, url string, html string")
    out = {r["page_id"]: r["record_type"] for r in X.capture_histories(df, min_payload=5, path=f"file://{tmp_path}/a").collect()}
    assert out == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert X.capture_histories(df.limit(0), path=f"file://{tmp_path}/b").collect() == []


def test_url_keys():
    assert X.url_key("HTTP://WWW.Example.org:80/A/b?z=1&a=2#top") == "org,example)/a/b?a=2&z=1"
    assert X.url_key("https://m.example.net:8443") == "net,example,m:8443)/"
    assert X.url_key(None) == "-"


def test_merges_in_pieces_keep_the_order(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(6)
    archives = X.write_archives(df, f"file://{tmp_path}/w", file_bytes=2000)
    runs = X.index_archives(archives, f"file://{tmp_path}/i", run_records=7)
    whole = sorted(X.merge_runs(runs, f"file://{tmp_path}/i", fan_in=128).collect(), key=lambda r: (r["range"], r["place"]))
    runs = X.index_archives(archives, f"file://{tmp_path}/j", run_records=7)
    parts = sorted(X.merge_runs(runs, f"file://{tmp_path}/j", fan_in=2, range_records=20, piece=25).collect(), key=lambda r: (r["range"], r["place"]))
    order = lambda rows: [(r["url_key"], r["captured_at"], r["page_id"], r["file"], r["file_offset"]) for r in rows]
    assert order(parts) == order(whole) and len({r["range"] for r in parts}) > 3


def test_a_long_page_and_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.b/c", "x" * 3_000_000, "k", 1), (2, None, None, "k", 2)], "page_id long, url string, html string, url_key string, place int")
    out = {r["page_id"]: r for r in X.capture_histories(df, path=f"file://{tmp_path}/a").collect()}
    assert out[1]["payload_bytes"] == 3_000_000 and out[2]["payload_bytes"] == 0 and out[2]["url_key"] == "-"
