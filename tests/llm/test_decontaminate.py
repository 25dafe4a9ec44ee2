import random

from tracelode.llm import decontaminate as D


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["élan", "Ünder", "x1"]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(str(i), " ".join(prose(r.randint(1, 40)))) for i in range(12)] + [("12", None), ("13", ""), ("14", "?? !!"), ("0", "a second text of the first item that is long enough to count here")]
    docs = [None, "", "...", "W1"]
    for _ in range(150):
        parts = prose(r.randint(0, 80))
        for _ in range(r.randint(0, 2)):
            w = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(w) - 5))
            parts += w[a : a + r.randint(3, 40)] + prose(r.randint(0, 30))
        docs.append(r.choice([" ", ", ", "\n"]).join(p.upper() if r.random() < 0.1 else p for p in parts))
    return docs + [docs[9], docs[9]], items


def brute(docs, items, window=13, percent=5):
    windows = []
    for name, text in items:
        w = D.words_of(text)
        n = min(window, len(w))
        windows += [(name, w[i : i + n]) for i in range(len(w) - n + 1) if n]
    out = []
    for text in docs:
        w = D.words_of(text)
        hit, names = set(), set()
        for name, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    names.add(name)
        out.append((len(w), len(hit), sorted(names), len(hit) > 0 and 100 * len(hit) >= percent * len(w)))
    return out


def run(spark, docs, items, **options):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(docs)], "doc_id long, text string, items int").repartition(3)
    rows = D.find_contamination(df, spark.createDataFrame(items, "item_id string, text string"), **options).collect()
    return [(r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_against_a_plain_loop(spark):
    docs, items = corpus()
    assert run(spark, docs, items) == brute(docs, items)


def test_the_benchmark_in_blocks_and_small_shards(spark):
    docs, items = corpus(2)
    assert run(spark, docs, items, block_bytes=100, shard_rows=7) == brute(docs, items)


def test_longest_matches_and_removal(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "start " + " ".join(f"q{i}" for i in range(4, 25)) + " end"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (None, item)], "item_id long, text string")
    found = {r["doc_id"]: r["matches"] for r in D.find_contamination(docs, bench).collect()}
    assert [tuple(m) for m in found[1]] == [("7", 4, 1, 21)] and found[2] == []
    assert sorted(r["doc_id"] for r in D.decontaminate(docs, bench).collect()) == [2, 3]
    assert D.find_contamination(docs, bench.limit(0)).filter("contaminated").collect() == []
    assert D.find_contamination(docs.limit(0), bench).collect() == []
