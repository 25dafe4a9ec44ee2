import random

from tracelode.llm import decontaminate as D


def brute(text, items, window=13):
    words = D.words_of(text)
    hit, names = set(), set()
    for name, item in items:
        w = D.words_of(item)
        size = min(window, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                names.add(name)
    return len(words), len(hit), sorted(names)


def corpus(seed=4):
    r = random.Random(seed)
    word = lambda: r.choice("ab bc cd de ef fg gh".split())
    items = [(f"i{k}", " ".join(word() for _ in range(r.randint(0, 30)))) for k in range(40)]
    items += [("one", "solo"), ("hot", " ".join(["the"] * 20)), ("hot", "again " * 14)]
    texts = [None, "", "solo", "the " * 500, "x solo y"]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 80)))]
        name, item = r.choice(items)
        parts.append(item)
        texts.append(" . ".join(parts) + " zz" * r.randint(0, 3))
    texts.append(" ".join(word() for _ in range(60_000)) + " " + items[3][1])
    return texts, items


def run(spark, texts, items, **options):
    docs = spark.createDataFrame([(i, t, 1, ["x"]) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int, items array<string>")
    bench = spark.createDataFrame(items, "item_id string, text string")
    return [(r["n_words"], r["n_hit"], r["items"]) for r in sorted(D.find_contamination(docs, bench, **options).collect(), key=lambda r: r["doc_id"])]


def test_broadcast_and_files_against_all_windows(spark):
    texts, items = corpus()
    want = [brute(t, items) for t in texts]
    assert run(spark, texts, items) == want
    assert run(spark, texts, items, block_bytes=300) == want
    assert run(spark, texts, items, block_bytes=300, broadcast_bytes=0) == want
    assert sum(w[1] > 0 for w in want) > 30


def test_no_benchmark(spark):
    assert run(spark, ["a b", None], [], broadcast_bytes=0) == [(2, 0, []), (0, 0, [])]
