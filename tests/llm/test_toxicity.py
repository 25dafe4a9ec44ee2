import random

from pyspark.sql import functions as F

from tracelode.llm import toxicity as X


def all_segments(scores):
    """Maximal-scoring segments by their definition: the best one (the shortest of the best), then left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i, len(scores)):
            s = sum(scores[i : j + 1])
            if s > 1e-12 and (best is None or s > best[2] + 1e-9 or (abs(s - best[2]) <= 1e-9 and j - i < best[1] - best[0])):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return all_segments(scores[:i]) + [best] + [(a + j + 1, b + j + 1, t) for a, b, t in all_segments(scores[j + 1 :])]


def test_segments_are_maximal():
    r = random.Random(1)
    for _ in range(400):
        n, rest = r.randint(0, 25), -r.uniform(0.1, 1)
        places = sorted(r.sample(range(n), r.randint(0, min(n, 10))))
        scores = [r.uniform(0.2, 3) for _ in places]
        row = [rest] * n
        for p, s in zip(places, scores, strict=True):
            row[p] = s
        got = X.maximal_segments(places, scores, rest)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in all_segments(row)]


def corpus(spark, n=1500, seed=1):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("an", "el", "ist", "om", "ur")]
    bad = ["vilest", "grotty", "fiend"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 200))]
        toxic = r.random() < 0.2
        for _ in range(r.randint(3, 6) if toxic else r.random() < 0.03):
            w.insert(r.randint(0, len(w)), r.choice(bad) + r.choice(["", ".", "s"]))
        docs.append((i, " ".join(w).capitalize()))
        if r.random() < 0.7:
            labels.append((i, int(toxic != (r.random() < 0.02))))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = X.fit(docs, labels.filter(~X.held_out(F.col("doc_id"))), max_rows=800)
    out = X.score(docs, model).join(labels, "doc_id").filter(X.held_out(F.col("doc_id"))).collect()
    right = sum(r["predicted"] == r["toxic"] for r in out) / len(out)
    caught = sum(r["predicted"] for r in out if r["toxic"]) / sum(r["toxic"] for r in out)
    assert len(out) > 150 and right > 0.95 and caught > 0.85
    hit = next(r for r in out if r["predicted"])
    tokens = X.tokens_of(hit["text"])
    assert any(tokens[s["first"]].startswith(("vil", "gro", "fie")) for s in hit["segments"])


def test_nulls_repeats_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "some words here" * 500)], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (empty, spark.createDataFrame([(2, 1), (2, None), (None, 0), (9, 0)], "doc_id long, toxic int")):
        out = X.score(docs, X.fit(docs, labels)).collect()
        assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out) and len({r["score"] for r in out}) == 1
    assert X.score(docs.limit(0), X.Model()).collect() == []
