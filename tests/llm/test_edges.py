"""Long texts, clashing columns, ties and hot groups of the corpus operators, and a plain form of the toxicity score."""

import hashlib
import math
import random

from tests.llm.test_suffix_dedup import brute
from tests.llm.test_toxicity import all_segments
from tracelode.llm import line_dedup, minhash, sharding, suffix_dedup
from tracelode.llm import toxicity as X


def test_scores_by_the_definition_of_segments():
    r = random.Random(7)
    model = X.Model(X.Weights({"vil$": 2.5, "gro": 1.5, "nic": -0.8}), rest=-0.4, scale=0.9, log_k=-1.2, logit=(-2.0, 0.7, 0.3))
    for _ in range(300):
        tokens = [r.choice(["vil", "grotty", "nice", "plain", "word", "sea"]) for _ in range(r.randint(0, 30))]
        row = [model.weights[t] or model.rest for t in tokens]
        excess = [model.scale * s - model.log_k - math.log(len(tokens)) for _, _, s in all_segments(row)]
        best = max([0.0, *(-math.log(1 - math.exp(-math.exp(-e))) if e < 30 else e for e in excess)])
        want = 1 / (1 + math.exp(-(-2.0 + 0.7 * best + 0.3 * sum(max(0.0, e) for e in excess))))
        _, got_best, total = X.features(tokens, model)
        assert abs(X.score_of(got_best, total, model) - want) < 1e-9


def test_toxicity_keeps_other_columns_and_whole_texts(spark):
    model = X.Model(X.Weights({"vil$": 4.0}), rest=-0.5, logit=(-3.0, 1.0, 0.1))
    long = "word " * 200_000 + "vil vil vil"
    df = spark.createDataFrame([(1, long, "s", ["a"], 3), (2, "word", "t", None, 4)], "doc_id long, text string, score string, segments array<string>, own int")
    out = {r["doc_id"]: r for r in X.score(df, model).collect()}
    assert out[1]["segments"][-1]["last"] == 200_002 and out[1]["own"] == 3 and isinstance(out[1]["score"], float)
    assert out[1]["score"] > out[2]["score"]


def test_shards_of_many_levels_and_clashing_columns(spark):
    df = spark.createDataFrame([(i % 50, f"s{i}", "x", i) for i in range(3000)], "doc_id long, slot string, shard string, row int")
    out = sharding.uniform_shards(df, 7, block_rows=1, max_levels=12).collect()
    assert sorted(r["row"] for r in out) == list(range(3000))
    for s in range(7):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (428, 429)


def test_a_passage_in_more_texts_than_a_task_holds_by_default(spark):
    r = random.Random(3)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(90))[:430]
    texts = [f"{i:05d} {passage}" for i in range(8600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(df).collect()
    got = [(x["n_bytes"], x["n_removed"], len(x["spans"]), hashlib.sha256(x["kept"]).hexdigest()) for x in sorted(rows, key=lambda x: x["doc_id"])]
    assert got == brute([t.encode() for t in texts], 400)


def test_long_texts_near_each_other(spark):
    r = random.Random(2)
    words = [f"w{r.randint(0, 5000)}" for _ in range(60_000)]
    other = list(words)
    for i in range(0, 60_000, 40):
        other[i] = "x"
    rows = [(1, " ".join(words), 5, "a"), (2, " ".join(other), 5, "b"), (3, "short text", 5, "c"), (4, None, 5, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int, kept string")
    out = {x["doc_id"]: x["component_id"] for x in minhash.with_components(minhash.near_duplicates(df, n=2, percent=80)).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 4}


def test_long_texts_of_lines(spark):
    rows = [(1, "\n".join(f"line number {i} of it" for i in range(50_000)), 1), (2, "\n".join(f"Line number {i} of it " for i in range(49_990, 50_010)), 2)]
    out = {x["doc_id"]: x for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int")).collect()}
    assert out[1]["n_dropped"] == 0 and (out[2]["n_lines"], out[2]["n_dropped"]) == (20, 10)
