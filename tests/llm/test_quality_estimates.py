import itertools
import random

import numpy as np

from tracelode.llm import quality_mcd as Q


def logdet(x):
    return np.linalg.slogdet(np.cov(x.T, bias=True) + np.diag(np.square(Q.FLOORS)))[1]


def test_the_least_determinant_of_all_subsets(spark):
    """The estimate against every subset of the share alpha, where a few rows lie apart."""
    for seed in range(2):
        r = np.random.default_rng(seed)
        x = r.normal(size=(15, Q.DIM)) * [1.0, 0.3, 0.2, 0.4, 0.3]
        x[:3] += [8.0, -3.0, 2.0, 3.0, -2.0]
        rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "__g string, " + ", ".join(f"__x{i} double" for i in range(Q.DIM)))
        found = Q.estimates(rows, 0.8, warm=2, steps=20, tolerance=1e-6).collect()
        assert len(found) == 1
        best = min(logdet(x[list(s)]) for s in itertools.combinations(range(15), 12))
        assert found[0]["__det"] <= best + 0.05, (found[0]["__det"], best)
        m = np.array([found[0][f"__m{i}"] for i in range(Q.DIM)])
        assert np.abs(m - x[3:].mean(0)).max() < 0.5


def plain_judge(x, alpha, tail):
    """The same estimate in numpy for one group, by sorted distances instead of bins."""
    h = int(np.floor(alpha * len(x)))
    out = None
    for m, c in ((np.median(x, 0), np.diag(((np.percentile(x, 75, 0) - np.percentile(x, 25, 0)) / 1.349 + Q.FLOORS) ** 2)), (x.mean(0), np.cov(x.T, bias=True) + np.diag(np.square(Q.FLOORS)))):
        for _ in range(30):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            near = x[np.argsort(d, kind="stable")[:h]]
            m, c = near.mean(0), np.cov(near.T, bias=True) + np.diag(np.square(Q.FLOORS))
        if out is None or np.linalg.slogdet(c)[1] < np.linalg.slogdet(out[1])[1]:
            out = m, c
    m, c = out
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    return d / (alpha / Q.chi2_cdf(Q.chi2_quantile(alpha, Q.DIM), Q.DIM + 2))


def test_verdicts_against_a_plain_estimate(spark):
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))
    rows = [(i, prose(r.randint(40, 400)), "en", "s") for i in range(300)]
    rows += [(300 + i, " ".join(x + "%%%%%%%%" for x in prose(80).split()), "en", "s") for i in range(15)]
    rows += [(315 + i, prose(60) + "\n" + "\n".join([prose(4)] * r.randint(5, 9)), "en", "s") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {x["doc_id"]: x for x in Q.judge(df).collect()}
    good = [i for i in out if not out[i]["base_failed"]]
    stats = spark.createDataFrame([out[i].asDict() for i in good]).select("doc_id", *(c.alias(f"x{k}") for k, c in enumerate(Q.statistics()))).collect()
    x = np.array([[s[f"x{k}"] for k in range(Q.DIM)] for s in stats])
    want = dict(zip((s["doc_id"] for s in stats), plain_judge(x, 0.75, 1e-5), strict=True))
    limit = Q.chi2_quantile(1 - 1e-5, Q.DIM)
    differ = [i for i in good if (want[i] <= limit) != out[i]["kept"] and not 0.8 < want[i] / limit < 1.25]
    assert not differ, [(i, want[i], out[i]["distance"]) for i in differ]
    assert not any(out[i]["kept"] for i in range(300, 315)) and sum(not out[i]["kept"] for i in range(300)) <= 3


def test_a_verdict_does_not_depend_on_the_partitions(spark):
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh#") for _ in range(r.randint(1, 9))) for _ in range(n))
    df = spark.createDataFrame([(i, prose(r.randint(5, 120)), r.choice(["en", "de"]), r.choice(["s", "t"])) for i in range(200)], "doc_id long, text string, lang string, source string")
    seen = [sorted((x["doc_id"], x["kept"], None if x["distance"] is None else round(x["distance"], 6)) for x in Q.judge(d).collect()) for d in (df.repartition(1), df.repartition(7, "text"))]
    assert seen[0] == seen[1]


def test_long_texts_ties_and_clashing_columns(spark):
    long = "word " * 300_000
    rows = [(1, long, "en", "s", 7.0, "x"), (2, "a b c d e f g h i j k", "en", "s", 8.0, "y"), (2, "a b c d e f g h i j k", "en", "s", 8.0, "y"), (3, None, None, None, 9.0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, distance double, kept string")
    out = Q.judge(df).collect()
    assert len(out) == 4 and {x["doc_id"]: x["n_words"] for x in out} == {1: 300_000, 2: 11, 3: 0}
    assert [x["base_failed"] for x in sorted(out, key=lambda x: x["doc_id"])] == [True, False, False, True]
