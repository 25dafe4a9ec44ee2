import random

import numpy as np

from tracelode.llm import quality_mcd as Q


def counts(text, window=5):
    blanks = " \t\n\x0b\x0c\r"
    text = text or ""
    words = "".join(" " if c in blanks else c for c in text).split(" ")
    words = [w for w in words if w]
    at = {}
    for i in range(len(words) - window + 1):
        at.setdefault(tuple(words[i : i + window]), []).append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + window)}
    seen, dups, n = set(), 0, 0
    for line in text.split("\n"):
        if any(c not in blanks for c in line):
            n += 1
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(hit), n


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}é" for i in range(40)] + ["#", "<b>", " x"]
    texts = [None, "", " \n\t", "one", "a b c d e a b c d e", "x " * 200, "line\nline\n\nline \nline", "\x0ba\x0cb\r\nc"]
    for _ in range(60):
        w = [r.choice(words) for _ in range(r.randint(0, 120))]
        if r.random() < 0.5 and len(w) > 10:
            w += w[: r.randint(3, 10)]
        texts.append("".join(x + r.choice([" ", "  ", "\n", "\t"]) for x in w))
    return texts


def test_counts_against_a_plain_loop(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    out = sorted(Q.with_counts(df).collect())
    assert [tuple(r[c] for c in Q.COUNTS) for r in out] == [counts(t) for t in texts]


def test_distance_is_the_inverse_covariance(spark):
    r = np.random.default_rng(2)
    x, m = r.normal(size=(4, Q.DIM)), r.normal(size=Q.DIM)
    a = r.normal(size=(Q.DIM, 20))
    cov = a @ a.T / 20 + np.eye(Q.DIM)
    row = {f"__m{i}": float(m[i]) for i in range(Q.DIM)} | {f"__c{i}{j}": float(cov[i, j]) for i, j in Q._pairs()}
    g = Q.factored(spark.createDataFrame([row]))
    rows = spark.createDataFrame([{"k": k} | {f"__x{i}": float(v[i]) for i in range(Q.DIM)} for k, v in enumerate(x)])
    got = {r["k"]: r["__d2"] for r in Q.with_distance2(rows.crossJoin(g)).collect()}
    for k, v in enumerate(x):
        assert abs(got[k] - (v - m) @ np.linalg.inv(cov) @ (v - m)) < 1e-8


def test_chi_squared():
    assert abs(Q.chi2_cdf(11.0705, 5) - 0.95) < 1e-5 and abs(Q.chi2_quantile(0.99, 5) - 15.0863) < 1e-3


def test_outliers_go_and_the_others_stay(spark):
    r = random.Random(3)
    prose = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(r.randint(60, 300)))
    rows = [(i, prose(), r.choice(["en", None]), "s") for i in range(900)]
    rows += [(900 + i, " ".join(x + "%%%%%%%" for x in prose().split()), "en", "s") for i in range(30)]
    rows += [(1000, None, "en", "s"), (1001, prose(), "xx", None), (0, rows[0][1], rows[0][2], "s")]
    out = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(out) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert sum(not kept[i] for i in range(900)) <= 2 and not any(kept[900 + i] for i in range(30))
    assert not kept[1000] and kept[1001]
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_small_groups_have_an_estimate(spark):
    r = random.Random(4)
    prose = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(r.randint(60, 300)))
    rows = [(i, prose(), r.choice(["en", "de", "fr"]), r.choice(["s", "t"])) for i in range(150)]
    rows += [(150 + i, " ".join(x + "%%%%%%%" for x in prose().split()), "en", "s") for i in range(6)]
    rows += [(156, " ".join(x + "%%%%%%%" for x in prose().split()), "xx", "u")]
    out = {r["doc_id"]: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all((r["distance"] is None) == r["base_failed"] for r in out.values())
    assert not any(out[i]["kept"] for i in range(150, 157)) and sum(not out[i]["kept"] for i in range(150)) <= 2
