import random

from tracelode.llm import minhash as M


def sets_of(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(texts, n, percent=80):
    sets, root = sets_of(texts, n), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \n\t ", "One", "one ", "two words", "TWO words", "É a", "é a"]
    for size, copies, edits in ((100, 60, 10), (40, 20, 3), (300, 30, 24), (12, 9, 1)):
        base = prose(size)
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(r.choice([" ", "  "]).join(w))
        texts += [" ".join(base)] * 5
    chain = prose(80)  # each is close to the next, the ends aren't
    for i in range(30):
        chain = list(chain)
        for k in range(3):
            chain[(7 * i + k) % 80] = r.choice(vocabulary)
        texts.append(" ".join(chain))
    texts += [" ".join(prose(r.randint(1, 60))) for _ in range(150)]
    return texts


def components(spark, texts, n, **options):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(3)
    return sorted(map(tuple, M.with_components(M.near_duplicates(df, n=n, **options)).collect()))


def test_against_all_pairs(spark):
    for seed, n in ((1, 2), (2, 5)):
        texts = corpus(seed)
        assert components(spark, texts, n) == brute(texts, n)


def test_large_buckets_of_few_links(spark):
    texts = corpus(4)
    # one minhash for each key: buckets are large, and most of their pairs are no links
    assert components(spark, texts, 2, m=6, t=1) == brute(texts, 2)


def test_one_row_of_each_component_stays(spark):
    texts = corpus(6)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, texts[9]), (1, "")], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in M.drop_near_duplicates(df, n=2).collect())
    assert kept == sorted([i for i, _, _, k in brute(texts, 2) if k] + [1])


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, "same text here"), (5, "same text here"), (None, None)], "doc_id long, text string")
    rows = sorted(map(tuple, M.with_components(M.near_duplicates(df, n=2)).collect()), key=str)
    assert rows == sorted([(None, 2, 5, False), (5, 2, 5, True), (None, 0, None, True)], key=str)
    assert M.near_duplicates(df.limit(0)).collect() == []


def test_nothing_is_broadcast(spark, monkeypatch):
    """The planner takes a node's hundred keys for one row, so a table of buckets went to the driver as a whole."""
    plans, write = [], M.materialise
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(M, "materialise", lambda df, name: (plans.append((name, shown(df))), write(df, name))[1])
    df = spark.createDataFrame(list(enumerate(corpus(4))), "doc_id long, text string")
    plans.append(("result", shown(M.near_duplicates(df, n=2, m=3, t=1))))
    assert {"active", "texts", "links", "pairs", "edges", "named"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []
