import hashlib
import random

from tracelode.llm import suffix_dedup as S


def brute(texts, length):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    hit = [bytearray(len(t)) for t in texts]
    for where in seen.values():
        if len(where) > 1:
            for d, i in where:
                hit[d][i : i + length] = b"\1" * length
    out = []
    for t, h in zip(texts, hit, strict=True):
        kept = bytes(c for c, x in zip(t, h, strict=True) if not x)
        runs = sum(1 for i in range(len(h)) if h[i] and (i == 0 or not h[i - 1]))
        out.append((len(t), sum(h), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(90) for _ in range(6)]
    texts = [None, "", "x", "a" * 1500, "ab" * 700, "a" * 399, prose(100)[:400]]
    for _ in range(60):
        parts = [prose(r.randint(5, 120))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, 80)
            parts += [s[a : a + r.randint(380, 460)], prose(r.randint(1, 60))]
        texts.append(r.choice(["", " "]).join(parts))
    base = prose(400)
    for _ in range(25):  # near copies
        w = base.split(" ")
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [texts[10], texts[10], texts[10]]
    return texts


def run(spark, texts, **options):
    df = spark.createDataFrame([(i, t, f"x{i}", "d", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, doc string, own int").repartition(3)
    rows = S.remove_repeats(df, **options).collect()
    return [(r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_against_all_strings(spark):
    texts = corpus()
    want = brute([(t or "").encode() for t in texts], 400)
    assert run(spark, texts) == want
    assert sum(w[1] > 0 for w in want) > 40


def test_hot_buckets_are_dealt_and_whole(spark):
    texts = corpus(5)
    assert run(spark, texts, hot=3) == brute([(t or "").encode() for t in texts], 400)


def test_shorter_strings(spark):
    texts = corpus(7)
    assert run(spark, texts, length=128) == brute([(t or "").encode() for t in texts], 128)


def test_repeated_rows_nulls_and_no_rows(spark):
    long = "word " * 10 + "".join(map(str, range(400)))
    df = spark.createDataFrame([(1, long), (1, long), (None, None), (2, "short")], "doc_id long, text string")
    rows = {(r["doc_id"], r["n_bytes"]): r for r in S.remove_repeats(df).collect()}
    assert rows[1, len(long)]["kept"] == b"" and rows[1, len(long)]["n_removed"] == len(long)
    assert rows[None, 0]["n_removed"] == 0 and rows[2, 5]["kept"] == b"short"
    assert S.remove_repeats(df.limit(0)).collect() == []
