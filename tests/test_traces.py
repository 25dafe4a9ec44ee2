"""Rewritten traces, shaping, probabilities, joins and streams on small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracelode.functions import probs as L
from tracelode.functions import shaping as H
from tracelode.functions import structure as S
from tracelode.functions import text as T
from tracelode.operators import groups as GR
from tracelode.operators import pool as P
from tracelode.operators import traces as O


def value(spark, column, **cells):
    names = list(cells)
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


def test_anchors_by_count_and_first_place(spark):
    df = spark.createDataFrame([(["7", "3", "3", "7", "1", "9", "9", "9"],), ([],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(S.most_common("v", 2, 2)).collect()] == [["9", "7"], [], []]


def test_numbers_keep_groups_and_part_lists(spark):
    assert value(spark, S.numbers(F.col("t")), t="from 4,5: 1,234.5 and -2,000 or 12,34") == ["4", "5", "1234.5", "-2000", "12", "34"]


def test_without_a_source_nothing_is_claimed(spark):
    df = spark.createDataFrame([(1, None, "case 1: x"), (2, "", None), (3, "Actually 5 and 5", "✗ 5")], "k int, origin string, compact string")
    out = {r["k"]: r for r in S.annotated(df).collect()}
    assert out[1]["branch_kept"] is None and out[1]["compact_has_branch"] and out[2]["value_coverage"] is None
    assert out[3]["branch_kept"] and out[3]["src_has_branch"] and out[3]["value_coverage"] == 1.0


ONE_SHOT = [
    ("```\ngoal: x\n⇒ 3\n```\n**Final Answer** 3", "goal: x\n⇒ 3", ["fence_trailer"]),
    ("  goal: x\n    ⇒ 3  \n\n", "goal: x\n  ⇒ 3", []),
    ("goal: x\n\\boxed{3}\nmore", "goal: x", ["boxed_in_think"]),
    ("goal: x\n---\n$$", "goal: x", []),
    ("### Final answer: 3", "", ["final_answer_trailer"]),
    ("", "", ["empty"]),
    ("```\n```", "", ["empty"]),
]


@pytest.mark.parametrize("raw,text,flags", ONE_SHOT)
def test_one_shot(spark, raw, text, flags):
    r = value(spark, H.one_shot(F.col("t")), t=raw)
    assert (r["text"], r["flags"]) == (text, flags)


def chunked(text, most):
    import re

    tokens = lambda s: max(1, len(s) // 4)
    out, cur, n = [], "", 0
    for p in [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]:
        for x, sep in ([(s, " ") for s in re.split(r"(?<=[.!?])\s+", p)] if tokens(p) > most else [(p, "\n\n")]):
            if cur and n + tokens(x) > most:
                out.append(cur)
                cur, n = x, tokens(x)
            else:
                cur = (cur + sep + x).strip() if cur else x
                n = tokens(cur)
    return [*out, cur] if cur else out


def test_chunks(spark):
    r = random.Random(1)
    for _ in range(12):
        text = "\n\n".join(" ".join("w" * r.randint(1, 9) + r.choice(["", "", ".", "!"]) for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 6)))
        assert value(spark, H.chunks_by_size(F.col("t"), 20), t=text) == chunked(text, 20)


def test_conclusions_labels_and_verdicts(spark):
    assert value(spark, H.without_conclusion(F.col("t")), t="⇒ a\nb\n⇒ c\n\nAnswer: 3\n") == "⇒ a\nb"
    text, n = H.replace_labels(F.col("t"), [("goal:", "Okay, so"), ("let:", None)])
    r = value(spark, F.struct(text.alias("t"), n.alias("n")), t="  goal: find x\nno goal:\nlet:  y")
    assert (r["t"], r["n"]) == ("  Okay, so find x\nno goal:\ny", 2)
    fields = "preserves_self_correction boolean, faithful boolean, preserves_load_bearing boolean, compact_register boolean, compression_quality int"
    df = spark.createDataFrame([((None, True, True, True, 3),), ((False, True, True, True, 5),), ((True, None, True, True, 5),), ((True, True, True, True, 2),)], f"a struct<{fields.replace(' boolean', ':boolean').replace(' int', ':int')}>")
    assert [r[0] for r in df.select(H.audit_verdict(F.col("a"))).collect()] == ["pass", "fail", "fail", "fail"]


def test_entropy_and_temperature(spark):
    x = [3.0, 1.0, 0.5, -2.0, 2.5]
    df = spark.createDataFrame([(x, 1.2), (x, 0.1), (x, 5.0)], "x array<double>, target double")

    def h(tau, k=5):
        v = sorted(x, reverse=True)[:k]
        z = [math.exp(a / tau) for a in v]
        return -sum(a / sum(z) * math.log(a / sum(z)) for a in z)

    got = df.select(L.entropy(F.col("x"), 1.3, 3).alias("h"), L.temperature(F.col("x"), F.col("target")).alias("t")).collect()
    assert abs(got[0]["h"] - h(1.3, 3)) < 1e-12 and abs(got[1]["t"] - 1.1) < 1e-5 and abs(got[2]["t"] - 1.5) < 1e-5


def test_payloads(spark):
    entry = lambda **x: {int(k[1:]): v for k, v in x.items()}
    rows = [
        ([5, 6], [None, entry(t6=(-1.0, 2), t7=(-0.5, 1))], None),
        ([5, 6], [None, None], "no entry"),
        ([5, 6], [None], "length"),
        ([5, 6], [None, entry(t7=(-0.5, 1))], "actual token missing"),
        ([5, 6], [None, entry(t6=(-0.5, 2), t7=(-1.0, 1))], "rank 1 is not the best"),
        ([5], [None], None),
    ]
    df = spark.createDataFrame([(i, p) for i, p, _ in rows], "ids array<int>, p array<map<int, struct<logprob: double, rank: int>>>")
    got = [r[0] for r in df.select(L.payload_scores(F.col("ids"), F.col("p"))).collect()]
    assert [g["problem"] for g in got] == [p for _, _, p in rows]
    assert got[0]["surprisal"] == [None, 1.0] and got[0]["gap"] == [None, 0.5] and got[5]["gap"] == [None]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_mean_jaccard_of_all_pairs(spark):
    r = random.Random(5)
    rows = [(g, i, [r.choice("abcdefgh") for _ in range(r.randint(0, 6))]) for g in range(8) for i in range(r.randint(1, 6))]
    rows = [(g, i, sorted(set(s))) for g, i, s in rows]
    want = {}
    for g in range(8):
        sets = [set(s) for h, _, s in rows if h == g and s]
        pairs = [jaccard(a, b) for k, a in enumerate(sets) for b in sets[k + 1 :]]
        if pairs:
            want[g] = sum(pairs) / len(pairs)
    got = {x["gid"]: x["jaccard"] for x in GR.mean_jaccard(spark.createDataFrame(rows, "gid int, member int, grams array<string>"), "gid", "member", "grams").collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-12 for g in want)


def test_near_pairs_against_all_pairs(spark):
    r = random.Random(9)
    shared = [f"s{i}" for i in range(60)]  # what very many hold
    texts = [" ".join(r.choice("abcdef") + str(r.randint(0, 3)) for _ in range(r.randint(0, 30))) for _ in range(25)]
    for _ in range(15):
        base = shared + [f"t{r.randint(0, 5)}" for _ in range(12)]
        if r.random() < 0.5:
            base[r.randrange(len(base))] = "x"
        texts.append(" ".join(base))
    texts += [texts[-1], texts[-1], texts[3], "", None]
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        g = frozenset(" ".join(w[k : k + 8]) for k in range(len(w) - 7)) if len(w) >= 8 else frozenset([" ".join(w)] if w else [])
        if g:
            sets.setdefault(g, []).append(i)
    heads = [(min(v), g) for g, v in sets.items()]
    want = {(min(v), d) for v in sets.values() for d in v if d != min(v)}
    want |= {(min(a, b), max(a, b)) for k, (a, x) in enumerate(heads) for b, y in heads[k + 1 :] if jaccard(x, y) > 0.8}
    got = P.near_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(x["doc_a"], x["doc_b"]) for x in got} == want and len(got) == len(want)


def test_contamination_of_odd_texts(spark):
    item = " ".join(f"w{i}" for i in range(30))
    evals = spark.createDataFrame([(1, item), (2, "!!"), (3, ""), (4, item)], "item_id long, text string")
    rows = [(1, " " * 3000 + item.upper()), (2, "!!"), (3, None), (4, item + " more"), (5, "other"), (6, "??"), (7, item + " " + "x " * 500)]
    got = {(r["doc_id"], r["kind"], r["item_id"]) for r in P.contamination(spark.createDataFrame(rows, "doc_id long, text string"), evals).collect()}
    assert got == {(1, "exact", 1), (2, "exact", 2), (3, "exact", 3), (4, "near", 1)}


def test_beginnings_of_keys(spark):
    texts = ["", None, "a" * 500, " \n" * 1500 + "b c" * 300, "x \t y " * 400, "é" * 401]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for a, b in df.select(T.match_head(F.col("t"), 400), F.substring(T.match_key(F.col("t")), 1, 400)).collect():
        assert a == b


def test_first_of_a_hot_key(spark):
    df = spark.range(5000).select((F.col("id") % 10 == 0).cast("int").alias("k"), F.md5(F.col("id").cast("string")).alias("h"), "id")
    got = {r["id"] for r in P.top_by(df, ["k"], ["h", "id"], F.lit(7)).collect()}
    want = {r["id"] for k in (0, 1) for r in df.filter(F.col("k") == k).orderBy("h", "id").limit(7).collect()}
    assert got == want


def test_drafts_joined_with_scores(spark):
    d = spark.createDataFrame([("a", 0, 1, None), ("a", 1, 2, None), ("b", 0, 1, "gate"), ("b", 1, 1, None), ("c", 0, 1, None)], "uid string, k int, round int, reject string")
    s = spark.createDataFrame([("a", 0, 1, None, 1.0, 1), ("a", 1, 2, "x", 1.0, 1), ("a", 1, 2, None, 3.0, 2), ("c", 0, 1, "long", None, 1)], "uid string, k int, round int, skip string, score double, line int")
    out = O.scored(d, s)
    assert {(r["uid"], r["k"]): r["reason"] for r in out.collect()} == {("a", 0): None, ("a", 1): None, ("b", 0): "gate", ("b", 1): "unscored", ("c", 0): "score_long"}
    kept = O.highest_round(out.filter("reason IS NULL")).collect()
    assert [(r["uid"], r["k"], r["score"]) for r in kept] == [("a", 1, 3.0)]
    problems = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "uid string")
    got = {r["uid"]: [(x["reason"], x["n"]) for x in r["reasons"]] for r in O.unserved(problems, out).collect()}
    assert got == {"b": [("gate", 1), ("unscored", 1)], "c": [("score_long", 1)]}


def test_refusals(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "uid string"), spark.createDataFrame([("x",)], "uid string")
    assert O.present(b, a).count() == 1
    with pytest.raises(Exception, match="1 aren't in the pool"):
        O.present(a, b).collect()
    src = spark.createDataFrame([("s", "q", "1")], "suite string, question string, answer string")
    assert O.eval_pool([src], {"s": 1}).count() == 1
    with pytest.raises(Exception, match="pinned"):
        O.eval_pool([src], {"s": 2}).collect()


def test_a_shared_folder_is_asked_for_on_a_cluster():
    from tracelode import tables

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        tables.shared_root(Session(), "x")
