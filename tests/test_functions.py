"""The literal cases of graders, segments and detectors."""

import math

import pytest
from pyspark.sql import functions as F

from tracelode.functions import grade as G
from tracelode.functions import reward as R
from tracelode.functions import text as T
from tracelode.functions import tokens as K
from tracelode.operators import groups as GR


def close(x):
    return f"<think>work</think>\n\n\\boxed{{{x}}}"


def test_strict_and_lenient(spark):
    rows = [("200", "0", True, False), ("90", "0", True, False), ("2", "42", True, False), ("200", "1200", True, False), ("20", "0", True, False), ("18", "18", True, True), ("-3", "-3", True, True), ("1,000", "1000", True, True), ("0.5", "1/2", True, True), ("1/2", "0.5", True, True), ("\\frac{1}{2}", "0.5", True, True), ("7", "8", False, False)]
    df = spark.createDataFrame([(close(p), g, a, s) for p, g, a, s in rows], "text string, gold string, a boolean, s boolean")
    for r in G.graded(df).collect():
        assert (r["as_scored"], r["strict"]) == (r["a"], r["s"]), r
        assert r["reason"] == ("" if r["s"] else "mismatch")


def test_extraction_ladder(spark):
    rows = [("<think>x</think>\nFinal Answer: 12.", "12"), ("<think>x</think><answer> 5 </answer>", "5"), ("a \\boxed{1} b \\boxed{2}", "1"), ("<think>\\boxed{1}</think>\n3\n\n 4 ", "4"), ("The answer is 7\nanswer: 8", "8"), ("", None), (None, None), ("  \n ", None), ("\\boxed{\\frac{1}{2}}", "\\frac{1}{2}"), ("\\boxed{}\nx", "")]
    df = spark.createDataFrame(rows, "text string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", G.extract_answer(F.col("text"))).collect())
    open_ = spark.createDataFrame([("\\boxed{4}", "4"), ("<think>a</think>\\boxed{4}", ""), ("<think>a</think>", "4")], "text string, gold string")
    assert [r["reason"] for r in G.graded(open_).collect()] == ["no_think_close", "no_gold", "no_answer_extracted"]


def test_wider_equivalence(spark):
    same = [("\\dfrac{3}{4}", "\\frac{3}{4}"), ("\\frac43", "4/3"), ("\\frac{\\pi}{3}", "\\pi / 3"), ("1.5 \\times 10^{3}", "1500"), ("30^\\circ", "30"), ("x = 5", "5"), ("x \\in [0,1]", "[0,1]"), ("(a)", "a"), ("\\text{yes}", "yes"), ("2 \\cdot 10^2", "200")]
    other = [("4", "5"), ("", ""), ("x = 5", "6"), ("3\\sqrt{2}", "3"), ("ab", "b")]
    df = spark.createDataFrame([(*p, True) for p in same] + [(*p, False) for p in other], "a string, b string, want boolean")
    for r in df.withColumn("got", G.equivalent(F.col("a"), F.col("b"))).collect():
        assert r["got"] == r["want"], r


def test_values_agree_has_three_values(spark):
    rows = [("4√2", "4\\sqrt{2}", True), ("1/2", "0.5", True), ("6200", "6600", False), ("x", "y", None), ("", "1", None), (None, "1", None), ("π", "\\pi", None), ("3 × 4", "3 \\times 4", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    for r in df.withColumn("got", R.values_agree(F.col("a"), F.col("b"))).collect():
        assert r["got"] == r["want"], r


def test_detectors(spark):
    ten = "\n" + "\n".join(["same line"] * 10)
    cases = [("<think>" + ten + "</think>x", "loop", True), ("<think>" + "\n".join(f"case {i}: y" for i in range(29)) + "</think>x", "loop", False), ("<think>" + "\n".join(f"case {i}: y" for i in range(31)) + "</think>x", "loop", True),
             ("<think>a</think>goal: x", "leak", True), ("<think>a</think>In this case: x", "leak", False), ("<think>a</think>Let: x", "leak", False), ("<think>a</think>so a ⇒ b", "leak", False), ("<think>a</think>\n ⇒ b", "leak", True),
             ("<think>⇒ a = 6,200</think>\\boxed{6600}", "contra", True), ("<think>⇒ a = 12</think>\\boxed{12}", "contra", False), ("<think>⇒ a</think>\\boxed{b}", "contra", False)]
    df = spark.createDataFrame([(t, n, w) for t, n, w in cases], "text string, name string, want boolean").withColumns({"think": G.thought(F.col("text")), "tail": G.tail(F.col("text"))})
    df = df.withColumns({"loop": R.loop(F.col("think")), "leak": R.leaks(F.col("tail")), "contra": R.contradicts(F.col("think"), F.col("tail"))})
    for r in df.collect():
        assert r[r["name"]] == r["want"], r
    rep = spark.createDataFrame([("151\n\n151\n\n151", 2), ("$$\n\n$$", 0), ("one\n\ntwo", 0), (None, 0)], "t string, want int")
    assert all(r["got"] == r["want"] for r in rep.withColumn("got", R.repeats(F.col("t"), R.ANSWER_REPEAT)).collect())


def test_reward_order(spark):
    """Right answers are above wrong ones, well-formed wrong ones above malformed ones, penalties never below the floor."""
    rows = [("<think>" + "a b c\n" * 9 + "</think>\\boxed{4}", 100, 288, 1), ("<think>" + "a b c\n" * 9 + "</think>\\boxed{4}", 900, 40, 1), ("<think>a</think>\\boxed{5}", 100, 288, 1), ("<think>" + "x\n" * 12 + "</think>goal: x\n\\boxed{5}", 100, 288, 1), ("<think>a", 100, 0, 0), ("<think>a</think>\\boxed{4}", 3, 288, 1)]
    df = spark.createDataFrame(rows, "text string, t int, a int, g int").withColumn("gold", F.lit("4"))
    got = [r["total"] for r in R.budget_reward(df, F.col("t"), F.col("a"), F.col("g"), F.lit(150.0)).collect()]
    assert got[0] == pytest.approx(1.35) and got[0] > got[1] > got[5] > got[2] and got[2] == pytest.approx(0.1) and got[3] == pytest.approx(0.1) and got[4] == 0
    assert min(got[0], got[1], got[5]) - max(got[2:5]) >= 0.3


def test_older_reward(spark):
    df = spark.createDataFrame([("<think>x</think>\n\\boxed{4}", "strict"), ("<think>x</think>\n1. a\n2. b\n3. c\n4. \\boxed{4}", "lenient"), ("<think>x</think>\n\\boxed{5}", "wrong"), ("<think>x</think>\n**Answer:** 4", "strict"), ("x 4", "wrong")], "text string, want string")
    for r in R.reward_v1(df.withColumn("gold", F.lit("4"))).collect():
        assert r["tier"] == r["want"], r


O, C, E = K.OPEN, K.CLOSE, K.EOS[0]


def test_segments(spark):
    rows = [
        ([1, O, 5, 6, C, 7, 8, E], 1, "ok", (2, 4, 5, 7)),
        ([1, O, 5], 1, "missing_think_close", (2, 3, -1, -1)),
        ([1, O, O, C, 7], 1, "duplicate_think_open", None),
        ([1, O, C, C, 7], 1, "duplicate_think_close", None),
        ([1, C, O, 7], 1, "close_before_open", None),
        ([1, 5, C, 7], 1, "missing_think_open", None),
        ([1, O, 5, C, E], 1, "empty_answer", (2, 3, 4, 4)),
        ([1, O, 5, C, 198, E], 1, "empty_answer", (2, 3, 4, 5)),
        ([O, C, 1, O, 5, C, 7], 3, "ok", (4, 5, 6, 7)),
    ]
    df = spark.createDataFrame([(i, p, w) for i, p, w, _ in rows], "ids array<int>, prompt int, want string")
    for r, (_, _, _, spans) in zip(df.withColumn("s", K.segments(F.col("ids"), F.col("prompt"), blanks=[198])).collect(), rows, strict=True):
        s = r["s"]
        assert s["reason"] == r["want"] and s["g"] == (s["reason"] == "ok"), r
        if spans:
            assert (s["think_start"], s["think_end"], s["answer_start"], s["answer_end"]) == spans


def test_text_functions(spark):
    r = spark.createDataFrame([("  a \u00a0 b\n\nc ", "x x yyy yyy yyy")], "t string, w string").select(T.norm_text(F.col("t")).alias("n"), T.uid(F.lit("s"), F.col("t")).alias("u"), T.word_stutter(F.col("w")).alias("k"), T.word_grams(F.col("t")).alias("g"), T.level_from_difficulty(F.lit(4.5)).alias("l"), T.shard(F.lit("abc"), 7).alias("h")).first()
    import hashlib

    assert r["n"] == "a b c" and r["u"] == "s:" + hashlib.sha1(b"a b c").hexdigest()[:8] and r["k"] == 2 and r["g"] == ["a b c"] and r["l"] == 5
    assert r["h"] == int(hashlib.md5(b"abc").hexdigest(), 16) % 7


def test_erfc(spark):
    for x in (0.0, 0.5, 1.0, 2.0, 4.0):
        assert abs(spark.range(1).select(GR.erfc(F.lit(x))).first()[0] - math.erfc(x)) < 2e-7


def test_promises_of_the_constants(spark):
    older, now = R.worst_case(), R.invariants()
    assert older["margin"] >= 0.30 and now["margin"] >= 0.30 and now["floor"] >= 0.10 and now["most_structure"] < 1.0


def test_a_missing_side_agrees(spark):
    df = spark.createDataFrame([(None, "3"), ("3", None), ("3", "3.0"), ("3", "4"), ("1,000", "1000")], "a string, b string")
    assert [r["ok"] for r in R.numerical_agree(df, "a", "b", "ok").collect()] == [True, True, True, False, True]


def test_hedged_ends(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("x The common answer is 3",), ("Or A. or 3",), ("common answer" + " z" * 300,), (None,)], "t string")
    assert [r[0] for r in df.select(R.meta_pattern(F.col("t"))).collect()] == [0.10, 0.10, 0.0, 0.0]
