import random

from pyspark.sql import functions as F

from tracelode.operators import groups as G
from tracelode.operators import pool as P
from tracelode.operators import select as S
from tracelode.plans import files, groups


def test_pairs_are_judged_by_whole_texts(spark):
    opening = " ".join(f"open{i}" for i in range(80))
    rest = [" ".join(f"{x}{i}" for i in range(400)) for x in "abc"]
    rows = [(1, f"{opening} {rest[0]}"), (2, f"{opening} {rest[1]}"), (3, f"one other start {rest[2]}"), (4, f"two words more to begin with {rest[2]}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r["doc_a"], r["doc_b"]) for r in P.near_pairs(df).collect()] == [(3, 4)]
    assert (1, 2) in [(r["doc_a"], r["doc_b"]) for r in P.near_pairs(df, first_chars=400).collect()]


def chosen(rows, adds, most=3, change=0.3):
    """The reference's loop, as a plain function."""
    rows = sorted(rows, key=lambda r: (r["worse"], r["k"]))
    kept = [rows[0]]

    def far(x, y):
        low, high = sorted((x["think_len"], y["think_len"]))
        return x["signature"] != y["signature"] or (low > 0 and (high - low) / low >= change)

    for first in (True, False):
        for c in rows[1:]:
            if len(kept) >= most or c in kept:
                continue
            if first and not any(c[p] and not any(y[p] for y in kept) for p in adds):
                continue
            if all(far(c, y) for y in kept):
                kept.append(c)
    return [(place, c["k"], rows.index(c) + 1) for place, c in enumerate(kept)]


def test_diverse_choice_against_a_plain_loop(spark):
    r = random.Random(5)
    row = lambda u, k, sig, n, p=False, q=False: {"uid": u, "k": k, "worse": r.random(), "signature": sig, "think_len": n, "p": p, "q": q}
    rows = [row(u, k, r.choice("ab"), r.randint(0, 30), r.random() < 0.1, r.random() < 0.1) for u in range(40) for k in range(r.randint(1, 30))]
    # 200 alike, and one that differs behind them; lengths 10 and 13 differ by 0.3 of the shorter.
    rows += [row(100, k, "a", 10) | {"worse": float(k)} for k in range(200)] + [row(100, 200, "b", 10) | {"worse": 200.0}, row(100, 201, "a", 13) | {"worse": 201.0}]
    df = spark.createDataFrame(rows, "uid long, k long, worse double, signature string, think_len int, p boolean, q boolean")
    for adds in ((), ("p", "q")):
        out = {}
        for x in S.diverse(df, ["worse", "k"], adds=adds).collect():
            out.setdefault(x["uid"], []).append((x["place"], x["k"], x["rank"]))
        assert {u: sorted(v) for u, v in out.items()} == {u: chosen([x for x in rows if x["uid"] == u], adds) for u in {x["uid"] for x in rows}}


def test_diverse_by_word_runs(spark):
    rows = [(1, 0, "a", 10, ["x", "y"]), (1, 1, "a", 10, ["x", "y"]), (1, 2, "a", 10, ["z"])]
    df = spark.createDataFrame(rows, "uid long, k long, signature string, think_len int, runs array<string>")
    assert sorted(x["k"] for x in S.diverse(df, ["k"], grams="runs").collect()) == [0, 2]


def test_shared_draws_are_as_many_as_the_least(spark):
    df = spark.createDataFrame([(u, k) for u, n in ((1, 2), (2, 5), (3, 3)) for k in range(n)], "uid long, k int")
    assert sorted(tuple(x) for x in G.shared_draws(df).collect()) == [(u, k) for u in (1, 2, 3) for k in (0, 1)]


def test_budget_over_blocks_is_the_fold(spark):
    import random

    r = random.Random(4)
    rows = [(run, step, r.randint(1, 5), r.choice([5.0, 50.0])) for run in "ab" for step in r.sample(range(2000), 300)]
    got = {(x["run"], x["step"]): x["budget"] for x in G.anneal(spark.createDataFrame(rows, "run string, step long, n int, std double"), "step", 400.0, block=37).collect()}
    for run in "ab":
        budget = 400.0
        for _, step, n, std in sorted(x for x in rows if x[0] == run):
            if n < 2 or std >= 40.0:
                budget = max(120.0, budget * 0.995)
            assert abs(got[run, step] - budget) < 1e-9


def test_rows_in_turn(spark):
    df = spark.createDataFrame([(i, "abc"[min(i % 7, 2)]) for i in range(60)], "id long, cell string")
    got = [(x["cell"], x["id"]) for x in P.round_robin(df, "cell", [F.col("id")], 8).collect()]
    cells = {c: sorted(i for i in range(60) if "abc"[min(i % 7, 2)] == c) for c in "abc"}
    want = [(c, cells[c][t]) for t in range(3) for c in "abc"][:8]
    assert got == want


def test_sums_below_in_blocks(spark):
    r = random.Random(2)
    rows = [(float(x), r.randint(0, 5)) for x in r.sample(range(-500, 500), 200)]
    got = {x["x"]: x["n_below"] for x in G.sums_below(spark.createDataFrame(rows, "x double, n int"), "x", ["n"], blocks=9).collect()}
    assert got == {x: sum(n for y, n in rows if y < x) for x, _ in rows}
    assert G.sums_below(spark.createDataFrame([], "x double, n int"), "x", ["n"]).collect() == []


def test_gap_of_rewards_is_what_decimals_give(spark):
    rest = "false AS closed, 10 AS chars, '' AS final, 0 AS restarts, 0 AS hedges, false AS contradicted, false AS by_prose, array('a') AS grams"
    rows = "(1, 1, 'strict', 1.1184D), (1, 2, 'strict', 1.218975D), (1, 3, 'lenient', 0.22D), (2, 1, 'strict', 1.1184D), (2, 2, 'strict', 1.218875D), (2, 3, 'lenient', 0.79D)"
    df = spark.sql(f"SELECT gid, member, tier, total, 1.0D AS accuracy, total AS fmt, {rest} FROM VALUES {rows} AS t(gid, member, tier, total)")
    got = {x["gid"]: x["gap"] for x in G.diagnostics(df).select("gid", F.round("strict_vs_lenient_gap", 6).alias("gap")).collect()}
    assert got == {1: 0.948688, 2: 0.378638}  # of 0.9486875 and 0.3786375


def test_budgets_where_deviations_are_just_at_the_limit(spark, tmp_path):
    r, lengths = random.Random(3), [21, 36, 30, 34, 34, 41, 27, 12, 11]  # a variance of 100, which running means give as less in some orders
    rows = [(uid, i, 1, i, float(x), 1.0, 0.0, 0.0, "R", "F") for uid in range(200) for i, x in enumerate(r.sample(lengths, len(lengths)))]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(uid, "1-URGENT", "F") for uid in range(200)], "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [(x["run"], x["moves"]) for x in files.budget_stream(spark, str(tmp_path)).collect()] == [("1", 200)]
    budgets = [x["budget"] for x in groups.think_budget_anneal(spark, str(tmp_path)).sort("uid").collect()]
    assert budgets == [round(400 * 0.995**i, 6) for i in range(1, 201)]
