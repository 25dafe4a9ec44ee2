import math
from collections import Counter

from pyspark.sql import functions as F

from tracelode.llm import sharding as S


def test_exact_sizes_and_slots(spark):
    df = spark.range(5003).select(F.col("id").alias("doc_id"), F.lit("a").alias("shard"), F.when(F.col("id") % 3 > 0, "same").alias("text"))
    out = S.uniform_shards(df, 40, seed=1, block_rows=64).collect()
    assert len(out) == 5003 and len({r["doc_id"] for r in out}) == 5003
    sizes = Counter(r["shard"] for r in out)
    assert sorted(sizes.values()) == [125] * 37 + [126] * 3
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    again = S.uniform_shards(df, 40, seed=1, block_rows=64).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_matrix_has_the_right_sums(spark):
    counts = spark.createDataFrame([(0, 10), (1, 0), (2, 33), (3, 7)], "block long, n long")
    rows = {r["block"]: r["sends"] for r in S.communication_matrix(spark, counts, 2, 4, 3).collect()}
    assert {b: sum(v) for b, v in rows.items()} == {0: 10, 1: 0, 2: 33, 3: 7}
    assert [sum(v[i] for v in rows.values()) for i in range(4)] == [13, 13, 12, 12]


def test_hypergeometric_draws(spark):
    """The draw at u is the least k whose distribution function is beyond u."""
    cases = [(20, 7, 5), (1000, 25, 500), (50, 50, 10), (50, 0, 10), (10, 3, 0), (10, 3, 10), (2, 1, 1), (100000, 2500, 50000)]
    for t, m, n in cases:
        df = spark.range(200).selectExpr("(id + 0.5D) / 200 AS u").selectExpr("u", f"{S.hypergeometric('u', f'{t}L', f'{m}L', f'{n}L')} AS k")
        lo, hi = max(0, n - (t - m)), min(n, m)
        weight = lambda k: math.exp(sum(math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1) for a, b in ((m, k), (t - m, n - k))) - (math.lgamma(t + 1) - math.lgamma(n + 1) - math.lgamma(t - n + 1)))
        total, cdf = 0.0, []
        for k in range(lo, hi + 1):
            total += weight(k)
            cdf.append((total, k))
        for u, k in df.collect():
            assert k == next((k for c, k in cdf if c > u + 1e-9), hi) or k == next((k for c, k in cdf if c > u - 1e-9), hi)


def test_shuffle_is_uniform(spark):
    """Rows of one source spread over the shards as a hypergeometric law says."""
    df = spark.range(8000).select("id")
    out = S.uniform_shards(df, 8, seed=5, block_rows=200)
    chi = sum((r["n"] - 125) ** 2 / 125 for r in out.filter("id < 1000").groupBy("shard").agg(F.count("*").alias("n")).collect())
    assert chi < 30
    order = out.filter("shard = 0").orderBy("slot").select("id").collect()
    ups = sum(a["id"] < b["id"] for a, b in zip(order, order[1:], strict=False))
    assert 400 < ups < 600


def test_nulls_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None, None)] * 50 + [(1, "a")] * 50, "doc_id long, text string")
    out = S.uniform_shards(df, 7, block_rows=8).collect()
    assert sorted(Counter(r["shard"] for r in out).values()) == [14] * 5 + [15] * 2
    assert S.uniform_shards(df.limit(0), 7).collect() == []
    assert S.uniform_shards(df.limit(3), 1).select("slot").orderBy("slot").collect() == [(0,), (1,), (2,)]
