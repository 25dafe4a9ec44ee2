"""Queries over log-probabilities, logits and built sequences of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import probs as L
from tracelode.functions import structure as S
from tracelode.functions import text as T
from tracelode.functions import tokens as K
from tracelode.plans.grading import IDS_SQL, SEGMENTS_SQL, sequences
from tracelode.plans.traces import TRACES_SQL, traces
from tracelode.tables import CANDIDATES_SQL as CAND
from tracelode.tables import candidates, table


def payload_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surprisal and gap of each token from a payload of candidates, and which contract a broken one breaks."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")).withColumn("ids", F.expr("transform(sequence(0, 3), i -> cast(10 + i + key % 3 AS int))"))
    entry = """CASE WHEN i = 2 AND key % 17 = 1 THEN NULL ELSE map(cast(CASE WHEN i = 1 AND key % 13 = 1 THEN 99 ELSE ids[i] END AS int), named_struct('logprob', -(key % 7 + i) / 4.0D, 'rank', CASE WHEN (key + i) % 2 = 0 THEN 1 ELSE 3 END),
 5, named_struct('logprob', CASE WHEN key % 19 = 1 THEN -9.0D WHEN (key + i) % 2 = 0 THEN -(key % 7 + i) / 4.0D - 1 ELSE -(key % 7 + i) / 4.0D + 0.5D END, 'rank', CASE WHEN (key + i) % 2 = 0 THEN 2 ELSE 1 END)) END"""
    o = o.withColumn("payload", F.expr(f"transform(sequence(0, CASE WHEN key % 11 = 1 THEN 2 ELSE 3 END), i -> {entry})"))
    s = o.select("key", L.payload_scores(F.col("ids"), F.col("payload")).alias("s"))
    total = lambda c: F.round(F.aggregate(F.slice(c, 2, 9), F.lit(0.0), lambda a, x: a + x), 6)
    return s.select("key", total(F.col("s.surprisal")).alias("surprisal"), total(F.col("s.gap")).alias("gap"), F.col("s.problem").alias("problem"))


PAYLOAD_SQL = """WITH o AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 11 = 1 THEN 3 ELSE 4 END AS n FROM orders), t AS (SELECT key, n, unnest(range(1, 4)) AS i FROM o),
x AS (SELECT *, i = 2 AND key % 17 = 1 AS none, i = 1 AND key % 13 = 1 AS missing, (key + i) % 2 = 0 AS first, -(key % 7 + i) / 4.0 AS own FROM t),
y AS (SELECT *, CASE WHEN first THEN 0.0 ELSE CASE WHEN key % 19 = 1 THEN -9.0 ELSE own + 0.5 END - own END AS gap FROM x),
g AS (SELECT key, any_value(n) AS n, bool_or(none) AS none, bool_or(missing) AS missing, bool_or(gap < -1e-6) AS negative, sum(-own) AS s, sum(greatest(gap, 0.0)) AS d FROM y GROUP BY 1),
p AS (SELECT *, CASE WHEN n <> 4 THEN 'length' WHEN none THEN 'no entry' WHEN missing THEN 'actual token missing' WHEN negative THEN 'rank 1 is not the best' END AS problem FROM g)
SELECT key, CASE WHEN problem IS NULL THEN round(s, 6) END AS surprisal, CASE WHEN problem IS NULL THEN round(d, 6) END AS gap, problem FROM p"""

_logits = "transform(sequence(0, 11), i -> (key * (i + 3)) % 23 / 4.0D)"


def topk_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entropy of the greatest eight of twelve logits, and the temperature at which it is a target; targets beyond the range end at its ends."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("key")).withColumn("x", F.expr(_logits))
    return o.select("key", F.round(L.entropy(F.col("x"), 1.0, 8), 6).alias("entropy"), F.round(L.temperature(F.col("x"), F.lit(0.6) + (F.col("key") % 10) / 8), 5).alias("tau"))


def _h(x: str, t: str) -> str:
    """The entropy of logits at a temperature, in SQL."""
    e = f"list_transform({x}, lambda v: exp((v - list_max({x})) / {t}))"
    w = f"list_transform({x}, lambda v: exp((v - list_max({x})) / {t}) * (v - list_max({x})) / {t})"
    return f"ln(list_sum({e})) - list_sum({w}) / list_sum({e})"


TOPK_SQL = f"""WITH RECURSIVE o AS (SELECT o_orderkey AS key, list_transform(range(0, 12), lambda i: (o_orderkey * (i + 3)) % 23 / 4.0) AS x, 0.6 + (o_orderkey % 10) / 8 AS target FROM orders WHERE o_orderkey % 5 = 0),
b AS (SELECT key, x, CAST(target AS double) AS target, CAST(1.1 AS double) AS lo, CAST(1.5 AS double) AS hi, 0 AS i FROM o UNION ALL
 SELECT key, x, target, CASE WHEN {_h('x', '((lo + hi) / 2)')} < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_h('x', '((lo + hi) / 2)')} < target THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM b WHERE i < 20),
t AS (SELECT key, list_sort(x, 'DESC')[1:8] AS x FROM o)
SELECT b.key, round({_h('t.x', '1.0')}, 6) AS entropy, round((lo + hi) / 2, 5) AS tau FROM b JOIN t ON b.key = t.key WHERE i = 20"""


def delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of log-probabilities by level and of all, by nearest rank; infinite ones are counted, not ranked."""
    c = candidates(spark, sf_dir).withColumn("d", F.when((F.col("k") == 2) & (F.col("uid") % 5 == 0), float("-inf")).when(F.col("k") == 5, None).otherwise(F.round(F.col("discount") - F.col("tax"), 4)))
    c = c.filter("d IS NOT NULL").withColumn("x", F.when(F.col("d") != float("-inf"), F.col("d")))
    places = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    return c.rollup("level").agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("n_neg_inf"), F.min("x").alias("least"), *(T.percentile_nearest("x", p).alias(n) for n, p in places.items()), F.max("x").alias("most"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.count_if(F.col("x") > 0.02) / F.count("x"), 6).alias("pass_rate")).withColumn("level", F.coalesce("level", F.lit("ALL")))


_place = lambda p: f"s[least(CAST(floor(len(s) * {p}) AS int), len(s) - 1) + 1]"
DELTA_SQL = f"""WITH {CAND}, d AS (SELECT level, CASE WHEN k = 2 AND uid % 5 = 0 THEN NULL ELSE round(discount - tax, 4) END AS x FROM cand WHERE k <> 5 OR (k = 2 AND uid % 5 = 0)),
a AS (SELECT level, x FROM d UNION ALL SELECT 'ALL', x FROM d), g AS (SELECT level, count(x) AS n, count(*) - count(x) AS n_neg_inf, list_sort(list(x) FILTER (x IS NOT NULL)) AS s, avg(x) AS mean, count(*) FILTER (x > 0.02) AS good FROM a GROUP BY 1)
SELECT level, n, n_neg_inf, s[1] AS least, {_place(0.05)} AS p05, {_place(0.25)} AS p25, {_place(0.5)} AS median, {_place(0.75)} AS p75, {_place(0.95)} AS p95, s[-1] AS most, round(mean, 6) AS mean, round(good / n, 6) AS pass_rate FROM g"""


def gap_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of gaps of the tokens of each class of marks, of all marked ones, and of all; a token may be of no class."""
    c = candidates(spark, sf_dir).select((F.col("think_len") / 10.0).alias("gap"), F.when(F.col("k") % 4 == 0, "structural").when(F.col("k") % 4 == 1, "branch").alias("class"))
    named = c.select("gap", F.explode(F.array_compact(F.array(F.col("class"), F.when(F.col("class").isNotNull(), F.lit("marked")), F.lit("all")))).alias("class"))
    return named.groupBy("class").agg(F.count("*").alias("n"), F.percentile("gap", [0.5, 0.95, 0.99]).alias("p"), F.avg("gap").alias("m")).select("class", "n", *(F.round(F.col("p")[i], 6).alias(f"p{q}") for i, q in enumerate((50, 95, 99))), F.round("m", 6).alias("mean"))


def arm_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each arm: thought, compression against the source, marks for each 100 tokens, stalled lines; only well-formed rollouts count, the others are counted."""
    t = traces(spark, sf_dir).withColumn("arm", F.concat(F.lit("arm"), F.col("k") % 3))
    ok = lambda c: F.when(F.col("g") == 1, c)
    t = t.withColumns({"ratio": F.col("think_len") / F.greatest(F.lit(1), F.length("origin")), "marked": 100.0 * S.register_marks(F.col("compact")) / F.greatest(F.lit(1), F.col("think_len")), "stalled": S.stalled_rate(F.split("compact", "\n", -1))})
    card = lambda c: [F.round(F.percentile(ok(F.col(c)), 0.5), 6).alias(f"{c}_median"), F.round(F.percentile(ok(F.col(c)), 0.25), 6).alias(f"{c}_p25"), F.round(F.percentile(ok(F.col(c)), 0.75), 6).alias(f"{c}_p75"), F.round(F.avg(ok(F.col(c))), 6).alias(f"{c}_mean")]
    return t.groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("g") == 0).alias("gate_fail"), F.count_if("strict").alias("verified"), *(x for c in ("think_len", "ratio", "marked", "stalled") for x in card(c)), F.round(F.avg(ok((F.col("think_len") < 30).cast("int"))), 6).alias("under_target"), F.round(F.avg(ok((F.col("stalled") >= 0.5).cast("int"))), 6).alias("mostly_stalled"))


_four = lambda c: f"round(quantile_cont({c}, 0.5) FILTER (g = 1), 6) AS {c}_median, round(quantile_cont({c}, 0.25) FILTER (g = 1), 6) AS {c}_p25, round(quantile_cont({c}, 0.75) FILTER (g = 1), 6) AS {c}_p75, round(avg({c}) FILTER (g = 1), 6) AS {c}_mean"
CARDS_SQL = f"""WITH {TRACES_SQL}, l AS (SELECT *, list_transform(string_split(compact, chr(10)), lambda x: trim(substr(x, 1, 120))) AS l FROM tr),
x AS (SELECT 'arm' || k % 3 AS arm, g, strict, think_len, think_len / greatest(1, length(origin)) AS ratio, 100.0 * len(regexp_extract_all(compact, '{S.REGISTER_MARK}')) / greatest(1, think_len) AS marked, CASE WHEN len(l) >= 2 THEN len(list_filter(range(1, len(l)), lambda i: l[i] <> '' AND l[i] = l[i + 1])) / (len(l) - 1) ELSE 0 END AS stalled FROM l)
SELECT arm, count(*) AS n, count(*) FILTER (g = 0) AS gate_fail, count(*) FILTER (strict) AS verified, {', '.join(map(_four, ('think_len', 'ratio', 'marked', 'stalled')))}, round(avg(CAST(think_len < 30 AS int)) FILTER (g = 1), 6) AS under_target, round(avg(CAST(stalled >= 0.5 AS int)) FILTER (g = 1), 6) AS mostly_stalled FROM x GROUP BY 1"""


def built_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences from a prompt and a completion; a problem whose text holds ids of boundaries, or a gate that fails, is named; and spans must be a partition."""
    s = sequences(spark, sf_dir).withColumns({"stray": F.when(F.col("key") % 6 == 0, F.array(F.lit(K.OPEN))).otherwise(F.array(F.lit(1))), "s": K.segments(F.col("ids"), F.col("prompt"), blanks=[198])})
    b = s.select("key", "s", L.built(F.slice("ids", 1, 3), F.slice("ids", 4, 99), F.col("s"), F.col("stray")).alias("b"), F.size("ids").alias("n"))
    c = b.select("key", F.size("b.ids").alias("size"), F.col("b.problem").alias("problem"), L.partition_problem(F.col("s"), F.col("n") - 3 - F.when(F.col("key") % 30 == 3, 8).otherwise(0)).alias("partition"))
    return c.groupBy("problem", "partition").agg(F.count("*").alias("n"), F.sum(F.when(F.col("size") > 0, F.col("size")).otherwise(0)).alias("tokens"))


def divergence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span of twins that is scored: 30 tokens from where they differ, within their thought; under five there is none."""
    s = sequences(spark, sf_dir).withColumn("ids", F.expr("concat(slice(ids, 1, 4), transform(sequence(0, cast(key % 50 AS int)), i -> cast(30 + i AS int)), array(151668, 20, 21))")).withColumn("twin", F.expr("transform(ids, (x, i) -> IF(i = 5 + key % 40, x + 1, x))"))
    s = s.filter("key % 10 = 0").withColumns({"at": K.first_difference(F.col("ids"), F.col("twin"), F.col("prompt")), "end": F.size("ids") - 3})
    return s.select("key", F.col("at").cast("long").alias("first"), F.when(F.least(F.col("at") + 30, F.col("end")) - F.col("at") >= 5, F.least(F.col("at") + 30, F.col("end"))).cast("long").alias("stop"))


_all = (payload_scores, topk_entropy, delta_stats, gap_by_class, arm_cards, built_sequences, divergence_spans)
QUERIES = {f.__name__: f for f in _all}
ORACLES = {
    "payload_scores": PAYLOAD_SQL,
    "topk_entropy": TOPK_SQL,
    "delta_stats": DELTA_SQL,
    "gap_by_class": f"""WITH {CAND}, c AS (SELECT think_len / 10.0 AS gap, CASE k % 4 WHEN 0 THEN 'structural' WHEN 1 THEN 'branch' END AS class FROM cand), a AS (SELECT gap, 'all' AS class FROM c UNION ALL SELECT gap, class FROM c WHERE class IS NOT NULL UNION ALL SELECT gap, 'marked' FROM c WHERE class IS NOT NULL)
SELECT class, count(*) AS n, round(quantile_cont(gap, 0.5), 6) AS p50, round(quantile_cont(gap, 0.95), 6) AS p95, round(quantile_cont(gap, 0.99), 6) AS p99, round(avg(gap), 6) AS mean FROM a GROUP BY 1""",
    "arm_cards": CARDS_SQL,
    "built_sequences": f"""WITH s AS ({SEGMENTS_SQL}), i AS (SELECT o_orderkey AS key, len(ids) AS n FROM (SELECT key AS o_orderkey, {IDS_SQL} AS ids FROM (SELECT o_orderkey AS key FROM orders))),
p AS (SELECT s.*, n, CASE WHEN s.key % 6 = 0 THEN 'boundary tokens' WHEN g <> 1 THEN 'gate: ' || reason END AS problem, CASE WHEN answer_start >= 0 AND answer_start < think_end THEN 'overlap' WHEN think_end - think_start + answer_end - answer_start > n - 3 - CASE WHEN s.key % 30 = 3 THEN 8 ELSE 0 END THEN 'beyond the end' END AS part FROM s JOIN i ON s.key = i.key)
SELECT problem, part AS partition, count(*) AS n, CAST(sum(CASE WHEN problem IS NULL THEN n ELSE 0 END) AS bigint) AS tokens FROM p GROUP BY 1, 2""",
    "divergence_spans": """WITH o AS (SELECT o_orderkey AS key, 5 + o_orderkey % 50 AS z, 5 + o_orderkey % 50 + 3 AS n FROM orders WHERE o_orderkey % 10 = 0), a AS (SELECT key, z, CASE WHEN 5 + key % 40 < n THEN 5 + key % 40 END AS p FROM o)
SELECT key, p AS first, CASE WHEN least(p + 30, z) - p >= 5 THEN least(p + 30, z) END AS stop FROM a""",
}
