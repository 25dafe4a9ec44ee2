"""Queries over rollouts: an order is a problem, its lines are the rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import groups as G
from tracelode.operators import pool as P
from tracelode.operators import select as S
from tracelode.tables import CANDIDATES_SQL as CAND
from tracelode.tables import STEPS_SQL, candidates, steps, table


def bucket_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2"""
    return G.buckets(candidates(spark, sf_dir))


BUCKETS = f"""{CAND}, b AS (SELECT uid, any_value(level) AS level, any_value(seen) AS seen, count(*) FILTER (strict) AS n_strict, count(*) AS n, count(DISTINCT part) AS n_distinct,
  coalesce(quantile_cont(think_len, 0.5) FILTER (g = 1), 0.0) AS think_median FROM cand GROUP BY uid),
t AS (SELECT *, CASE WHEN n_strict = 0 THEN 'none' WHEN n_strict = n THEN 'all' ELSE 'mixed' END AS bucket, round(n_strict / n, 6) AS p_hat FROM b)"""


def bucket_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3"""
    return G.bucket_cube(G.buckets(candidates(spark, sf_dir)))


def yield_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4"""
    return G.yields(candidates(spark, sf_dir))


def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5"""
    return G.pass_at_k(candidates(spark, sf_dir))


def tokens_per_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of gated and of all rollouts, rates, and tokens for each right one (null without any)."""
    c = candidates(spark, sf_dir)
    return c.groupBy("level").agg(
        F.round(F.percentile(F.when(F.col("g") == 1, F.col("think_len")), 0.5), 6).alias("median_gated"),
        F.round(F.percentile("think_len", 0.5), 6).alias("median_all"),
        F.round(F.avg((F.col("answer_len") >= 590).cast("int")), 6).alias("cap_rate"),
        F.round(F.try_divide(F.sum(F.col("think_len") + F.col("answer_len")), F.count_if("strict")), 6).alias("tokens_per_correct"),
    )


def think_per_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over as many draws as every problem has, thought for each right answer (infinite without any)."""
    g = G.shared_draws(candidates(spark, sf_dir)).groupBy("level", "seen").agg(F.count("*").alias("n"), F.count_if("strict").alias("correct"), F.sum("think_len").alias("think"))
    return g.select("level", "seen", "n", F.round(F.when(F.col("correct") > 0, F.col("think") / F.col("correct")).otherwise(F.lit(float("inf"))), 6).alias("think_per_correct"))


def mcnemar_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms that share problems and draws."""
    c = candidates(spark, sf_dir)
    a = c.select("uid", "k", F.col("strict").alias("a"))
    b = c.select("uid", "k", (F.col("g") == 1).alias("b"))
    return G.mcnemar(a.join(b, ["uid", "k"]), "a", "b").select("wins", "losses", "n", "z", F.round("p", 4).alias("p"))


def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: brands by accuracy and cost."""
    c = candidates(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_brand"), "part")
    arms = c.groupBy(F.col("p_brand").alias("arm")).agg(F.round(F.avg(F.col("strict").cast("int")), 6).alias("acc"), F.round(F.sum("think_len") / F.count_if("strict"), 6).alias("cost"))
    return G.pareto(arms, "acc", "cost")


def endpoint_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: a run for each brand; the first draw is its start, and every later one a step."""
    c = candidates(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("run")), "part")
    arms = c.groupBy("run", F.least("k", F.lit(4)).alias("step")).agg(F.avg(F.col("strict").cast("int")).alias("acc"), F.percentile("think_len", 0.5).alias("cost"))
    start = c.filter("k = 0").groupBy("run").agg(F.avg(F.col("strict").cast("int")).alias("acc0"), (F.stddev_samp(F.col("strict").cast("int")) / F.sqrt(F.count("*"))).alias("std0"), F.percentile("think_len", 0.5).alias("cost0"))
    return G.endpoint(arms.filter("step > 0"), start).withColumnRenamed("step", "last")


def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advantages, the difficulty of a group as a weight, and the part that goes to thought."""
    c = candidates(spark, sf_dir).withColumn("reward", F.col("strict").cast("double") + F.col("discount"))
    a = G.advantages(c, "reward").withColumn("rate", F.avg(F.col("strict").cast("int")).over(W.partitionBy("uid")))
    weight = 1 + (1 - F.col("rate"))
    return a.select("uid", "k", F.round("centred", 6).alias("centred"), F.round("advantage", 4).alias("advantage"), F.round(weight, 6).alias("weight"), F.round(F.when(F.col("centred") > 0, F.col("centred") * weight).otherwise(0.0), 6).alias("routed"))


def dynamic_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14"""
    return G.dynamic_sampling(candidates(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("problems"), F.sum("n").alias("rollouts"))


def tea_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8"""
    t = G.tea_weights(candidates(spark, sf_dir).withColumn("x", F.col("think_len") / 10.0), "x", "discount")
    return t.select("uid", "k", F.round(F.col("weight") * F.col("n"), 6).alias("weight"))


def think_budget_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9"""
    return G.effective_budget(candidates(spark, sf_dir), 20.0).withColumn("budget", F.round("budget", 6))


def think_budget_anneal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in the order of problems, a run for each level."""
    c = candidates(spark, sf_dir)
    g = c.groupBy(F.col("level").alias("run"), "uid").agg(F.count("*").alias("n"), G.whole_deviation("think_len").alias("std"))
    return G.anneal(g, "uid", 400.0, least_std=10.0).select("run", "uid", F.round("budget", 6).alias("budget"))


def length_band_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7, C8"""
    c = candidates(spark, sf_dir)
    return c.select("uid", "k", F.round(G.length_multiplier(F.col("think_len"), 20.0), 6).alias("by_length"), F.round(G.band_multiplier(F.col("answer_len")), 6).alias("by_band"))


def kept_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each problem counts once, whatever number of its traces is kept."""
    c = candidates(spark, sf_dir).filter("strict and g = 1")
    w = W.partitionBy("uid")
    return c.select("uid", "k", (F.row_number().over(w.orderBy("k")) - 1).cast("long").alias("trace_idx"), F.round(1 / F.count("*").over(w), 6).alias("weight"))


def golden_first_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict may be missing; then a problem without a pass isn't exhausted."""
    c = S.ranked(candidates(spark, sf_dir), [F.desc("discount"), F.col("k")])
    return S.first_pass(c, F.col("tax") > 0.01, (F.col("tax") > 0.01) & (F.col("answer_len") % 3 == 0)).select("uid", F.col("rank").cast("long").alias("rank"), "outcome")


def unresolved_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, A25"""
    return golden_first_pass(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


GOLDEN = f"""{CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY discount DESC, k) AS rank FROM cand),
o AS (SELECT uid, min(rank) FILTER (tax > 0.01 AND answer_len % 3 = 0) AS rank, count(*) FILTER (NOT tax > 0.01) AS errors FROM r GROUP BY 1),
f AS (SELECT uid, rank, CASE WHEN rank IS NOT NULL THEN 'chosen' WHEN errors > 0 THEN 'errored' ELSE 'exhausted' END AS outcome FROM o)"""


def selection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: rejects by reason, and how many of the problems that could be served are."""
    c = P.reasons(candidates(spark, sf_dir), [("gate", F.col("g") == 0), ("wrong", ~F.col("strict")), ("long", F.col("think_len") > 45)])
    served = W.partitionBy("uid")
    c = c.withColumn("could", F.max(F.col("strict").cast("int")).over(served)).withColumn("is", F.max(F.col("reason").isNull().cast("int")).over(served))
    return c.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("could") == 1, F.col("is"))), 6).alias("served"))


def unscored_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts with their last score; one without a score, or a superseded draft, is rejected with a reason."""
    c = candidates(spark, sf_dir).select("uid", "k", (F.col("k") % 2 + 1).alias("gen"), "discount")
    drafts = c.join(c.groupBy("uid").agg(F.max("gen").alias("top")), "uid")
    events = table(spark, sf_dir, "events").select((F.col("user_id") * 7 + 1).alias("uid"), F.pmod(F.col("event_id"), F.lit(4)).cast("int").alias("k"), "event_id", "value")
    scores = events.groupBy("uid", "k").agg(F.max_by("value", "event_id").alias("score"))
    out = drafts.join(scores, ["uid", "k"], "left")
    out = P.reasons(out, [("superseded", F.col("gen") < F.col("top")), ("unscored", F.col("score").isNull()), ("low", F.col("score") < 20)])
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def percentile_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three percentiles by name: between neighbours, the nearest rank, and the upper median."""
    c = candidates(spark, sf_dir)
    return c.groupBy("uid").agg(F.round(T.percentile_linear("think_len", 0.9), 6).alias("linear"), T.percentile_nearest("think_len", 0.9).cast("long").alias("nearest"), T.upper_median("think_len").cast("long").alias("upper"))


def step_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of ten steps each."""
    s = steps(spark, sf_dir)
    return s.groupBy("user_id", F.floor((F.col("step") - 1) / 10).cast("long").alias("win")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg((F.col("event_type") == "click").cast("int")), 6).alias("rate"))


def trailing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the last five steps."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"), F.count("*").over(w).alias("n"))


def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last, median and greatest value of a log."""
    s = steps(spark, sf_dir)
    return s.groupBy("user_id").agg(F.round(F.min_by("value", "step"), 6).alias("first"), F.round(F.max_by("value", "step"), 6).alias("last"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.max("value"), 6).alias("most"))


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work list of every problem's draws less what is done, in the order of a seed."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"))
    work = o.select("uid", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    todo = P.unseen(work, candidates(spark, sf_dir), ["uid", "k"])
    return todo.select("uid", F.col("k").cast("long").alias("k"), T.seed(F.col("uid").cast("string"), F.col("k").cast("string"), F.lit("42")).alias("seed"))


def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 problems with the fewest judgments, then by id; a top-k that never sorts all rows."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"))
    done = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("uid")).agg(F.count("*").alias("prior"))
    return o.join(done, "uid", "left").select("uid", F.coalesce("prior", F.lit(0)).alias("prior")).orderBy("prior", "uid").limit(200)


_all = (bucket_table, bucket_cube, yield_rollup, pass_at_k, tokens_per_correct, think_per_correct, mcnemar_paired, pareto_frontier, endpoint_verdict, group_advantage, dynamic_sampling, tea_weights, think_budget_group, think_budget_anneal, length_band_multipliers, kept_weights, golden_first_pass, unresolved_split, selection_report, unscored_join, percentile_conventions, step_windows, trailing_rate, dashboard_summary, resume_anti_join, queue_order)
QUERIES = {f.__name__: f for f in _all}

ORACLES = {
    "bucket_table": f"WITH {BUCKETS} SELECT uid, level, seen, n_strict, n, n_distinct, think_median, bucket, p_hat FROM t",
    "bucket_cube": f"""WITH {BUCKETS}, c AS (SELECT coalesce(level, '*') AS level, coalesce(CAST(seen AS varchar), '*') AS seen, count(*) AS n, count(*) FILTER (bucket = 'none') AS n_none, count(*) FILTER (bucket = 'mixed') AS n_mixed, count(*) FILTER (bucket = 'all') AS n_all FROM t GROUP BY CUBE (level, seen)),
l AS (SELECT level, seen FROM (SELECT DISTINCT level FROM t UNION ALL SELECT '*') CROSS JOIN (VALUES ('*'), ('true'), ('false')) v(seen))
SELECT l.level, l.seen, coalesce(n, 0) AS n, coalesce(n_none, 0) AS n_none, coalesce(n_mixed, 0) AS n_mixed, coalesce(n_all, 0) AS n_all FROM l LEFT JOIN c ON l.level = c.level AND l.seen = c.seen""",
    "yield_rollup": f"""WITH {CAND}, r AS (SELECT coalesce(level, 'ALL') AS level, count(*) AS rollouts, round(avg(CAST(strict AS int)), 6) AS verify_rate, round(avg(g), 6) AS gate_rate FROM cand GROUP BY ROLLUP (level)),
u AS (SELECT uid, level, bool_or(strict) AS solved FROM cand GROUP BY 1, 2), p AS (SELECT coalesce(level, 'ALL') AS level, count(*) AS problems, round(avg(CAST(solved AS int)), 6) AS solve_rate FROM u GROUP BY ROLLUP (level))
SELECT r.level, rollouts, verify_rate, gate_rate, problems, solve_rate FROM r JOIN p ON r.level = p.level""",
    "pass_at_k": f"""WITH {CAND}, f AS (SELECT * FROM cand), d AS (SELECT k, avg(CAST(strict AS int)) AS p FROM f GROUP BY 1), a AS (SELECT round(avg(p), 6) AS pass_1, round(stddev_samp(p), 6) AS std, count(*) AS draws FROM d),
u AS (SELECT uid, bool_or(strict) AS x, max(CASE WHEN k = 0 THEN CAST(strict AS int) END) AS at1 FROM f GROUP BY 1), b AS (SELECT round(avg(CAST(x AS int)), 6) AS pass_k, round(avg(at1), 6) AS at1, count(*) AS problems FROM u)
SELECT * FROM a CROSS JOIN b""",
    "tokens_per_correct": f"WITH {CAND} SELECT level, round(quantile_cont(think_len, 0.5) FILTER (g = 1), 6) AS median_gated, round(quantile_cont(think_len, 0.5), 6) AS median_all, round(avg(CAST(answer_len >= 590 AS int)), 6) AS cap_rate, round(sum(think_len + answer_len) / nullif(count(*) FILTER (strict), 0), 6) AS tokens_per_correct FROM cand GROUP BY 1",
    "think_per_correct": f"WITH {CAND} SELECT level, seen, count(*) AS n, round(CASE WHEN count(*) FILTER (strict) > 0 THEN sum(think_len) / count(*) FILTER (strict) ELSE CAST('inf' AS double) END, 6) AS think_per_correct FROM cand WHERE k < 1 GROUP BY 1, 2",
    "mcnemar_paired": f"""WITH {CAND}, s AS (SELECT count(*) FILTER (g = 1 AND NOT strict) AS wins, count(*) FILTER (strict AND g = 0) AS losses, count(*) AS n FROM cand),
z AS (SELECT *, (wins - losses) / sqrt(wins + losses) AS zz FROM s),
x AS (SELECT *, abs(zz) / sqrt(2.0) AS x, 1 / (1 + 0.5 * abs(zz) / sqrt(2.0)) AS t FROM z)
SELECT wins, losses, n, round(zz, 6) AS z, round(t * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))), 4) AS p FROM x""",
    "pareto_frontier": f"""WITH {CAND}, a AS (SELECT p_brand AS arm, round(avg(CAST(strict AS int)), 6) AS acc, round(sum(think_len) / count(*) FILTER (strict), 6) AS cost FROM cand JOIN part ON p_partkey = part GROUP BY 1),
m AS (SELECT *, min(cost) OVER (ORDER BY acc DESC, cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM a)
SELECT arm, acc, cost FROM m WHERE least IS NULL OR cost < least""".replace("p_partkey = part ", "p_partkey = cand.part "),
    "endpoint_verdict": f"""WITH {CAND}, c AS (SELECT cand.*, p_brand AS run, least(k, 4) AS step FROM cand JOIN part ON p_partkey = cand.part), z AS (SELECT run, avg(CAST(strict AS int)) AS acc0, stddev_samp(CAST(strict AS int)) / sqrt(count(*)) AS std0, quantile_cont(think_len, 0.5) AS cost0 FROM c WHERE k = 0 GROUP BY 1),
a AS (SELECT run, step, avg(CAST(strict AS int)) AS acc, quantile_cont(think_len, 0.5) AS cost FROM c WHERE step > 0 GROUP BY 1, 2), j AS (SELECT a.*, acc > acc0 AND cost <= cost0 AS beats, round(acc - acc0, 12) < -round(std0, 12) OR cost > cost0 AS worse FROM a JOIN z ON a.run = z.run)
SELECT run, max(step) AS last, CASE WHEN bool_or(beats) THEN 'PASS' WHEN arg_max(worse, step) THEN 'FAIL' ELSE 'EXTEND' END AS verdict FROM j GROUP BY 1""",
    "group_advantage": f"""WITH {CAND}, r AS (SELECT *, CAST(strict AS int) + discount AS reward FROM cand),
a AS (SELECT uid, k, reward - avg(reward) OVER w AS centred, (reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-6) AS advantage, 2 - avg(CAST(strict AS int)) OVER w AS weight FROM r WINDOW w AS (PARTITION BY uid))
SELECT uid, k, round(centred, 6) AS centred, round(advantage, 4) AS advantage, round(weight, 6) AS weight, round(CASE WHEN centred > 0 THEN centred * weight ELSE 0.0 END, 6) AS routed FROM a""",
    "dynamic_sampling": f"WITH {CAND}, u AS (SELECT uid, count(*) FILTER (strict) AS r, count(*) AS n FROM cand GROUP BY 1) SELECT CASE WHEN r = 0 THEN 'all wrong' WHEN r = n THEN 'all right' ELSE 'kept' END AS reason, count(*) AS problems, CAST(sum(n) AS bigint) AS rollouts FROM u GROUP BY 1",
    "tea_weights": f"""WITH {CAND}, m AS (SELECT avg(think_len / 10.0) AS mx, avg(discount) AS my, count(*) AS n FROM cand), c AS (SELECT uid, k, n, (think_len / 10.0 - mx) * (discount - my) AS cov FROM cand CROSS JOIN m),
e AS (SELECT uid, k, n, exp(cov - (SELECT max(cov) FROM c)) AS e FROM c) SELECT uid, k, round(least(e / (SELECT sum(e) FROM e), 100.0 / n) * n, 6) AS weight FROM e""",
    "think_budget_group": f"WITH {CAND} SELECT uid, round(CASE WHEN max(think_len) FILTER (think_len > 0) IS NULL THEN 120.0 ELSE greatest(least(20.0, max(think_len)), quantile_cont(think_len, 0.25) FILTER (think_len > 0), 1.0) END, 6) AS budget FROM cand GROUP BY 1",
    "think_budget_anneal": f"""WITH {CAND}, g AS (SELECT level AS run, uid, count(*) AS n, stddev_pop(think_len) AS std FROM cand GROUP BY 1, 2),
m AS (SELECT *, sum(CASE WHEN n >= 2 AND std < 10 THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY uid ROWS UNBOUNDED PRECEDING) AS moves FROM g) SELECT run, uid, round(greatest(120.0, 400.0 * pow(0.995, moves)), 6) AS budget FROM m""",
    "length_band_multipliers": f"WITH {CAND} SELECT uid, k, round(exp(-greatest(0.0, think_len - 20.0) / 20.0), 6) AS by_length, round(CASE WHEN abs(answer_len - 288.0) <= 32 THEN 1.0 ELSE exp(-(abs(answer_len - 288.0) - 32) / 288.0) END, 6) AS by_band FROM cand",
    "kept_weights": f"WITH {CAND} SELECT uid, k, row_number() OVER (PARTITION BY uid ORDER BY k) - 1 AS trace_idx, round(1 / count(*) OVER (PARTITION BY uid), 6) AS weight FROM cand WHERE strict AND g = 1",
    "golden_first_pass": f"WITH {GOLDEN} SELECT * FROM f",
    "unresolved_split": f"WITH {GOLDEN} SELECT outcome, count(*) AS n FROM f GROUP BY 1",
    "selection_report": f"""WITH {CAND}, x AS (SELECT *, CASE WHEN g = 0 THEN 'gate' WHEN NOT strict THEN 'wrong' WHEN think_len > 45 THEN 'long' ELSE 'kept' END AS reason FROM cand),
y AS (SELECT reason, max(CAST(strict AS int)) OVER (PARTITION BY uid) AS could, max(CAST(reason = 'kept' AS int)) OVER (PARTITION BY uid) AS served FROM x) SELECT reason, count(*) AS n, round(avg(CASE WHEN could = 1 THEN served END), 6) AS served FROM y GROUP BY 1""",
    "unscored_join": f"""WITH {CAND}, d AS (SELECT uid, k, k % 2 + 1 AS gen, max(k % 2 + 1) OVER (PARTITION BY uid) AS top FROM cand), s AS (SELECT user_id * 7 + 1 AS uid, event_id % 4 AS k, arg_max(value, event_id) AS score FROM events GROUP BY 1, 2)
SELECT CASE WHEN gen < top THEN 'superseded' WHEN score IS NULL THEN 'unscored' WHEN score < 20 THEN 'low' ELSE 'kept' END AS reason, count(*) AS n FROM d LEFT JOIN s ON d.uid = s.uid AND d.k = s.k GROUP BY 1""",
    "percentile_conventions": f"""WITH {CAND}, l AS (SELECT uid, list_sort(list(think_len)) AS s, quantile_cont(think_len, 0.9) AS q FROM cand GROUP BY 1)
SELECT uid, round(q, 6) AS linear, CAST(s[least(CAST(floor(len(s) * 0.9) AS int), len(s) - 1) + 1] AS bigint) AS nearest, CAST(s[len(s) // 2 + 1] AS bigint) AS upper FROM l""",
    "step_windows": f"WITH {STEPS_SQL} SELECT user_id, (step - 1) // 10 AS win, count(*) AS n, round(avg(value), 6) AS mean, round(avg(CAST(event_type = 'click' AS int)), 6) AS rate FROM steps GROUP BY 1, 2",
    "trailing_rate": "SELECT event_id, round(avg(value) OVER w, 6) AS mean, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    "dashboard_summary": f"WITH {STEPS_SQL} SELECT user_id, round(arg_min(value, step), 6) AS first, round(arg_max(value, step), 6) AS last, round(quantile_cont(value, 0.5), 6) AS median, round(max(value), 6) AS most FROM steps GROUP BY 1",
    "resume_anti_join": f"WITH {CAND}, w AS (SELECT o_orderkey AS uid, unnest(range(0, 4)) AS k FROM orders) SELECT uid, k, CAST(CAST('0x' || substr(sha1(uid || ':' || k || ':42'), 1, 8) AS uhugeint) AS bigint) AS seed FROM w WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.uid = w.uid AND c.k = w.k)",
    "queue_order": "WITH d AS (SELECT l_orderkey AS uid, count(*) AS prior FROM lineitem GROUP BY 1) SELECT o_orderkey AS uid, coalesce(prior, 0) AS prior FROM orders LEFT JOIN d ON o_orderkey = uid ORDER BY prior, o_orderkey LIMIT 200".replace("ORDER BY prior,", "ORDER BY coalesce(prior, 0),"),
}
