"""Queries of statistics over tokens and labels, and of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import tokens as K
from tracelode.operators import groups as GR
from tracelode.streaming import follow as V
from tracelode.tables import shared_root, CANDIDATES_SQL as CAND
from tracelode.tables import shared_root, candidates, table


def type_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word types with a high mean and a low deviation of a measure, and a list that is in anyhow; the thresholds are one row."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("w"), "n_chars")
    types = words.groupBy("w").agg(F.count("*").alias("n"), F.avg(F.col("n_chars") % 97).alias("mean"), F.stddev_pop(F.col("n_chars") % 97).alias("std")).filter("n >= 10")
    limits = types.agg(F.percentile("mean", 0.75).alias("high"), F.percentile("std", 0.5).alias("low"))
    stats = types.join(F.broadcast(limits)).filter("mean > high and std < low").select("w", F.lit("stats").alias("source"))
    listed = spark.sql("SELECT explode(array('the', 'and', 'of')) AS w").withColumn("source", F.lit("list"))
    return stats.union(listed.join(stats, "w", "left_anti"))


def token_gate_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over three thresholds, by level."""
    c = candidates(spark, sf_dir).select("level", (F.col("think_len") / 4.0).alias("s"), (F.col("k") == 0).alias("marked"), F.explode(F.array(F.lit(-4.0), F.lit(-8.0), F.lit(-12.0))).alias("gamma"))
    g = 1 / (1 + F.exp(-(-F.col("s") - F.col("gamma"))))
    w = g * K.novelty(F.col("s"))
    w = F.when(F.col("marked"), F.greatest(w, F.lit(1.0))).otherwise(w)
    return c.groupBy("level", "gamma").agg(F.count("*").alias("n"), F.round(F.avg(g), 6).alias("gate"), F.round(F.avg((g < 0.1).cast("int")), 6).alias("masked"), F.round(F.greatest(F.sum(w), 0.25 * F.count("*")), 4).alias("total"))


def g_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16"""
    g = K.g_spike(candidates(spark, sf_dir).withColumn("gap", F.col("think_len") / 10.0), "uid", "gap", {"b5": 5.0, "b10": 10.0})
    return g.select("uid", F.round("b5", 6).alias("b5"), F.round("b10", 6).alias("b10"))


def entropy_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles, central moments and Sarle's coefficient, by level; the moments are written out, as engines differ in theirs."""
    c = candidates(spark, sf_dir).select("level", (F.col("price") / 1000).alias("x"))
    m = c.groupBy("level").agg(F.count("*").alias("n"), F.avg("x").alias("mu"), F.percentile("x", [0.1, 0.5, 0.9]).alias("p"))
    d = c.join(m, "level").withColumn("d", F.col("x") - F.col("mu"))
    s = d.groupBy("level").agg(F.first("n").alias("n"), F.first("p").alias("p"), F.avg(F.pow("d", F.lit(2.0))).alias("m2"), F.avg(F.pow("d", F.lit(3.0))).alias("m3"), F.avg(F.pow("d", F.lit(4.0))).alias("m4"), F.avg((F.col("x") > 60).cast("int")).alias("mass"))
    skew, kurtosis = F.col("m3") / F.pow("m2", F.lit(1.5)), F.col("m4") / F.pow("m2", F.lit(2.0))
    return s.select("level", "n", *(F.round(F.col("p")[i], 4).alias(f"p{q}") for i, q in enumerate((10, 50, 90))), F.round(F.sqrt("m2"), 4).alias("std"), F.round((skew * skew + 1) / kurtosis, 4).alias("bimodality"), F.round("mass", 6).alias("mass"))


def surprisal_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of ten, the last one open."""
    c = candidates(spark, sf_dir)
    return c.groupBy("level", F.least(F.floor(F.col("think_len") / 10), F.lit(4)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("y"))
    return labels.join(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x")), "doc_id")


def point_biserial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: r, t and a two-sided p (by a normal distribution) of a measure and a 0/1 label; null where nothing varies."""
    s = _labelled(spark, sf_dir).agg(F.count("*").alias("n"), F.avg("y").alias("p"), F.avg(F.when(F.col("y") == 1, F.col("x"))).alias("m1"), F.avg(F.when(F.col("y") == 0, F.col("x"))).alias("m0"), F.stddev_pop("x").alias("sd"))
    r = F.try_divide(F.col("m1") - F.col("m0"), F.col("sd")) * F.sqrt(F.col("p") * (1 - F.col("p")))
    t = r * F.sqrt(F.try_divide(F.col("n") - 2, 1 - r * r))
    return s.select("n", F.round(r, 6).alias("r"), F.round(t, 4).alias("t"), F.round(GR.erfc(F.abs(t) / 2**0.5), 4).alias("p"))


def auc_youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: the area by counts of distinct values, ties as halves, and the smallest threshold with the greatest J; never a pair of rows."""
    v = _labelled(spark, sf_dir).groupBy("x").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    v = GR.sums_below(v, "x", ["pos", "neg"])
    total = v.agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    v = v.join(F.broadcast(total))
    j = (F.col("np") - F.col("pos_below")) / F.col("np") - (F.col("nn") - F.col("neg_below")) / F.col("nn")
    best = v.agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("u"), F.first("np").alias("np"), F.first("nn").alias("nn"), F.max(F.struct(F.round(j, 9).alias("j"), (-F.col("x")).alias("x"))).alias("best"))
    return best.select(F.round(F.col("u") / (F.col("np") * F.col("nn")), 6).alias("auc"), F.round("best.j", 6).alias("j"), (-F.col("best.x")).alias("threshold"))


def arm_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: arms side by side."""
    c = candidates(spark, sf_dir)
    return c.groupBy("level").pivot("k", [0, 1, 2]).agg(F.round(F.avg(F.col("strict").cast("int")), 6)).select("level", *(F.col(str(i)).alias(f"k{i}") for i in range(3)))


def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: gates of three values: a measure that is missing is no pass."""
    c = candidates(spark, sf_dir).groupBy("level").agg(F.avg(F.col("strict").cast("int")).alias("acc"), F.avg(F.when(F.col("g") == 1, F.col("think_len"))).alias("think"), F.avg(F.when(F.col("answer_len") > 598, F.col("tax"))).alias("rare"))
    gate = lambda test: F.when(test.isNull(), "UNMEASURED").when(test, "PASS").otherwise("FAIL")
    g = c.select("level", gate(F.col("acc") > 0.33).alias("accuracy"), gate(F.col("think") < 26).alias("length"), gate(F.col("rare") < 0.04).alias("rare"))
    both = F.array("accuracy", "length", "rare")
    return g.withColumn("verdict", F.when(F.array_contains(both, "FAIL"), "FAIL").when(F.array_contains(both, "UNMEASURED"), "UNMEASURED").otherwise("PASS"))


def seen_within_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences within levels, pooled by inverse variance."""
    c = candidates(spark, sf_dir).withColumn("y", F.col("strict").cast("double"))
    l = c.groupBy("level").agg(F.avg(F.when(F.col("seen"), F.col("y"))).alias("a"), F.avg(F.when(~F.col("seen"), F.col("y"))).alias("b"), F.count_if("seen").alias("na"), F.count_if(~F.col("seen")).alias("nb"))
    var = F.col("a") * (1 - F.col("a")) / F.col("na") + F.col("b") * (1 - F.col("b")) / F.col("nb")
    return l.agg(F.round(F.sum((F.col("a") - F.col("b")) / var) / F.sum(1 / var), 6).alias("difference"), F.round(F.sqrt(1 / F.sum(1 / var)), 6).alias("error"))


def kl_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two estimators of a divergence from log-probabilities, and gaps."""
    c = candidates(spark, sf_dir).select("level", (-F.col("think_len") / 10.0).alias("p"), (-F.col("think_len") / 10.0 + F.col("discount") - F.col("tax")).alias("q"))
    d = F.col("q") - F.col("p")
    return c.groupBy("level").agg(F.round(F.avg(-d), 6).alias("k1"), F.round(F.avg(F.exp(d) - d - 1), 6).alias("k3"), F.round(F.avg(K.gap(F.col("p"), F.col("q"))), 6).alias("gap"))


def follow_stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: the log read as a stream until it is used up; each event is scored once, and what can't be scored waits."""
    root = shared_root(spark, "follow")
    events = table(spark, sf_dir, "events")
    source = f"{root}/source"
    events.select("event_id", "user_id", "value").union(events.filter("event_id % 10 = 0").select("event_id", "user_id", "value")).write.parquet(source)
    score = lambda b: b.withColumn("score", F.when(F.col("value") >= 0, F.round(F.col("value") / 10, 6)))
    q = V.follow(spark, source, "event_id long, user_id long, value double", score, f"{root}/scores", f"{root}/checkpoint", ["event_id"])
    q.awaitTermination()
    return spark.read.parquet(f"{root}/scores").select("event_id", "user_id", "score")


_all = (type_aggregation, token_gate_weights, g_spike, entropy_profile, surprisal_hist, point_biserial, auc_youden, arm_pivot, gate_verdict, seen_within_level, kl_estimators, follow_stream_scores)
QUERIES = {f.__name__: f for f in _all}

ORACLES = {
    "type_aggregation": """WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w, n_chars FROM documents), t AS (SELECT w, count(*) AS n, avg(n_chars % 97) AS mean, stddev_pop(n_chars % 97) AS std FROM w GROUP BY 1 HAVING count(*) >= 10),
l AS (SELECT quantile_cont(mean, 0.75) AS high, quantile_cont(std, 0.5) AS low FROM t), s AS (SELECT w FROM t CROSS JOIN l WHERE mean > high AND std < low)
SELECT w, 'stats' AS source FROM s UNION ALL SELECT w, 'list' FROM (VALUES ('the'), ('and'), ('of')) v(w) WHERE w NOT IN (SELECT w FROM s)""",
    "token_gate_weights": f"""WITH {CAND}, x AS (SELECT level, think_len / 4.0 AS s, k = 0 AS marked, unnest([-4.0, -8.0, -12.0]) AS gamma FROM cand), g AS (SELECT *, 1 / (1 + exp(s + gamma)) AS g FROM x),
w AS (SELECT *, CASE WHEN marked THEN greatest(g * (1 + 0.2 * least(s, 10)), 1.0) ELSE g * (1 + 0.2 * least(s, 10)) END AS w FROM g)
SELECT level, CAST(gamma AS double) AS gamma, count(*) AS n, round(avg(g), 6) AS gate, round(avg(CAST(g < 0.1 AS int)), 6) AS masked, round(greatest(sum(w), 0.25 * count(*)), 4) AS total FROM w GROUP BY 1, 2""",
    "g_spike": f"""WITH {CAND}, m AS (SELECT uid, think_len / 10.0 AS x, max(think_len / 10.0) OVER (PARTITION BY uid) AS t FROM cand)
SELECT uid, round(exp(-(1 / 5.0) * (5.0 * any_value(t) + ln(avg(exp(5.0 * (x - t)))))), 6) AS b5, round(exp(-(1 / 10.0) * (10.0 * any_value(t) + ln(avg(exp(10.0 * (x - t)))))), 6) AS b10 FROM m GROUP BY 1""",
    "entropy_profile": f"""WITH {CAND}, x AS (SELECT level, price / 1000 AS x, avg(price / 1000) OVER (PARTITION BY level) AS mu FROM cand),
s AS (SELECT level, count(*) AS n, quantile_cont(x, 0.1) AS p1, quantile_cont(x, 0.5) AS p5, quantile_cont(x, 0.9) AS p9, avg(pow(x - mu, 2)) AS m2, avg(pow(x - mu, 3)) AS m3, avg(pow(x - mu, 4)) AS m4, avg(CAST(x > 60 AS int)) AS mass FROM x GROUP BY 1)
SELECT level, n, round(p1, 4) AS p10, round(p5, 4) AS p50, round(p9, 4) AS p90, round(sqrt(m2), 4) AS std, round((pow(m3 / pow(m2, 1.5), 2) + 1) / (m4 / pow(m2, 2)), 4) AS bimodality, round(mass, 6) AS mass FROM s""",
    "surprisal_hist": f"WITH {CAND} SELECT level, CAST(least(think_len // 10, 4) AS bigint) AS bin, count(*) AS n FROM cand GROUP BY 1, 2",
    "point_biserial": """WITH x AS (SELECT quality AS y, CAST(n_chars AS double) AS x FROM labels JOIN documents USING (doc_id)), s AS (SELECT count(*) AS n, avg(y) AS p, avg(x) FILTER (y = 1) AS m1, avg(x) FILTER (y = 0) AS m0, stddev_pop(x) AS sd FROM x),
r AS (SELECT n, (m1 - m0) / sd * sqrt(p * (1 - p)) AS r FROM s), z AS (SELECT n, r, r * sqrt((n - 2) / (1 - r * r)) AS t FROM r), e AS (SELECT *, abs(t) / sqrt(2.0) AS x, 1 / (1 + 0.5 * abs(t) / sqrt(2.0)) AS s FROM z)
SELECT n, round(r, 6) AS r, round(t, 4) AS t, round(s * exp(-x * x - 1.26551223 + s * (1.00002368 + s * (0.37409196 + s * (0.09678418 + s * (-0.18628806 + s * (0.27886807 + s * (-1.13520398 + s * (1.48851587 + s * (-0.82215223 + s * 0.17087277))))))))), 4) AS p FROM e""",
    "auc_youden": """WITH x AS (SELECT quality AS y, CAST(n_chars AS double) AS x FROM labels JOIN documents USING (doc_id)), v AS (SELECT x, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY 1),
c AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pb, coalesce(sum(neg) OVER w, 0) AS nb, (SELECT sum(pos) FROM v) AS np, (SELECT sum(neg) FROM v) AS nn FROM v WINDOW w AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT *, round((np - pb) / np - (nn - nb) / nn, 9) AS j FROM c), b AS (SELECT x, j FROM j ORDER BY j DESC, x LIMIT 1)
SELECT round((SELECT sum(pos * (nb + neg / 2)) / (any_value(np) * any_value(nn)) FROM j), 6) AS auc, round(j, 6) AS j, x AS threshold FROM b""",
    "arm_pivot": f"WITH {CAND} SELECT level, round(avg(CAST(strict AS int)) FILTER (k = 0), 6) AS k0, round(avg(CAST(strict AS int)) FILTER (k = 1), 6) AS k1, round(avg(CAST(strict AS int)) FILTER (k = 2), 6) AS k2 FROM cand GROUP BY 1",
    "gate_verdict": f"""WITH {CAND}, c AS (SELECT level, avg(CAST(strict AS int)) > 0.33 AS a, avg(think_len) FILTER (g = 1) < 26 AS t, avg(tax) FILTER (answer_len > 598) < 0.04 AS r FROM cand GROUP BY 1),
g AS (SELECT level, {", ".join(f"CASE WHEN {x} IS NULL THEN 'UNMEASURED' WHEN {x} THEN 'PASS' ELSE 'FAIL' END AS {n}" for x, n in (("a", "accuracy"), ("t", "length"), ("r", "rare")))} FROM c)
SELECT *, CASE WHEN 'FAIL' IN (accuracy, length, rare) THEN 'FAIL' WHEN 'UNMEASURED' IN (accuracy, length, rare) THEN 'UNMEASURED' ELSE 'PASS' END AS verdict FROM g""",
    "seen_within_level": f"""WITH {CAND}, l AS (SELECT level, avg(CAST(strict AS int)) FILTER (seen) AS a, avg(CAST(strict AS int)) FILTER (NOT seen) AS b, count(*) FILTER (seen) AS na, count(*) FILTER (NOT seen) AS nb FROM cand GROUP BY 1),
v AS (SELECT a - b AS d, a * (1 - a) / na + b * (1 - b) / nb AS v FROM l) SELECT round(sum(d / v) / sum(1 / v), 6) AS difference, round(sqrt(1 / sum(1 / v)), 6) AS error FROM v""",
    "kl_estimators": f"WITH {CAND}, x AS (SELECT level, discount - tax AS d FROM cand) SELECT level, round(avg(-d), 6) AS k1, round(avg(exp(d) - d - 1), 6) AS k3, round(avg(greatest(d, 0.0)), 6) AS gap FROM x GROUP BY 1",
    "follow_stream_scores": "SELECT event_id, user_id, round(value / 10, 6) AS score FROM events WHERE value >= 0",
}
