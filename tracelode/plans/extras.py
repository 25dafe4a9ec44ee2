"""Queries of the smaller operators: projections, choices for each problem, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import groups as GR
from tracelode.operators import pool as P
from tracelode.plans.grading import COMPLETIONS_SQL, completions
from tracelode.plans.groups import BUCKETS
from tracelode.plans.pool import LINES
from tracelode.tables import CANDIDATES_SQL as CAND
from tracelode.tables import candidates, table


def gold_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first marked number, and all that follows the last mark."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    s = F.concat(F.lit("a #### "), F.col("key").cast("string"), F.lit(" b #### "), (F.col("key") + 1).cast("string"))
    return o.select("key", F.regexp_extract(s, r"####\s*(-?\d+)", 1).alias("first"), T.strip(F.substring_index(s, "####", -1)).alias("last"))


def mcq_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options in the order of a digest, and the letter of the right one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    options = F.array(*(F.concat(F.lit(x), F.col("key").cast("string")) for x in ("right", "wrong", "near", "far")))
    mixed = F.transform(F.array_sort(F.transform(options, lambda x: F.struct(F.md5(F.concat(F.col("key").cast("string"), F.lit(":"), x)).alias("h"), x.alias("x")))), lambda s: s["x"])
    o = o.withColumn("mixed", mixed)
    return o.select("key", F.array_join("mixed", "|").alias("options"), F.char(64 + F.array_position("mixed", F.concat(F.lit("right"), F.col("key").cast("string")))).alias("letter"))


def label_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that a pattern describes, at the start of lines, go, what is before them stays; and how many there were."""
    pattern = r"^(\s*)(?:goal|chk|sub|let|case)\s*\d*\s*:\s?"
    c = completions(spark, sf_dir).withColumn("rows", F.split("text", "\n"))
    return c.select("key", F.array_join(F.transform("rows", lambda x: F.regexp_replace(x, pattern, "$1")), "\n").alias("text"), F.size(F.filter("rows", lambda x: x.rlike(pattern))).cast("long").alias("labels"))


def round_robin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dealt to three buckets in turn."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("l"))
    part = lambda b: F.array_join(F.filter("l", lambda x, i: i % 3 == b), " ")
    return d.select("doc_id", *(F.md5(part(b)).alias(f"b{b}") for b in range(3)))


def shortest_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the shortest right rollout of each problem, the earliest of equals; and the earliest eligible one."""
    c = candidates(spark, sf_dir).filter("strict")
    return c.groupBy("uid").agg(F.min(F.struct("think_len", "k")).alias("m"), F.min(F.when(F.col("g") == 1, F.col("k"))).alias("first")).select("uid", F.col("m.k").cast("long").alias("k"), F.col("first").cast("long").alias("first"))


def finalize_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what is finite and beyond the threshold, and what is refused, by reason."""
    c = candidates(spark, sf_dir).withColumn("delta", F.when(F.col("k") == 3, float("nan")).otherwise(F.col("discount") - F.col("tax")))
    c = P.reasons(c, [("not finite", F.isnan("delta")), ("low", F.col("delta") <= 0.02)])
    return c.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def capped_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five examples of each kind."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.md5(F.col("event_id").cast("string")).alias("h"))
    return P.top_by(e, ["event_type"], ["h", "event_id"], F.lit(5)).select("event_type", "event_id")


def curriculum_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems by pass rate, and the share that still teaches."""
    b = GR.buckets(candidates(spark, sf_dir))
    band = F.when(F.col("p_hat") >= 0.625, "high").when(F.col("p_hat") >= 0.375, "mid").when(F.col("p_hat") > 0, "low").otherwise("zero")
    return b.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("bucket") == "mixed").cast("int")), 6).alias("mixed"))


def draft_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures by level, those out of bounds named."""
    g = candidates(spark, sf_dir).groupBy("level").agg(F.round(F.avg("g"), 6).alias("gate"), F.round(F.percentile("think_len", 0.5), 6).alias("median"), F.round(F.stddev_samp("think_len"), 6).alias("std"))
    breaches = F.array_join(F.array_compact(F.array(F.when(F.col("gate") < 0.5, "gate"), F.when(F.col("median") > 25, "median"), F.when(F.col("std") > 14.4, "std"))), ",")
    return g.withColumn("breaches", breaches)


def length_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether thought grows with the level."""
    m = candidates(spark, sf_dir).groupBy("level").agg(F.avg("think_len").alias("m"))
    return m.agg(F.round(F.corr(F.col("level").cast("double"), "m"), 6).alias("r"), F.count("*").alias("levels")).withColumn("grows", F.col("r") > 0.3)


def excess_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty word types with the largest sum of what is beyond a threshold, and their shares."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("w"), (F.col("n_chars") % 50).alias("x"))
    t = w.groupBy("w").agg(F.sum(F.greatest(F.col("x") - 30, F.lit(0))).alias("excess"))
    total = t.agg(F.sum("excess").alias("total"))
    return t.orderBy(F.desc("excess"), "w").limit(20).join(F.broadcast(total)).select("w", "excess", F.round(F.col("excess") / F.col("total"), 6).alias("share"))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest over names and sizes, in order."""
    n = table(spark, sf_dir, "nation")
    return n.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("n_name"), F.lit(":"), F.col("n_nationkey").cast("string")))), ","), 256).alias("digest"))


def array_join_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays joined by a composite key; those of another length than the record says, and missing ones, are counted."""
    c = candidates(spark, sf_dir).select("uid", "k", (F.col("think_len") % 5).alias("n"))
    a = c.filter("k % 3 < 2").select("uid", "k", F.transform(F.sequence(F.lit(0), F.col("k") % 5), lambda i: i * 1.0).alias("scores"))
    j = c.join(a, ["uid", "k"], "left")
    return P.reasons(j, [("missing", F.col("scores").isNull()), ("length", F.size("scores") != F.col("n"))]).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


_all = (gold_extract, mcq_render, label_strip, round_robin_merge, shortest_trace, finalize_threshold, capped_samples, curriculum_bands, draft_breaches, length_correlation, excess_types, fingerprint, array_join_checked)
QUERIES = {f.__name__: f for f in _all}
LABEL = "^(\\s*)(?:goal|chk|sub|let|case)\\s*\\d*\\s*:\\s?"
ORACLES = {
    "gold_extract": "WITH s AS (SELECT o_orderkey AS key, 'a #### ' || o_orderkey || ' b #### ' || (o_orderkey + 1) AS s FROM orders) SELECT key, regexp_extract(s, '####\\s*(-?\\d+)', 1) AS first, trim(string_split(s, '####')[-1]) AS last FROM s",
    "mcq_render": """WITH o AS (SELECT o_orderkey AS key, list_transform(list_sort(list_transform(['right', 'wrong', 'near', 'far'], lambda x: {'h': md5(o_orderkey || ':' || x || o_orderkey), 'x': x || o_orderkey})), lambda s: s.x) AS m FROM orders)
SELECT key, array_to_string(m, '|') AS options, chr(CAST(64 + list_position(m, 'right' || key) AS int)) AS letter FROM o""",
    "label_strip": f"WITH {COMPLETIONS_SQL}, r AS (SELECT key, string_split(text, chr(10)) AS l FROM comp) SELECT key, array_to_string(list_transform(l, lambda x: regexp_replace(x, '{LABEL}', '\\1')), chr(10)) AS text, CAST(len(list_filter(l, lambda x: regexp_matches(x, '{LABEL}'))) AS bigint) AS labels FROM r",
    "round_robin_merge": f"WITH l AS (SELECT doc_id, {LINES} AS l FROM documents) SELECT doc_id, " + ", ".join(f"md5(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: (i - 1) % 3 = {b}), lambda i: l[i]), ' ')) AS b{b}" for b in range(3)) + " FROM l",
    "shortest_trace": f"WITH {CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY think_len, k) AS n, min(k) FILTER (g = 1) OVER (PARTITION BY uid) AS first FROM cand WHERE strict) SELECT uid, k, first FROM r WHERE n = 1",
    "finalize_threshold": f"WITH {CAND} SELECT CASE WHEN k = 3 THEN 'not finite' WHEN discount - tax <= 0.02 THEN 'low' ELSE 'kept' END AS reason, count(*) AS n FROM cand GROUP BY 1",
    "capped_samples": "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS varchar)), event_id) AS n FROM events) SELECT event_type, event_id FROM r WHERE n <= 5",
    "curriculum_bands": f"WITH {BUCKETS} SELECT CASE WHEN p_hat >= 0.625 THEN 'high' WHEN p_hat >= 0.375 THEN 'mid' WHEN p_hat > 0 THEN 'low' ELSE 'zero' END AS band, count(*) AS n, round(avg(CAST(bucket = 'mixed' AS int)), 6) AS mixed FROM t GROUP BY 1",
    "draft_breaches": f"WITH {CAND}, g AS (SELECT level, round(avg(g), 6) AS gate, round(quantile_cont(think_len, 0.5), 6) AS median, round(stddev_samp(think_len), 6) AS std FROM cand GROUP BY 1) SELECT *, array_to_string(list_filter([CASE WHEN gate < 0.5 THEN 'gate' END, CASE WHEN median > 25 THEN 'median' END, CASE WHEN std > 14.4 THEN 'std' END], lambda x: x IS NOT NULL), ',') AS breaches FROM g",
    "length_correlation": f"WITH {CAND}, m AS (SELECT level, avg(think_len) AS m FROM cand GROUP BY 1), r AS (SELECT round(corr(CAST(level AS double), m), 6) AS r, count(*) AS levels FROM m) SELECT r, levels, r > 0.3 AS grows FROM r",
    "excess_types": """WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w, n_chars % 50 AS x FROM documents), t AS (SELECT w, CAST(sum(greatest(x - 30, 0)) AS bigint) AS excess FROM w GROUP BY 1)
SELECT w, excess, round(excess / (SELECT sum(excess) FROM t), 6) AS share FROM t ORDER BY excess DESC, w LIMIT 20""",
    "fingerprint": "SELECT sha256(array_to_string(list_sort(list(n_name || ':' || n_nationkey)), ',')) AS digest FROM nation",
    "array_join_checked": f"WITH {CAND} SELECT CASE WHEN k % 3 = 2 THEN 'missing' WHEN k % 5 + 1 <> think_len % 5 THEN 'length' ELSE 'ok' END AS reason, count(*) AS n FROM cand GROUP BY 1",
}
