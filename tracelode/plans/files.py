"""Queries that write and read files, versioned tables and streams in the shared folder, and give back what they found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import grade as G
from tracelode.functions import text as T
from tracelode.operators import groups as GR
from tracelode.operators import pool as P
from tracelode.sources import jsonl as J
from tracelode.streaming import follow as V
from tracelode.tables import CANDIDATES_SQL as CAND
from tracelode.tables import candidates, shared_root, table


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private columns stay behind, but for the id; a side file has what was counted."""
    root = shared_root(spark, "jsonl")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_uid"), F.lit("x").alias("_scratch"), F.concat("c_name", F.lit(" ü⇒")).alias("name"), "c_acctbal", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")).alias("nation"))
    J.write(c, root)
    back = J.read_strict(spark, root, "_uid long, _scratch string, name string, c_acctbal double, nation int")
    J.write_meta(spark, root, {"rows": back.count()})
    return back.select(F.col("_uid").alias("uid"), F.col("_scratch").alias("scratch"), "name", "c_acctbal", "nation", F.lit(J.read_meta(spark, root)["rows"]).cast("long").alias("counted"))


def jsonl_torn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that were cut off, as every seventh is here, are left out, as are blank ones."""
    root = shared_root(spark, "torn")
    k = F.col("o_orderkey")
    line = F.to_json(F.struct(k.alias("key"), F.col("o_orderstatus").alias("status")))
    o = table(spark, sf_dir, "orders").select(F.when(k % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 4)).when(k % 11 == 0, "").otherwise(line).alias("value"))
    o.write.text(root)
    return J.read_tolerant(spark, root, "key long, status string").filter("key IS NOT NULL").groupBy("status").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


def eval_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files, each a suite with the file's name; some are left out."""
    root = shared_root(spark, "suites")
    nations = table(spark, sf_dir, "nation").collect()  # 25 rows
    for suite, rest in (("math", 0), ("code", 1), ("old", 2)):
        J.write_text(spark, f"{root}/{suite}.jsonl", "".join(f'{{"id": {r["n_nationkey"]}, "prompt": "{r["n_name"]}"}}\n' for r in nations if r["n_nationkey"] % 3 == rest))
    return J.read_suites(spark, f"{root}/*.jsonl", "id int, prompt string", without=["old"])


def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current version of a table that was published three times, what pruning left, and whether a frozen file could be overwritten."""
    root = shared_root(spark, "versions")
    n = table(spark, sf_dir, "nation")
    for v in (1, 2, 3):
        J.publish(n.filter(F.col("n_nationkey") % 4 < v), root, v)
    gone = J.prune(spark, root, 1)
    J.write(n, f"{root}-frozen", frozen=True)
    try:
        J.write(n.limit(1), f"{root}-frozen", frozen=True)
        refused = False
    except Exception as e:
        refused = "exist" in str(e).lower()
    return J.current(spark, root).select("n_nationkey", "n_name", F.lit(len(gone)).cast("long").alias("pruned"), F.lit(refused).alias("refused"))


def merged_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that were written again replace the older ones, others stay."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), "o_orderkey", "o_totalprice")
    return J.latest_by_key(o, "name", "o_orderkey").select("name", F.col("o_orderkey").alias("line"), F.round("o_totalprice", 2).alias("value"))


REPLY = """CASE o_orderkey % 5 WHEN 0 THEN concat('```json', chr(10), '{"a": ', o_orderkey, '}', chr(10), '```') WHEN 1 THEN concat('So: {"a": ', o_orderkey, ', "b": {"c": 1}} ok') WHEN 2 THEN 'none' WHEN 3 THEN concat('{"a": ', o_orderkey) ELSE concat(' {"a": ', o_orderkey, '} ') END"""


def tolerant_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as JSON, in a fence, among prose, broken, or none."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.expr(REPLY).alias("reply"))
    return o.select("key", J.tolerant_json(F.col("reply"), "a long")["a"].alias("a"))


CARD = "concat('# Card ', n_name, chr(10), '## 1. Rules', chr(10), 'text <!-- a', chr(10), 'b -->', chr(10), '```', chr(10), n_name, chr(10), '```', chr(10), '### Exemplar 1', chr(10), 'one', chr(10), '### Exemplar 2', chr(10), 'two ', n_nationkey, chr(10), '---', chr(10), chr(10), '## 2. End', chr(10), 'end', chr(10))"


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of Markdown, fenced blocks, and cards with fewer or more exemplars."""
    root = shared_root(spark, "cards")
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 4").select("n_name", F.expr(CARD).alias("card")).collect()
    for r in n:
        J.write_text(spark, f"{root}/{r['n_name'].replace(' ', '_')}.md", r["card"])
    s = J.sections(spark, root)
    own = s.select(F.col("title"), F.length("body").cast("long").alias("length"), T.strip(J.fenced(F.col("body"))).alias("block"))
    few = table(spark, sf_dir, "nation").filter("n_nationkey < 4").select(F.expr(CARD).alias("card"))
    few = few.select(F.lit("variant").alias("title"), F.length(J.with_exemplars(J.without_exemplars(F.col("card"), 2), ["new"])).cast("long").alias("length"), F.md5(J.with_exemplars(J.without_exemplars(F.col("card"), 2), ["new"])).alias("block"))
    return own.unionByName(few)


def artifact_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source, rows of a wrong type, empty ones, ids that repeat, and of a sample of each the gold answers that fail a round trip through the verifier."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), (F.col("o_orderkey") - F.when(F.col("o_orderkey") % 50 == 2, 1).otherwise(0)).alias("uid"), F.when(F.col("o_orderkey") % 40 != 0, F.concat(F.lit("p"), F.col("o_orderkey"))).otherwise("  ").alias("prompt"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("{"), F.col("o_orderkey"), F.lit("."))).otherwise(F.col("o_orderkey").cast("string")).alias("gold"), F.when(F.col("o_orderkey") % 90 != 0, (F.col("o_orderkey") % 9).cast("string")).otherwise("x").alias("level"))
    errors = d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("level").try_cast("int").isNull()).alias("wrong_type"), F.count_if(T.strip(F.col("prompt")) == "").alias("empty"), (F.count("*") - F.count_distinct("uid")).alias("repeated"))
    sample = P.top_by(d.withColumn("h", F.md5(F.concat(F.lit("s"), F.col("uid").cast("string"), F.col("prompt")))), ["source"], ["h", "uid", "prompt"], F.lit(20))
    tried = G.verified(sample.withColumn("pred", G.extract_answer(F.concat(F.lit("</think>\n\\boxed{"), F.col("gold"), F.lit("}")))), "pred", "gold", "ok")
    return errors.join(tried.groupBy("source").agg(F.count("*").alias("sampled"), F.count_if("ok").alias("round_trips")), "source")


def fresh_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates that were made for another model are stale: their digest isn't that of its files."""
    files = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("model"), "n_name", "n_nationkey")
    digest = lambda df: df.groupBy("model").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("n_name", F.lit(":"), F.col("n_nationkey").cast("string")))), ","), 256).alias("digest"))
    then = digest(files.withColumn("n_nationkey", F.when(F.col("n_nationkey") == 7, 70).otherwise(F.col("n_nationkey")))).withColumnRenamed("digest", "then")
    return digest(files).join(then, "model").select("model", "digest", (F.col("digest") == F.col("then")).alias("fresh"))


# Streams.
def scores_after_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: what a first scorer couldn't score is kept aside and scored by a later one, and nothing is scored twice."""
    root = shared_root(spark, "retry")
    events = table(spark, sf_dir, "events").select("event_id", "value")
    events.unionByName(events.filter("event_id % 10 = 0")).write.parquet(f"{root}/source")
    first = lambda b: b.withColumn("score", F.when(F.col("event_id") % 6 != 0, F.round(F.col("value") / 10, 6)))
    V.follow(spark, f"{root}/source", "event_id long, value double", first, f"{root}/scores", f"{root}/checkpoint", ["event_id"]).awaitTermination()
    later = V.retried(spark, lambda b: b.withColumn("score", F.round(F.col("value") / 10, 6)), f"{root}/scores", ["event_id"])
    out = spark.read.parquet(f"{root}/scores").select("event_id", "score", F.lit("first").alias("run"))
    return out.unionByName(later.select("event_id", "score", F.lit("later").alias("run")))


def budget_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget of each run as its groups come in; the state is two numbers for a run."""
    root = shared_root(spark, "budget")
    g = candidates(spark, sf_dir).groupBy(F.col("level").alias("run"), F.col("uid").alias("step")).agg(F.count("*").alias("n"), GR.whole_deviation("think_len").alias("std"))
    g.write.parquet(f"{root}/in")
    rows = spark.readStream.schema("run string, step long, n long, std double").parquet(f"{root}/in")
    sink = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch={number}")
    V.annealed_budget(rows, start=400.0, least_std=10.0).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("run").agg(F.max_by(F.struct("budget", "moves"), "moves").alias("x")).select("run", F.round("x.budget", 6).alias("budget"), "x.moves")


def request_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: requests with the rows that came back; the marker, written last, makes them an answer."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("step"))
    rows = candidates(spark, sf_dir).filter("uid % 3 <> 0").select(F.col("uid").alias("step"), "k")
    done = o.filter("step % 2 = 0")
    return V.answered(o, rows, done).groupBy("state").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))


def worker_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: how long ago each worker gave a sign of life, at the time of the last event of all."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("ts"))
    now = e.agg(F.max("ts").alias("now")).first()[0]  # one number
    workers = table(spark, sf_dir, "customer").filter("c_custkey <= 200").select(F.col("c_custkey").alias("worker"))
    out = V.staleness(workers, e, F.lit(now), 86_400.0)
    return out.groupBy("state").agg(F.count("*").alias("n"), F.round(F.min("age"), 1).alias("least"))


def audit_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: the problems that an audit round judges: as many as are due, of each level in turn, none that was judged."""
    chosen = candidates(spark, sf_dir).filter("strict").groupBy("uid").agg(F.min("level").alias("level"), F.min("k").alias("k"))
    judged = chosen.filter("uid % 17 = 0").select("uid")
    due = V.audit_due(chosen.count(), judged.count(), every=50, each=10, most=40)  # two numbers
    order = [F.md5(F.concat(F.lit("a"), F.col("uid").cast("string"))), F.col("uid")]
    return P.round_robin(P.unseen(chosen, judged, ["uid"]), "level", order, due).select("uid", "level", F.col("turn").cast("long").alias("turn"))


def audit_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 200 judgments of each band; a pause where the hard band breaks its bounds."""
    j = candidates(spark, sf_dir).filter("k = 0").select("uid", F.when(F.col("level") >= "4", "hard").otherwise("easy").alias("band"), F.col("strict").alias("faithful"), (F.col("discount") > 0.08).alias("wrong"))
    last = P.top_by(j.withColumn("h", -F.col("uid")), ["band"], ["h"], F.lit(200))
    r = last.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg(F.col("faithful").cast("int")), 6).alias("faithful"), F.round(F.avg(F.col("wrong").cast("int")), 6).alias("wrong"))
    return r.withColumn("pause", (F.col("band") == "hard") & ((F.col("faithful") < 0.35) | (F.col("wrong") > 0.35)))


_all = (jsonl_round_trip, jsonl_torn_lines, eval_suites, published_versions, merged_stats, tolerant_replies, cards, artifact_errors, fresh_gates, scores_after_retry, budget_stream, request_states, worker_staleness, audit_round, audit_pause)
QUERIES = {f.__name__: f for f in _all}

_variant = """regexp_replace(split_part(CARD, '### Exemplar 2', 1) || chr(45) || '--' || chr(10) || chr(10) || '## 2. End' || chr(10) || 'end', '\\s+$', '') || chr(10) || chr(10) || '### Exemplar 2' || chr(10) || chr(10) || 'new' || chr(10)""".replace("CARD", CARD)
ORACLES = {
    "jsonl_round_trip": "SELECT c_custkey AS uid, NULL AS scratch, c_name || ' ü⇒' AS name, c_acctbal, CASE WHEN c_nationkey % 3 <> 0 THEN c_nationkey END AS nation, (SELECT count(*) FROM customer) AS counted FROM customer",
    "jsonl_torn_lines": "SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey) AS bigint) AS keys FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 GROUP BY 1",
    "eval_suites": "SELECT n_nationkey AS id, n_name AS prompt, CASE n_nationkey % 3 WHEN 0 THEN 'math' ELSE 'code' END AS suite FROM nation WHERE n_nationkey % 3 <> 2",
    "published_versions": "SELECT n_nationkey, n_name, 2 AS pruned, true AS refused FROM nation WHERE n_nationkey % 4 < 3",
    "merged_stats": "SELECT o_custkey AS name, max(o_orderkey) AS line, round(arg_max(o_totalprice, o_orderkey), 2) AS value FROM orders GROUP BY 1",
    "tolerant_replies": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 IN (0, 1, 4) THEN o_orderkey END AS a FROM orders",
    "cards": f"""WITH c AS (SELECT n_name, n_nationkey, {CARD} AS card FROM nation WHERE n_nationkey < 4),
v AS (SELECT {_variant} AS v FROM nation WHERE n_nationkey < 4)
SELECT '1. Rules' AS title, length(split_part(split_part(replace(card, '<!-- a' || chr(10) || 'b -->', ''), '## 1. Rules' || chr(10), 2), '## 2. End', 1)) AS length, n_name AS block FROM c
 UNION ALL SELECT '2. End', 4, '' FROM c UNION ALL SELECT 'variant', length(v), md5(v) FROM v""",
    "artifact_errors": f"""WITH d AS (SELECT o_orderpriority AS source, o_orderkey - CASE WHEN o_orderkey % 50 = 2 THEN 1 ELSE 0 END AS uid, CASE WHEN o_orderkey % 40 <> 0 THEN 'p' || o_orderkey ELSE '  ' END AS prompt, o_orderkey AS k FROM orders),
e AS (SELECT source, count(*) AS n, count(*) FILTER (k % 90 = 0) AS wrong_type, count(*) FILTER (k % 40 = 0) AS empty, count(*) - count(DISTINCT uid) AS repeated FROM d GROUP BY 1),
s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('s' || uid || prompt), uid, prompt) AS r FROM d), t AS (SELECT source, CASE WHEN k % 3 = 0 THEN '{{' || k || '.' ELSE CAST(k AS varchar) END AS gold, '</think>' || chr(10) || chr(92) || 'boxed{{' || CASE WHEN k % 3 = 0 THEN '{{' || k || '.' ELSE CAST(k AS varchar) END || '}}' AS text FROM s WHERE r <= 20),
{G.sql_steps('t')}, z AS (SELECT source, count(*) AS sampled, count(*) FILTER (as_scored) AS round_trips FROM graded GROUP BY 1) SELECT e.*, sampled, round_trips FROM e JOIN z ON e.source = z.source""",
    "fresh_gates": "SELECT n_regionkey AS model, sha256(array_to_string(list_sort(list(n_name || ':' || n_nationkey)), ',')) AS digest, count(*) FILTER (n_nationkey = 7) = 0 AS fresh FROM nation GROUP BY 1",
    "scores_after_retry": "SELECT event_id, round(value / 10, 6) AS score, CASE WHEN event_id % 6 <> 0 THEN 'first' ELSE 'later' END AS run FROM events",
    "budget_stream": f"WITH {CAND}, g AS (SELECT level AS run, uid, count(*) AS n, stddev_pop(think_len) AS std FROM cand GROUP BY 1, 2), m AS (SELECT run, count(*) FILTER (n < 2 OR std >= 10) AS moves FROM g GROUP BY 1) SELECT run, round(greatest(120.0, 400.0 * pow(0.995, moves)), 6) AS budget, moves FROM m",
    "request_states": f"WITH {CAND}, o AS (SELECT o_orderkey AS step FROM orders WHERE o_orderkey % 5 = 0), r AS (SELECT uid AS step, count(*) AS n FROM cand WHERE uid % 3 <> 0 GROUP BY 1), s AS (SELECT CASE WHEN o.step % 2 = 0 THEN 'answered' WHEN n > 0 THEN 'writing' ELSE 'waiting' END AS state, coalesce(n, 0) AS n FROM o LEFT JOIN r ON o.step = r.step) SELECT state, count(*) AS n, CAST(sum(s.n) AS bigint) AS rows FROM s GROUP BY 1",
    "worker_staleness": "WITH l AS (SELECT user_id AS worker, max(ts) AS ts FROM events GROUP BY 1), a AS (SELECT round(epoch((SELECT max(ts) FROM events)) - epoch(l.ts), 1) AS age FROM customer LEFT JOIN l ON c_custkey = worker WHERE c_custkey <= 200) SELECT CASE WHEN age IS NULL THEN 'never started' WHEN age > 86400 THEN 'stale' ELSE 'alive' END AS state, count(*) AS n, round(min(age), 1) AS least FROM a GROUP BY 1",
    "audit_round": f"""WITH {CAND}, c AS (SELECT uid, min(level) AS level FROM cand WHERE strict GROUP BY 1), d AS (SELECT greatest(0, least(40, count(*) // 50 * 10 - count(*) FILTER (uid % 17 = 0))) AS due FROM c),
t AS (SELECT uid, level, row_number() OVER (PARTITION BY level ORDER BY md5('a' || uid), uid) AS turn FROM c WHERE uid % 17 <> 0), r AS (SELECT *, row_number() OVER (ORDER BY turn, level) AS i FROM t) SELECT uid, level, turn FROM r WHERE i <= (SELECT due FROM d)""",
    "audit_pause": f"""WITH {CAND}, j AS (SELECT uid, CASE WHEN level >= '4' THEN 'hard' ELSE 'easy' END AS band, strict, discount > 0.08 AS wrong FROM cand WHERE k = 0), l AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY uid DESC) AS r FROM j)
SELECT band, count(*) AS n, round(avg(CAST(strict AS int)), 6) AS faithful, round(avg(CAST(wrong AS int)), 6) AS wrong, band = 'hard' AND (round(avg(CAST(strict AS int)), 6) < 0.35 OR round(avg(CAST(wrong AS int)), 6) > 0.35) AS pause FROM l WHERE r <= 200 GROUP BY 1""",
}
