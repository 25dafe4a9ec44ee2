"""Queries of rules that must hold: splits, refusals, gates, verdicts, and measures with data that is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelode.functions import reward as R
from tracelode.functions import shaping as H
from tracelode.functions import text as T
from tracelode.operators import groups as GR
from tracelode.operators import pool as P
from tracelode.operators import traces as O
from tracelode.plans.grading import COMPLETIONS_SQL, PENALTIES_SQL, completions
from tracelode.plans.traces import TRACES_SQL, traces
from tracelode.streaming import follow as V
from tracelode.tables import CANDIDATES_SQL as CAND
from tracelode.tables import STEPS_SQL, candidates, shared_root, steps, table

LABELS = ("goal:", "chk:", "case 1:", "⇒")
NEW_LABELS = (("goal:", "Okay, so"), ("case 1:", "First"), ("✗", "No"))


def labels_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each line the first label that it begins with goes, or gives way to another; how many did."""
    gone, n = H.strip_labels(F.col("compact"), list(LABELS))
    other, m = H.replace_labels(F.col("compact"), list(NEW_LABELS))
    return traces(spark, sf_dir).filter("k < 3").select("uid", "k", F.md5(gone).alias("stripped"), n.cast("long").alias("n_stripped"), F.md5(other).alias("replaced"), m.cast("long").alias("n_replaced"))


def _line_sql(pairs) -> str:
    body = "ltrim(x)"
    cases = " ".join(f"WHEN starts_with({body}, '{old}') THEN " + (f"ltrim(substr({body}, {len(old) + 1}))" if new is None else f"trim('{new} ' || ltrim(substr({body}, {len(old) + 1})))") for old, new in pairs)
    return f"list_transform(l, lambda x: substr(x, 1, length(x) - length({body})) || CASE {cases} ELSE {body} END)"


def _hit_sql(pairs) -> str:
    return f"len(list_filter(l, lambda x: {' OR '.join(f'starts_with(ltrim(x), {chr(39)}{old}{chr(39)})' for old, _ in pairs)}))"


def group_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With how far the numbers of paragraphs in a group are apart, which is a trigger beyond 100; paragraphs count twenty-fold here, so that it is met."""
    c = R.split(completions(spark, sf_dir)).withColumn("gid", F.floor(F.col("key") / 8)).withColumn("parts_n", 20 * F.size(T.chunks(F.col("think"))))
    w = W.partitionBy("gid")
    p = R.penalties_v1(c.withColumn("spread", F.max("parts_n").over(w) - F.min("parts_n").over(w)), variation="spread")
    return p.groupBy("shape").agg(F.count_if(F.col("spread") > 100).alias("wide"), F.round(F.sum("monolithic"), 4).alias("monolithic"))


def meta_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guesses that are hedged at the end of the thought; off unless it is asked for."""
    tail = "concat(think, CASE key % 6 WHEN 0 THEN ' The Common Answer is 3' WHEN 1 THEN concat(' Or A. Or ', key) WHEN 2 THEN ' Lets go with it' WHEN 3 THEN concat(' such problems often', repeat(' end', 150)) ELSE '' END)"
    c = R.split(completions(spark, sf_dir)).withColumn("think", F.expr(tail))
    return c.groupBy("shape").agg(F.count_if(R.meta_pattern(F.col("think")) > 0).alias("fired"), F.round(F.sum(R.meta_pattern(F.col("think"))), 4).alias("magnitude"), F.round(F.sum(R.meta_pattern(F.col("think"), enabled=False)), 4).alias("off"))


def stratified_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source and language a twentieth is held out and a tenth is for validation, the rest is for training; keys in two splits are counted, by intersections."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").withColumn("h", F.md5(F.concat(F.lit("split"), F.col("doc_id").cast("string"))))
    sizes = d.groupBy("source", "lang").agg(F.floor(F.count("*") / 20).alias("n_held"), F.floor(F.count("*") / 10).alias("n_val"))
    keyed = d.join(F.broadcast(sizes), ["source", "lang"])  # a row for each stratum
    small = P.top_by(keyed, ["source", "lang"], ["h", "doc_id"], F.col("n_held") + F.col("n_val"))
    place = F.row_number().over(W.partitionBy("source", "lang").orderBy("h", "doc_id"))
    small = small.select("doc_id", "source", "lang", F.when(place <= F.col("n_held"), "heldout").otherwise("val").alias("split"))
    train = d.join(small, "doc_id", "left_anti").select("doc_id", "source", "lang", F.lit("train").alias("split"))
    every = small.unionByName(train)
    ids = {s: every.filter(F.col("split") == s).select("doc_id") for s in ("train", "val", "heldout")}
    both = ids["train"].intersect(ids["val"]).unionByName(ids["train"].intersect(ids["heldout"])).unionByName(ids["val"].intersect(ids["heldout"])).agg(F.count("*").alias("in_two"))
    return every.groupBy("split", "lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")).join(F.broadcast(both))  # a single row


def finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drafts whose difference is a number beyond the threshold; a draft without one of its texts, or with a box in its thought, stops the job before anything is written."""
    t = traces(spark, sf_dir).filter("uid % 5 <> 0").withColumn("delta", F.when(F.col("k") == 3, float("nan")).when(F.col("k") != 4, F.col("discount") - F.col("tax")))
    kept = t.filter(F.col("delta").isNotNull() & ~F.isnan("delta") & (F.col("delta") > 0.02))
    bad = kept.agg(F.count_if((F.coalesce(F.col("origin"), F.lit("")) == "") | (F.coalesce(F.col("compact"), F.lit("")) == "")).alias("empty"), F.count_if(F.contains("compact", F.lit("\\boxed{"))).alias("boxed"))
    allowed = O.asserted(kept, bad, (F.col("empty") == 0) & (F.col("boxed") == 0), F.concat(F.lit("refused: "), F.col("empty").cast("string"), F.lit(" without a text, "), F.col("boxed").cast("string"), F.lit(" with a box")))
    return allowed.groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("delta"))


def pass_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: verdicts that are missing don't count, and a draw that has none has no rate."""
    c = candidates(spark, sf_dir).withColumn("strict", F.when((F.col("k") < 6) & ~((F.col("k") % 4 == 3) & (F.col("uid") % 3 == 0)), F.col("strict")))
    return GR.pass_at_k(c)


def protocol_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: a model against its baseline, suite by suite: accuracy, thought and answer, entropy (measured for some), form. Other settings than the baseline's end it; what isn't measured never passes."""
    c = candidates(spark, sf_dir).withColumns({"entropy": F.when(F.col("level") <= "3", F.col("discount")), "cap": F.when(F.col("level") == "5", F.when(F.col("seen"), 100).otherwise(200)).otherwise(100)})
    side = c.groupBy("level", "seen").agg(F.avg(F.col("strict").cast("int")).alias("acc"), F.percentile(F.when(F.col("g") == 1, F.col("think_len")), 0.5).alias("think"), F.percentile(F.when(F.col("g") == 1, F.col("answer_len")), 0.5).alias("answer"), F.percentile("entropy", 0.5).alias("entropy"), F.avg("g").alias("g"), F.max("cap").alias("cap"))
    b, s = side.filter("seen").alias("b"), side.filter("NOT seen").alias("s")
    j = b.join(s, F.col("b.level") == F.col("s.level")).select(F.col("b.level").alias("level"), (F.col("b.cap") == F.col("s.cap")).alias("same"), (F.round(F.col("s.acc"), 9) >= F.round(F.col("b.acc") - 0.02, 9)).alias("f3a"), ((F.col("s.think") <= F.col("b.think")) & (F.abs(F.col("s.answer") - F.col("b.answer")) <= 0.15 * F.col("b.answer"))).alias("f3b"), (F.col("s.entropy") > F.col("b.entropy")).alias("f3c"), (F.round(F.col("s.g"), 9) >= 0.49).alias("f3d"))
    gate = lambda c: F.when(F.col(c).isNull(), "UNMEASURED").when(F.col(c), "PASS").otherwise("FAIL")
    every = [gate(x) for x in ("f3a", "f3b", "f3c", "f3d")]
    overall = F.when(~F.col("same"), "OTHER PROTOCOL").when(F.array_contains(F.array(*every), "UNMEASURED"), "INCOMPLETE").when(F.array_contains(F.array(*every), "FAIL"), "FAIL").otherwise("PASS")
    return j.select("level", *(g.alias(n) for g, n in zip(every, ("accuracy", "length", "entropy", "form"), strict=True)), overall.alias("overall"))


def entropy_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of low and of high entropies, a histogram of fixed bins with an open last one, and whether two of three tests speak for a collapse."""
    c = candidates(spark, sf_dir).select("level", (F.pow(F.col("think_len") / 50.0, F.lit(3.0)) * 2 * F.when(F.col("level") == "1", 0.2).otherwise(1.0)).alias("x"))
    bins = [F.count_if(F.least(F.floor(F.col("x") * 4), F.lit(7)) == i) for i in range(8)]
    s = c.groupBy("level").agg(F.count("*").alias("n"), F.percentile("x", 0.5).alias("p50"), F.avg((F.col("x") < 0.1).cast("int")).alias("low"), F.avg((F.col("x") > 1.5).cast("int")).alias("high"), F.array_join(F.array(*bins), ",").alias("histogram"))
    hits = (F.col("p50") < 0.15).cast("int") + (F.col("low") > 0.60).cast("int") + (F.col("high") < 0.10).cast("int")
    return s.select("level", "n", F.round("p50", 6).alias("p50"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "histogram", hits.alias("hits"), F.when(hits >= 2, "restoration").otherwise("preservation").alias("mode"), F.when(hits >= 2, 0.7).otherwise(0.5).alias("delta_max"))


def nested_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over ten steps of a value inside a record, by its path; a path that isn't there has no mean."""
    s = steps(spark, sf_dir).withColumn("p", F.from_json("props", "k double, deep struct<x: double>"))
    return s.groupBy("user_id", F.floor((F.col("step") - 1) / 10).cast("long").alias("win")).agg(F.round(F.avg("p.k"), 6).alias("k"), F.round(F.avg("p.deep.x"), 6).alias("deep"))


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream has read, and the keys that it holds, from its own progress."""
    root = shared_root(spark, "progress")
    table(spark, sf_dir, "events").select("event_id", "value").write.parquet(f"{root}/source")
    q = V.follow(spark, f"{root}/source", "event_id long, value double", lambda b: b.withColumn("score", F.col("value") * 2), f"{root}/scores", f"{root}/checkpoint", ["event_id"])
    q.awaitTermination()
    told = V.progress(q)
    return spark.read.parquet(f"{root}/scores").agg(F.count("*").alias("scored"), F.lit(sum(p["rows"] for p in told)).cast("long").alias("read"), F.lit(max([0, *(p["state"] for p in told)])).cast("long").alias("state"))


_all = (labels_replaced, group_spread, meta_patterns, stratified_splits, finalized, pass_with_missing, protocol_gates, entropy_verdict, nested_windows, stream_progress)
QUERIES = {f.__name__: f for f in _all}
_strip = [(m, None) for m in LABELS]
_meta = "concat(think, CASE key % 6 WHEN 0 THEN ' The Common Answer is 3' WHEN 1 THEN concat(' Or A. Or ', key) WHEN 2 THEN ' Lets go with it' WHEN 3 THEN concat(' such problems often', repeat(' end', 150)) ELSE '' END)"
ORACLES = {
    "labels_replaced": f"WITH {TRACES_SQL}, l AS (SELECT uid, k, string_split(compact, chr(10)) AS l FROM tr WHERE k < 3) SELECT uid, k, md5(array_to_string({_line_sql(_strip)}, chr(10))) AS stripped, {_hit_sql(_strip)} AS n_stripped, md5(array_to_string({_line_sql(NEW_LABELS)}, chr(10))) AS replaced, {_hit_sql(NEW_LABELS)} AS n_replaced FROM l",
    "group_spread": f"""WITH {COMPLETIONS_SQL}, {PENALTIES_SQL}, s AS (SELECT shape, monolithic, 20 * (max(len(parts)) OVER w - min(len(parts)) OVER w) > 100 AS wide, coalesce(list_max(list_transform(regexp_extract_all(think, '(?m)^\\s*(\\d+)\\.\\s', 1), lambda x: TRY_CAST(x AS bigint))), 0) > 50 AS a, again_ = 0 AND length(think) > 6000 AS b FROM pen WINDOW w AS (PARTITION BY floor(key / 8)))
SELECT shape, count(*) FILTER (wide) AS wide, round(CAST(sum(least(0.15, 0.1 * (CAST(a AS int) + CAST(b AS int) + CAST(wide AS int)))) AS double), 4) AS monolithic FROM s GROUP BY 1""",
    "meta_patterns": f"""WITH {COMPLETIONS_SQL}, p AS (SELECT shape, key, CASE WHEN instr(text, '</think>') > 0 THEN substr(text, 1, instr(text, '</think>') - 1) ELSE text END AS think FROM comp), m AS (SELECT shape, regexp_matches("right"({_meta}, 500), '{R.META_PATTERN.replace("'", "''")}') AS hit FROM p)
SELECT shape, count(*) FILTER (hit) AS fired, round(CAST(sum(CASE WHEN hit THEN {R.META_PENALTY} ELSE 0 END) AS double), 4) AS magnitude, CAST(0.0 AS double) AS off FROM m GROUP BY 1""",
    "stratified_splits": """WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5('split' || doc_id), doc_id) AS place, count(*) OVER (PARTITION BY source, lang) AS n FROM documents),
s AS (SELECT *, CASE WHEN place <= n // 20 THEN 'heldout' WHEN place <= n // 20 + n // 10 THEN 'val' ELSE 'train' END AS split FROM r) SELECT split, lang, count(*) AS n, CAST(sum(doc_id) AS bigint) AS ids, 0 AS in_two FROM s GROUP BY 1, 2""",
    "finalized": f"WITH {CAND} SELECT level, count(*) AS n, round(avg(discount - tax), 6) AS delta FROM cand WHERE uid % 5 <> 0 AND k NOT IN (3, 4) AND discount - tax > 0.02 GROUP BY 1",
    "pass_with_missing": f"""WITH {CAND}, f AS (SELECT uid, k, CASE WHEN k < 6 AND NOT (k % 4 = 3 AND uid % 3 = 0) THEN CAST(strict AS int) END AS s FROM cand), d AS (SELECT k, avg(s) AS p FROM f GROUP BY 1), a AS (SELECT round(avg(p), 6) AS pass_1, round(stddev_samp(p), 6) AS std, count(*) AS draws FROM d),
u AS (SELECT uid, max(s) AS x, max(CASE WHEN k = 0 THEN s END) AS at1 FROM f GROUP BY 1), b AS (SELECT round(avg(x), 6) AS pass_k, round(avg(at1), 6) AS at1, count(*) AS problems FROM u) SELECT * FROM a CROSS JOIN b""",
    "protocol_gates": f"""WITH {CAND}, x AS (SELECT level, seen, avg(CAST(strict AS int)) AS acc, quantile_cont(think_len, 0.5) FILTER (g = 1) AS think, quantile_cont(answer_len, 0.5) FILTER (g = 1) AS answer, quantile_cont(discount, 0.5) FILTER (level <= '3') AS entropy, avg(g) AS g FROM cand GROUP BY 1, 2),
j AS (SELECT b.level, b.level <> '5' AS same, round(s.acc, 9) >= round(b.acc - 0.02, 9) AS a, s.think <= b.think AND abs(s.answer - b.answer) <= 0.15 * b.answer AS l, s.entropy > b.entropy AS e, round(s.g, 9) >= 0.49 AS f FROM x b JOIN x s ON b.level = s.level AND b.seen AND NOT s.seen),
g AS (SELECT level, same, {", ".join(f"CASE WHEN {x} IS NULL THEN 'UNMEASURED' WHEN {x} THEN 'PASS' ELSE 'FAIL' END AS {n}" for x, n in (("a", "accuracy"), ("l", "length"), ("e", "entropy"), ("f", "form")))} FROM j)
SELECT level, accuracy, length, entropy, form, CASE WHEN NOT same THEN 'OTHER PROTOCOL' WHEN 'UNMEASURED' IN (accuracy, length, entropy, form) THEN 'INCOMPLETE' WHEN 'FAIL' IN (accuracy, length, entropy, form) THEN 'FAIL' ELSE 'PASS' END AS overall FROM g""",
    "entropy_verdict": f"""WITH {CAND}, x AS (SELECT level, pow(think_len / 50.0, 3) * 2 * CASE WHEN level = '1' THEN 0.2 ELSE 1.0 END AS x FROM cand), s AS (SELECT level, count(*) AS n, quantile_cont(x, 0.5) AS p50, avg(CAST(x < 0.1 AS int)) AS low, avg(CAST(x > 1.5 AS int)) AS high, {" || ',' || ".join(f"count(*) FILTER (least(floor(x * 4), 7) = {i})" for i in range(8))} AS histogram FROM x GROUP BY 1),
h AS (SELECT *, CAST(p50 < 0.15 AS int) + CAST(low > 0.6 AS int) + CAST(high < 0.1 AS int) AS hits FROM s) SELECT level, n, round(p50, 6) AS p50, round(low, 6) AS low, round(high, 6) AS high, histogram, hits, CASE WHEN hits >= 2 THEN 'restoration' ELSE 'preservation' END AS mode, CAST(CASE WHEN hits >= 2 THEN 0.7 ELSE 0.5 END AS double) AS delta_max FROM h""",
    "nested_windows": f"WITH {STEPS_SQL} SELECT user_id, (step - 1) // 10 AS win, round(avg(CAST(json_extract_string(props, '$.k') AS double)), 6) AS k, round(avg(CAST(json_extract_string(props, '$.deep.x') AS double)), 6) AS deep FROM steps GROUP BY 1, 2",
    "stream_progress": "SELECT count(*) AS scored, count(*) AS read, count(*) AS state FROM events",
}
