"""Queries over pools of problems: documents are the pool, benchmark items the evaluation set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import pool as P
from tracelode.tables import spread, table

NORM = "trim(regexp_replace(coalesce(text, ''), '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))"
TOKENS = f"regexp_extract_all(substr(lower({NORM}), 1, 400), '[\\p{{L}}\\p{{N}}_]+')"


def grams_sql(name: str, source: str, key: str) -> str:
    return f"""
{name}_t AS (SELECT {key} AS id, lower({NORM}) AS mkey, {TOKENS} AS toks FROM {source}),
{name} AS (SELECT id, mkey, CASE WHEN len(toks) >= 8 THEN list_distinct(list_transform(range(1, len(toks) - 6), lambda i: array_to_string(toks[i:i + 7], ' ')))
           WHEN len(toks) > 0 THEN [array_to_string(toks, ' ')] ELSE [] END AS grams FROM {name}_t)"""


def contamination_sql(threshold: float) -> str:
    return f"""WITH {grams_sql('d', 'documents', 'doc_id')}, {grams_sql('e', 'benchmark', 'item_id')},
exact AS (SELECT d.id AS doc_id, min(e.id) AS item_id FROM d JOIN e ON d.mkey = e.mkey GROUP BY 1),
dg AS (SELECT id, len(grams) AS n, unnest(grams) AS g FROM d), eg AS (SELECT id, len(grams) AS n, unnest(grams) AS g FROM e),
pairs AS (SELECT dg.id AS doc_id, eg.id AS item_id, count(*) AS c, any_value(dg.n) AS na, any_value(eg.n) AS nb FROM dg JOIN eg ON dg.g = eg.g GROUP BY 1, 2),
near AS (SELECT doc_id, item_id, round(c / (na + nb - c), 4) AS score FROM pairs WHERE c / (na + nb - c) > {threshold} AND doc_id NOT IN (SELECT doc_id FROM exact)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS r FROM near)
SELECT doc_id, 'exact' AS kind, item_id, CAST(1.0 AS double) AS score FROM exact UNION ALL SELECT doc_id, 'near', item_id, score FROM best WHERE r = 1"""


def near_sql(grams: str) -> str:
    return f"""WITH {grams}, s AS (SELECT id, list_sort(grams) AS grams FROM d WHERE len(grams) > 0), m AS (SELECT id, grams, min(id) OVER (PARTITION BY grams) AS head FROM s),
g AS (SELECT id, len(grams) AS n, unnest(grams) AS g FROM m WHERE id = head), f AS (SELECT g FROM g GROUP BY 1 HAVING count(*) > 1), k AS (SELECT g.* FROM g WHERE g IN (SELECT g FROM f)),
pairs AS (SELECT x.id AS doc_a, y.id AS doc_b, count(*) AS c, any_value(x.n) AS na, any_value(y.n) AS nb FROM k x JOIN k y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
SELECT doc_a, doc_b, round(c / (na + nb - c), 4) AS score FROM pairs WHERE c / (na + nb - c) > 0.8 UNION ALL SELECT head, id, 1.0 FROM m WHERE id <> head"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def contamination_report(spark: SparkSession, sf_dir: str, threshold: float = 0.8) -> DataFrame:
    """Exact and near copies of benchmark items."""
    return P.contamination(spread(docs(spark, sf_dir).select("doc_id", "text")), table(spark, sf_dir, "benchmark"), threshold)


def contamination_report_t50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(spark, sf_dir, 0.5)


def decontaminated_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays, counted by source."""
    hits = contamination_report(spark, sf_dir, 0.5)
    return docs(spark, sf_dir).join(hits, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


def contamination_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, J2 on what must be found: benchmark items with other white space, with eight more words, and with every other word gone."""
    b = table(spark, sf_dir, "benchmark")
    words = F.split("text", " ")
    third = F.array_join(F.filter(words, lambda x, i: i % 2 == 0), " ")
    made = b.select(F.col("item_id").alias("doc_id"), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("\n ")), F.lit(" "))).when(F.col("item_id") % 3 == 1, F.concat("text", F.lit(" and then eight more words at the end"))).otherwise(third).alias("text"))
    return P.contamination(made.unionByName(docs(spark, sf_dir).select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text")), b, 0.8)


CONTROL = """(SELECT item_id AS doc_id, CASE item_id % 3 WHEN 0 THEN concat(chr(32), chr(32), replace(text, chr(32), chr(10) || chr(32)), chr(32)) WHEN 1 THEN text || ' and then eight more words at the end' ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(text, ' ')) + 1), lambda i: i % 2 = 1), lambda i: string_split(text, ' ')[i]), ' ') END AS text FROM benchmark
 UNION ALL SELECT doc_id + 1000000, text FROM documents)"""


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 within the pool, by the first 400 characters: documents that open alike, pairs of classes and their members."""
    return P.near_pairs(spread(docs(spark, sf_dir).select("doc_id", "text")), first_chars=400)


def near_dup_pairs_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 within the pool, by whole texts: pairs of classes and their members."""
    return P.near_pairs(spread(docs(spark, sf_dir).select("doc_id", "text")))


def exact_dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in their order, then ids."""
    d = docs(spark, sf_dir).select("doc_id", "source", T.dedup_key(F.col("text")).alias("key"))
    return P.first_of(d, ["key"], [F.col("source"), F.col("doc_id")]).select("doc_id", "source", "key")


def stable_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by both recipes."""
    return docs(spark, sf_dir).select("doc_id", T.uid(F.col("source"), F.col("text")).alias("uid"), T.folded_key(F.col("text")).alias("folded"), F.sha1(T.match_key(F.col("text"))).alias("match_sha1"))


def hash_shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """7 shards by digest."""
    return docs(spark, sf_dir).groupBy(T.shard(F.concat(F.col("source"), F.lit(":"), F.col("doc_id").cast("string")), 7).cast("long").alias("shard")).agg(F.count("*").alias("n"))


def dist_by_source_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: counts by source, by language, and of all, in one pass."""
    g = docs(spark, sf_dir).groupingSets([["source"], ["lang"], []], "source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return g.select(F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("lang", F.lit("*")).alias("lang"), "n", "chars")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 documents by language."""
    return P.stratified_sample(docs(spark, sf_dir).select("doc_id", "lang"), "lang", F.col("doc_id"), 100, "s1").select("doc_id", "lang")


STRATIFIED_SQL = """WITH z AS (SELECT lang, count(*) AS size, (100 * count(*)) // (SELECT count(*) FROM documents) AS quota FROM documents GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY size - quota DESC, lang) AS rank FROM z),
q AS (SELECT lang, quota + CASE WHEN rank <= 100 - (SELECT sum(quota) FROM z) THEN 1 ELSE 0 END AS quota FROM r),
d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s1' || doc_id), doc_id) AS place FROM documents)
SELECT doc_id, d.lang FROM d JOIN q ON d.lang = q.lang WHERE place <= quota"""


def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """77 seats by source."""
    sizes = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("size"))
    return P.apportion(sizes, "source", 77)


def floor_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 documents of each language, those with a label first."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.lit(1).alias("has"))
    d = docs(spark, sf_dir).select("doc_id", "lang").join(labels, "doc_id", "left").withColumn("labelled", F.coalesce("has", F.lit(0)))
    d = d.withColumns({"unlabelled": 1 - F.col("labelled"), "h": F.md5(F.concat(F.lit("f"), F.col("doc_id").cast("string")))})
    return P.top_by(d, ["lang"], ["unlabelled", "h", "doc_id"], F.lit(20)).select("doc_id", "lang", F.col("labelled").cast("long").alias("labelled"))


def round_robin_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 documents, one of each source in turn."""
    out = P.round_robin(docs(spark, sf_dir).select("doc_id", "source"), "source", [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], 60)
    return out.select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


def disjoint_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits by the digest of the text's key, so that copies are in one split; counts."""
    d = docs(spark, sf_dir).select("source", T.dedup_key(F.col("text")).alias("key")).withColumn("p", P.split_by_hash(F.col("key"), "split"))
    d = d.withColumn("split", F.when(F.col("p") < 500, "val").when(F.col("p") < 1500, "heldout").otherwise("train"))
    return d.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


SPLIT_SQL = f"""WITH k AS (SELECT substr(sha1({NORM}), 1, 16) AS key FROM documents),
m AS (SELECT key, md5('split' || key) AS h FROM k),
p AS (SELECT key, ((CAST('0x' || substr(h, 1, 16) AS uhugeint) % 10000) * {2**64 % 10000} + CAST('0x' || substr(h, 17, 16) AS uhugeint) % 10000) % 10000 AS p FROM m)
SELECT CASE WHEN p < 500 THEN 'val' WHEN p < 1500 THEN 'heldout' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT key) AS keys FROM p GROUP BY 1"""


def staged_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: labelled documents in a digest's order; the first stage takes low levels only, later ones add what is left of them and higher levels."""
    d = docs(spark, sf_dir).select("doc_id", (F.col("n_chars") % 10 + 1).alias("level"))
    d = d.withColumn("band", F.when(F.col("level") <= 4, "low").when(F.col("level") >= 7, "high").otherwise("mid"))
    d = P.top_by(d.withColumn("h", F.md5(F.concat(F.lit("c"), F.col("doc_id").cast("string")))), ["band"], ["h", "doc_id"], F.lit(440))  # no stage goes further
    d = d.withColumn("place", F.row_number().over(W.partitionBy("band").orderBy("h", "doc_id")))
    low, place = F.col("band") == "low", F.col("place")
    stage = F.when(low & (place <= 200), 1).when(low & (place <= 340), 2).when((F.col("band") == "mid") & (place <= 60), 2).when(low & (place <= 440), 3).when((F.col("band") == "mid") & (place <= 110), 3).when((F.col("band") == "high") & (place <= 50), 3)
    return d.withColumn("stage", stage).filter("stage is not null").groupBy("stage", "band").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


def rejects_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason that holds, counted."""
    hits = contamination_report(spark, sf_dir, 0.5).select("doc_id", F.lit(True).alias("hit"))
    d = docs(spark, sf_dir).select("doc_id", "n_chars", T.dedup_key(F.col("text")).alias("key")).join(hits, "doc_id", "left")
    d = d.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("doc_id")))
    d = P.reasons(d, [("short", F.col("n_chars") < 200), ("in evaluation", F.coalesce("hit", F.lit(False))), ("repeated", F.col("place") > 1)])
    return d.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


REJECTS_SQL = f"""WITH hits AS ({contamination_sql(0.5)}),
k AS (SELECT doc_id, n_chars, substr(sha1({NORM}), 1, 16) AS key FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS place FROM k)
SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN doc_id IN (SELECT doc_id FROM hits) THEN 'in evaluation' WHEN place > 1 THEN 'repeated' ELSE 'kept' END AS reason, count(*) AS n FROM p GROUP BY 1"""


def validate_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, missing fields, blank texts and repeated keys of the pool, by source; no key is collected."""
    d = docs(spark, sf_dir).select("source", "doc_id", "text", T.dedup_key(F.col("text")).alias("key"))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull() | F.col("doc_id").isNull()).alias("missing"), F.count_if(T.strip(F.col("text")) == "").alias("blank"), (F.count("key") - F.count_distinct("key")).alias("repeated"))


#: Problems that have words of every kind: by the id, before the text.
TOPIC_WORDS = "concat(CASE doc_id % 9 WHEN 0 THEN 'Find the area of a square. ' WHEN 1 THEN 'Choose subsets. ' WHEN 2 THEN 'A rectangular prime. ' WHEN 3 THEN 'The integral ' WHEN 4 THEN 'Solve for roots ' WHEN 5 THEN 'primes and angles ' WHEN 6 THEN 'all digits ' ELSE '' END, coalesce(text, ''))"


def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N10"""
    return docs(spark, sf_dir).groupBy(T.topic(F.expr(TOPIC_WORDS)).alias("topic")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


def level_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels from a difficulty, rounded half up; what is out of range has none."""
    d = docs(spark, sf_dir).select(T.level_from_difficulty(F.col("n_chars") / 500.0).alias("level"))
    return d.groupBy(F.coalesce(F.col("level"), F.lit(-1)).cast("long").alias("level")).agg(F.count("*").alias("n"))


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of equal lines, stutters, words for each line, and markers."""
    d = docs(spark, sf_dir)
    lines = T.lines(F.col("text"))
    n = F.size(lines)
    per_line = F.aggregate(F.transform(lines, lambda x: F.size(T.words(x))), F.lit(0), lambda a, b: a + b)
    return d.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(T.longest_run(lines), F.lit(0)).cast("long").alias("line_run"), T.word_stutter(F.col("text")).cast("long").alias("stutters"), F.round(F.when(n > 0, per_line / n), 6).alias("words_per_line"), T.occurrences(F.col("text"), "the ").cast("long").alias("markers"))


LINES = "list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"
FEATURES_SQL = f"""WITH l AS (SELECT doc_id, text, {LINES} AS lines, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l),
y AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS island FROM x),
r AS (SELECT doc_id, max(c) AS run FROM (SELECT doc_id, line, island, count(*) AS c FROM y GROUP BY ALL) GROUP BY 1),
p AS (SELECT doc_id, sum(len(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+'))) AS words FROM x GROUP BY 1)
SELECT l.doc_id, CAST(len(lines) AS bigint) AS n_lines, CAST(coalesce(run, 0) AS bigint) AS line_run,
  CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND length(w[i]) > 2)) AS bigint) AS stutters,
  round(words / len(lines), 6) AS words_per_line, CAST((length(text) - length(replace(text, 'the ', ''))) // 4 AS bigint) AS markers
FROM l LEFT JOIN r ON l.doc_id = r.doc_id LEFT JOIN p ON l.doc_id = p.doc_id"""


def template_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines have in common without numbers and formulas, and how many lines share it."""
    lines = docs(spark, sf_dir).select(F.explode(T.lines(F.col("text"))).alias("line"))
    return lines.select(T.template(F.col("line")).alias("template")).filter("template <> ''").groupBy("template").agg(F.count("*").alias("n")).filter("n > 1")


WS = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
TEMPLATE_SQL = f"""WITH x AS (SELECT unnest({LINES}) AS line FROM documents),
t AS (SELECT array_to_string(list_slice(regexp_split_to_array(line, '{WS}'), 1, 12), ' ') AS s FROM x),
u AS (SELECT trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\\$[^$]*\\$', ' ', 'g'), '\\\\[A-Za-z]+\\{{[^{{}}]*\\}}', ' ', 'g'), '\\([^)]*\\)', ' ', 'g'), '[-+]?\\d+(?:[.,]\\d+)*', ' ', 'g'), '\\\\[A-Za-z]+', ' ', 'g')), '{WS}', ' ', 'g')) AS template FROM t)
SELECT template, count(*) AS n FROM u WHERE template <> '' GROUP BY 1 HAVING count(*) > 1"""

QUERIES = {f.__name__: f for f in (contamination_report, contamination_report_t50, contamination_control, decontaminated_pool, near_dup_pairs, near_dup_pairs_whole, exact_dedup_first_wins, stable_uid, hash_shard_counts, dist_by_source_level, stratified_sample, largest_remainder, floor_draw, round_robin_cells, disjoint_splits, staged_curriculum, rejects_by_reason, validate_artifact, topic_counts, level_bands, text_features, template_normalize)}

ORACLES = {
    "contamination_report": contamination_sql(0.8),
    "contamination_report_t50": contamination_sql(0.5),
    "decontaminated_pool": f"WITH hits AS ({contamination_sql(0.5)}) SELECT source, count(*) AS n, CAST(sum(doc_id) AS bigint) AS id_sum FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits) GROUP BY 1",
    "contamination_control": contamination_sql(0.8).replace("FROM documents)", f"FROM {CONTROL})"),
    "near_dup_pairs": near_sql(grams_sql('d', 'documents', 'doc_id')),
    "near_dup_pairs_whole": near_sql(grams_sql('d', 'documents', 'doc_id').replace(f"substr(lower({NORM}), 1, 400)", f"lower({NORM})")),
    "exact_dedup_first_wins": f"WITH k AS (SELECT doc_id, source, substr(sha1({NORM}), 1, 16) AS key FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source, doc_id) AS n FROM k) SELECT doc_id, source, key FROM r WHERE n = 1",
    "stable_uid": f"SELECT doc_id, source || ':' || substr(sha1({NORM}), 1, 8) AS uid, sha1({NORM.replace('coalesce(text', 'lower(coalesce(text').replace(chr(39) * 2 + '),', chr(39) * 2 + ')),', 1)}) AS folded, sha1(lower({NORM})) AS match_sha1 FROM documents",
    "hash_shard_counts": f"WITH m AS (SELECT md5(source || ':' || doc_id) AS h FROM documents) SELECT CAST(((CAST('0x' || substr(h, 1, 16) AS uhugeint) % 7) * {2**64 % 7} + CAST('0x' || substr(h, 17, 16) AS uhugeint) % 7) % 7 AS bigint) AS shard, count(*) AS n FROM m GROUP BY 1",
    "dist_by_source_level": "SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang, count(*) AS n, CAST(sum(n_chars) AS bigint) AS chars FROM documents GROUP BY GROUPING SETS ((source), (lang), ())",
    "stratified_sample": STRATIFIED_SQL,
    "largest_remainder": """WITH z AS (SELECT source, count(*) AS size FROM documents GROUP BY 1), x AS (SELECT source, 77 * size / (SELECT sum(size) FROM z) AS exact FROM z),
r AS (SELECT source, floor(exact) AS base, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, source) AS rank FROM x)
SELECT source, CAST(base + CASE WHEN rank <= 77 - (SELECT sum(base) FROM r) THEN 1 ELSE 0 END AS bigint) AS seats FROM r""",
    "floor_draw": "WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END AS labelled FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY labelled DESC, md5('f' || doc_id), doc_id) AS place FROM d) SELECT doc_id, lang, CAST(labelled AS bigint) AS labelled FROM r WHERE place <= 20",
    "round_robin_cells": "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS varchar)), doc_id) AS turn FROM documents) SELECT doc_id, source, turn FROM r ORDER BY turn, source LIMIT 60",
    "disjoint_splits": SPLIT_SQL,
    "staged_curriculum": """WITH d AS (SELECT doc_id, n_chars % 10 + 1 AS level FROM documents), b AS (SELECT *, CASE WHEN level <= 4 THEN 'low' WHEN level >= 7 THEN 'high' ELSE 'mid' END AS band FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('c' || doc_id), doc_id) AS place FROM b),
s AS (SELECT *, CASE WHEN band = 'low' AND place <= 200 THEN 1 WHEN band = 'low' AND place <= 340 THEN 2 WHEN band = 'mid' AND place <= 60 THEN 2 WHEN band = 'low' AND place <= 440 THEN 3 WHEN band = 'mid' AND place <= 110 THEN 3 WHEN band = 'high' AND place <= 50 THEN 3 END AS stage FROM p)
SELECT stage, band, count(*) AS n, CAST(sum(doc_id) AS bigint) AS id_sum FROM s WHERE stage IS NOT NULL GROUP BY 1, 2""",
    "rejects_by_reason": REJECTS_SQL,
    "validate_artifact": f"WITH k AS (SELECT source, doc_id, text, substr(sha1({NORM}), 1, 16) AS key FROM documents) SELECT source, count(*) AS n, count(*) FILTER (text IS NULL OR doc_id IS NULL) AS missing, count(*) FILTER (trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '') AS blank, count(key) - count(DISTINCT key) AS repeated FROM k GROUP BY 1",
    "topic_counts": f"SELECT CASE {' '.join(f'WHEN regexp_matches(lower(q), {chr(39)}{p}{chr(39)}) THEN {chr(39)}{n}{chr(39)}' for n, p in T.TOPICS)} ELSE 'other' END AS topic, count(*) AS n, CAST(sum(doc_id) AS bigint) AS id_sum FROM (SELECT doc_id, {TOPIC_WORDS} AS q FROM documents) GROUP BY 1",
    "level_bands": "WITH l AS (SELECT CAST(floor(n_chars / 500.0 + 0.5) AS bigint) AS level FROM documents) SELECT CASE WHEN level BETWEEN 1 AND 10 THEN level ELSE -1 END AS level, count(*) AS n FROM l GROUP BY 1",
    "text_features": FEATURES_SQL,
    "template_normalize": TEMPLATE_SQL,
}
