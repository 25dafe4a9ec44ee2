"""Queries over rewritten traces: what they keep, how they are shaped and judged, and joins with their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import grade as G
from tracelode.functions import shaping as H
from tracelode.functions import structure as S
from tracelode.functions import text as T
from tracelode.functions import tokens as K
from tracelode.operators import pool as P
from tracelode.operators import traces as O
from tracelode.plans.grading import COMPLETIONS_SQL, DETECT_SQL, SEGMENTS_SQL, completions, sequences
from tracelode.tables import CANDIDATES_SQL as CAND
from tracelode.tables import candidates, table

_N, _M = "uid % 89 + 11", "uid % 997 + 1003"
_M3 = f"concat(CAST(floor(({_M}) / 1000) AS int), ',', lpad(CAST(({_M}) % 1000 AS string), 3, '0'))"
#: The source of a problem and the rewrite of a draft, as SQL that both engines read.
VERBOSE = f"""CASE WHEN uid % 5 = 0 THEN '' ELSE concat('We have ', {_N}, ' and ', {_M3}, '.', chr(10), CASE uid % 4 WHEN 0 THEN 'But wait, that fails. ' WHEN 1 THEN 'Let me check: ' ELSE '' END, chr(10), '1. sum = ', {_N} + {_M}, chr(10),
 CASE WHEN uid % 3 = 0 THEN concat('2) again ', {_N}, ' then ', {_N} + {_M}, chr(10)) ELSE '' END, '- so ', {_N} + {_M}, ' is it, ', CASE WHEN uid % 6 = 1 THEN 'which confirms ' ELSE 'giving ' END, {_N}) END"""
COMPACT = f"""concat('goal: find ', {_N}, chr(10), CASE (uid + k) % 3 WHEN 0 THEN concat('case 1: x = ', {_M}, chr(10)) WHEN 1 THEN concat('✗ ', {_N}, chr(10)) ELSE '' END, repeat(concat('3. ⇒ ', {_N} + {_M}, ' = ', {_N}, ' + ', k + 1, chr(10)), CAST(k % 3 AS int)),
 CASE (uid + k) % 4 WHEN 0 THEN 'chk: ok' WHEN 1 THEN concat('✓ ', {_M3}) ELSE concat('the words of a long sentence that goes on and on without any symbol at all in here and then some more of it ', uid % 7, chr(10), chr(10)) END)"""
TRACES_SQL = f"{CAND}, tr AS (SELECT *, {VERBOSE} AS origin, {COMPACT} AS compact FROM cand)"


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts with the source of their problem (every fifth has none) and their rewrite."""
    return candidates(spark, sf_dir).withColumns({"origin": F.expr(VERBOSE), "compact": F.expr(COMPACT)})


FEATURES = ("src_has_branch", "src_has_verify", "branch_kept", "verify_kept", "n_anchors", "value_coverage", "invented", "invented_frac", "compact_lines", "verbose_steps", "lines_per_step")


def structural_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1"""
    return S.with_structure(traces(spark, sf_dir).filter("k < 3").select("uid", "k", "origin", "compact")).select("uid", "k", *FEATURES)


_nums = lambda c: f"list_transform(regexp_extract_all({c}, '{S.NUM}'), lambda x: replace(x, ',', ''))"
_sqlpat = lambda p: p.replace("'", "''")
FEATURES_SQL = f"""{TRACES_SQL}, src AS (SELECT uid, any_value(origin) AS origin, {_nums('any_value(origin)')} AS v FROM tr GROUP BY 1),
occ AS (SELECT uid, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM src), cnt AS (SELECT uid, x, count(*) AS c, min(pos) AS pos FROM occ GROUP BY 1, 2),
anc AS (SELECT uid, list(x) AS a FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY c DESC, pos) AS r FROM cnt WHERE c >= {S.ANCHOR_LEAST}) WHERE r <= {S.ANCHORS} GROUP BY 1),
f1 AS (SELECT tr.uid, k, tr.origin, compact, v, coalesce(a, []) AS a, list_distinct({_nums(f"regexp_replace(compact, '{S.STEP_NUM}', '', 'g')")}) AS cn FROM tr JOIN src ON tr.uid = src.uid LEFT JOIN anc ON tr.uid = anc.uid),
f2 AS (SELECT *, regexp_matches(origin, '{_sqlpat(S.VERBOSE_BRANCH)}') AS src_has_branch, regexp_matches(origin, '{_sqlpat(S.VERBOSE_VERIFY)}') AS src_has_verify, len(a) AS n_anchors, len(list_filter(cn, lambda x: NOT list_contains(v, x))) AS invented,
  len({G.sql_lines('compact')}) AS compact_lines, len(regexp_extract_all(origin, '{S.STEP}')) AS verbose_steps FROM f1),
feat AS (SELECT *, NOT src_has_branch OR regexp_matches(compact, '{S.COMPACT_BRANCH}') AS branch_kept, NOT src_has_verify OR regexp_matches(compact, '{S.COMPACT_VERIFY}') AS verify_kept,
  CASE WHEN n_anchors > 0 THEN round(len(list_intersect(a, cn)) / n_anchors, 4) ELSE 1.0 END AS value_coverage, round(invented / greatest(1, len(cn)), 4) AS invented_frac, round(compact_lines / greatest(1, verbose_steps), 5) AS lines_per_step FROM f2)"""


def structural_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a source nothing is claimed."""
    a = S.annotated(traces(spark, sf_dir).select("uid", "k", "origin", "compact"))
    return a.groupBy("no_source", "src_has_branch", "src_has_verify", "branch_kept", "verify_kept", "compact_has_branch", "compact_has_verify").agg(F.count("*").alias("n"), F.round(F.avg("value_coverage"), 6).alias("coverage"))


def structural_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are marked by each test and by all, none is dropped; which tests fail together."""
    tests = S.checks(min_coverage=0.5, max_invented=0.6, min_lines=0.75, branch=True)
    t = S.with_structure(traces(spark, sf_dir).select("uid", "k", "origin", "compact"))
    failed = F.array_join(F.array_compact(F.array(*(F.when(~test, F.lit(n)) for n, test in tests.items()))), ",")
    return t.groupBy(failed.alias("failed")).agg(F.count("*").alias("n")).withColumn("passed", F.col("failed") == "")


def register_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4, X5, X7"""
    c = F.col("compact")
    return traces(spark, sf_dir).filter("k < 3").select("uid", "k", F.round(S.marker_density(c), 6).alias("density"), F.round(S.words_per_line(c), 6).alias("words"), S.in_register(c).alias("in_register"), S.register_marks(c).alias("marks"))


_hits = " + ".join(f"(length(compact) - length(replace(compact, '{m}', ''))) // {len(m)}" for m in S.MARKERS)
_wpl = f"CASE WHEN len({G.sql_lines('compact')}) > 0 THEN list_sum(list_transform({G.sql_lines('compact')}, lambda x: len(regexp_split_to_array(x, '\\s+')))) / len({G.sql_lines('compact')}) ELSE 0 END"


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions with the reason of a gate, how they ended and the tokens of their thought, all by key."""
    key = F.col("key")
    c = completions(spark, sf_dir)
    reason = F.when(F.col("shape") == 2, "missing_think_close").when(key % 23 == 0, "missing_think_open").otherwise("ok")
    return c.withColumns({"gate_reason": reason, "g": (reason == "ok").cast("int"), "finish": F.when(key % 7 == 0, "length").otherwise("stop"), "think_len": (key % 40).cast("int")})


_gated = "CASE WHEN shape = 2 THEN 'missing_think_close' WHEN key % 23 = 0 THEN 'missing_think_open' ELSE 'ok' END"


def rollout_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen flags of each rollout, counted by shape."""
    s = O.scanned(gated(spark, sf_dir))
    return s.groupBy("shape").agg(F.count("*").alias("n"), *(F.count_if(f).alias(f) for f in O.FLAGS))


def answer_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of the register in the answers of well-formed rollouts."""
    return gated(spark, sf_dir).filter("g = 1").groupBy("shape").agg(F.count("*").alias("n"), F.count_if(S.answer_leaks(G.tail(F.col("text")))).alias("leaked"))


def twin_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: a step in the middle goes, the others are numbered again; which one is decided by a digest of the key."""
    c = completions(spark, sf_dir).filter("shape = 1").select("key", G.thought(F.col("text")).alias("body"))
    pick = F.conv(F.substring(F.md5(F.col("key").cast("string")), 1, 8), 16, 10).cast("long")
    return c.select("key", O.without_a_step(F.col("body"), pick).alias("x")).select("key", F.md5("x.text").alias("text"), "x.removed")


def suite_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be graded here has no verdict, which is not a wrong one."""
    c = completions(spark, sf_dir).withColumn("verifier", F.when(F.col("key") % 5 == 0, "code").when(F.col("key") % 5 == 1, "judge").otherwise("own"))
    c = G.verified(c.withColumn("pred", G.extract_answer(F.col("text"))), "pred", "gold", "ok").withColumn("correct", F.when(F.col("verifier") == "own", F.col("ok")))
    return c.groupBy("verifier", "shape").agg(F.count("*").alias("n"), F.count("correct").alias("graded"), F.count_if("correct").alias("right"))


#: A rewrite as a model returns it, with fences, trailers and junk.
RAW = r"concat(CASE WHEN key % 3 = 0 THEN concat('```', chr(10)) ELSE '' END, chr(10), '  goal: ', key, chr(10), chr(10), '    ⇒ ', key, '  ', chr(10), CASE key % 5 WHEN 0 THEN concat('```', chr(10), '**Final Answer** ', key) WHEN 1 THEN concat('## Final answer ', key, chr(10), 'more') WHEN 2 THEN concat(chr(92), 'boxed{', key, '}', chr(10)) WHEN 3 THEN concat('---', chr(10), '$$') ELSE '' END)"


def one_shot_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N13"""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")).withColumn("raw", F.when(F.col("key") % 11 == 0, "```\n\n```").otherwise(F.expr(RAW)))
    return o.select("key", H.one_shot(F.col("raw")).alias("x")).select("key", "x.text", F.array_join("x.flags", ",").alias("flags"))


_row = lambda test: test.replace("ROW", "x")
ONE_SHOT_SQL = f"""WITH o AS (SELECT o_orderkey AS key FROM orders), r AS (SELECT key, CASE WHEN key % 11 = 0 THEN concat('```', chr(10), chr(10), '```') ELSE {RAW} END AS raw FROM o),
a AS (SELECT key, regexp_split_to_array(regexp_replace(regexp_replace(raw, '^\\n+|\\n+$', '', 'g'), '\\s+$', ''), '\\r\\n|\\r|\\n') AS l FROM r),
b AS (SELECT key, l[coalesce(list_min(list_filter(range(1, len(l) + 1), lambda i: trim(l[i]) <> '')), len(l) + 1):] AS l FROM a), c AS (SELECT key, CASE WHEN regexp_matches(l[1], '{H.FENCE}') THEN l[2:] ELSE l END AS l FROM b),
d AS (SELECT key, l, coalesce(list_min(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '{H.FENCE}'))), len(l) + 1) AS f FROM c), e AS (SELECT key, l[1:f - 1] AS l, CASE WHEN f < len(l) THEN 'fence_trailer' END AS t FROM d),
g AS (SELECT *, coalesce(list_min(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '{H.FINAL_ANSWER}') OR regexp_matches(l[i], '{H.BOXED}'))), len(l) + 1) AS p FROM e),
h AS (SELECT key, t, CASE WHEN regexp_matches(l[p], '{H.BOXED}') THEN 'boxed_in_think' WHEN l[p] IS NOT NULL THEN 'final_answer_trailer' END AS u, l[1:p - 1] AS l FROM g),
i AS (SELECT key, t, u, list_filter(list_transform(l[1:coalesce(list_max(list_filter(range(1, len(l) + 1), lambda i: NOT regexp_matches(l[i], '{H.JUNK}'))), 0)], lambda x: rtrim(x)), lambda x: trim(x) <> '') AS l FROM h),
j AS (SELECT *, list_filter([t, u], lambda x: x IS NOT NULL) AS fl, list_min(list_transform(l, lambda x: length(x) - length(ltrim(x)))) AS ind FROM i)
SELECT key, array_to_string(list_transform(l, lambda x: substr(x, ind + 1)), chr(10)) AS text, CASE WHEN len(l) = 0 AND len(fl) = 0 THEN 'empty' ELSE array_to_string(fl, ',') END AS flags FROM j"""


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in chunks of about 40 tokens, dealt to three at most."""
    d = table(spark, sf_dir, "documents").select("doc_id", H.chunks_by_size(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")), 40).alias("c"))
    return d.select("doc_id", F.size("c").cast("long").alias("chunks"), F.md5(F.array_join("c", "|")).alias("all"), F.md5(F.array_join(H.dealt(F.col("c"), 3), "|")).alias("dealt"))


CHUNKED_SQL = """WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS p FROM documents),
s AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN greatest(1, length(x) // 4) > 40 THEN list_transform(string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda y: {'done': CAST([] AS varchar[]), 'cur': y, 'sep': ' '}) ELSE [{'done': CAST([] AS varchar[]), 'cur': x, 'sep': chr(10) || chr(10)}] END)) AS s FROM t),
r AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN list_reduce(s, lambda a, b: CASE WHEN a.cur <> '' AND greatest(1, length(a.cur) // 4) + greatest(1, length(b.cur) // 4) > 40 THEN {'done': list_append(a.done, a.cur), 'cur': b.cur, 'sep': ''} ELSE {'done': a.done, 'cur': CASE WHEN a.cur = '' THEN b.cur ELSE trim(a.cur || b.sep || b.cur) END, 'sep': ''} END) END AS r FROM s),
c AS (SELECT doc_id, CASE WHEN r IS NULL THEN [] WHEN r.cur = '' THEN r.done ELSE list_append(r.done, r.cur) END AS c FROM r)
SELECT doc_id, CAST(len(c) AS bigint) AS chunks, md5(array_to_string(c, '|')) AS all, md5(array_to_string(CASE WHEN len(c) <= 3 THEN c ELSE list_transform([0, 1, 2], lambda b: array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: (i - 1) % 3 = b), lambda i: c[i]), chr(10) || chr(10))) END, '|')) AS dealt FROM c"""


def masked_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without marks of chunks, and without conclusions at the end."""
    c = F.concat(F.col("compact"), F.when(F.col("uid") % 2 == 0, "\nORIGINAL CHUNK 2\nrest").otherwise("\n⇒ done\n\nAnswer: 3\n"))
    t = traces(spark, sf_dir).filter("k < 2").withColumn("raw", c)
    return t.select("uid", "k", F.md5(H.without_chunk_marks(F.col("raw"))).alias("marks"), F.md5(H.without_conclusion(F.col("raw"))).alias("masked"))


_split = "regexp_split_to_array({}, '\\r\\n|\\r|\\n')"
MASKED_SQL = f"""WITH {TRACES_SQL}, r AS (SELECT uid, k, concat(compact, CASE WHEN uid % 2 = 0 THEN concat(chr(10), 'ORIGINAL CHUNK 2', chr(10), 'rest') ELSE concat(chr(10), '⇒ done', chr(10), chr(10), 'Answer: 3', chr(10)) END) AS raw FROM tr WHERE k < 2),
l AS (SELECT uid, k, {_split.format("regexp_replace(raw, '\\s+$', '')")} AS l, {_split.format(G.sql_strip("regexp_split_to_array(raw, '" + H.CHUNK_MARK + "')[1]"))} AS m FROM r)
SELECT uid, k, md5(array_to_string(list_filter(list_transform(m, lambda x: regexp_replace(x, '\\s+$', '')), lambda x: trim(x) <> ''), chr(10))) AS marks,
 md5(array_to_string(l[1:coalesce(list_max(list_filter(range(1, len(l) + 1), lambda i: NOT (trim(l[i]) = '' OR regexp_matches(l[i], '{H.CONCLUSION}')))), 0)], chr(10))) AS masked FROM l"""


def audit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N21"""
    k = F.col("o_orderkey")
    flag = lambda d: F.when(k % d == 0, False).when(k % d == 1, F.lit(None).cast("boolean")).otherwise(True)
    a = table(spark, sf_dir, "orders").select(F.struct(flag(5).alias("preserves_self_correction"), flag(7).alias("faithful"), flag(6).alias("preserves_load_bearing"), flag(9).alias("compact_register"), F.when(k % 8 != 0, (k % 4 + 1).cast("int")).alias("compression_quality")).alias("a"))
    return a.groupBy(H.audit_verdict(F.col("a")).alias("verdict")).agg(F.count("*").alias("n"))


_flag = lambda d: f"CASE o_orderkey % {d} WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END"


def completion_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N19"""
    return traces(spark, sf_dir).filter("k = 0").select("uid", F.sha1(H.completion(F.col("compact"), F.concat(F.lit("It is "), F.col("uid").cast("string")))).alias("digest"))


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of different columns as one pool. A gold answer comes from its field or from a box; what lacks a prompt or a gold goes; each source must have the rows that are pinned for it."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.year("o_orderdate").alias("y"))
    k = F.col("key").cast("string")
    box = lambda x: F.concat(F.lit("\\boxed{"), x, F.lit("}"))
    math = o.filter("key % 3 = 0").select("key", F.lit("math").alias("suite"), F.concat(F.lit("What is "), k, F.lit("?")).alias("problem"), F.when(F.col("key") % 2 == 0, k).alias("answer"), F.when(F.col("key") % 4 == 1, F.concat(box(k), F.lit(" or "), box(F.lit("0")))).alias("solution"), F.col("y").alias("Year"), F.concat(F.lit("Mathematics -> Algebra "), F.col("key") % 4).alias("topic"))
    aime = o.filter("key % 3 = 1").select("key", F.lit("aime").alias("suite"), F.when(F.col("key") % 10 != 0, F.concat(F.lit(" Find  "), k)).alias("Question"), k.alias("Answer"), F.concat(F.col("y"), F.lit("-"), k).alias("ID"))
    code = o.filter("key % 3 = 2").select("key", F.lit("code").alias("suite"), F.concat(F.lit("def f():\n  "), k).alias("prompt"), F.lit("assert f()").alias("test"))
    out = O.eval_pool([math, aime, code], expected={"code": None})
    return out.select("key", "suite", "prompt", "ground_truth", "verifier", "year", "family").filter("year = 0 OR year <= 1997")


EVAL_SQL = """WITH o AS (SELECT o_orderkey AS key, year(o_orderdate) AS y FROM orders),
m AS (SELECT key, 'math' AS suite, 'What is ' || key || '?' AS prompt, CASE WHEN key % 2 = 0 THEN CAST(key AS varchar) WHEN key % 4 = 1 THEN CAST(key AS varchar) END AS gold, 'own' AS verifier, y AS year, 'Algebra ' || key % 4 AS family FROM o WHERE key % 3 = 0
 UNION ALL SELECT key, 'aime', CASE WHEN key % 10 <> 0 THEN 'Find ' || key END, CAST(key AS varchar), 'own', y, 'aime' FROM o WHERE key % 3 = 1
 UNION ALL SELECT key, 'code', 'def f():' || chr(10) || '  ' || key, 'assert f()', 'code', 0, 'code' FROM o WHERE key % 3 = 2)
SELECT key, suite, prompt, gold AS ground_truth, verifier, year, family FROM m WHERE prompt IS NOT NULL AND gold IS NOT NULL AND (year = 0 OR year <= 1997)"""


# Joins of drafts, scores, sources and gold answers.
def drafts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drafts (uid, k, round), their scores, written more than once, and the subset with sources."""
    t = traces(spark, sf_dir).withColumn("round", F.when(F.col("uid") % 9 == 0, F.col("k") % 2 + 1))
    d = t.select("uid", "k", F.coalesce("round", F.lit(1)).alias("round"), "level", "compact", F.when(F.col("g") == 0, "gate").alias("reject"))
    s = t.filter("k % 5 != 4").select("uid", "k", F.coalesce("round", F.lit(1)).alias("round"), F.when(F.col("uid") % 13 == 0, "too_long").alias("skip"), F.col("price").alias("score"))
    again = s.filter("uid % 4 = 0").withColumns({"score": F.col("score") + 1, "skip": F.lit(None).cast("string"), "line": F.lit(2)})
    subset = t.filter("k = 0 AND uid % 5 != 0").select("uid", "level", "origin")
    return d, s.withColumn("line", F.lit(1)).unionByName(again), subset


DRAFTS_SQL = f"""{TRACES_SQL}, dr AS (SELECT uid, k, CASE WHEN uid % 9 = 0 THEN k % 2 + 1 ELSE 1 END AS round, level, compact, CASE WHEN g = 0 THEN 'gate' END AS reject, price, origin FROM tr),
sc AS (SELECT uid, k, round, CASE WHEN uid % 13 = 0 AND uid % 4 <> 0 THEN 'too_long' END AS skip, CASE WHEN uid % 4 = 0 THEN price + 1 ELSE price END AS score FROM dr WHERE k % 5 <> 4),
sub AS (SELECT uid, level, origin FROM tr WHERE k = 0 AND uid % 5 <> 0),
el AS (SELECT dr.*, sc.uid IS NOT NULL AS scored, skip, score, coalesce(reject, CASE WHEN sc.uid IS NULL THEN 'unscored' WHEN skip IS NOT NULL THEN 'score_' || skip END) AS reason FROM dr LEFT JOIN sc ON dr.uid = sc.uid AND dr.k = sc.k AND dr.round = sc.round),
kept AS (SELECT * FROM el WHERE reason IS NULL QUALIFY round = max(round) OVER (PARTITION BY uid))"""


def scored_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reason why a draft can't be chosen: its own, or that it has no score (the last written counts), or why the score was skipped."""
    d, s, _ = drafts(spark, sf_dir)
    return O.scored(d, s).groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("score"))


def golden_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that can be chosen, of the highest round of each problem, with the source of the problem, or none."""
    d, s, subset = drafts(spark, sf_dir)
    return O.highest_round(O.scored(d, s).filter("reason IS NULL")).join(subset.select("uid", "origin"), "uid", "left").select("uid", "k", "round", F.coalesce(F.length("origin"), F.lit(0)).alias("source"))


def unserved_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of the subset none of whose drafts can be chosen, with the reasons and how often."""
    d, s, subset = drafts(spark, sf_dir)
    return O.unserved(subset, O.scored(d, s)).select("uid", F.array_join(F.transform("reasons", lambda r: F.concat(r["reason"], F.lit(":"), r["n"].cast("string"))), ",").alias("reasons"))


def seen_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag for problems that training has seen; and how many that were asked for aren't in the pool, which must be none."""
    asked = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("level"))
    pool = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"))
    seen = candidates(spark, sf_dir).filter("strict").select("uid")
    out = O.flagged(O.present(asked, pool), seen, "seen")
    return out.groupBy("level", "seen").agg(F.count("*").alias("n"))


def rescue_clientele(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems that no rollout solves, with the subset's sources; how many of them the subset lacks."""
    none = candidates(spark, sf_dir).groupBy("uid").agg(F.bool_or("strict").alias("any"), F.first("level").alias("level")).filter("NOT any")
    _, _, subset = drafts(spark, sf_dir)
    j = none.join(subset.select("uid", F.lit(True).alias("there"), (F.length("origin") > 0).alias("traced")), "uid", "left")
    return j.groupBy("level").agg(F.count("*").alias("zero"), F.count("there").alias("written"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if("traced").alias("traced"))


def rescue_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the drafts that are right and in the register, the one with the most marks, the first of equals."""
    t = traces(spark, sf_dir).filter("g = 1 AND strict").withColumn("marks", S.register_marks(F.col("compact"))).filter("marks >= 3")
    return t.groupBy("uid").agg(F.max(F.struct("marks", (-F.col("k")).alias("k"))).alias("m")).select("uid", (-F.col("m.k")).alias("k"), "m.marks")


def control_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified rows of problems that the register doesn't have, one for each problem, in the order of the file; a sample of them by level."""
    c = candidates(spark, sf_dir)
    pool = O.one_each(c.filter("strict").join(c.filter("tax > 0.07").select("uid"), "uid", "left_anti"), "uid", "k")
    return P.stratified_sample(pool, "level", F.col("uid"), 500, "control").select("uid", "level", "k").orderBy("uid")


def structure_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the rows of structure that they have, by problem."""
    t = traces(spark, sf_dir).filter("k = 0")
    rows = S.with_structure(t.filter("uid % 3 != 1").select("uid", "origin", "compact")).select("uid", "branch_kept", "src_has_branch")
    return t.join(rows, "uid").groupBy("src_has_branch", "branch_kept").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("gap"))


def rollouts_with_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollout's own gold answer, else the pool's; without either it is left out."""
    c = completions(spark, sf_dir).withColumn("own", F.when(F.col("key") % 3 == 0, F.col("gold")).when(F.col("key") % 3 == 1, ""))
    pool = completions(spark, sf_dir).filter("key % 5 != 2").select("key", F.col("gold").alias("pooled"))
    j = c.drop("gold").join(pool, "key", "left").withColumn("gold", F.coalesce(F.when(F.col("own") != "", F.col("own")), F.when(F.col("pooled") != "", F.col("pooled"))))
    j = j.filter((F.instr("text", G.CLOSE) > 0) & (T.strip(G.tail(F.col("text"))) != ""))
    v = G.verified(j.withColumn("pred", G.extract_answer(F.col("text"))), "pred", "gold", "ok")
    return v.groupBy("shape", F.when(F.col("gold").isNull(), "no gold").when(F.col("ok"), "kept").otherwise("wrong").alias("outcome")).agg(F.count("*").alias("n"))


GOLDS_SQL = f"""WITH {COMPLETIONS_SQL.replace('comp AS', 'comp0 AS')}, comp AS (SELECT key, shape, text, CASE WHEN key % 3 = 0 THEN gold WHEN key % 5 <> 2 THEN gold END AS gold FROM comp0), {G.sql_steps('comp')}
SELECT shape, CASE WHEN gold IS NULL THEN 'no gold' WHEN as_scored THEN 'kept' ELSE 'wrong' END AS outcome, count(*) AS n FROM graded WHERE closed AND {G.sql_strip('post')} <> '' GROUP BY 1, 2"""


def assistant_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences in which more than one assistant turn begins are errors."""
    s = sequences(spark, sf_dir).withColumn("ids", F.when(F.col("key") % 4 == 0, F.concat("ids", F.array(F.lit(K.TURN), F.lit(K.ASSISTANT)))).when(F.col("key") % 4 == 1, F.concat(F.array(F.lit(K.TURN), F.lit(K.ASSISTANT)), "ids", F.array(F.lit(K.TURN), F.lit(K.ASSISTANT)))).otherwise(F.col("ids")))
    return s.groupBy(K.turns(F.col("ids")).alias("turns")).agg(F.count("*").alias("n")).withColumn("problem", F.when(F.col("turns") > 1, "several turns"))


def stalled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of lines whose first 120 characters, not blank, are those of the line before."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.stalled_rate(F.split(F.coalesce("text", F.lit("")), "\n", -1)), 6).alias("stalled"))


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed gate with its reason, then a box in the thought, then the lenient verdict; the first that fails is the reason."""
    ids = sequences(spark, sf_dir).select("key", K.segments(F.col("ids"), F.col("prompt"), blanks=[198]).alias("s"))
    c = completions(spark, sf_dir).join(ids, "key")
    c = G.verified(c.withColumn("pred", G.extract_answer(F.col("text"))), "pred", "gold", "ok")
    c = c.withColumn("reject", F.when(F.col("s.g") != 1, F.concat(F.lit("gate:"), F.col("s.reason"))).when(G.thought(F.col("text")).rlike(r"\\boxed"), "boxed_in_think").when(~F.col("ok"), "verify_fail"))
    return c.groupBy("shape", F.coalesce("reject", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_all = (structural_features, structural_annotated, structural_gate, register_measures, rollout_scan, answer_leak, twin_corruption, suite_verdicts, one_shot_cleaned, chunked, masked_conclusions, audit_verdicts, completion_texts, eval_items, scored_drafts, golden_candidates, unserved_problems, seen_flags, rescue_clientele, rescue_best, control_set, structure_join, rollouts_with_golds, assistant_turns, stalled_chunks, triage)
QUERIES = {f.__name__: f for f in _all}

_scan = f"""WITH {COMPLETIONS_SQL}, {G.sql_steps('comp')}, {DETECT_SQL}, z AS (SELECT detect.*, {_gated} AS gate, key % 7 = 0 AS cap, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS w FROM detect)"""
ORACLES = {
    "structural_features": f"WITH {FEATURES_SQL} SELECT uid, k, {', '.join(FEATURES)} FROM feat WHERE k < 3",
    "structural_annotated": f"""WITH {FEATURES_SQL}, x AS (SELECT origin = '' AS no_source, {', '.join(f"CASE WHEN origin <> '' THEN {c} END AS {c}" for c in S.KEPT)}, regexp_matches(compact, '{S.COMPACT_BRANCH}') AS compact_has_branch, regexp_matches(compact, '{S.COMPACT_VERIFY}') AS compact_has_verify FROM feat)
SELECT no_source, src_has_branch, src_has_verify, branch_kept, verify_kept, compact_has_branch, compact_has_verify, count(*) AS n, round(avg(value_coverage), 6) AS coverage FROM x GROUP BY ALL""",
    "structural_gate": f"""WITH {FEATURES_SQL}, x AS (SELECT array_to_string(list_filter([CASE WHEN NOT verify_kept THEN 'verify_kept' END, CASE WHEN value_coverage < 0.5 THEN 'value_coverage' END, CASE WHEN invented_frac > 0.6 THEN 'no_invention' END, CASE WHEN lines_per_step < 0.75 THEN 'length_floor' END, CASE WHEN NOT branch_kept THEN 'branch_kept' END], lambda x: x IS NOT NULL), ',') AS failed FROM feat)
SELECT failed, count(*) AS n, failed = '' AS passed FROM x GROUP BY 1""",
    "register_measures": f"WITH {TRACES_SQL} SELECT uid, k, round(100.0 * ({_hits}) / length(compact), 6) AS density, round({_wpl}, 6) AS words, contains(compact, '⇒') AND {_wpl} <= 14 AS in_register, len(regexp_extract_all(compact, '{S.REGISTER_MARK}')) AS marks FROM tr WHERE k < 3",
    "rollout_scan": f"""{_scan} SELECT z.shape, count(*) AS n, count(*) FILTER (gate = 'ok' AND z.key % 40 < 16) AS empty_think, count(*) FILTER (gate = 'missing_think_close' AND NOT cap) AS missing_think_close, count(*) FILTER (gate = 'missing_think_open') AS missing_think_open, count(*) FILTER (cap) AS cap_hit, count(*) FILTER (loop) AS ngram_loop,
 count(*) FILTER (len(regexp_extract_all(think, '(?m)^case \\d+:')) >= 20) AS case_enum_20, count(*) FILTER (len(regexp_extract_all(think, '(?m)^chk:')) >= 15) AS chk_chain_15, count(*) FILTER (gate = 'ok' AND leak) AS register_leak, count(*) FILTER (gate = 'ok' AND repeat_ > 0) AS answer_repeat, count(*) FILTER (gate = 'ok' AND contra) AS contradiction,
 count(*) FILTER (len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND length(w[i]) > 2)) / greatest(1, len(w)) > 0.01) AS word_stutter, count(*) FILTER (as_scored AND reason <> '' AND gate = 'ok') AS lenient_only, count(*) FILTER (reason = '' AND gate = 'ok') AS strict_correct FROM z JOIN graded ON z.key = graded.key GROUP BY 1""",
    "answer_leak": f"WITH {COMPLETIONS_SQL} SELECT shape, count(*) AS n, count(*) FILTER (instr(text, '</think>') > 0 AND ({' OR '.join(f'contains(substr(text, instr(text, {chr(39)}</think>{chr(39)}) + 8), {chr(39)}{m}{chr(39)})' for m in S.ANSWER_LEAKS)})) AS leaked FROM comp WHERE {_gated} = 'ok' GROUP BY 1",
    "twin_corruption": f"""WITH {COMPLETIONS_SQL}, b AS (SELECT key, string_split(substr(text, 1, instr(text, '</think>') - 1), chr(10)) AS l FROM comp WHERE shape = 1), i AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '{O.STEP}')) AS s FROM b),
v AS (SELECT *, CASE WHEN len(s) >= 3 THEN s[2 + CAST('0x' || substr(md5(CAST(key AS varchar)), 1, 8) AS bigint) % (len(s) - 2)] END AS v FROM i)
SELECT key, CASE WHEN v IS NOT NULL THEN md5(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: i <> v), lambda i: CASE WHEN regexp_matches(l[i], '{O.STEP}') THEN regexp_replace(l[i], '{O.STEP}', '\\1' || len(list_filter(s, lambda j: j <= i AND j <> v)) || '.\\3\\4') ELSE l[i] END), chr(10))) END AS text, trim(l[v]) AS removed FROM v""",
    "suite_verdicts": f"WITH {COMPLETIONS_SQL}, {G.sql_steps('comp')}, v AS (SELECT *, CASE key % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'judge' ELSE 'own' END AS verifier FROM graded) SELECT verifier, shape, count(*) AS n, count(*) FILTER (verifier = 'own') AS graded, count(*) FILTER (verifier = 'own' AND as_scored) AS \"right\" FROM v GROUP BY 1, 2",
    "one_shot_cleaned": ONE_SHOT_SQL,
    "chunked": CHUNKED_SQL,
    "masked_conclusions": MASKED_SQL,
    "audit_verdicts": f"WITH a AS (SELECT {_flag(5)} AS p, {_flag(7)} AS f, {_flag(6)} AS l, {_flag(9)} AS c, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 4 + 1 END AS q FROM orders) SELECT CASE WHEN p IS NOT DISTINCT FROM false THEN 'fail' WHEN coalesce(f, false) AND coalesce(l, false) AND coalesce(c, false) AND coalesce(q, 0) >= 3 THEN 'pass' ELSE 'fail' END AS verdict, count(*) AS n FROM a GROUP BY 1",
    "completion_texts": f"WITH {TRACES_SQL} SELECT uid, sha1(concat('<think>', chr(10), compact, chr(10), '</think>', chr(10), chr(10), 'It is ', uid)) AS digest FROM tr WHERE k = 0",
    "eval_items": EVAL_SQL,
    "scored_drafts": f"WITH {DRAFTS_SQL} SELECT coalesce(reason, 'eligible') AS reason, count(*) AS n, round(sum(score), 2) AS score FROM el GROUP BY 1",
    "golden_candidates": f"WITH {DRAFTS_SQL} SELECT kept.uid, k, round, CASE WHEN kept.uid % 5 = 0 THEN 0 ELSE length(origin) END AS source FROM kept",
    "unserved_problems": f"""WITH {DRAFTS_SQL}, u AS (SELECT sub.uid FROM sub WHERE uid NOT IN (SELECT uid FROM el WHERE reason IS NULL)), c AS (SELECT u.uid, reason, count(*) AS n FROM u JOIN el ON u.uid = el.uid GROUP BY 1, 2)
SELECT uid, string_agg(reason || ':' || n, ',' ORDER BY reason) AS reasons FROM c GROUP BY 1""",
    "seen_flags": f"WITH {CAND}, s AS (SELECT DISTINCT uid FROM cand WHERE strict) SELECT o_orderpriority AS level, s.uid IS NOT NULL AS seen, count(*) AS n FROM orders LEFT JOIN s ON o_orderkey = s.uid WHERE o_orderkey % 2 = 0 GROUP BY 1, 2",
    "rescue_clientele": f"WITH {CAND}, z AS (SELECT uid, any_value(level) AS level FROM cand GROUP BY 1 HAVING NOT bool_or(strict)) SELECT level, count(*) AS zero, count(*) FILTER (uid % 5 <> 0) AS written, count(*) FILTER (uid % 5 = 0) AS missing, count(*) FILTER (uid % 5 <> 0) AS traced FROM z GROUP BY 1",
    "rescue_best": f"WITH {TRACES_SQL}, m AS (SELECT uid, k, len(regexp_extract_all(compact, '{S.REGISTER_MARK}')) AS marks FROM tr WHERE g = 1 AND strict) SELECT uid, k, marks FROM m WHERE marks >= 3 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY marks DESC, k) = 1",
    "control_set": f"""WITH {CAND}, p AS (SELECT uid, any_value(level) AS level, min(k) AS k FROM cand WHERE strict AND uid NOT IN (SELECT uid FROM cand WHERE tax > 0.07) GROUP BY 1), z AS (SELECT level, count(*) AS size, (SELECT count(*) FROM p) AS total FROM p GROUP BY 1),
q AS (SELECT *, CASE WHEN total <= 500 THEN size ELSE 500 * size // total END AS quota FROM z), r AS (SELECT *, row_number() OVER (ORDER BY size - quota DESC, level) AS rank, least(500, total) - sum(quota) OVER () AS more FROM q),
w AS (SELECT level, quota + CASE WHEN size > quota AND rank <= more THEN 1 ELSE 0 END AS quota FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY md5('control' || uid), uid) AS place FROM p) SELECT uid, n.level, k FROM n JOIN w ON n.level = w.level WHERE place <= w.quota""",
    "structure_join": f"WITH {FEATURES_SQL} SELECT src_has_branch, branch_kept, count(*) AS n, round(avg(price), 4) AS gap FROM feat JOIN cand ON feat.uid = cand.uid AND feat.k = cand.k WHERE feat.k = 0 AND feat.uid % 3 <> 1 GROUP BY 1, 2",
    "rollouts_with_golds": GOLDS_SQL,
    "assistant_turns": "WITH t AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS turns FROM orders) SELECT turns, count(*) AS n, CASE WHEN turns > 1 THEN 'several turns' END AS problem FROM t GROUP BY 1",
    "triage": f"""WITH {COMPLETIONS_SQL}, {G.sql_steps('comp')}, seg AS ({SEGMENTS_SQL}) SELECT shape, CASE WHEN g <> 1 THEN 'gate:' || seg.reason WHEN regexp_matches(CASE WHEN closed THEN substr(text, 1, instr(text, '</think>') - 1) ELSE text END, '\\\\boxed') THEN 'boxed_in_think' WHEN NOT as_scored THEN 'verify_fail' ELSE 'kept' END AS reason, count(*) AS n FROM graded JOIN seg ON graded.key = seg.key GROUP BY 1, 2""",
    "stalled_chunks": f"WITH l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {G.sql_strip('substr(x, 1, 120)')}) AS l FROM documents) SELECT doc_id, round(CASE WHEN len(l) >= 2 THEN len(list_filter(range(1, len(l)), lambda i: l[i] <> '' AND l[i] = l[i + 1])) / (len(l) - 1) ELSE 0 END, 6) AS stalled FROM l",
}
