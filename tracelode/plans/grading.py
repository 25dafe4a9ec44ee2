"""Queries over completions that are made from orders: each has a gold answer and one of ten shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import grade as G
from tracelode.functions import reward as R
from tracelode.functions import text as T
from tracelode.functions import tokens as K
from tracelode.tables import spread, table

#: The shapes, as SQL that both engines read: n is the number, and gold its text; lengths, repeats and values vary with the key.
SHAPES = r"""CASE o_orderkey % 10
 WHEN 0 THEN concat('<think>', chr(10), 'goal: find n', chr(10), '⇒ 2 · 3 = ', n + o_orderkey % 3, chr(10), '</think>', chr(10), chr(10), b, 'boxed{', n, '}')
 WHEN 1 THEN concat('<think>', chr(10), '1. First step', chr(10), chr(10), '2. Next 9', n, chr(10), chr(10), repeat(concat('3. again ', o_orderkey % 4, chr(10), chr(10)), CAST(o_orderkey % 14 AS int)), '</think>', chr(10), b, 'boxed{9', n, '}')
 WHEN 2 THEN concat('<think>', chr(10), 'work ', b, 'boxed{', n, '}')
 WHEN 3 THEN concat('<think>√(', o_orderkey % 5, ') ⇒ a = ', n, '</think>', chr(10), CASE WHEN o_orderkey % 4 = 1 THEN concat('  chk: it holds', chr(10)) ELSE '' END, '$', b, 'dfrac{', 2 * n, '}{2}$')
 WHEN 4 THEN concat('<think>', chr(10), 'so ', n + o_orderkey % 2, '</think>', b, 'boxed{', n, '}{boxed{', n, '}}')
 WHEN 5 THEN concat('<think>a a word word', chr(10), 'case 2: x', chr(10), 'case ', 1 + o_orderkey % 3, ': y</think>', chr(10), 'The sum is known.', chr(10), '**Final Answer:** ', n, '.')
 WHEN 6 THEN concat('<think>', n, '</think> ', b, 'boxed{', n, ' ', b, 'times 10^{0}}')
 WHEN 7 THEN concat('<think>', repeat(concat('loop ', n, chr(10)), CAST(6 + o_orderkey % 13 AS int)), '⇒ x = ', n + o_orderkey % 2, '</think>', chr(10), CASE WHEN o_orderkey % 3 = 0 THEN 'goal: say it' ELSE '1. say it' END, chr(10), b, 'boxed{', n, '}')
 WHEN 8 THEN concat('<think>', chr(10), '</think>', chr(10), '<answer> ', n, ' </answer>', chr(10), n, repeat(concat(chr(10), chr(10), n), CAST(o_orderkey % 4 AS int)))
 ELSE concat('<think>', CASE WHEN o_orderkey % 400 = 9 THEN repeat('abcdefgh ', 1200) ELSE 'done' END, repeat(concat(chr(10), chr(10), 'Final Answer: ', n), CAST(o_orderkey % 7 AS int)), '</think>', chr(10), 'x', chr(10), '  ', n, '  ') END"""
COMPLETIONS_SQL = f"comp AS (SELECT o_orderkey AS key, o_orderkey % 10 AS shape, CAST(n AS varchar) AS gold, {SHAPES} AS text FROM (SELECT o_orderkey, o_orderkey % 997 + 2 AS n, chr(92) AS b FROM orders))"


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, shape, gold, text"""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey")).withColumns({"n": F.col("o_orderkey") % 997 + 2, "b": F.char(F.lit(92))})
    return o.select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 10).alias("shape"), F.col("n").cast("string").alias("gold"), F.expr(SHAPES.replace("'⇒", "'⇒")).alias("text"))


def grade_as_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 to G4"""
    c = G.verified(completions(spark, sf_dir).withColumn("pred", G.extract_answer(F.col("text"))), "pred", "gold", "as_scored")
    return c.select("key", "pred", G.normalize(F.col("pred")).alias("normal"), "as_scored")


def grade_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5 to G7"""
    return G.graded(completions(spark, sf_dir)).select("key", "strict", "as_scored", "pred", "reason")


def grade_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons by shape, and what only the lenient rule takes."""
    return G.graded(completions(spark, sf_dir)).groupBy("shape", "reason").agg(F.count("*").alias("n"), F.count_if(F.col("as_scored") & ~F.col("strict")).alias("lenient_only"))


def grade_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wider normal form and what it equals."""
    c = completions(spark, sf_dir).withColumn("pred", G.extract_answer(F.col("text")))
    return c.select("key", G.wider(F.col("pred")).alias("wider"), G.equivalent(F.col("pred"), F.col("gold")).alias("equal"))


def text_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thought and tail, the block up to the last box, and how it ends."""
    c = completions(spark, sf_dir).withColumn("tail", G.tail(F.col("text")))
    block = R.final_block(F.col("tail"))
    boxed, bare = R.terminal(block)
    return c.select("key", F.length(G.thought(F.col("text"))).cast("long").alias("thought"), F.length("tail").cast("long").alias("tail"), F.length(block).cast("long").alias("block"), boxed.alias("boxed"), bare.alias("bare"))


def word_stutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 of dialogue turns."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.word_stutter(F.col("text")).cast("long").alias("stutters"))


def counter_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5"""
    return completions(spark, sf_dir).groupBy("shape").agg(F.sum(R.restarts(G.thought(F.col("text")))).alias("restarts"), F.count("*").alias("n"))


def detector_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, C2, C3, C4"""
    c = completions(spark, sf_dir).withColumns({"think": G.thought(F.col("text")), "tail": G.tail(F.col("text"))})
    c = c.select("shape", R.loop(F.col("think")).alias("loop"), R.repeats(F.col("tail"), R.ANSWER_REPEAT).alias("repeat"), R.leaks(F.col("tail")).alias("leak"), R.contradicts(F.col("think"), F.col("tail")).alias("contra"))
    return c.groupBy("shape").agg(F.count_if("loop").alias("loops"), F.sum("repeat").alias("repeats"), F.count_if("leak").alias("leaks"), F.count_if("contra").alias("contradictions"))


def reward_stagec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths come from the key."""
    c = completions(spark, sf_dir)
    think, answer, g = (F.col("key") % 400).cast("int"), (F.col("key") % 700).cast("int"), F.when(F.col("shape") == 2, 0).otherwise(1)
    r = R.budget_reward(c, think, answer, g, F.lit(150.0))
    return r.select("key", *(F.round(n, 6).alias(n) for n in ("accuracy", "structure", "penalty", "total")))


def reward_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 to D14, G8"""
    r = R.reward_v1(completions(spark, sf_dir))
    return r.groupBy("shape", "tier").agg(F.count("*").alias("n"), *(F.round(F.avg(n), 6).alias(n) for n in ("structure", "penalty", "total")))


def reward_v1_strict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8 with the strict gate: a right answer that the end of the thought contradicts is lenient."""
    return R.reward_v1(completions(spark, sf_dir), strict_gate=True).select("key", "tier", F.round("total", 6).alias("total"))


def penalty_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 to D12, each by itself."""
    p = R.penalties_v1(R.split(completions(spark, sf_dir)))
    return p.groupBy("shape").agg(*(F.round(F.sum(c), 4).alias(c) for c in R.PENALTIES))


def _one_notation(c: str) -> str:
    out = G.sql_strip(f"coalesce({c}, '')")
    for pattern, to in R.ONE_NOTATION:
        out = f"regexp_replace({out}, '{pattern.replace('(?U)', '')}', '{to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
    return f"lower({out})"


def _longest_run(c: str) -> str:
    step = "{'v': b.v, 'run': CASE WHEN a.v = b.v THEN a.run + 1 ELSE 1 END, 'best': greatest(a.best, CASE WHEN a.v = b.v THEN a.run + 1 ELSE 1 END)}"
    start = "{'v': x, 'run': 1, 'best': 1}"
    return f"CASE WHEN len({c}) = 0 THEN 0 ELSE list_reduce(list_transform({c}, lambda x: {start}), lambda a, b: {step}).best END"


def _restated(name: str, source: str, token: str, least: int) -> str:
    """key and n: over runs of lines that are one and the same token, each after a blank line, the gaps' pairs of line ends, where a run has at least so many."""
    return f"""
{name}_l AS (SELECT key, unnest(string_split(tail, chr(10))) AS line, generate_subscripts(string_split(tail, chr(10)), 1) AS pos FROM {source}),
{name}_t AS (SELECT key, pos, {G.sql_strip('line')} AS t, line, pos - lag(pos) OVER w AS gap, {G.sql_strip('lag(line) OVER w')} AS before FROM {name}_l WHERE {G.sql_strip('line')} <> '' WINDOW w AS (PARTITION BY key ORDER BY pos)),
{name}_s AS (SELECT *, sum(CASE WHEN t = before AND gap >= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY pos) AS run FROM {name}_t WHERE regexp_matches(t, '{token}')),
{name}_r AS (SELECT key, run, sum(gap // 2) FILTER (t = before AND gap >= 2) AS n FROM {name}_s GROUP BY 1, 2),
{name} AS (SELECT key, sum(n) AS n FROM {name}_r WHERE n >= {least} GROUP BY 1)"""


_PARTS = "CASE WHEN instr(text, '</think>') > 0 THEN substr(text, 1, instr(text, '</think>') - 1) ELSE text END AS think, CASE WHEN instr(text, '</think>') > 0 THEN substr(text, instr(text, '</think>') + 8) ELSE '' END AS tail"
#: key, loop, repeat, leak, contra: the detectors over whatever texts ``comp`` has.
DETECT_SQL = f"""
d1 AS (SELECT *, {_PARTS} FROM comp), d2 AS (SELECT *, {G.sql_lines('think')} AS rows_, regexp_extract_all(think, '{R.ARROW}', 1)[-1] AS arrow, regexp_extract_all(tail, '{G.BOXED}', 1)[-1] AS box FROM d1),
d3 AS (SELECT *, list_transform(rows_, lambda x: regexp_replace(x, '\\d+', '#', 'g')) AS blanked, {G.sql_strip("string_split(regexp_replace(" + G.sql_strip('arrow') + ", '[.;,]+$', ''), '=')[-1]")} AS said FROM d2),
d4 AS (SELECT *, {_one_notation('said')} AS na, {_one_notation('box')} AS nb FROM d3), d5 AS (SELECT *, {G.sql_numeric('na')} AS xa, {G.sql_numeric('nb')} AS xb FROM d4), {_restated('again', 'd1', '^(?:[^' + chr(92) + 's]*' + chr(92) + 'w[^' + chr(92) + 's]*)$', 1)},
detect AS (SELECT d5.*, {_longest_run('rows_')} >= {R.LOOP_EXACT} OR {_longest_run('blanked')} >= {R.LOOP_TEMPLATE} AS loop, coalesce(again.n, 0) AS repeat_,
  len(list_filter(regexp_split_to_array(tail, '\\r\\n|\\r|\\n'), lambda x: regexp_matches(x, '{R.LEAK_LINE}') OR regexp_matches(x, '{R.LEAK_SYMBOL}'))) > 0 AS leak,
  CASE WHEN na = '' OR nb = '' THEN false WHEN na = nb THEN false WHEN xa IS NOT NULL AND xb IS NOT NULL THEN NOT {G.sql_close('xa', 'xb')} ELSE false END AS contra FROM d5 LEFT JOIN again ON d5.key = again.key)"""
FLAGS_SQL = f"""WITH {COMPLETIONS_SQL}, {DETECT_SQL}
SELECT shape, count(*) FILTER (loop) AS loops, CAST(sum(repeat_) AS bigint) AS repeats, count(*) FILTER (leak) AS leaks, count(*) FILTER (contra) AS contradictions FROM detect GROUP BY 1"""
STAGEC_SQL = f"""WITH {COMPLETIONS_SQL}, {G.sql_steps('comp')}, {DETECT_SQL},
r AS (SELECT key, shape, key % 400 AS think, key % 700 AS answer, shape <> 2 AND key % 400 >= 16 AS formed, reason = '' AND shape <> 2 AS ok FROM graded),
pen AS (SELECT key, CASE WHEN loop THEN 0.1 ELSE 0 END + least(0.1, 0.05 * repeat_) + CASE WHEN leak THEN 0.1 ELSE 0 END + CASE WHEN contra THEN 0.2 ELSE 0 END AS pen FROM detect),
s AS (SELECT r.*, pen, CASE WHEN formed THEN 0.1 ELSE 0 END AS base, CASE WHEN formed AND ok THEN 0.15 * exp(-greatest(0, think - 150.0) / 150.0) + 0.1 * CASE WHEN abs(answer - 288.0) <= 32 THEN 1 ELSE exp(-(abs(answer - 288.0) - 32) / 288.0) END ELSE 0 END AS bonus FROM r JOIN pen ON r.key = pen.key)
SELECT key, CAST(ok AS double) AS accuracy, round(CAST(base AS double) + bonus, 6) AS structure, round(CAST(pen AS double), 6) AS penalty, round(CAST(ok AS int) + greatest(CAST(base AS double), base + bonus - pen), 6) AS total FROM s"""


def _prose(line: str) -> str:
    """prose_answer() of a line."""
    s = G.sql_strip(line)
    first = G.sql_strip(f"regexp_replace(regexp_replace({G.sql_strip(f'regexp_extract({s}, {chr(39)}{R.PROSE}{chr(39)}, 1)')}, '^\\*+|\\*+$', '', 'g'), '\\.+$', '')")
    bold = G.sql_strip(f"regexp_replace({G.sql_strip(f'regexp_extract({s}, {chr(39)}{R.BOLD}{chr(39)}, 1)')}, '\\.+$', '')")
    return f"CASE WHEN regexp_matches({s}, '{R.PROSE}') AND {first} <> '' THEN {first} WHEN regexp_matches({s}, '{R.BOLD}') AND {bold} <> '' THEN {bold} END"


def _template(c: str) -> str:
    t = f"array_to_string(regexp_split_to_array({G.sql_strip(c)}, '\\s+')[1:12], ' ')"
    for pattern in T.TEMPLATE:
        t = f"regexp_replace({t}, '{pattern}', ' ', 'g')"
    return G.sql_strip(f"regexp_replace(lower({t}), '\\s+', ' ', 'g')")


def _matched(source: str, out: str, candidate: str, gold: str, verdict: str) -> str:
    """with_match(): a candidate, as if in a box, against a gold answer."""
    boxed = f"concat(chr(92), 'boxed{{', {candidate}, '}}')"
    return f"""
{out}_0 AS (SELECT *, CASE WHEN {candidate} IS NOT NULL THEN {G.sql_extract(boxed, boxed)} END AS m_p FROM {source}),{G.sql_verified(out + '_0', out + '_m', 'm_p', gold, 'm_v')},
{out} AS (SELECT * EXCLUDE (m_p, m_v), m_v AND coalesce({candidate} <> '' AND {gold} <> '', false) AS {verdict} FROM {out}_m)"""


_holder = " OR ".join(f"regexp_matches(x, '(?i){p}')" for p in R.PLACEHOLDERS)
_chunks = lambda c: f"list_filter(string_split({c}, chr(10) || chr(10)), lambda x: {G.sql_strip('x')} <> '')"
_block = f"CASE WHEN regexp_matches(tail, '{R.ANY_BOX}') THEN regexp_extract(tail, '(?s)^(.*{R.ANY_BOX})', 1) ELSE regexp_replace(tail, '\\s+$', '') END"
#: key, shape, the penalties and what tiers need, over whatever texts ``comp`` has.
PENALTIES_SQL = f"""
e1 AS (SELECT *, instr(text, '</think>') > 0 AS closed, {_PARTS} FROM comp), e2 AS (SELECT *, {_block} AS block, {_chunks('think')} AS parts, {_chunks('tail')} AS after_ FROM e1),
e3 AS (SELECT *, coalesce({G.sql_lines('block')}[-1], '') AS last_, len(list_filter(parts, lambda x: regexp_matches(x, '^\\s*\\d+\\.\\s'))) AS again_, CASE WHEN len(parts) <= 30 THEN list_filter(parts, lambda x: NOT ({_holder})) ELSE parts END AS look,
  regexp_extract_all("right"(think, 200), '{R.NUMBER}')[-1] AS number_, CASE WHEN tail <> '' THEN {G.sql_extract('tail', 'tail')} END AS told FROM e2),
e4 AS (SELECT *, regexp_matches(last_, '{R.TERMINAL_BOXED}') AS boxed, regexp_matches(last_, '{R.TERMINAL_NUMBER}') OR regexp_matches(last_, '{R.TERMINAL_SYMBOL}') AS bare, {_prose('last_')} AS prose, list_filter(list_transform(look, lambda x: {_template('x')}), lambda x: x <> '') AS shapes_ FROM e3),
{_matched('e4', 'e5', 'number_', 'told', 'ab')},{_matched('e5', 'e6', 'told', 'number_', 'ba')},{_restated('tails', 'e1', '^(?:[0-9]+|[A-Z])$', 2)},
e7 AS (SELECT e6.*, coalesce(tails.n, 0) AS tails, TRY_CAST(replace(number_, ',', '') AS double) AS fx, TRY_CAST(replace(told, ',', '') AS double) AS fy FROM e6 LEFT JOIN tails ON e6.key = tails.key),
pen AS MATERIALIZED (SELECT *, CASE WHEN length(think) > {R.LENGTH_FROM} THEN least(CAST({R.LENGTH_MOST} AS double), CAST({R.LENGTH_MOST} AS double) * (length(think) - {R.LENGTH_FROM}) / {R.LENGTH_TO - R.LENGTH_FROM}) ELSE 0.0 END AS length_,
  least(0.15, 0.05 * greatest(0, len(list_filter(list_concat(parts, after_), lambda x: {_holder})) - 2)) AS placeholder,
  CASE WHEN {_longest_run('look')} >= 10 OR {_longest_run('shapes_')} >= 5 THEN 0.2 ELSE 0.0 END AS repetition,
  least(0.15, 0.1 * (CAST(coalesce(list_max(list_transform(regexp_extract_all(think, '(?m)^\\s*(\\d+)\\.\\s', 1), lambda x: TRY_CAST(x AS bigint))), 0) > 50 AS int) + CAST(again_ = 0 AND length(think) > 6000 AS int))) AS monolithic,
  least(0.15, 0.05 * tails) AS tail_repeat, CASE WHEN len(list_filter({G.sql_lines('tail')}, lambda y: regexp_matches(y, '{R.LEAK_V1}') AND ({_prose('y')}) IS NULL)) > 0 THEN 0.05 ELSE 0.0 END AS leak,
  CASE WHEN len(regexp_extract_all(think, '{R.SENTINEL}')) >= 3 THEN 0.05 ELSE 0.0 END AS sentinel, CASE WHEN number_ IS NOT NULL AND told IS NOT NULL AND NOT (ab OR ba OR {G.sql_close('fx', 'fy')}) THEN 0.05 ELSE 0.0 END AS contradiction,
  least(0.1, 0.05 * (CAST(len(regexp_extract_all(block, '\\\\boxed\\{{')) > 1 AS int) + CAST(contains(block, '{{boxed{{') AS int))) AS malformed, CASE WHEN closed THEN -0.02 ELSE 0.0 END AS closure FROM e7)"""
_gold_int = f"regexp_matches(window_, concat(chr(92), 'b', gs, '($|[^', chr(92), chr(92), '])'))"
#: key, shape, tier and the parts of the older reward.
REWARD_V1_SQL = f"""{PENALTIES_SQL}, f1 AS (SELECT *, {G.sql_post('text')} AS post, {G.sql_strip("coalesce(gold, '')")} AS gs, "right"(regexp_replace(tail, '\\s+$', ''), 500) AS window_, {G.sql_lines('block')} AS rows_ FROM pen), f2 AS (SELECT *, {G.sql_extract('text', 'post')} AS pred FROM f1),
{G.sql_verified('f2', 'f3', 'pred', 'gold', 'ok')},{_matched('f3', 'f4', 'prose', 'gold', 'said')},
f5 AS (SELECT *, len(rows_) BETWEEN 1 AND 3 AND (boxed OR bare OR prose IS NOT NULL) AND len(list_filter(rows_, lambda x: regexp_matches(x, '^\\d+\\.\\s'))) = 0 AS clean, CASE WHEN gs = '' OR window_ = '' THEN false WHEN regexp_matches(gs, '^-?\\d+$') THEN {_gold_int} ELSE contains(window_, gs) END AS there FROM f4),
f6 AS MATERIALIZED (SELECT *, CASE WHEN (ok OR said) AND clean AND NOT (contradiction > 0 AND {{gate}}) THEN 'strict' WHEN (ok OR said) AND (there OR clean AND contradiction > 0 AND {{gate}}) THEN 'lenient' ELSE 'wrong' END AS tier FROM f5),
f7 AS (SELECT *, CASE tier WHEN 'strict' THEN 1.0 WHEN 'lenient' THEN 0.5 ELSE 0.0 END AS accuracy, length_ + placeholder + repetition + monolithic + tail_repeat + leak + sentinel + contradiction + malformed + closure AS penalty FROM f6),
f8 AS (SELECT *, CAST(closed AS int) * 0.15 + CAST(boxed AS int) * 0.1 + CAST(bare AS int) * 0.1 + CASE WHEN accuracy >= 0.5 AND len(parts) <= 25 AND (boxed OR bare) THEN 0.12 ELSE 0 END + CASE WHEN accuracy >= 0.5 AND again_ >= 2 THEN 0.05 ELSE 0 END AS structure FROM f7),
reward AS (SELECT *, accuracy + greatest(CASE WHEN closed THEN 0.1 ELSE 0 END, structure - penalty) AS total FROM f8)"""


def answer_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tier is made of, completion by completion."""
    t = R.tiers(R.split(completions(spark, sf_dir)))
    return t.select("key", "tier", "clean", "in_window", "accepted", "by_prose", "prose")


def thought_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, those that begin with a number, the greatest number of a line, their templates, the last number of the end, and boxes."""
    s = R.split(completions(spark, sf_dir))
    parts, think = T.chunks(F.col("think")), F.col("think")
    n = F.transform(F.regexp_extract_all(think, F.lit(r"(?m)^\s*(\d+)\.\s"), 1), lambda x: x.try_cast("long"))
    return s.select("key", F.size(parts).alias("parts"), F.size(F.filter(parts, lambda x: x.rlike(r"^\s*\d+\.\s"))).alias("numbered"), F.coalesce(F.array_max(n), F.lit(0)).alias("greatest"), F.array_join(F.transform(parts, T.template), "|").alias("templates"), F.try_element_at(F.regexp_extract_all(F.right(think, F.lit(200)), F.lit(R.NUMBER), 0), F.lit(-1)).alias("number"), F.regexp_count("block", F.lit(r"\\boxed\{")).alias("boxes"), F.contains("block", F.lit("{boxed{")).alias("malformed"))


#: Two ways to write one value, or two, or nothing.
PAIRS = r"""CASE o_orderkey % 12 WHEN 0 THEN concat('√', n) WHEN 1 THEN concat(b, 'frac{', n, '}{2}') WHEN 2 THEN concat(n, '.0') WHEN 3 THEN concat(n, ' ≤ x') WHEN 4 THEN '' WHEN 5 THEN concat('$', n, '$') WHEN 6 THEN concat('2·', n) WHEN 7 THEN concat(n, b, 'text{ cm}') WHEN 8 THEN NULL WHEN 9 THEN concat('−', n) WHEN 10 THEN concat('x = ', n) ELSE concat(n, ',000') END AS a,
 CASE o_orderkey % 12 WHEN 0 THEN concat(b, 'sqrt{', n, '}') WHEN 1 THEN concat(n / 2.0) WHEN 2 THEN concat(n + o_orderkey % 2) WHEN 3 THEN concat(n, b, 'le x') WHEN 4 THEN concat(n) WHEN 5 THEN concat(n, '.') WHEN 6 THEN concat('2', b, 'times ', n) WHEN 7 THEN concat(n, 'cm') WHEN 8 THEN concat(n) WHEN 9 THEN concat('-', n + o_orderkey % 5) WHEN 10 THEN concat(n) ELSE concat(n, '000') END AS b"""


def value_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two values agree: true, false or undecided; and the rule by which a missing side agrees."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 997 + 2 AS n", "char(92) AS b")
    p = o.select(F.col("o_orderkey").alias("key"), *(F.expr(x).alias(y) for x, y in ((PAIRS.split(" AS a,")[0], "a"), (PAIRS.split(" AS a,")[1].removesuffix(" AS b"), "b"))))
    return R.numerical_agree(p, "a", "b", "agree").select("key", R.one_notation(F.col("a")).alias("left"), R.values_agree(F.col("a"), F.col("b")).alias("decided"), "agree")


def reward_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the constants promise, beside the worst right and the best wrong rollout that there are."""
    c = completions(spark, sf_dir)
    think, answer, g = (F.col("key") % 400).cast("int"), (F.col("key") % 700).cast("int"), F.when(F.col("shape") == 2, 0).otherwise(1)
    r = R.budget_reward(c, think, answer, g, F.lit(150.0)).agg(F.round(F.min(F.when(F.col("accuracy") == 1, F.col("total"))), 6).alias("worst_right"), F.round(F.max(F.when(F.col("accuracy") == 0, F.col("total"))), 6).alias("best_wrong"))
    promised, older = R.invariants(), R.worst_case()
    return r.select("worst_right", "best_wrong", ((F.col("worst_right") >= promised["worst_right"]) & (F.col("best_wrong") <= promised["best_wrong"])).alias("kept"), F.lit(round(promised["margin"], 6)).alias("margin"), F.lit(round(older["margin"], 6)).alias("older_margin"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, ids, prompt: token arrays of ten shapes."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return o.select("key", F.expr(IDS).alias("ids"), F.lit(3).alias("prompt"))


IDS = """transform(CASE key % 10
 WHEN 0 THEN array(1, 2, 3, 151667, 10, 11, 151668, 20, 21, 151645) WHEN 1 THEN array(1, 2, 3, 151667, 10, 151668, 151645)
 WHEN 2 THEN array(1, 2, 3, 151667, 10, 11, 12) WHEN 3 THEN array(1, 2, 3, 10, 151668, 20) WHEN 4 THEN array(1, 2, 3, 151667, 151667, 10, 151668, 20)
 WHEN 5 THEN array(1, 2, 3, 151667, 10, 151668, 20, 151668, 21) WHEN 6 THEN array(1, 2, 3, 151668, 10, 151667, 20)
 WHEN 7 THEN array(1, 2, 3, 9, 151667, 151668, 20, 151645, 30) WHEN 8 THEN array(1, 2, 3, 151667, 10, 151668, 198, 198)
 ELSE array(1, 2, 3, 151667, 10, 151668, 20, 21, 22) END, x -> IF(x BETWEEN 10 AND 30, x + key % 5, x))"""
IDS_SQL = IDS.replace("array(", "list_value(").replace("transform(", "list_transform(").replace("x -> IF(x BETWEEN 10 AND 30, x + key % 5, x)", "lambda x: CASE WHEN x BETWEEN 10 AND 30 THEN x + key % 5 ELSE x END")


def segments_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P3"""
    s = sequences(spark, sf_dir).select("key", K.segments(F.col("ids"), F.col("prompt"), blanks=[198]).alias("s"))
    return s.select("key", "s.g", "s.reason", F.concat_ws(",", "s.warnings").alias("warnings"), "s.think_start", "s.think_end", "s.answer_start", "s.answer_end")


SEGMENTS_SQL = f"""WITH i AS (SELECT key, {IDS_SQL} AS ids FROM (SELECT o_orderkey AS key FROM orders)),
p AS (SELECT key, ids, len(ids) AS n, list_filter(range(3, len(ids)), lambda i: ids[i + 1] = 151667) AS o, list_filter(range(3, len(ids)), lambda i: ids[i + 1] = 151668) AS c FROM i),
q AS (SELECT *, coalesce(o[1], -1) AS op, coalesce(c[1], -1) AS cl FROM p),
e AS (SELECT *, CASE WHEN op >= 0 THEN op + 1 ELSE 3 END AS st, coalesce(list_filter(range(cl + 1, n), lambda i: ids[i + 1] IN (151645, 151643))[1], n) AS en FROM q),
b AS (SELECT *, len(list_filter(range(cl + 1, en), lambda i: ids[i + 1] <> 198)) = 0 AS empty_, len(list_filter(range(st, cl), lambda i: ids[i + 1] <> 198)) = 0 AS nothink, len(list_filter(range(en, n), lambda i: ids[i + 1] NOT IN (151645, 151643))) > 0 AS beyond FROM e),
r AS (SELECT *, CASE WHEN len(o) > 1 THEN 'duplicate_think_open' WHEN len(c) > 1 THEN 'duplicate_think_close' WHEN op < 0 THEN 'missing_think_open' WHEN cl < 0 THEN 'missing_think_close' WHEN cl < op THEN 'close_before_open' WHEN empty_ THEN 'empty_answer' ELSE 'ok' END AS reason FROM b)
SELECT key, CASE WHEN reason = 'ok' THEN 1 ELSE 0 END AS g, reason,
 CASE WHEN reason IN ('ok', 'empty_answer') THEN array_to_string(list_filter([CASE WHEN nothink THEN 'empty_think' END, CASE WHEN op > 3 THEN 'preamble' END, CASE WHEN beyond THEN 'trailing_after_eos' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS warnings,
 CASE WHEN reason IN ('ok', 'empty_answer', 'missing_think_close') THEN st ELSE -1 END AS think_start, CASE WHEN reason IN ('ok', 'empty_answer') THEN cl WHEN reason = 'missing_think_close' THEN n ELSE -1 END AS think_end,
 CASE WHEN reason IN ('ok', 'empty_answer') THEN cl + 1 ELSE -1 END AS answer_start, CASE WHEN reason IN ('ok', 'empty_answer') THEN en ELSE -1 END AS answer_end FROM r"""


def segment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of thought and of answers, always apart."""
    s = sequences(spark, sf_dir).select("key", K.segments(F.col("ids"), F.col("prompt"), blanks=[198]).alias("s"))
    ok = F.col("s.g") == 1
    return s.groupBy("s.reason").agg(F.count("*").alias("n"), F.sum(F.when(ok, F.col("s.think_end") - F.col("s.think_start")).otherwise(0)).alias("think"), F.sum(F.when(ok, F.col("s.answer_end") - F.col("s.answer_start")).otherwise(0)).alias("answer"))


def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twins that differ from some place on."""
    s = sequences(spark, sf_dir).withColumn("twin", F.expr("transform(ids, (x, i) -> IF(i = 4 + key % 3, x + 1, x))"))
    return s.select("key", F.coalesce(K.first_difference(F.col("ids"), F.col("twin"), F.col("prompt")), F.lit(-1)).cast("long").alias("at"))


_all = (grade_as_scored, grade_strict, grade_reason_counts, grade_extended, text_split, word_stutter, counter_restart, detector_flags, reward_stagec, reward_v1, reward_v1_strict_gate, penalty_breakdown, answer_tiers, thought_structure, value_agreement, reward_margins, segments_parse, segment_totals, first_divergence)
QUERIES = {f.__name__: f for f in _all}

_graded = f"WITH {COMPLETIONS_SQL}, {G.sql_steps('comp')}"
ORACLES = {
    "grade_as_scored": f"{_graded} SELECT key, pred, np AS normal, as_scored FROM graded",
    "grade_strict": f"{_graded} SELECT key, reason = '' AS strict, as_scored, CASE WHEN closed AND gs <> '' THEN pred END AS pred, reason FROM graded",
    "grade_reason_counts": f"{_graded} SELECT shape, reason, count(*) AS n, count(*) FILTER (as_scored AND reason <> '') AS lenient_only FROM graded GROUP BY 1, 2",
    "grade_extended": f"{_graded} SELECT key, wp AS wider, wide AS equal FROM graded",
    "text_split": f"""WITH {COMPLETIONS_SQL}, t AS (SELECT *, instr(text, '</think>') AS pos FROM comp), u AS (SELECT key, CASE WHEN pos > 0 THEN substr(text, 1, pos - 1) ELSE text END AS thought, CASE WHEN pos > 0 THEN substr(text, pos + 8) ELSE '' END AS tail FROM t),
b AS (SELECT *, CASE WHEN regexp_matches(tail, '{R.ANY_BOX}') THEN regexp_extract(tail, '(?s)^(.*{R.ANY_BOX})', 1) ELSE regexp_replace(tail, '\\s+$', '') END AS block FROM u),
l AS (SELECT *, coalesce(list_filter(list_transform(string_split(block, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1], '') AS last FROM b)
SELECT key, length(thought) AS thought, length(tail) AS tail, length(block) AS block, regexp_matches(last, '{R.TERMINAL_BOXED}') AS boxed, regexp_matches(last, '{R.TERMINAL_NUMBER}') OR regexp_matches(last, '{R.TERMINAL_SYMBOL}') AS bare FROM l""",
    "word_stutter": "WITH w AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+') AS w FROM conversations) SELECT conv_id, turn, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND length(w[i]) > 2)) AS bigint) AS stutters FROM w",
    "counter_restart": f"WITH {COMPLETIONS_SQL}, n AS (SELECT shape, list_transform(regexp_extract_all(split_part(text, '</think>', 1), '(?im)^\\s*(?:case|sub)\\s*(\\d+)\\s*:', 1), lambda x: CAST(x AS bigint)) AS n FROM comp) SELECT shape, CAST(sum(len(list_filter(range(1, len(n)), lambda i: n[i + 1] <= n[i]))) AS bigint) AS restarts, count(*) AS n FROM n GROUP BY 1",
    "detector_flags": FLAGS_SQL,
    "reward_stagec": STAGEC_SQL,
    "reward_v1": f"WITH {COMPLETIONS_SQL}, {REWARD_V1_SQL.replace('{gate}', 'false')} SELECT shape, tier, count(*) AS n, round(avg(structure), 6) AS structure, round(avg(penalty), 6) AS penalty, round(avg(total), 6) AS total FROM reward GROUP BY 1, 2",
    "reward_v1_strict_gate": f"WITH {COMPLETIONS_SQL}, {REWARD_V1_SQL.replace('{gate}', 'true')} SELECT key, tier, round(total, 6) AS total FROM reward",
    "answer_tiers": f"WITH {COMPLETIONS_SQL}, {REWARD_V1_SQL.replace('{gate}', 'false')} SELECT key, tier, clean, there AS in_window, ok OR said AS accepted, said AND NOT ok AS by_prose, prose FROM reward",
    "thought_structure": f"""WITH {COMPLETIONS_SQL}, {PENALTIES_SQL} SELECT key, len(parts) AS parts, again_ AS numbered, coalesce(list_max(list_transform(regexp_extract_all(think, '(?m)^\\s*(\\d+)\\.\\s', 1), lambda x: TRY_CAST(x AS bigint))), 0) AS greatest, array_to_string(list_transform(parts, lambda x: {_template('x')}), '|') AS templates, number_ AS number,
 len(regexp_extract_all(block, '\\\\boxed\\{{')) AS boxes, contains(block, '{{boxed{{') AS malformed FROM pen""",
    "value_agreement": f"""WITH o AS (SELECT o_orderkey, o_orderkey % 997 + 2 AS n, chr(92) AS b FROM orders), p AS (SELECT o_orderkey AS key, {PAIRS} FROM o),{_matched('p', 'q', 'a', 'b', 'ab')},{_matched('q', 'r', 'b', 'a', 'ba')},
s AS (SELECT *, {_one_notation('a')} AS x, {_one_notation('b')} AS y, TRY_CAST(replace(a, ',', '') AS double) AS fx, TRY_CAST(replace(b, ',', '') AS double) AS fy FROM r), t AS (SELECT *, {G.sql_numeric('x')} AS nx, {G.sql_numeric('y')} AS ny FROM s)
SELECT key, x AS "left", CASE WHEN x = '' OR y = '' THEN NULL WHEN x = y THEN true WHEN nx IS NOT NULL AND ny IS NOT NULL THEN {G.sql_close('nx', 'ny')} END AS decided, a IS NULL OR b IS NULL OR ab OR ba OR {G.sql_close('fx', 'fy')} AS agree FROM t""",
    "reward_margins": f"WITH m AS ({STAGEC_SQL}) SELECT round(min(total) FILTER (accuracy = 1), 6) AS worst_right, round(max(total) FILTER (accuracy = 0), 6) AS best_wrong, min(total) FILTER (accuracy = 1) >= 1 AND max(total) FILTER (accuracy = 0) <= 0.1 AS kept, CAST(0.9 AS double) AS margin, CAST(0.45 AS double) AS older_margin FROM m",
    "penalty_breakdown": f"WITH {COMPLETIONS_SQL}, {PENALTIES_SQL} SELECT shape, " + ", ".join(f"round(CAST(sum({"length_" if n == "length" else n}) AS double), 4) AS {n}" for n in R.PENALTIES) + " FROM pen GROUP BY 1",
    "segments_parse": SEGMENTS_SQL,
    "segment_totals": f"SELECT reason, count(*) AS n, CAST(sum(CASE WHEN g = 1 THEN think_end - think_start ELSE 0 END) AS bigint) AS think, CAST(sum(CASE WHEN g = 1 THEN answer_end - answer_start ELSE 0 END) AS bigint) AS answer FROM ({SEGMENTS_SQL}) GROUP BY 1",
    "first_divergence": f"SELECT key, CASE WHEN len(ids) > 4 + key % 3 THEN 4 + key % 3 ELSE -1 END AS at FROM (SELECT key, {IDS_SQL} AS ids FROM (SELECT o_orderkey AS key FROM orders))",
}
