"""Answers in completions: extraction, normal forms and equivalence, as column expressions.

Every rule is a pattern here and, with the same words, in the SQL that ``sql_steps`` writes, which tests compare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.text import strip

CLOSE = "</think>"
# The patterns that define what counts as an answer.
BOXED = r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
TAGGED = r"<answer>\s*(.*?)\s*</answer>"
FINAL = r"(?:final answer|answer is|answer[:=])\s*[:\-]?\s*([^\n.]+)"
#: Rewrites of an answer, in order; the order matters.
NORMAL = [
    (r"\\,|\\ |\\!", ""),
    (r"\\dfrac\{(-?[\d.]+)\}\{(-?[\d.]+)\}", "1/2"),
    (r"\\frac\{(-?[\d.]+)\}\{(-?[\d.]+)\}", "1/2"),
    (r"\\text\{([^}]*)\}", "1"),
    (r"\\(?:mathrm|mathbf|mathsf)\{([^}]*)\}", "1"),
    (r"[{},]", ""),
    (r"\d+\s*\\sqrt", r"\sqrt"),
    (r"\\([%$#])", "1"),
    (r"\\left|\\right", ""),
    (r"\\!", ""),
]
#: Rewrites before (and, from the third list on, after) those, for the wider equivalence.
WIDER_BEFORE = [(r"\\[dt]frac", r"\frac"), (r"\\frac\s*(\d)\s*(\d)", "1/2"), *[(r"\\frac\{([^{}]+)\}\{([^{}]+)\}", "1/2")] * 3]
WIDER_AFTER = [(r"\^\s*\\circ|\\degree|°", ""), (r"^\s*[a-z](?:\s*,\s*[a-z])*\s*(?:\\in|=|\\approx)\s*(\S)", "1"), (r"\s+", ""), (r"^\(([a-z])\)$", "1")]
DECIMAL = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?\s*$"
INFINITE = r"^\s*[+-]?inf(?:inity)?\s*$"
RATIO = r"^\s*([+-]?\d+(?:\.\d+)?)\s*/\s*(-?\d+(?:\.\d+)?)\s*$"
SCIENTIFIC = r"^\s*(-?\d+(?:\.\d+)?)\s*(?:\\times|\\cdot|\*|x|×)\s*10\s*\^\s*(-?\d+)\s*$"


def _java(replacement: str) -> str:
    """A replacement with groups as digits to Java's form."""
    if replacement in ("1", "1/2"):
        return replacement.replace("1", "$1").replace("2", "$2")
    return replacement.replace("\\", "\\\\")


def rewrite(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        c = F.regexp_replace(c, f"(?U){pattern}", _java(replacement))
    return c


def after_close(c: Column) -> Column:
    """What follows the first end of thought; all of it where there is none."""
    at = F.instr(c, CLOSE)
    return F.when(at > 0, F.substring(c, at + len(CLOSE), F.length(c))).otherwise(c)


def thought(c: Column) -> Column:
    at = F.instr(c, CLOSE)
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)


def tail(c: Column) -> Column:
    """What follows the first end of thought, or nothing."""
    return F.when(F.instr(c, CLOSE) > 0, after_close(c)).otherwise(F.lit(""))


def last_line(c: Column) -> Column:
    rows = F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), strip), lambda x: x != "")
    return F.try_element_at(rows, F.lit(-1))


def extract_answer(c: Column) -> Column:
    """The first box, else the first answer tag, else the last "final answer", else the last line; null in an empty text."""
    post = after_close(c)
    finals = F.regexp_extract_all(post, F.lit(f"(?iU){FINAL}"), 1)
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, None).when(post.rlike(BOXED), strip(F.regexp_extract(post, BOXED, 1))).when(post.rlike(f"(?sU){TAGGED}"), strip(F.regexp_extract(post, f"(?sU){TAGGED}", 1))).when(F.size(finals) > 0, F.regexp_replace(strip(F.element_at(finals, -1)), "[.,;]+$", "")).otherwise(last_line(post))


def extract_strict(c: Column) -> Column:
    """The same, but null where thought has no end."""
    return F.when(F.instr(c, CLOSE) > 0, extract_answer(c))


def normalize(c: Column) -> Column:
    s = strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"^\$+|\$+$", ""))
    return F.lower(strip(F.regexp_replace(rewrite(s, NORMAL), r"\.+$", "")))


def numeric(c: Column) -> Column:
    """A decimal, an infinity or a ratio of decimals; else null, as for a ratio to zero."""
    ratio = F.try_divide(F.regexp_extract(c, RATIO, 1).try_cast("double"), F.regexp_extract(c, RATIO, 2).try_cast("double"))
    infinite = F.when(strip(c).startswith("-"), float("-inf")).otherwise(float("inf"))
    return F.when(c.rlike(DECIMAL), strip(c).try_cast("double")).when(c.rlike(INFINITE), infinite).when(c.rlike(RATIO), ratio)


def close(a: Column, b: Column, rel: float = 1e-6, least: float = 1e-9) -> Column:
    """False for null, and for NaN, which Spark holds equal to itself."""
    near = (a == b) | (F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(least)))
    return F.coalesce(near & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def verified(df: DataFrame, pred: str, gold: str, out: str) -> DataFrame:
    """df with the lenient verdict on an extracted answer: equal, close, or either ends in the other. In steps, so that no normal form is worked out twice."""
    df = df.withColumn("__gold", strip(F.coalesce(F.col(gold), F.lit("")))).withColumns({"__p": normalize(F.col(pred)), "__n": normalize(F.col("__gold"))})
    df = df.withColumns({"__x": numeric(F.col("__p")), "__y": numeric(F.col("__n"))})
    p, n = F.col("__p"), F.col("__n")
    same = ((p != "") & (p == n)) | close(F.col("__x"), F.col("__y")) | ((n != "") & F.endswith(p, n)) | ((p != "") & F.endswith(n, p))
    return df.withColumn(out, F.coalesce(F.col(pred).isNotNull() & (F.col("__gold") != "") & same, F.lit(False))).drop("__gold", "__p", "__n", "__x", "__y")


def wider(c: Column) -> Column:
    return rewrite(normalize(rewrite(F.coalesce(c, F.lit("")), WIDER_BEFORE)), WIDER_AFTER)


def wider_number(c: Column) -> Column:
    power = F.regexp_extract(c, SCIENTIFIC, 1).try_cast("double") * F.pow(F.lit(10.0), F.regexp_extract(c, SCIENTIFIC, 2).try_cast("double"))
    return F.when(c.rlike(SCIENTIFIC), power).otherwise(numeric(c))


def equivalent(pred: Column, gold: Column) -> Column:
    """Equal in a wider notation: fractions, powers of ten, degrees, binders, spaces."""
    p, g = wider(pred), wider(gold)
    return ((p != "") & (p == g)) | close(wider_number(p), wider_number(g))


def graded(df: DataFrame, text: str = "text", gold: str = "gold") -> DataFrame:
    """df with pred, as_scored, strict and reason; no end of thought goes before no gold, then no answer, then mismatch."""
    df = verified(df.withColumn("pred", extract_answer(F.col(text))), "pred", gold, "as_scored")
    df = df.withColumns({"__closed": F.coalesce(F.instr(F.col(text), CLOSE) > 0, F.lit(False)), "__gold": strip(F.coalesce(F.col(gold), F.lit("")))})
    df = df.withColumns({"__p": normalize(F.col("pred")), "__n": normalize(F.col("__gold")), "__wp": wider(F.col("pred")), "__wn": wider(F.col("__gold"))})
    df = df.withColumns({"__x": numeric(F.col("__p")), "__y": numeric(F.col("__n")), "__wx": wider_number(F.col("__wp")), "__wy": wider_number(F.col("__wn"))})
    same = lambda p, n, x, y: ((F.col(p) != "") & (F.col(p) == F.col(n))) | close(F.col(x), F.col(y))
    right = same("__p", "__n", "__x", "__y") | same("__wp", "__wn", "__wx", "__wy")
    reason = F.when(~F.col("__closed"), "no_think_close").when(F.col("__gold") == "", "no_gold").when(F.col("pred").isNull(), "no_answer_extracted").when(right, "").otherwise("mismatch")
    df = df.withColumn("reason", reason)
    df = df.withColumns({"strict": F.col("reason") == "", "pred": F.when(F.col("__closed") & (F.col("__gold") != ""), F.col("pred"))})
    return df.drop("__closed", "__gold", "__p", "__n", "__wp", "__wn", "__x", "__y", "__wx", "__wy")


# The same rules in SQL.
def _sql(rules: list[tuple[str, str]], c: str) -> str:
    for pattern, replacement in rules:
        to = replacement.replace("1", "\\1").replace("2", "\\2") if replacement in ("1", "1/2") else replacement.replace("\\", "\\\\")
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


SPACE = "[\\s\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{3000}\\x0B]"


def sql_strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def sql_normalize(c: str) -> str:
    s = sql_strip(f"regexp_replace({sql_strip(f'coalesce({c}, {chr(39) * 2})')}, '^\\$+|\\$+$', '', 'g')")
    return f"lower({sql_strip(f'regexp_replace({_sql(NORMAL, s)}, {chr(39)}\\.+$' + chr(39) + ', ' + chr(39) * 2 + ')')})"


def sql_wider(c: str) -> str:
    return _sql(WIDER_AFTER, sql_normalize(_sql(WIDER_BEFORE, f"coalesce({c}, '')")))


def sql_numeric(c: str) -> str:
    ratio = f"TRY_CAST(regexp_extract({c}, '{RATIO}', 1) AS double) / nullif(TRY_CAST(regexp_extract({c}, '{RATIO}', 2) AS double), 0)"
    return f"CASE WHEN regexp_matches({c}, '{DECIMAL}') THEN TRY_CAST(trim({c}) AS double) WHEN regexp_matches({c}, '{INFINITE}') THEN CAST(CASE WHEN starts_with(trim({c}), '-') THEN '-inf' ELSE 'inf' END AS double) WHEN regexp_matches({c}, '{RATIO}') THEN {ratio} END"


def sql_wider_number(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{SCIENTIFIC}') THEN TRY_CAST(regexp_extract({c}, '{SCIENTIFIC}', 1) AS double) * pow(10.0, TRY_CAST(regexp_extract({c}, '{SCIENTIFIC}', 2) AS double)) ELSE {sql_numeric(c)} END"


def sql_close(a: str, b: str) -> str:
    return f"coalesce({a} = {b} OR abs({a} - {b}) <= greatest(1e-6 * greatest(abs({a}), abs({b})), 1e-9), false)"


def sql_post(c: str) -> str:
    return f"CASE WHEN instr({c}, '{CLOSE}') > 0 THEN substr({c}, instr({c}, '{CLOSE}') + {len(CLOSE)}) ELSE {c} END"


def sql_lines(c: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({c}, '\\r\\n|\\r|\\n'), lambda x: {sql_strip('x')}), lambda x: x <> '')"


def sql_extract(c: str, post: str) -> str:
    """extract_answer() of a text whose part after the end of thought is a column."""
    finals = f"regexp_extract_all({post}, '(?i){FINAL}', 1)"
    boxed, tagged, final = f"regexp_extract({post}, '{BOXED}', 1)", f"regexp_extract({post}, '(?s){TAGGED}', 1)", f"{finals}[-1]"
    return f"""CASE WHEN coalesce(length({c}), 0) = 0 THEN NULL WHEN regexp_matches({post}, '{BOXED}') THEN {sql_strip(boxed)} WHEN regexp_matches({post}, '(?s){TAGGED}') THEN {sql_strip(tagged)}
  WHEN len({finals}) > 0 THEN regexp_replace({sql_strip(final)}, '[.,;]+$', '') ELSE {sql_lines(post)}[-1] END"""


def sql_verified(source: str, out: str, pred: str, gold: str, verdict: str) -> str:
    """Common table expressions that add to a table the lenient verdict on an extracted answer, as verified() does."""
    return f"""
{out}_1 AS (SELECT *, {sql_strip(f"coalesce({gold}, '')")} AS v_g FROM {source}), {out}_2 AS (SELECT *, {sql_normalize(pred)} AS v_p, {sql_normalize('v_g')} AS v_n FROM {out}_1), {out}_3 AS (SELECT *, {sql_numeric('v_p')} AS v_x, {sql_numeric('v_n')} AS v_y FROM {out}_2),
{out} AS (SELECT * EXCLUDE (v_g, v_p, v_n, v_x, v_y), coalesce({pred} IS NOT NULL AND v_g <> '' AND ((v_p <> '' AND v_p = v_n) OR {sql_close('v_x', 'v_y')} OR (v_n <> '' AND ends_with(v_p, v_n)) OR (v_p <> '' AND ends_with(v_n, v_p))), false) AS {verdict} FROM {out}_3)"""


def sql_steps(source: str) -> str:
    """Common table expressions up to ``graded``, for a table with key, text and gold."""
    return f"""
g1 AS (SELECT *, {sql_post('text')} AS post, instr(text, '{CLOSE}') > 0 AS closed, {sql_strip("coalesce(gold, '')")} AS gs FROM {source}),
g3 AS (SELECT *, {sql_extract('text', 'post')} AS pred FROM g1),
g4 AS (SELECT *, {sql_normalize('pred')} AS np, {sql_normalize('gs')} AS ng, {sql_wider('pred')} AS wp, {sql_wider('gs')} AS wg FROM g3),
g5 AS (SELECT *, {sql_numeric('np')} AS xp, {sql_numeric('ng')} AS xg, {sql_wider_number('wp')} AS yp, {sql_wider_number('wg')} AS yg FROM g4),
g6 AS (SELECT *, (np <> '' AND np = ng) OR {sql_close('xp', 'xg')} AS equal_, (wp <> '' AND wp = wg) OR {sql_close('yp', 'yg')} AS wide FROM g5),
graded AS (SELECT *, coalesce(pred IS NOT NULL AND gs <> '' AND (equal_ OR (ng <> '' AND ends_with(np, ng)) OR (np <> '' AND ends_with(ng, np))), false) AS as_scored,
  CASE WHEN NOT closed THEN 'no_think_close' WHEN gs = '' THEN 'no_gold' WHEN pred IS NULL THEN 'no_answer_extracted' WHEN equal_ OR wide THEN '' ELSE 'mismatch' END AS reason FROM g6)"""
