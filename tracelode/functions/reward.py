"""Detectors and rewards of single rollouts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions import grade as G
from tracelode.functions import text as T
from tracelode.operators.groups import band_multiplier, length_multiplier

# The weights and limits of the reward for rollouts with a thought budget.
W_FORMAT, W_LENGTH, W_BAND = 0.10, 0.15, 0.10
LEAST_THOUGHT = 16
PEN_CONTRADICTION, PEN_LEAK, PEN_LOOP = 0.20, 0.10, 0.10
PEN_REPEAT, PEN_REPEAT_MOST = 0.05, 0.10
LOOP_EXACT, LOOP_TEMPLATE = 10, 30
LEAK_LINE = r"^\s*(?:goal|chk|sub|let|case)\s*:"
LEAK_SYMBOL = r"^\s*[⇒✗]"
ARROW = r"⇒\s*([^\n⇒]{1,80})"
ANSWER_REPEAT = r"(?m)^((?=\S{0,39}\w)\S{1,40})(?:\s*\n\s*\n\s*\1)+\s*$"
# Those of the older reward.
R_STRICT, R_LENIENT = 1.0, 0.5
S_CLOSED, S_TERMINAL, S_SHORT, S_RESTART = 0.15, 0.10, 0.12, 0.05
LENGTH_FROM, LENGTH_TO, LENGTH_MOST = 8_000, 20_000, 0.30
PLACEHOLDERS = [r"^\s*final answer\s*[:\-]?\s*[^\s\n]{0,40}\.?\s*$", r"^\s*end\.?\s*$", r"^\s*done\.?\s*$", r"^\s*output complete\.?\s*$", r"^\s*end of thought process\.?\s*$", r"^\s*\(placeholder[^)]*\)\s*$"]
SENTINEL = r"(?i)Final Answer:|End of thought process|Output complete|\(Placeholder|\(Self-Correction|\(Final Output"
LEAK_V1 = r"^\s*(?:\*\*[A-Z][^*]{0,80}\*\*|\d+\.\s)"
TAIL_REPEAT = r"(?m)^([\d]+|[A-Z])(?:\s*\n\s*\n\s*\1)+\s*$"
TERMINAL_BOXED = r"^\s*\\?boxed\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}\s*\.?\s*$"
TERMINAL_NUMBER = r"^\s*-?\d+(?:[.,]\d+)*(?:\s*/\s*-?\d+(?:[.,]\d+)*)?\s*\.?\s*$"
TERMINAL_SYMBOL = r"^\s*(?:\$[^$]+\$|[A-Za-z]|\([A-Za-z]\)|\\text\{[^}]+\})\s*\.?\s*$"
META_PATTERN, META_PENALTY = r"(?i)Common answer|such problems often|usually the answer|Let'?s go with|Or\s+[A-Z0-9]+\.\s*Or", 0.10
ANY_BOX = r"\\?boxed\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
PROSE = r"(?i)^(?:\*\*)?(?:Answer|Final\s+Answer|Final\s+result\s+is|The\s+.+?\s+is)(?:\*\*)?\s*[:=]?\s*\**\s*([^\s.*][^*]*?)\s*\**\.?\s*$"
BOLD = r"^\s*\*\*([^*]+?)\*\*\s*\.?\s*$"
NUMBER = r"-?\d+(?:\.\d+)?(?:\s*/\s*\d+(?:\.\d+)?)?"
# One notation for what is written in symbols or in TeX, in order.
ONE_NOTATION = [
    (r"\\(?:text|mathrm|mathbf|mathsf|mathit)\s*\{([^{}]*)\}", "$1"), (r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", "($1)/($2)"), (r"\\sqrt\s*\{([^{}]*)\}", "sqrt($1)"), (r"\\sqrt\s*([0-9a-zA-Z]+)", "sqrt($1)"),
    (r"√\s*\(([^()]*)\)", "sqrt($1)"), (r"√\s*([0-9a-zA-Z]+)", "sqrt($1)"), (r"\^\s*\{([^{}]*)\}", "^$1"), (r"\\(?:cdot|times)", "*"), (r"\\left|\\right|\\,|\;|\\!|\\ |\\quad|\\qquad|\\displaystyle|\\dollar|\$", ""),
    ("[−–—]", "-"), ("[×·∗]", "*"), ("[÷⁄]", "/"), ("≤", "<="), ("≥", ">="), ("≠", "!="), ("±", "+-"), ("π", "pi"), ("∞", "inf"), ("°", "deg"), ("[,{}]", ""), (r"(?U)\s+", ""), (r"\.+$", ""),
]


def one_notation(c: Column) -> Column:
    out = T.strip(F.coalesce(c, F.lit("")))
    for pattern, to in ONE_NOTATION:
        out = F.regexp_replace(out, pattern, to)
    return F.lower(out)


def values_agree(a: Column, b: Column) -> Column:
    """True, false, or null where it can't be decided: a side is missing, or they differ and aren't both numbers."""
    x, y = one_notation(a), one_notation(b)
    p, q = G.numeric(x), G.numeric(y)
    return F.when((x == "") | (y == ""), None).when(x == y, True).when(p.isNotNull() & q.isNotNull(), G.close(p, q))


def lines_of(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n")


def loop(think: Column) -> Column:
    """A line that repeats, or lines that are the same but for numbers."""
    rows = T.lines(think)
    blanked = F.transform(rows, lambda x: F.regexp_replace(x, r"\d+", "#"))
    return (F.coalesce(T.longest_run(rows), F.lit(0)) >= LOOP_EXACT) | (F.coalesce(T.longest_run(blanked), F.lit(0)) >= LOOP_TEMPLATE)


def repeats(post: Column, pattern: str) -> Column:
    """How many blank-line gaps the restatements of an answer have."""
    found = F.regexp_extract_all(F.coalesce(post, F.lit("")), F.lit(pattern), 0)
    return F.aggregate(F.transform(found, lambda m: T.occurrences(m, "\n\n")), F.lit(0), lambda a, b: a + b)


def leaks(post: Column) -> Column:
    rows = lines_of(post)
    return F.exists(rows, lambda x: x.rlike(LEAK_LINE) | x.rlike(LEAK_SYMBOL))


def contradicts(think: Column, post: Column) -> Column:
    """The last conclusion of the thought and the last box are both there, can be compared, and differ."""
    arrow = F.try_element_at(F.regexp_extract_all(think, F.lit(ARROW), 1), F.lit(-1))
    value = F.regexp_replace(T.strip(arrow), "[.;,]+$", "")
    value = T.strip(F.element_at(F.split(value, "="), -1))
    box = F.try_element_at(F.regexp_extract_all(post, F.lit(G.BOXED), 1), F.lit(-1))
    return F.coalesce(~values_agree(value, box), F.lit(False))


def restarts(think: Column) -> Column:
    """How often a numbered case or step doesn't count up."""
    n = F.transform(F.regexp_extract_all(F.coalesce(think, F.lit("")), F.lit(r"(?im)^\s*(?:case|sub)\s*(\d+)\s*:"), 1), lambda x: x.cast("long"))
    return T.neighbours(n, lambda a, b: b <= a)


def budget_reward(df: DataFrame, think_len: Column, answer_len: Column, g: Column, budget: Column) -> DataFrame:
    """df (text, gold) with accuracy, structure, penalty and total of a rollout with a thought budget.

    Right answers count only in well-formed text, bonuses only with them, and penalties never go below the floor.
    """
    df = G.graded(df).withColumns({"__think": G.thought(F.col("text")), "__tail": G.tail(F.col("text")), "__formed": (g == 1) & (think_len >= LEAST_THOUGHT), "__right": F.col("strict") & (g == 1)})
    bonus = W_LENGTH * length_multiplier(think_len, budget) + W_BAND * band_multiplier(answer_len)
    df = df.withColumn("structure", F.when(F.col("__formed"), W_FORMAT).otherwise(0.0) + F.when(F.col("__formed") & F.col("__right"), bonus).otherwise(0.0))
    df = df.withColumns({"pen_loop": F.when(loop(F.col("__think")), PEN_LOOP).otherwise(0.0), "pen_repeat": F.least(F.lit(PEN_REPEAT_MOST), PEN_REPEAT * repeats(F.col("__tail"), ANSWER_REPEAT)), "pen_leak": F.when(leaks(F.col("__tail")), PEN_LEAK).otherwise(0.0), "pen_contradiction": F.when(contradicts(F.col("__think"), F.col("__tail")), PEN_CONTRADICTION).otherwise(0.0)})
    df = df.withColumn("penalty", F.col("pen_loop") + F.col("pen_repeat") + F.col("pen_leak") + F.col("pen_contradiction"))
    floor = F.when(F.col("__formed"), W_FORMAT).otherwise(0.0)
    df = df.withColumns({"accuracy": F.col("__right").cast("double"), "total": F.col("__right").cast("double") + F.greatest(floor, F.col("structure") - F.col("penalty"))})
    return df.drop("__think", "__tail", "__formed", "__right")


# The older reward.
def final_block(post: Column) -> Column:
    """Up to the end of the last box, else without white space at the end."""
    boxed = F.regexp_extract(post, f"(?s)^(.*{ANY_BOX})", 1)
    return F.when(post.rlike(ANY_BOX), boxed).otherwise(F.regexp_replace(post, r"(?U)\s+$", ""))


def prose_answer(line: Column) -> Column:
    s = T.strip(line)
    first = T.strip(F.regexp_replace(F.regexp_replace(T.strip(F.regexp_extract(s, PROSE, 1)), r"^\*+|\*+$", ""), r"\.+$", ""))
    bold = T.strip(F.regexp_replace(T.strip(F.regexp_extract(s, BOLD, 1)), r"\.+$", ""))
    return F.when(s.rlike(PROSE) & (first != ""), first).when(s.rlike(BOLD) & (bold != ""), bold)


def terminal(block: Column) -> tuple[Column, Column]:
    last = F.coalesce(G.last_line(block), F.lit(""))
    return last.rlike(TERMINAL_BOXED), last.rlike(TERMINAL_NUMBER) | last.rlike(TERMINAL_SYMBOL)


def gold_in_window(post: Column, gold: Column, size: int = 500) -> Column:
    """The gold answer in the last characters; an integer must not be part of a longer number or of a root."""
    window = F.right(F.regexp_replace(post, r"(?U)\s+$", ""), F.lit(size))
    g = T.strip(gold)
    return F.when((g == "") | (window == ""), False).when(g.rlike(r"^-?\d+$"), F.regexp_like(window, F.concat(F.lit(r"\b"), g, F.lit(r"(?!\\)")))).otherwise(F.contains(window, g))


def split(df: DataFrame, text: str = "text") -> DataFrame:
    """df with think, tail, block (up to the last box), last (its last line), boxed, bare and closed."""
    df = df.withColumns({"think": G.thought(F.col(text)), "tail": G.tail(F.col(text)), "closed": F.coalesce(F.instr(F.col(text), G.CLOSE) > 0, F.lit(False))}).withColumn("block", final_block(F.col("tail")))
    df = df.withColumn("last", F.coalesce(G.last_line(F.col("block")), F.lit("")))
    return df.withColumns({"boxed": F.col("last").rlike(TERMINAL_BOXED), "bare": F.col("last").rlike(TERMINAL_NUMBER) | F.col("last").rlike(TERMINAL_SYMBOL), "prose": prose_answer(F.col("last"))})


def with_match(df: DataFrame, candidate: str, gold: str, out: str) -> DataFrame:
    """df with whether a candidate, as if in a box, is the gold answer; a missing side is none."""
    df = df.withColumn("__boxed", G.extract_answer(F.concat(F.lit("\\boxed{"), F.col(candidate), F.lit("}"))))
    return G.verified(df, "__boxed", gold, out).withColumn(out, F.col(out) & F.coalesce((F.col(candidate) != "") & (F.col(gold) != ""), F.lit(False))).drop("__boxed")


def numerical_agree(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with whether two answers agree, either as the gold answer of the other, or as numbers. A missing side agrees: without evidence there is no contradiction."""
    df = with_match(with_match(df, a, b, "__ab"), b, a, "__ba")
    number = lambda c: F.replace(F.col(c), F.lit(","), F.lit("")).try_cast("double")
    both = F.col("__ab") | F.col("__ba") | G.close(number(a), number(b))
    return df.withColumn(out, F.col(a).isNull() | F.col(b).isNull() | both).drop("__ab", "__ba")


def worst_case() -> dict[str, float]:
    """What the older reward's constants promise: a strictly right answer that trips every penalty against a lenient one that trips none."""
    most = LENGTH_MOST + 0.15 + 0.20 + 0.15 + 0.15 + 0.05 + 0.05 + 0.05 + 0.10 - 0.02
    strict, lenient = R_STRICT + max(0.10, S_CLOSED - most), R_LENIENT + S_CLOSED
    return {"strict": strict, "lenient": lenient, "margin": strict - lenient}


def invariants() -> dict[str, float]:
    """The same of the reward with a budget: the worst right rollout, the best wrong one, and what structure can add at most."""
    return {"floor": W_FORMAT, "worst_right": 1.0, "best_wrong": W_FORMAT, "margin": 1.0 - W_FORMAT, "most_structure": W_FORMAT + W_LENGTH + W_BAND}


def tiers(df: DataFrame) -> DataFrame:
    """split(text, gold) with tier (strict, lenient or wrong), clean (the block is little more than an answer), in_window (the gold answer is near the end), accepted and by_prose (only as a sentence says it)."""
    df = G.verified(df.withColumn("__pred", G.extract_answer(F.col("text"))), "__pred", "gold", "__ok")
    df = with_match(df, "prose", "gold", "__said")
    rows = T.lines(F.col("block"))
    clean = (F.size(rows) > 0) & (F.size(rows) <= 3) & (F.col("boxed") | F.col("bare") | F.col("prose").isNotNull()) & ~F.exists(rows, lambda x: x.rlike(r"^\d+\.\s"))
    accepted = F.col("__ok") | F.col("__said")
    df = df.withColumns({"clean": clean, "in_window": gold_in_window(F.col("tail"), F.col("gold"))})
    df = df.withColumn("tier", F.when(accepted & F.col("clean"), "strict").when(accepted & F.col("in_window"), "lenient").otherwise("wrong"))
    return df.withColumns({"accepted": accepted, "by_prose": F.col("__said") & ~F.col("__ok")}).drop("__pred", "__ok", "__said")


def meta_pattern(think: Column, enabled: bool = True, last: int = 500) -> Column:
    """The penalty for a guess that is hedged at the end of the thought; not among PENALTIES, as it is off by default."""
    return F.when(F.lit(enabled) & F.right(F.coalesce(think, F.lit("")), F.lit(last)).rlike(META_PATTERN), META_PENALTY).otherwise(0.0)


PENALTIES = ("length", "placeholder", "repetition", "monolithic", "tail_repeat", "leak", "sentinel", "contradiction", "malformed", "closure")


def penalties_v1(df: DataFrame, variation: str | None = None) -> DataFrame:
    """split() with the magnitude of each of PENALTIES, the last of which is a bonus for closing."""
    placeholder = lambda x: F.exists(F.array(*(F.lit(f"(?i){p}") for p in PLACEHOLDERS)), lambda p: F.regexp_like(x, p))
    think, tail, block = F.col("think"), F.col("tail"), F.col("block")
    df = df.withColumns({"__parts": T.chunks(think), "__size": F.coalesce(F.length(think), F.lit(0)), "__steps": F.transform(F.regexp_extract_all(think, F.lit(r"(?m)^\s*(\d+)\.\s"), 1), lambda x: x.try_cast("long"))})
    df = df.withColumns({"__look": F.when(F.size("__parts") <= 30, F.filter("__parts", lambda x: ~placeholder(x))).otherwise(F.col("__parts")), "__again": F.size(F.filter("__parts", lambda x: x.rlike(r"^\s*\d+\.\s")))})
    df = df.withColumn("__shapes", F.filter(F.transform("__look", T.template), lambda x: x != ""))
    # The last number of the thought's end against what the tail says.
    df = df.withColumns({"__number": F.try_element_at(F.regexp_extract_all(F.right(think, F.lit(200)), F.lit(NUMBER), 0), F.lit(-1)), "__told": F.when(tail != "", G.extract_answer(tail))})
    df = numerical_agree(df, "__number", "__told", "__agree")
    size, excess = F.col("__size"), F.greatest(F.lit(0), F.size(F.filter(F.concat("__parts", T.chunks(tail)), placeholder)) - 2)
    looped = (F.coalesce(T.longest_run(F.col("__look")), F.lit(0)) >= 10) | (F.coalesce(T.longest_run(F.col("__shapes")), F.lit(0)) >= 5)
    outlier = F.coalesce(F.col(variation) > 100, F.lit(False)) if variation else F.lit(False)
    triggers = (F.coalesce(F.array_max("__steps"), F.lit(0)) > 50).cast("int") + ((F.col("__again") == 0) & (size > 6000)).cast("int") + outlier.cast("int")
    tails = F.filter(F.transform(F.regexp_extract_all(tail, F.lit(TAIL_REPEAT), 0), lambda m: T.occurrences(m, "\n\n")), lambda n: n >= 2)
    boxes = (F.regexp_count(block, F.lit(r"\\boxed\{")) > 1).cast("int") + F.contains(block, F.lit("{boxed{")).cast("int")
    df = df.withColumns({
        "length": F.when(size > LENGTH_FROM, F.least(F.lit(LENGTH_MOST), LENGTH_MOST * (size - LENGTH_FROM) / (LENGTH_TO - LENGTH_FROM))).otherwise(0.0),
        "placeholder": F.least(F.lit(0.15), 0.05 * excess),
        "repetition": F.when(looped, 0.20).otherwise(0.0),
        "monolithic": F.least(F.lit(0.15), 0.10 * triggers),
        "tail_repeat": F.least(F.lit(0.15), 0.05 * F.aggregate(tails, F.lit(0), lambda a, b: a + b)),
        "leak": F.when(F.exists(T.lines(tail), lambda x: x.rlike(LEAK_V1) & prose_answer(x).isNull()), 0.05).otherwise(0.0),
        "sentinel": F.when(F.regexp_count(think, F.lit(SENTINEL)) >= 3, 0.05).otherwise(0.0),
        "contradiction": F.when(~F.col("__agree"), 0.05).otherwise(0.0),
        "malformed": F.least(F.lit(0.10), 0.05 * boxes),
        "closure": F.when(F.col("closed"), -0.02).otherwise(0.0),
    })
    return df.drop("__look", "__shapes", "__steps", "__number", "__told", "__agree", "__size")


def reward_v1(df: DataFrame, variation: str | None = None, strict_gate: bool = False) -> DataFrame:
    """df (text, gold) with tier, structure, penalty and total: accuracy + max(floor, structure - penalties). With strict_gate a contradiction makes a strict answer lenient."""
    df = penalties_v1(tiers(split(df)), variation)
    if strict_gate:
        df = df.withColumn("tier", F.when((F.col("tier") == "strict") & (F.col("contradiction") > 0), "lenient").otherwise(F.col("tier")))
    df = df.withColumn("accuracy", F.when(F.col("tier") == "strict", R_STRICT).when(F.col("tier") == "lenient", R_LENIENT).otherwise(0.0))
    half = F.col("accuracy") >= 0.5
    parts = ((F.col("closed"), S_CLOSED), (F.col("boxed"), S_TERMINAL), (F.col("bare"), S_TERMINAL), (half & (F.size("__parts") <= 25) & (F.col("boxed") | F.col("bare")), S_SHORT), (half & (F.col("__again") >= 2), S_RESTART))
    df = df.withColumns({"structure": sum((F.when(test, value).otherwise(0.0) for test, value in parts), F.lit(0.0)), "penalty": sum((F.col(n) for n in PENALTIES), F.lit(0.0))})
    floor = F.when(F.col("closed"), 0.10).otherwise(0.0)
    df = df.withColumn("fmt", F.greatest(floor, F.col("structure") - F.col("penalty")))
    return df.withColumns({"total": F.col("accuracy") + F.col("fmt"), "restarts": F.col("__again")}).drop("__parts", "__again")
