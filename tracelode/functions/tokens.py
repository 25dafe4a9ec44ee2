"""Token arrays: segments of a sequence and measures of its tokens, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ids that open and close thought, start a turn and end a text.
OPEN, CLOSE, EOS, TURN, ASSISTANT = 151667, 151668, (151645, 151643), 151644, 77091


def places(ids: Column, token: int, prompt: Column) -> Column:
    """Where a token is, from 0, the prompt left out."""
    at = F.transform(ids, lambda x, i: F.when((x == token) & (i >= prompt), i))
    return F.array_compact(at)


def blank(ids: Column, start: Column, end: Column, blanks: list[int]) -> Column:
    """Nothing, or nothing but blank tokens."""
    part = F.slice(ids, start + 1, F.greatest(end - start, F.lit(0)))
    return (end <= start) | (F.forall(part, lambda x: x.isin(blanks)) if blanks else F.lit(False))


def segments(ids: Column, prompt: Column, opened: Column | None = None, blanks: list[int] | None = None) -> Column:
    """g, reason, warnings and half-open spans of thought and answer; the first rule that is broken gives the reason."""
    opened = F.lit(False) if opened is None else opened
    blanks = blanks or []
    n = F.size(ids)
    o, c = places(ids, OPEN, prompt), places(ids, CLOSE, prompt)
    first = lambda a: F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(-1))
    open_, close = first(o), first(c)
    start = F.when(open_ >= 0, open_ + 1).otherwise(prompt)
    ends = F.array_compact(F.transform(ids, lambda x, i: F.when(x.isin(*EOS) & (i > close), i)))
    end = F.coalesce(F.try_element_at(ends, F.lit(1)), n)
    beyond = F.exists(F.slice(ids, end + 1, F.greatest(n - end, F.lit(0))), lambda x: ~x.isin(*EOS))
    reason = (
        F.when(F.size(o) > 1, "duplicate_think_open")
        .when(F.size(c) > 1, "duplicate_think_close")
        .when((open_ < 0) & ~opened, "missing_think_open")
        .when(close < 0, "missing_think_close")
        .when((open_ >= 0) & (close < open_), "close_before_open")
        .when(blank(ids, close + 1, end, blanks), "empty_answer")
        .otherwise("ok")
    )
    parsed = reason.isin("ok", "empty_answer")
    warnings = F.array_compact(F.array(F.when(blank(ids, start, close, blanks), "empty_think"), F.when((open_ >= 0) & (open_ > prompt), "preamble"), F.when(beyond, "trailing_after_eos")))
    span = lambda x: F.when(parsed, x).otherwise(-1)
    cut = reason == "missing_think_close"
    return F.struct(
        (reason == "ok").cast("int").alias("g"),
        reason.alias("reason"),
        F.when(parsed, warnings).otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.when(cut, start).otherwise(span(start)).cast("int").alias("think_start"),
        F.when(cut, n).otherwise(span(close)).cast("int").alias("think_end"),
        span(close + 1).cast("int").alias("answer_start"),
        span(end).cast("int").alias("answer_end"),
    )


def turns(ids: Column) -> Column:
    """How many assistant turns begin; more than one is an error of the input."""
    n = F.size(ids)
    pairs = F.zip_with(F.slice(ids, 1, F.greatest(n - 1, F.lit(0))), F.slice(ids, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (a == TURN) & (b == ASSISTANT))
    return F.size(F.filter(pairs, lambda x: x))


def first_difference(a: Column, b: Column, start: Column) -> Column:
    """The first place from start on where two sequences differ, or null."""
    at = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    found = F.array_position(F.slice(at, start + 1, F.greatest(F.size(at) - start, F.lit(0))), True)
    return F.when(found > 0, (found - 1 + start).cast("int"))


def gate(s: Column, gamma: float = -8.0, kappa: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-kappa * (-s - gamma)))


def novelty(s: Column, alpha: float = 0.2, cap: float = 10.0) -> Column:
    return 1 + alpha * F.least(s, F.lit(cap))


def token_weight(s: Column, marked: Column, floor: float = 1.0, **options) -> Column:
    """The gate times the novelty, at least the floor where a token is marked."""
    w = gate(s, **options) * novelty(s)
    return F.when(marked, F.greatest(w, F.lit(floor))).otherwise(w)


def g_spike(df: DataFrame, group: str, gaps: str, betas: dict[str, float], lam: float = 1.0) -> DataFrame:
    """group and, for each name and beta, exp(-lam / beta * log mean exp(beta * gap)), shifted by the group's greatest gap so that nothing overflows: two aggregates, no list of a group's tokens."""
    top = df.groupBy(group).agg(F.max(gaps).alias("__top"))
    near = df.join(top, group)
    means = near.groupBy(group).agg(F.first("__top").alias("__top"), *(F.avg(F.exp(b * (F.col(gaps) - F.col("__top")))).alias(n) for n, b in betas.items()))
    return means.select(group, *(F.exp(-(lam / b) * (b * F.col("__top") + F.log(n))).alias(n) for n, b in betas.items()))


def gap(actual: Column, top: Column) -> Column:
    """How far a token's log-probability is below the best one's; never negative."""
    return F.greatest(top - actual, F.lit(0.0))
