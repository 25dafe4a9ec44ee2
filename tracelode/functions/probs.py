"""Log-probabilities and logits of tokens, as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelode.functions.tokens import CLOSE, EOS, OPEN, TURN


def entropy(logits: Column, tau: Column | float, k: int = 512) -> Column:
    """In nats, of the softmax of the k greatest logits at a temperature; shifted by the greatest, so that nothing overflows."""
    t = F.lit(tau) if isinstance(tau, float) else tau
    top = F.slice(F.reverse(F.array_sort(logits)), 1, k)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def of(x: Column) -> Column:
        e = F.transform(x, lambda v: F.exp((v - F.get(x, F.lit(0))) / t))
        weighted = F.transform(x, lambda v: F.exp((v - F.get(x, F.lit(0))) / t) * (v - F.get(x, F.lit(0))) / t)
        return F.log(total(e)) - total(weighted) / total(e)

    return F.element_at(F.transform(F.array(top), of), 1)


def temperature(logits: Column, target: Column, low: float = 1.1, high: float = 1.5, rounds: int = 20) -> Column:
    """The temperature at which the entropy is the target, by bisection; beyond the range, its end."""
    zero = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        cold = entropy(logits, mid) < target
        return F.struct(F.when(cold, mid).otherwise(a["lo"]).alias("lo"), F.when(cold, a["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), zero, halve, lambda a: (a["lo"] + a["hi"]) / 2)


def payload_scores(ids: Column, payload: Column) -> Column:
    """struct(surprisal, gap, problem) of ids and an array of map<int, struct<logprob, rank>>, one for each token; the first has none.

    problem is the first contract that is broken: as many entries as tokens, an entry for each, the actual token in it, no
    better token than that of rank 1, no gap of a token of rank 1.
    """
    n = F.size(ids)
    places = F.sequence(F.lit(1), n - 1)
    actual = lambda i: F.try_element_at(F.get(payload, i), F.get(ids, i))
    best = lambda i: F.array_max(F.transform(F.filter(F.map_values(F.get(payload, i)), lambda e: e["rank"] == 1), lambda e: e["logprob"]))
    gap = lambda i: best(i) - actual(i)["logprob"]
    broken = lambda test: F.exists(places, test)
    problem = (
        F.when(F.size(payload) != n, "length")
        .when(n < 2, None)
        .when(broken(lambda i: F.get(payload, i).isNull()), "no entry")
        .when(broken(lambda i: actual(i).isNull()), "actual token missing")
        .when(broken(lambda i: F.coalesce(gap(i) < -1e-6, F.lit(True))), "rank 1 is not the best")
        .when(broken(lambda i: (actual(i)["rank"] == 1) & (F.abs(gap(i)) > 1e-6)), "gap at rank 1")
    )
    none = F.array(F.lit(None).cast("double"))
    return F.struct(
        F.when(problem.isNull(), F.concat(none, F.when(n >= 2, F.transform(places, lambda i: -actual(i)["logprob"])).otherwise(F.array().cast("array<double>")))).alias("surprisal"),
        F.when(problem.isNull(), F.concat(none, F.when(n >= 2, F.transform(places, lambda i: F.greatest(gap(i), F.lit(0.0)))).otherwise(F.array().cast("array<double>")))).alias("gap"),
        problem.alias("problem"),
    )


def built(prompt: Column, completion: Column, segments: Column, stray: Column, gated: bool = True) -> Column:
    """struct(ids, prompt_len, problem) of a prompt's and a completion's ids: the text of a problem must hold no id that opens or closes thought or turns, and (gated) the segments must be well formed."""
    bounds = F.array(*(F.lit(x) for x in (OPEN, CLOSE, TURN, *EOS)))
    problem = F.when(F.arrays_overlap(stray, bounds), F.lit("boundary tokens"))
    problem = problem.when(segments["g"] != 1, F.concat(F.lit("gate: "), segments["reason"])) if gated else problem
    return F.struct(F.when(problem.isNull(), F.concat(prompt, completion)).alias("ids"), F.size(prompt).alias("prompt_len"), problem.alias("problem"))


def partition_problem(segments: Column, length: Column) -> Column:
    """Spans of thought and answer may not overlap, nor have more tokens than there are."""
    think, answer = segments["think_end"] - segments["think_start"], segments["answer_end"] - segments["answer_start"]
    return F.when((segments["answer_start"] >= 0) & (segments["answer_start"] < segments["think_end"]), "overlap").when(think + answer > length, "beyond the end")
