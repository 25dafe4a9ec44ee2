"""Rollouts by problem: pass rates, buckets, advantages, budgets and tests between arms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def buckets(c: DataFrame) -> DataFrame:
    """A row for each problem: how many of its rollouts are right, and the bucket that this puts it in."""
    g = c.groupBy("uid").agg(
        F.first("level").alias("level"),
        F.first("seen").alias("seen"),
        F.count_if("strict").alias("n_strict"),
        F.count("*").alias("n"),
        F.count_distinct("part").alias("n_distinct"),
        F.coalesce(F.percentile(F.when(F.col("g") == 1, F.col("think_len")), 0.5), F.lit(0.0)).alias("think_median"),
    )
    bucket = F.when(F.col("n_strict") == 0, "none").when(F.col("n_strict") == F.col("n"), "all").otherwise("mixed")
    return g.withColumn("bucket", bucket).withColumn("p_hat", F.round(F.col("n_strict") / F.col("n"), 6))


def bucket_cube(b: DataFrame) -> DataFrame:
    """Counts of all, by level, by seen and by both; cells without problems are there too."""
    agg = b.cube("level", "seen").agg(F.count("*").alias("n"), F.count_if(F.col("bucket") == "none").alias("n_none"), F.count_if(F.col("bucket") == "mixed").alias("n_mixed"), F.count_if(F.col("bucket") == "all").alias("n_all"))
    seen = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    agg = agg.select(seen("level").alias("level"), seen("seen").alias("seen"), "n", "n_none", "n_mixed", "n_all")
    levels = b.select("level").distinct().union(b.sparkSession.sql("SELECT '*'")).withColumn("seen", F.explode(F.array(F.lit("*"), F.lit("true"), F.lit("false"))))
    return levels.join(agg, ["level", "seen"], "left").na.fill(0)


def yields(c: DataFrame) -> DataFrame:
    """By level and of all: rates of rollouts, and of problems, each on its own grain."""
    rollouts = c.rollup("level").agg(F.count("*").alias("rollouts"), F.round(F.avg(F.col("strict").cast("int")), 6).alias("verify_rate"), F.round(F.avg("g"), 6).alias("gate_rate"))
    problems = c.groupBy("uid", "level").agg(F.bool_or("strict").alias("solved")).rollup("level").agg(F.count("*").alias("problems"), F.round(F.avg(F.col("solved").cast("int")), 6).alias("solve_rate"))
    key = F.coalesce("level", F.lit("ALL")).alias("level")
    return rollouts.select(key, "rollouts", "verify_rate", "gate_rate").join(problems.select(key, "problems", "solve_rate"), "level")


def pass_at_k(c: DataFrame, k: int | None = None) -> DataFrame:
    """pass@1 as the mean over draws with its sample deviation, and pass@k, over all draws, or the first k where that is asked for. Verdicts that are missing don't count; a draw without any has no rate."""
    first = c if k is None else c.filter(F.col("k") < k)
    draws = first.groupBy("k").agg(F.avg(F.col("strict").cast("int")).alias("p")).agg(F.round(F.avg("p"), 6).alias("pass_1"), F.round(F.stddev_samp("p"), 6).alias("std"), F.count("*").alias("draws"))
    problems = first.groupBy("uid").agg(F.bool_or("strict").alias("any"), F.max(F.when(F.col("k") == 0, F.col("strict"))).alias("at1")).agg(F.round(F.avg(F.col("any").cast("int")), 6).alias("pass_k"), F.round(F.avg(F.col("at1").cast("int")), 6).alias("at1"), F.count("*").alias("problems"))
    return draws.join(F.broadcast(problems))  # two single rows


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Wins and losses of b against a over paired draws, z, and a two-sided p by a series of the error function."""
    s = pairs.agg(F.count_if(F.col(b) & ~F.col(a)).alias("wins"), F.count_if(F.col(a) & ~F.col(b)).alias("losses"), F.count("*").alias("n"))
    z = F.when(F.col("wins") + F.col("losses") > 0, (F.col("wins") - F.col("losses")) / F.sqrt(F.col("wins") + F.col("losses"))).otherwise(0.0)
    return s.withColumn("z", F.round(z, 6)).withColumn("p", F.round(erfc(F.abs(z) / 2**0.5), 6))


def erfc(x: Column) -> Column:
    """1 - erf(x) for x >= 0, to 1.2e-7, by a rational approximation."""
    t = 1 / (1 + 0.5 * x)
    series = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    return t * F.exp(-x * x + reduce(lambda acc, c: acc * t + c, reversed(series[:-1]), F.lit(series[-1])))


def pareto(points: DataFrame, acc: str, cost: str) -> DataFrame:
    """Points that no point of the same or a higher accuracy undercuts."""
    before = W.orderBy(F.desc(acc), F.col(cost)).rowsBetween(W.unboundedPreceding, -1)
    return points.withColumn("__least", F.min(cost).over(before)).filter(F.col("__least").isNull() | (F.col(cost) < F.col("__least"))).drop("__least")


def sums_below(df: DataFrame, order: str, columns: list[str], blocks: int = 256) -> DataFrame:
    """df with, for each column, its sum over all rows that are lower in an order (``name_below``); equal rows aren't lower than each other if each value of the order is one row.

    The order is cut into blocks at approximate quantiles, which only decide how even the blocks are: a running sum within
    each, and one over the few blocks, so that no task sorts all rows.
    """
    cuts = sorted({x for x in df.agg(F.percentile_approx(order, [i / blocks for i in range(1, blocks)], 10_000)).first()[0] or []})
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    g = df.withColumn("__block", place)
    before, within = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("__block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    sums = g.groupBy("__block").agg(*(F.sum(c).alias(f"__{c}") for c in columns)).withColumns({f"__{c}_before": F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)) for c in columns}).drop(*(f"__{c}" for c in columns))
    g = g.withColumns({f"__{c}_within": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns}).join(F.broadcast(sums), "__block")  # a row for each block
    return g.withColumns({f"{c}_below": F.col(f"__{c}_within") + F.col(f"__{c}_before") for c in columns}).drop("__block", *(f"__{c}_{x}" for c in columns for x in ("within", "before")))


def advantages(c: DataFrame, reward: str, eps: float = 1e-6) -> DataFrame:
    """The reward less its group's mean, as it is and in units of the group's deviation."""
    w = W.partitionBy("uid")
    return c.withColumns({"centred": F.col(reward) - F.avg(reward).over(w), "advantage": (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + eps)})


def dynamic_sampling(c: DataFrame) -> DataFrame:
    """Which groups teach something: those with right and wrong rollouts."""
    g = c.groupBy("uid").agg(F.count_if("strict").alias("right"), F.count("*").alias("n"))
    return g.withColumn("reason", F.when(F.col("n") == 0, "empty").when(F.col("right") == 0, "all wrong").when(F.col("right") == F.col("n"), "all right").otherwise("kept"))


def tea_weights(c: DataFrame, x: str, y: str, cap: float = 100.0) -> DataFrame:
    """Softmax of the centred product of two measures over all rows, capped at cap / n; not normalised again. Two aggregates of one row are sent back."""
    means = c.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.count("*").alias("n"))
    p = c.join(F.broadcast(means)).withColumn("cov", (F.col(x) - F.col("mx")) * (F.col(y) - F.col("my")))
    top = p.agg(F.max("cov").alias("top"))
    p = p.join(F.broadcast(top)).withColumn("e", F.exp(F.col("cov") - F.col("top")))
    total = p.agg(F.sum("e").alias("total"))
    return p.join(F.broadcast(total)).withColumn("weight", F.least(F.col("e") / F.col("total"), F.lit(cap) / F.col("n")))


def whole_deviation(x: str) -> Column:
    """The population deviation of whole numbers, an aggregate. From whole sums, so that no order of the rows changes it: a deviation of just 10 is 10."""
    n, total, squares = F.count(x), F.sum(F.col(x).cast("long")), F.sum(F.col(x).cast("long") * F.col(x).cast("long"))
    big = lambda c: c.cast("decimal(19,0)")
    return F.sqrt((big(n) * big(squares) - big(total) * big(total)).cast("double") / F.nullif(big(n) * big(n), F.lit(0)).cast("double"))


def effective_budget(c: DataFrame, budget: float, floor: float = 120.0, share: float = 0.25) -> DataFrame:
    """The budget of each problem: not beyond its longest rollout, not under its own low percentile, 1 at least."""
    long = F.when(F.col("think_len") > 0, F.col("think_len"))
    g = c.groupBy("uid").agg(F.max(long).alias("most"), F.percentile(long, share).alias("low"))
    return g.select("uid", F.when(F.col("most").isNull(), F.lit(max(budget, floor))).otherwise(F.greatest(F.least(F.lit(budget), F.col("most")), F.col("low"), F.lit(1.0))).alias("budget"))


def anneal(groups: DataFrame, order: str, start: float, floor: float = 120.0, rate: float = 0.995, least_std: float = 40.0, block: int = 100_000) -> DataFrame:
    """The budget after each group in order (a whole number): a group of little spread leaves it, any other lowers it.

    As only the number of lowering groups before matters, a running count replaces the fold. It is counted within blocks of
    the order and over blocks, so that a run of any length is dealt to many tasks.
    """
    g = groups.withColumns({"__move": F.when((F.col("n") >= 2) & (F.col("std") < least_std), 0).otherwise(1), "__block": F.floor(F.col(order) / block)})
    before = W.partitionBy("run").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = g.groupBy("run", "__block").agg(F.sum("__move").alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    within = W.partitionBy("run", "__block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    moved = g.withColumn("__within", F.sum("__move").over(within)).join(blocks, ["run", "__block"]).withColumn("moves", F.col("__within") + F.col("__before"))
    return moved.withColumn("budget", F.greatest(F.lit(floor), F.lit(start) * F.pow(F.lit(rate), F.col("moves")))).drop("__move", "__block", "__within", "__before")


def length_multiplier(length: Column, budget: Column | float) -> Column:
    b = F.lit(budget) if isinstance(budget, float) else budget
    return F.when(b <= 0, 1.0).otherwise(F.exp(-F.greatest(F.lit(0.0), length - b) / b))


def band_multiplier(length: Column, target: float = 288.0, width: float = 32.0) -> Column:
    off = F.abs(length - target)
    return F.when(off <= width, 1.0).otherwise(F.exp(-(off - width) / target))


# What counts as confident and as chaotic, and the bounds of health.
CONFIDENT_CHARS, CONFIDENT_HEDGES, CHAOTIC_CHARS, CHAOTIC_HEDGES = 4000, 1, 8000, 3
COLLAPSED, FEW_ANSWERS = 0.60, 0.15


def mean_jaccard(sets: DataFrame, group: str, member: str, grams: str) -> DataFrame:
    """group, jaccard: the mean similarity of all pairs of a group's sets; null with fewer than two sets that aren't empty.

    Only pairs that share a gram are ever made, by a join on group and gram; all others add nothing to the sum and are
    counted by a formula. Groups are the few rollouts of a problem.
    """
    s = sets.filter(F.size(grams) > 0).select(group, F.col(member).alias("m"), F.size(grams).alias("n"), F.transform(grams, lambda g: F.xxhash64(g)).alias("grams"))
    flat = s.select(group, "m", "n", F.explode("grams").alias("gram"))
    other = flat.select(group, F.col("m").alias("m2"), F.col("n").alias("n2"), "gram")
    pairs = flat.join(other, [group, "gram"]).filter("m < m2").groupBy(group, "m", "m2").agg(F.count("*").alias("both"), F.first("n").alias("n"), F.first("n2").alias("n2"))
    total = pairs.groupBy(group).agg(F.sum(F.col("both") / (F.col("n") + F.col("n2") - F.col("both"))).alias("total"))
    count = s.groupBy(group).agg(F.count("*").alias("k")).filter("k >= 2")
    return count.join(total, group, "left").select(group, (F.coalesce("total", F.lit(0.0)) / (F.col("k") * (F.col("k") - 1) / 2)).alias("jaccard"))


def diagnostics(c: DataFrame, grams: str = "grams", late_grams: str | None = None, most_chars: int | None = None) -> DataFrame:
    """Measures of each group of rollouts; null where there is nothing to measure.

    c: gid, member, tier, accuracy, fmt (the reward but for accuracy), total, closed, chars, final (the last line of the
    answer, or empty), restarts, hedges, contradicted, by_prose, and the thought's grams; late_grams: those after the set-up.
    """
    tier, hit = F.col("tier"), ~F.col("closed") & (F.col("chars") >= most_chars) if most_chars is not None else ~F.col("closed")
    when = lambda test, x: F.when(test, x)
    strict, lenient, wrong, final = tier == "strict", tier == "lenient", tier == "wrong", F.when(F.col("final") != "", F.col("final"))
    g = c.groupBy("gid").agg(
        F.count("*").alias("n_rollouts"),
        F.count_if(strict).alias("n_strict"),
        F.count_if(lenient).alias("n_lenient"),
        F.count_if(wrong).alias("n_wrong"),
        # Rewards are decimal fractions: to twelve digits, what adding them as doubles leaves is gone, so that a half is a half.
        F.round(F.avg(when(strict, F.col("total"))) - F.avg(when(lenient, F.col("total"))), 12).alias("strict_vs_lenient_gap"),
        F.avg(when(strict, (F.round("fmt", 9) >= 0.10).cast("int"))).alias("strict_winners_fmt"),
        F.max(when(wrong, F.col("fmt"))).alias("max_wrong_fmt"),
        F.percentile("chars", 0.5).alias("median_chars"),
        F.percentile("chars", 0.95).alias("p95_chars"),
        F.avg(hit.cast("int")).alias("cap_hit_rate"),
        (F.count_distinct("accuracy") == 1).cast("double").alias("zero_advantage"),
        (F.count_distinct(final) / F.count(final)).alias("unique_final"),
        F.min("restarts").alias("min_restarts"),
        F.max("restarts").alias("max_restarts"),
        F.count_if((F.col("chars") <= CONFIDENT_CHARS) & (F.col("hedges") <= CONFIDENT_HEDGES) & wrong).alias("confident_wrong"),
        F.count_if((F.col("chars") >= CHAOTIC_CHARS) & (F.col("hedges") >= CHAOTIC_HEDGES) & ~wrong).alias("chaotic_correct"),
        (F.count_if("contradicted") / F.nullif(F.count_if(~wrong), F.lit(0))).alias("contradiction_rate"),
        F.avg(when(strict, F.col("by_prose").cast("int"))).alias("prose_strict_rate"),
    )
    g = g.join(mean_jaccard(c, "gid", "member", grams), "gid", "left")
    late = mean_jaccard(c, "gid", "member", late_grams).withColumnRenamed("jaccard", "late_jaccard") if late_grams else None
    g = g.join(late, "gid", "left") if late_grams else g.withColumn("late_jaccard", F.lit(None).cast("double"))
    alike = F.coalesce("late_jaccard", "jaccard")
    return g.withColumn("collapsed", F.coalesce((F.round(alike, 9) >= COLLAPSED) & (F.col("unique_final") <= FEW_ANSWERS), F.lit(False)))


def health(d: DataFrame) -> DataFrame:
    """A label for each of nine measures: ok, warn or fail, and n/a without data."""
    none = lambda c: F.when(F.col(c).isNull(), "n/a")
    gap = F.round("strict_vs_lenient_gap", 9)
    return d.withColumns({
        "h_gap": none("strict_vs_lenient_gap").when((gap < 0.45) | (gap > 0.75), "fail").when(gap < 0.55, "warn").otherwise("ok"),
        "h_winners": none("strict_winners_fmt").when(F.col("strict_winners_fmt") < 0.90, "warn").otherwise("ok"),
        "h_wrong_fmt": none("max_wrong_fmt").when(F.round("max_wrong_fmt", 9) <= 0.30, "ok").otherwise("fail"),
        "h_cap": none("cap_hit_rate").when(F.col("cap_hit_rate") < 0.10, "ok").otherwise("warn"),
        "h_collapse": F.when(F.col("collapsed"), "fail").otherwise("ok"),
        "h_zero": none("zero_advantage").when(F.col("zero_advantage") < 0.20, "ok").otherwise("warn"),
        "h_restarts": none("min_restarts").when(F.col("min_restarts") > 0, "ok").otherwise("warn"),
        "h_confident": F.when(F.col("confident_wrong") == 0, "ok").otherwise("warn"),
        "h_contradiction": none("contradiction_rate").when(F.col("contradiction_rate") < 0.10, "ok").otherwise("warn"),
    })


def endpoint(arms: DataFrame, start: DataFrame) -> DataFrame:
    """run and verdict for arms (run, step, acc, cost) against their start (run, acc0, std0, cost0): PASS if any step is more accurate at no more cost; else the last step decides: FAIL if it costs more or is less accurate by over a deviation, else EXTEND."""
    a = arms.join(start, "run").withColumn("beats", (F.col("acc") > F.col("acc0")) & (F.col("cost") <= F.col("cost0")))
    a = a.withColumn("worse", (F.round(F.col("acc") - F.col("acc0"), 12) < -F.round("std0", 12)) | (F.col("cost") > F.col("cost0")))
    ends = a.groupBy("run").agg(F.bool_or("beats").alias("any"), F.max_by("worse", "step").alias("worse"), F.max("step").alias("step"))
    return ends.select("run", "step", F.when(F.col("any"), "PASS").when(F.col("worse"), "FAIL").otherwise("EXTEND").alias("verdict"))


def shared_draws(c: DataFrame) -> DataFrame:
    """The draws k (from 0) that every problem has: as many as the problem with the fewest."""
    fewest = c.groupBy("uid").agg(F.count("*").alias("n")).agg(F.min("n").alias("__fewest"))
    return c.join(F.broadcast(fewest)).filter("k < __fewest").drop("__fewest")  # a single row
