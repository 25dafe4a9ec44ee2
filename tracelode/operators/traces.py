"""Rollouts and drafts: flags, corrupted twins, and joins with scores, sources and gold answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelode.functions import grade as G
from tracelode.functions import reward as R
from tracelode.functions import shaping as H
from tracelode.functions import text as T

#: A numbered step: what is before the number, the number, and the rest.
STEP = r"^(\s*)(\d+)\.(\s*)(.*)$"
FLAGS = ("empty_think", "missing_think_close", "missing_think_open", "cap_hit", "ngram_loop", "case_enum_20", "chk_chain_15", "register_leak", "answer_repeat", "contradiction", "word_stutter", "lenient_only", "strict_correct")


def scanned(df: DataFrame) -> DataFrame:
    """df (text, gold, g, gate_reason, finish, think_len) with FLAGS."""
    df = G.graded(df).withColumns({"__think": G.thought(F.col("text")), "__tail": G.tail(F.col("text"))})
    think, tail, ok, cap = F.col("__think"), F.col("__tail"), F.col("g") == 1, F.col("finish") == "length"
    flags = {
        "empty_think": ok & (F.col("think_len") < R.LEAST_THOUGHT),
        "missing_think_close": (F.col("gate_reason") == "missing_think_close") & ~cap,
        "missing_think_open": F.col("gate_reason") == "missing_think_open",
        "cap_hit": cap,
        "ngram_loop": R.loop(think),
        "case_enum_20": F.regexp_count(think, F.lit(r"(?m)^case \d+:")) >= 20,
        "chk_chain_15": F.regexp_count(think, F.lit(r"(?m)^chk:")) >= 15,
        "register_leak": ok & R.leaks(tail),
        "answer_repeat": ok & (R.repeats(tail, R.ANSWER_REPEAT) > 0),
        "contradiction": ok & R.contradicts(think, tail),
        "word_stutter": T.word_stutter(F.col("text")) / F.greatest(F.lit(1), F.size(T.words(F.coalesce("text", F.lit(""))))) > 0.01,
        "lenient_only": ok & F.col("as_scored") & ~F.col("strict"),
        "strict_correct": ok & F.col("strict"),
    }
    return df.withColumns(flags).drop("__think", "__tail")


def without_a_step(body: Column, pick: Column) -> Column:
    """struct(text, removed): a numbered step that is neither the first nor the last goes, the others are numbered again; null with fewer than three."""
    def out(rows: Column) -> Column:
        steps = F.filter(F.transform(rows, lambda x, i: F.when(x.rlike(STEP), i)), lambda i: i.isNotNull())

        def cut(steps: Column) -> Column:
            gone = F.when(F.size(steps) >= 3, F.get(steps, (pick % F.greatest(F.size(steps) - 2, F.lit(1)) + 1).cast("int")))

            def renumbered(x: Column, i: Column) -> Column:
                number = F.size(F.filter(steps, lambda j: (j <= i) & (j != gone))).cast("string")
                return F.when(i == gone, None).when(x.rlike(STEP), F.concat(F.regexp_extract(x, STEP, 1), number, F.lit("."), F.regexp_extract(x, STEP, 3), F.regexp_extract(x, STEP, 4))).otherwise(x)

            return F.struct(F.when(gone.isNotNull(), F.array_join(F.array_compact(F.transform(rows, renumbered)), "\n")).alias("text"), T.strip(F.get(rows, gone)).alias("removed"))

        return H.let(steps, cut)

    return H.let(F.split(body, "\n", -1), out)


def asserted(df: DataFrame, facts: DataFrame, test: Column, message: Column) -> DataFrame:
    """df, if a test of facts (a single row) holds; else the job fails. The test is a filter, which the planner can't leave out as it could a column."""
    return df.join(F.broadcast(facts.filter(F.assert_true(test, message).isNull()).select(F.lit(1).alias("__held")))).filter("__held = 1").drop("__held")


PROMPTS, GOLDS, YEARS, NAMES = ("problem", "Problem", "Question", "question", "prompt"), ("answer", "Answer", "ground_truth", "gold", "expected_answer"), ("Year", "year"), ("ID", "id")


def eval_pool(sources: list[DataFrame], expected: dict[str, int | None] | None = None) -> DataFrame:
    """Sources (suite and some of the known columns) as one pool: prompt, ground_truth, verifier, year, family.

    The gold answer is the first field that has one, else the first box of a solution. Code is taken as it is, with its
    test as the answer, and graded elsewhere. Rows without a prompt or an answer go. A source that is pinned to a number
    of rows fails the job if it has another.
    """
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    first = lambda names: F.coalesce(*(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in names if c in df.columns), F.lit(None).cast("string"))
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    code = has("test").isNotNull()
    box = F.when(has("solution").rlike(G.BOXED), T.strip(F.regexp_extract(has("solution"), G.BOXED, 1)))
    df = df.withColumns({
        "prompt": F.when(code, has("prompt")).otherwise(T.norm_text(first(PROMPTS))),
        "ground_truth": F.when(code, has("test")).otherwise(T.strip(F.coalesce(first(GOLDS), box))),
        "verifier": F.when(code, "code").otherwise("own"),
        "year": H.year(*(F.col(c) for c in YEARS if c in df.columns), name=first(NAMES)),
        "family": H.family(has("topic"), F.col("suite")),
    }).filter((F.col("prompt") != "") & F.col("ground_truth").isNotNull())
    for suite, rows in (expected or {}).items():
        if rows is not None:
            df = asserted(df, df.filter(F.col("suite") == suite).agg(F.count("*").alias("n")), F.col("n") == rows, F.lit(f"{suite}: not the {rows} rows it is pinned to"))
    return df


def scored(drafts: DataFrame, scores: DataFrame) -> DataFrame:
    """drafts (uid, k, round, reject) with the last score (by line) of their key, and reason: the draft's own, else that it has no score, else why there is none; null for a draft that can be chosen."""
    keys = ["uid", "k", "round"]
    last = scores.groupBy(*keys).agg(F.max_by(F.struct("skip", "score"), "line").alias("s"))
    out = drafts.join(last, keys, "left")
    reason = F.coalesce("reject", F.when(F.col("s").isNull(), "unscored").when(F.col("s.skip").isNotNull(), F.concat(F.lit("score_"), F.col("s.skip"))))
    return out.withColumns({"reason": reason, "score": F.col("s.score")}).drop("s")


def highest_round(drafts: DataFrame) -> DataFrame:
    """Drafts of earlier rounds give way to those of the last, problem by problem."""
    top = drafts.groupBy("uid").agg(F.max("round").alias("__top"))
    return drafts.join(top, "uid").filter("round = __top").drop("__top")


def unserved(problems: DataFrame, drafts: DataFrame) -> DataFrame:
    """uid and reasons (array of reason, n) of problems whose drafts were all refused; problems without drafts aren't listed."""
    left = problems.select("uid").join(drafts.filter("reason IS NULL").select("uid"), "uid", "left_anti")
    counts = drafts.join(left, "uid").groupBy("uid", "reason").agg(F.count("*").alias("n"))
    return counts.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("reason", "n"))).alias("reasons"))  # a row for each reason there is


def flagged(df: DataFrame, seen: DataFrame, name: str) -> DataFrame:
    """df with whether its uid is among those of seen, however often."""
    return df.join(seen.select("uid").distinct().withColumn(name, F.lit(True)), "uid", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def present(asked: DataFrame, pool: DataFrame) -> DataFrame:
    """asked, all of which must be in the pool; else the job fails and says how many aren't."""
    missing = asked.select("uid").join(pool.select("uid"), "uid", "left_anti").agg(F.count("*").alias("n"))
    return asserted(asked, missing, F.col("n") == 0, F.concat(F.col("n").cast("string"), F.lit(" aren't in the pool")))


def one_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; a minimum, not a sort of the key's rows."""
    return df.groupBy(key).agg(F.min_by(F.struct(*(c for c in df.columns if c != key)), order).alias("x")).select(key, "x.*")


def rounds(df: DataFrame, cell: str, key: Column, each: int) -> DataFrame:
    """df with the round in which each row's turn comes: ``each`` of every cell a round, by a digest of the key."""
    place = F.row_number().over(W.partitionBy(cell).orderBy(F.md5(key.cast("string")), key))
    return df.withColumn("round", F.floor((place - 1) / each).cast("int") + 1)
