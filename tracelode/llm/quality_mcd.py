"""Quality rules: base counts, and robust multivariate outliers for each language and source.

Statistics of a text are transformed to a vector of five. For each language and source, the minimum-covariance-determinant
estimate is found by concentration steps over all its rows: the rows nearest to the centre (a share ``alpha``) give the
next mean and covariance, to which a fixed ridge is added (the regularised form of the estimate). There are two starts,
medians with quartile ranges, and means with the covariance of all rows; after ``warm`` steps of both, each group goes on
with the one of the smaller determinant until no group's determinant falls by more than ``tolerance``, for ``steps`` steps
at most. Rows whose squared Mahalanobis distance is beyond the chi-squared quantile are rejected. The same estimate is made of each language and of all rows. A language's centre and
covariance are shrunk towards those of all rows, and a group's towards its language's as shrunk: the wider estimate
counts as ``prior_rows`` rows, ten for each dimension. Groups of under ``min_rows`` rows, four for each dimension, of which
a few odd rows may be a quarter by chance, take the wider estimate as it is. So every row that passes the base rule has a
distance, whatever the size of its group.

All is DataFrame and SQL functions. Rows are narrow after the text is counted, and only sums and counts by fixed bins of
groups are shuffled, so a group may have any share of the rows. Estimates are a table, joined by group. The nearest rows
are those of the bins (1.1 % of a distance wide) up to the one in which the share ``alpha`` is reached: a choice that
doesn't depend on how rows are dealt over tasks.

Defined results: words are parted by ASCII white space. A null or empty text has no words and fails the base rule. Null
languages and sources are groups of their own. Rows that repeat are judged each, and count each. No rows: no rows.
Columns of the input stay, but for those named like the results (``COUNTS``, ``base_failed``, ``distance``, ``kept``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, discard, materialise, whole

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOLS = "#*$%&|<>"
#: What is added to the deviation of each statistic, so that one that hardly varies rejects nothing by itself.
FLOORS = [0.25, 0.05, 0.04, 0.10, 0.10]
DIM = len(FLOORS)


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def repeated_words(windows: str, size: int) -> str:
    """SQL for the number of words in windows (hashes, by place) that are found twice or more; in n log n of a text."""
    placed = f"sort_array(transform({windows}, (h, i) -> named_struct('h', h, 'i', i)))"
    again = "filter(s, (x, i) -> (i > 0 and s[greatest(i - 1, 0)].h = x.h) or (i < size(s) - 1 and s[least(i + 1, size(s) - 1)].h = x.h))"
    places = _let("s", placed, f"sort_array(transform({again}, x -> x.i))")
    covered = f"aggregate({places}, named_struct('n', 0L, 'end', 0), (a, p) -> named_struct('n', a.n + p + {size} - greatest(p, a.end), 'end', p + {size}), a -> a.n)"
    return f"if(size(array_distinct({windows})) = size({windows}), 0L, {covered})"


def with_counts(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """docs with COUNTS instead of the text."""
    kept = [c for c in docs.columns if c not in (text, *COUNTS)]
    t = whole(F.col(text))
    bare = F.btrim(t, F.lit(BLANKS))
    base = docs.select(
        *kept,
        F.when(F.length(bare) > 0, F.split(bare, r"[ \t-\r]+", -1)).otherwise(F.array().cast("array<string>")).alias("__q_words"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0).alias("__q_lines"),
    )
    base = base.select(*kept, "word_chars", "n_symbols", F.size("__q_words").cast("long").alias("n_words"), F.size("__q_lines").cast("long").alias("n_lines"), (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long").alias("n_dup_lines"), F.transform("__q_words", lambda w: F.xxhash64(w)).alias("__q_hash"))
    joined = ", ".join(f"__q_hash[i + {k}]" for k in range(window))
    base = base.withColumn("__q_win", F.expr(f"if(size(__q_hash) >= {window}, transform(sequence(0, size(__q_hash) - {window}), i -> xxhash64({joined})), cast(array() as array<bigint>))"))
    return base.withColumn("n_repeat_words", F.expr(repeated_words("__q_win", window))).select(*kept, *COUNTS)


def statistics() -> list[Column]:
    """The transformed statistics, of a text that has words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.log1p(F.col("word_chars") / n),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def chi2_cdf(x: float, k: int) -> float:
    """The series of the incomplete gamma function."""
    term = total = 1 / (k / 2)
    i = 0
    while term > 1e-17 * total:
        i += 1
        term *= x / 2 / (k / 2 + i)
        total += term
    return total * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2)) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return low


def _xs() -> list[str]:
    return [f"__x{i}" for i in range(DIM)]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIM) for j in range(i + 1)]


def with_distance2(rows: DataFrame) -> DataFrame:
    """The squared Mahalanobis distance by the group's centre __m and the Cholesky factor __l of its covariance: a substitution, each term of which is worked out once."""
    for i in range(DIM):
        rest = F.col(f"__x{i}") - F.col(f"__m{i}")
        for j in range(i):
            rest = rest - F.col(f"__l{i}{j}") * F.col(f"__y{j}")
        rows = rows.withColumn(f"__y{i}", rest / F.col(f"__l{i}{i}"))
    total = F.col("__y0") * F.col("__y0")
    for i in range(1, DIM):
        total = total + F.col(f"__y{i}") * F.col(f"__y{i}")
    return rows.withColumn("__d2", total).drop(*(f"__y{i}" for i in range(DIM)))


def factored(groups: DataFrame) -> DataFrame:
    """Groups with their covariance __c to the same with its Cholesky factor __l."""
    for j in range(DIM):
        inner = F.col(f"__c{j}{j}")
        for k in range(j):
            inner = inner - F.col(f"__l{j}{k}") * F.col(f"__l{j}{k}")
        groups = groups.withColumn(f"__l{j}{j}", F.sqrt(F.greatest(inner, F.lit(FLOORS[j] ** 2 / 4))))
        for i in range(j + 1, DIM):
            inner = F.col(f"__c{i}{j}")
            for k in range(j):
                inner = inner - F.col(f"__l{i}{k}") * F.col(f"__l{j}{k}")
            groups = groups.withColumn(f"__l{i}{j}", inner / F.col(f"__l{j}{j}"))
    return groups


#: Bins of a statistic for each unit, and of a squared distance for each doubling.
BINS, BINS2 = 1000, 64


def _reached(counts: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys and __b0, __b1, ...: the bins (column __bin, counts __n) in which the shares of a group's rows are reached."""
    upto = F.sum("__n").over(W.partitionBy(*keys).orderBy("__bin"))
    placed = counts.withColumns({"__upto": upto, "__all": F.sum("__n").over(W.partitionBy(*keys))})
    return placed.groupBy(*keys).agg(*(F.min(F.when(F.col("__upto") >= F.greatest(F.floor(p * F.col("__all")), F.lit(1)), F.col("__bin"))).alias(f"__b{k}") for k, p in enumerate(shares)))


def _start(rows: DataFrame) -> DataFrame:
    """Two starts __s of each group __g: medians and quartile ranges, and means and covariance."""
    binned = rows.select("__g", F.posexplode(F.array(*(F.floor(F.col(x) * BINS) for x in _xs()))).alias("__i", "__bin"))
    found = _reached(binned.groupBy("__g", "__i", "__bin").agg(F.count("*").alias("__n")), ["__g", "__i"], [0.25, 0.5, 0.75])
    at = lambda i, c: F.max(F.when(F.col("__i") == i, c))
    middle = found.groupBy("__g").agg(*(at(i, (F.col("__b1") + 0.5) / BINS).alias(f"__m{i}") for i in range(DIM)), *(at(i, (F.col("__b2") - F.col("__b0")) / BINS / 1.349).alias(f"__s{i}") for i in range(DIM)))
    robust = middle.select("__g", F.lit(0).alias("__s"), *(f"__m{i}" for i in range(DIM)), *(F.lit(0.0).alias(f"__c{i}{j}") if i != j else F.pow(F.col(f"__s{i}") + FLOORS[i], 2).alias(f"__c{i}{i}") for i, j in _pairs()))
    plain = _moments(rows.withColumns({"__s": F.lit(1)} | {f"__m{i}": F.lit(0.0) for i in range(DIM)}))
    return materialise(with_determinant(factored(robust.unionByName(plain))), "start")


#: A table of groups of so many rows at most, each some 40 numbers, is broadcast; a larger one is joined by key.
SMALL_ROWS = 50_000


def _small(groups: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows of a hot group then stay where they are, for the sums that follow. rows: how many groups there are at most, if that is known."""
    return F.broadcast(groups) if (groups.count() if rows is None else rows) <= SMALL_ROWS else groups


def _moments(near: DataFrame) -> DataFrame:
    """Mean and covariance, with the ridge, of rows (__g, __s, __x, and __m to sum around, where sums lose no digits)."""
    off = [F.col(x) - F.col(f"__m{i}") for i, x in enumerate(_xs())]
    sums = near.groupBy("__g", "__s").agg(*(F.first(f"__m{i}").alias(f"__o{i}") for i in range(DIM)), *(F.avg(off[i]).alias(f"__a{i}") for i in range(DIM)), *(F.avg(off[i] * off[j]).alias(f"__p{i}{j}") for i, j in _pairs()))
    return sums.select("__g", "__s", *((F.col(f"__o{i}") + F.col(f"__a{i}")).alias(f"__m{i}") for i in range(DIM)), *((F.col(f"__p{i}{j}") - F.col(f"__a{i}") * F.col(f"__a{j}") + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"__c{i}{j}") for i, j in _pairs()))


def with_determinant(groups: DataFrame) -> DataFrame:
    """Groups with the logarithm __det of the determinant of their covariance."""
    return groups.withColumn("__det", sum((2 * F.log(f"__l{i}{i}") for i in range(1, DIM)), 2 * F.log("__l00")))


def _step(rows: DataFrame, groups: DataFrame, alpha: float, n_groups: int) -> DataFrame:
    """A concentration step: mean and covariance of the share alpha of a group's rows that is nearest to its centre."""
    near = with_distance2(rows.join(_small(groups.drop("__det", *(f"__c{i}{j}" for i, j in _pairs())), n_groups), "__g")).withColumn("__bin", F.floor(F.log2(F.greatest(F.col("__d2"), F.lit(1e-12))) * BINS2))
    limit = materialise(_reached(near.groupBy("__g", "__s", "__bin").agg(F.count("*").alias("__n")), ["__g", "__s"], [alpha]), "limits")
    # Not null-rejecting: else the planner would test the distance for null below the join, in a copy that repeats each term over and over.
    near = near.join(_small(limit, n_groups), ["__g", "__s"]).filter(F.coalesce(F.col("__bin") <= F.col("__b0"), F.lit(False)))
    out = materialise(with_determinant(factored(_moments(near))), "step")
    discard(limit)
    return out


def estimates(rows: DataFrame, alpha: float, warm: int, steps: int, tolerance: float) -> DataFrame:
    """__g with centre __m, covariance __c, its Cholesky factor __l and its log-determinant __det, for rows (__g, __x)."""
    groups = _start(rows)
    n_groups = groups.count()
    for k in range(steps):
        before, groups = groups, _step(rows, groups, alpha, n_groups)
        if k + 1 == warm:  # each group goes on with its better start
            every, least = groups, groups.groupBy("__g").agg(F.min(F.struct("__det", "__s")).alias("x")).select("__g", F.col("x.__s").alias("__s"))
            groups = materialise(every.join(least, ["__g", "__s"]), "chosen")
            discard(every)
        elif k >= warm:  # one number
            fell = before.select("__g", "__s", F.col("__det").alias("__old")).join(groups, ["__g", "__s"]).agg(F.max(F.col("__old") - F.col("__det"))).first()[0]
            if fell is None or fell <= tolerance:
                discard(before)
                break
        discard(before)
    return groups


def _levels(language: Column, source: Column) -> list[Column]:
    """The names of a row's groups: language and source, language, all."""
    return [F.concat(F.lit("s"), F.length(language).cast("string"), F.lit(":"), language, F.lit(":"), source), F.concat(F.lit("l:"), language), F.lit("a")]


def _shrunk(base: DataFrame, groups: DataFrame, min_rows: int, prior_rows: int) -> DataFrame:
    """__lang and __source with their centre __m and Cholesky factor __l, each level shrunk towards the next wider one."""
    values = [f"__m{i}" for i in range(DIM)] + [f"__c{i}{j}" for i, j in _pairs()]
    own, language, _ = _levels(F.col("__lang"), F.col("__source"))
    n = base.groupBy("__lang", "__source").agg(F.count("*").alias("__n0"))
    n = n.withColumn("__n1", F.sum("__n0").over(W.partitionBy("__lang"))).withColumns({"__g0": own, "__g1": language})
    level = lambda k: groups.select(F.col("__g").alias(f"__g{k}"), *(F.col(c).alias(f"{c}_{k}") for c in values))
    n = n.join(level(0), "__g0").join(level(1), "__g1").join(F.broadcast(level(2).filter("__g2 = 'a'")))  # a single row
    n = n.withColumns({c: F.when(F.col(c) >= min_rows, F.col(c)).otherwise(0) for c in ("__n0", "__n1")})
    for k in (1, 0):
        n = n.withColumns({f"{c}_{k}": (F.col(f"__n{k}") * F.col(f"{c}_{k}") + prior_rows * F.col(f"{c}_{k + 1}")) / (F.col(f"__n{k}") + prior_rows) for c in values})
    return materialise(factored(n.select("__lang", "__source", *(F.col(f"{c}_0").alias(c) for c in values))).drop(*values[DIM:]), "estimates")


def judge(docs: DataFrame, alpha: float = 0.75, tail: float = 1e-5, min_rows: int = 4 * DIM, prior_rows: int = 10 * DIM, warm: int = 2, steps: int = 20, tolerance: float = 1e-3, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """docs without the text, with COUNTS, base_failed, distance (squared, null where the base rule fails) and kept."""
    given = docs.drop("base_failed", "distance", "kept")
    for c in ("lang", "source"):
        if c not in given.columns:
            given = given.withColumn(c, F.lit(None).cast("string"))
    names = [c for c in docs.columns if c not in ("text", *COUNTS, "base_failed", "distance", "kept")]
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    own = with_counts(given).withColumn("base_failed", failed)
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    own = own.withColumns({"__lang": tag("lang"), "__source": tag("source")} | dict(zip(_xs(), statistics(), strict=True)))
    # The narrow table goes to a few files of a fitting size, not to one for each piece of text that was read.
    own = materialise(own.hint("rebalance"), "statistics")
    base = own.filter("not base_failed").select("__lang", "__source", *_xs())
    rows = base.select(F.explode(F.array(*_levels(F.col("__lang"), F.col("__source")))).alias("__g"), *_xs())
    groups = estimates(rows, alpha, warm, steps, tolerance)
    # The covariance of the nearest share is smaller than that of all, by a known factor.
    factor = alpha / chi2_cdf(chi2_quantile(alpha, DIM), DIM + 2)
    limit = chi2_quantile(1 - tail, DIM)
    found = with_distance2(own.join(_small(_shrunk(base, groups, min_rows, prior_rows)), ["__lang", "__source"], "left"))
    found = found.withColumn("distance", F.when(~F.col("base_failed"), F.col("__d2") / factor))
    found = found.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= limit))
    return found.select(*names, *COUNTS, "base_failed", "distance", "kept")
