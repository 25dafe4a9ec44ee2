"""Pools: near-duplicate joins, deduplication, sampling and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelode.functions import text as T


#: An index of so many grams at most, each two numbers and a hash, is broadcast; a larger one is joined by gram.
INDEX_ROWS = 2_000_000


def gram_pairs(left: DataFrame, right: DataFrame, threshold: float, small: bool = False) -> DataFrame:
    """a, b, both, na, nb: pairs of left (a, grams) and right (b, grams) whose Jaccard similarity is over the threshold.

    An inverted index: both sides are exploded and joined by the grams' 64-bit hashes, so pairs that share none never
    meet. With ``small`` the right side is broadcast, and only what it finds is shuffled.
    """
    hashed = lambda c: F.explode(F.transform(c, lambda g: F.xxhash64(g))).alias("gram")
    l = left.select("a", F.size("grams").alias("na"), hashed("grams"))
    r = right.select("b", F.size("grams").alias("nb"), hashed("grams"))
    shared = l.join(F.broadcast(r) if small else r, "gram").groupBy("a", "b").agg(F.count("*").alias("both"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return shared.filter(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")) > threshold)


def contamination(train: DataFrame, evals: DataFrame, threshold: float = 0.8, n: int = 8, first_chars: int | None = 400) -> DataFrame:
    """doc_id, kind, item_id, score of train (doc_id, text) rows that equal an item of evals (item_id, text) or are near it.

    An equal item goes before near ones, the first before others; of near ones the nearest counts, then the first. Equal
    texts have equal grams, so only pairs with these are compared as a whole; a text without words is its own gram.
    """
    grams = lambda c: F.element_at(F.transform(F.array(T.word_grams(c, n, first_chars)), lambda g: F.when(F.size(g) > 0, g).otherwise(F.array(F.concat(F.lit("= "), T.match_key(c))))), 1)
    e = evals.select(F.col("item_id").alias("b"), grams(F.col("text")).alias("grams"))
    small = (e.agg(F.sum(F.size("grams"))).first()[0] or 0) <= INDEX_ROWS
    pairs = gram_pairs(train.select(F.col("doc_id").alias("a"), grams(F.col("text")).alias("grams")), e, threshold, small).persist()
    alike = pairs.filter("both = na AND both = nb").select("a", "b")
    few = F.broadcast if pairs.count() <= INDEX_ROWS else (lambda df: df)
    keys = train.join(few(alike), F.col("doc_id") == F.col("a")).select("a", "b", F.md5(T.match_key(F.col("text"))).alias("x"))
    same = evals.select(F.col("item_id").alias("b"), F.md5(T.match_key(F.col("text"))).alias("y"))
    exact = keys.join(same, "b").filter("x = y").groupBy("a").agg(F.min("b").alias("b"))
    exact = exact.select("a", "b", F.lit(1.0).alias("score"), F.lit("exact").alias("kind"))
    # A gram that stands for a text without words is no near copy.
    words = e.filter(~F.get("grams", F.lit(0)).startswith("= ")).select("b")
    score = F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 4)
    near = pairs.join(words, "b", "left_semi").join(exact.select("a"), "a", "left_anti").select("a", "b", score.alias("score"))
    best = near.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), "b")).alias("m")).select("a", F.col("m.b").alias("b"), (-F.col("m.s")).alias("score"), F.lit("near").alias("kind"))
    return exact.unionByName(best).select(F.col("a").alias("doc_id"), "kind", F.col("b").alias("item_id"), "score")


def near_pairs(docs: DataFrame, threshold: float = 0.8, n: int = 8, first_chars: int | None = None) -> DataFrame:
    """doc_a, doc_b, score: documents over the threshold, by whole texts unless first_chars is given.

    Documents with equal grams are a class, and its first stands for it: a row for it and each other member (score 1),
    and one for each two classes that are near. So copies multiply neither the work of the index nor the rows.

    Of a set only its rarest grams are looked up, a share of 1 - threshold of it and one more: two sets that are near
    have one of these in common. So what very many documents hold isn't joined with itself, unless a set has little else.
    """
    t = docs.select(F.col("doc_id").alias("a"), F.sort_array(F.transform(T.word_grams(F.col("text"), n, first_chars), lambda g: F.xxhash64(g))).alias("grams")).filter(F.size("grams") > 0)
    classes = t.groupBy(F.xxhash64("grams").alias("h"), F.size("grams").alias("size")).agg(F.min("a").alias("head"), F.min_by("grams", "a").alias("grams"))
    same = t.join(classes.select("h", "size", "head"), (F.xxhash64("grams") == F.col("h")) & (F.size(t["grams"]) == F.col("size"))).filter("a <> head").select(F.col("head").alias("doc_a"), F.col("a").alias("doc_b"), F.lit(1.0).alias("score"))
    flat = classes.select("head", "size", F.explode("grams").alias("g"))
    counts = flat.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    # What only one set has can't be shared; it stands at the front of the order.
    known = flat.join(counts, "g").groupBy("head", "size").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("own"))
    rare = F.col("size") - F.ceil(F.col("size") * threshold) + 1 - (F.col("size") - F.size("own"))
    index = known.withColumn("rare", rare.cast("int")).filter("rare > 0").select("head", "size", F.explode(F.slice("own", 1, F.col("rare"))).alias("x")).select("head", "size", "x.g")
    l, r = index.alias("l"), index.alias("r")
    meet = l.join(r, (F.col("l.g") == F.col("r.g")) & (F.col("l.head") < F.col("r.head")) & (F.least("l.size", "r.size") > threshold * F.greatest("l.size", "r.size"))).select(F.col("l.head").alias("doc_a"), F.col("r.head").alias("doc_b")).distinct()
    sets = classes.select("head", "grams")
    both = meet.join(sets.select(F.col("head").alias("doc_a"), F.col("grams").alias("x")), "doc_a").join(sets.select(F.col("head").alias("doc_b"), F.col("grams").alias("y")), "doc_b")
    shared = F.size(F.array_intersect("x", "y"))
    scored = both.select("doc_a", "doc_b", (shared / (F.size("x") + F.size("y") - shared)).alias("score")).filter(F.col("score") > threshold)
    return scored.select("doc_a", "doc_b", F.round("score", 4).alias("score")).unionByName(same)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in an order: a fixed choice, unlike dropDuplicates(), and a minimum, so that a large key isn't sorted."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min_by(F.struct(*rest), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))
    return df.groupBy(*keys).agg(least.alias("__x")).select(*keys, "__x.*")


def stratified_sample(df: DataFrame, stratum: str, key: Column, n: int, seed: str = "0") -> DataFrame:
    """n rows with each stratum's share: floor quotas, and what is left over in rounds, the largest remainder of rows first.

    Rows of a stratum are taken in the order of a digest of seed and key.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    q = sizes.join(F.broadcast(total)).withColumn("quota", F.floor(F.lit(n) * F.col("size") / F.col("total")))
    q = q.withColumn("rest", F.col("size") - F.col("quota"))
    # The rounds go over strata by what remains; with floor quotas, one round is enough unless strata are used up.
    left = q.agg((F.least(F.lit(n), F.max("total")) - F.sum("quota")).alias("left"))
    rank = F.row_number().over(W.orderBy(F.desc("rest"), F.col(stratum)))
    take = q.filter("rest > 0").withColumn("rank", rank).join(F.broadcast(left)).filter("rank <= left").select(stratum, F.lit(1).alias("more"))
    quota = q.join(take, stratum, "left").select(stratum, F.when(F.col("total") <= n, F.col("size")).otherwise(F.col("quota") + F.coalesce("more", F.lit(0))).alias("quota"))
    df = df.join(F.broadcast(quota), stratum).withColumns({"__h": F.md5(F.concat(F.lit(seed), key.cast("string"))), "__k": key})
    return top_by(df, [stratum], ["__h", "__k"], F.col("quota")).drop("quota", "__h", "__k")


def top_by(df: DataFrame, keys: list[str], order: list[str], most: Column, deals: int = 64) -> DataFrame:
    """The first ``most`` rows of each key in an order. A key's rows are dealt by all that orders them, and only the first of each deal are sorted together: a few large keys don't end in a few tasks."""
    dealt = df.withColumn("__deal", F.pmod(F.xxhash64(*order), F.lit(deals)))
    few = dealt.withColumn("__n", F.row_number().over(W.partitionBy(*keys, "__deal").orderBy(*order))).filter(F.col("__n") <= most)
    return few.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= most).drop("__n", "__deal")


def apportion(sizes: DataFrame, key: str, n: int) -> DataFrame:
    """key, seats: n seats by the largest remainders; ties go by key."""
    total = sizes.agg(F.sum("size").alias("total"))
    s = sizes.join(F.broadcast(total)).withColumn("exact", F.lit(n) * F.col("size") / F.col("total")).withColumn("base", F.floor("exact"))
    left = s.agg((F.lit(n) - F.sum("base")).alias("left"))
    s = s.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), F.col(key)))).join(F.broadcast(left))
    return s.select(key, (F.col("base") + (F.col("rank") <= F.col("left")).cast("int")).cast("long").alias("seats"))


def round_robin(df: DataFrame, cell: str, order: list[Column], n: int) -> DataFrame:
    """n rows, one of each cell in turn; of a cell no more than its first n can be among them."""
    names = {f"__o{i}": c for i, c in enumerate(order)}
    few = top_by(df.withColumns(names), [cell], list(names), F.lit(n))
    return few.withColumn("turn", F.row_number().over(W.partitionBy(cell).orderBy(*names))).orderBy("turn", cell).limit(n).drop(*names)


def split_by_hash(key: Column, seed: str) -> Column:
    """A number in 0 to 9,999 that decides the split of a key, whatever else is in the pool."""
    return T.hex_mod(F.md5(F.concat(F.lit(seed), key.cast("string"))), 10_000)


def reasons(df: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    """df with reason: the first test that holds, or null."""
    out = F.lit(None).cast("string")
    for name, test in reversed(tests):
        out = F.when(test, F.lit(name)).otherwise(out)
    return df.withColumn("reason", out)


def unseen(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do."""
    return work.join(done.select(*keys), keys, "left_anti")


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of the highest version of each key; a maximum and a join, so that a large key isn't sorted."""
    top = df.groupBy(key).agg(F.max(version).alias("__top"))
    return df.join(top, key).filter(F.col(version) == F.col("__top")).drop("__top")
