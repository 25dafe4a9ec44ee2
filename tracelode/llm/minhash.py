"""Near-duplicate documents by MinHash with tensored banding; candidates are verified on whole sets.

Two collections of ``m`` half-keys of ``t`` minhashes each are made from a document's shingles. A table's key is a pair of
half-keys, one of each collection, so ``m * m`` tables with keys of ``2 * t`` minhashes cost ``2 * m * t`` minhashes, not
``2 * t * m * m``. Two documents of similarity s share a table's key with probability (1 - (1 - s**t)**m)**2: with the
values here 0.99993 at 0.8, and 0.99999 at 0.85.

Documents with equal sets are one node from the start. In each bucket the node with the least number is the lead, and
every other one is compared with it, on the sets of the whole texts; what holds are the links, and components come from
them. Nodes of buckets that still hold several components may have links that join them. These nodes go through an
exact filter: any two of them, of different components, whose sets can be similar enough are compared too. So no pair
of a bucket is left out that matters, and all pairs of a bucket are never written.

No bucket is ever gathered: leads are minima, members find them by a join that splits hot keys. Nothing is broadcast.

Defined results: A-Z are lower-cased, words are parted by ASCII white space. A set holds the distinct runs of ``n`` words;
a text of fewer words is one run; one without words (or null) has the empty set and is linked with nothing. Rows that
repeat, also under other ids, are in one component, but for texts without words. A null doc_id counts as the largest. Columns
of the input stay; ``NEW`` replaces columns of these names. Nothing in, nothing out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, claim, discard, materialise

WORDS = 16  # of 64 bits each, for the classes of a set's shingles
#: Sets of a frequent shingle that one task compares with the others, and comparisons for each task.
DEALT, WORK = 2000, 2_000_000
NEW = ["n_shingles", "component_id", "kept", "group"]


class Words(dict):
    """64-bit hashes of words, as signed numbers."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word) - 2**63
        if len(self) > 200_000:
            self.clear()
        self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int, words: Words) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of n words."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(words.__getitem__, parts)), np.int64).view(np.uint64)
    size = min(n, len(h))
    runs = mix(h[: len(h) - size + 1] + np.uint64(size))
    for k in range(1, size):
        runs = mix(runs + h[k : len(h) - size + 1 + k])
    return np.unique(runs)


def multipliers(m: int, t: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    made = mix(np.arange(1, 4 * m * t + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return made[: 2 * m * t] | np.uint64(1), made[2 * m * t :]


def half_keys(shingles: np.ndarray, m: int, t: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """2 * m half-keys, each of t minhashes."""
    least = np.full(len(a), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 2000):
        least = np.minimum(least, (shingles[at : at + 2000, None] * a + b).min(0))
    parts = least.reshape(2 * m, t)
    key = mix(parts[:, 0])
    for k in range(1, t):
        key = mix(key + parts[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, n: int, m: int, t: int, seed: int = 0) -> DataFrame:
    """doc, own (the text's hash), n_shingles, digest (of the set; null if it is empty), halves."""

    def run(batches):
        claim("minhash")
        a, b = multipliers(m, t, seed)
        words = Words()
        for batch in batches:
            sizes, digests, halves = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), n, words)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                halves.append(half_keys(s, m, t, a, b) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(halves, pa.list_(pa.int64()))], names=["doc", "own", "n_shingles", "digest", "halves"])

    return keyed(docs).mapInArrow(run, "doc long, own long, n_shingles long, digest binary, halves array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("own"), F.col("text").cast("string").alias("text"))


def buckets(nodes: DataFrame, m: int) -> DataFrame:
    """key, node for each table: the tensor product of a node's two collections of half-keys."""
    first = nodes.select("node", F.posexplode(F.slice("halves", 1, m)).alias("i", "g"), F.slice("halves", m + 1, m).alias("others"))
    both = first.select("node", "i", "g", F.posexplode("others").alias("j", "h"))
    return both.select(F.xxhash64("i", "j", "g", "h").alias("key"), "node")


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffles only. A broadcast goes through the driver, and the planner's estimates are far too low for what comes from arrays: a node's hundred keys count as one."""
    return left.join(right.hint("merge"), on, how)


def texts_of(nodes: DataFrame, ids: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text for the nodes that are candidates: the only time that whole texts are shuffled."""
    wanted = met(nodes, ids, "node").select("node", "doc", "own")
    return materialise(met(keyed(docs), wanted, ["doc", "own"]).select("node", "text").dropDuplicates(["node"]), "texts")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) with 100 * intersection >= percent * union, by the sets of the whole texts."""
    half = met(pairs, texts.select(F.col("node").alias("b"), F.col("text").alias("second")), "b")
    both = met(half, texts.select(F.col("node").alias("a"), F.col("text").alias("first")), "a").select("a", "b", "first", "second")

    def run(batches):
        claim("minhash")
        words, last, held = Words(), None, None
        for batch in batches:
            good = []
            for i, (a, x, y) in enumerate(zip(batch.column(0), batch.column(2), batch.column(3), strict=True)):
                if a != last:
                    last, held = a, shingle_set(x.as_py(), n, words)
                other = shingle_set(y.as_py(), n, words)
                shared = len(np.intersect1d(held, other, assume_unique=True))
                if 100 * shared >= percent * (len(held) + len(other) - shared):
                    good.append(i)
            at = pa.array(good, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return materialise(both.mapInArrow(run, "a long, b long"), "links")


def shingles(texts: DataFrame, n: int) -> DataFrame:
    """node, root, size, token: a row for each shingle of texts (node, text, root)."""

    def run(batches):
        claim("minhash")
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingle_set(t.as_py(), n, words) for t in part.column(1)]
                back = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), pa.int32())
                sizes = pa.array([len(x) for x in sets], pa.int64()).take(back)
                tokens = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(back), part.column(2).take(back), sizes, pa.array(tokens)], names=["node", "root", "size", "token"])

    return texts.select("node", "text", "root").mapInArrow(run, "node long, root long, size long, token long")


def across(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of texts (node, text, root) of different components that can be similar enough: all that are, and few others.

    Shingles are put in an order, rare ones first. Of two sets that are similar enough, the first shingles of each, a
    share of 1 - percent / 100 of it and one more, have one in common. Shingles that only one set has can't be it. At the
    first one in common, no set shares what it has before, which bounds the intersection. So do the sets' classes: each of
    1,024 classes of shingles that one set has a shingle of and the other has not is at least one that isn't shared. Of the sets with a shingle in common, those of its most frequent component need no
    comparison with each other: only the others are joined with all of them.
    """
    tokens = materialise(shingles(texts, n), "shingles")
    common = materialise(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "common")
    bits = [F.coalesce(F.expr(f"bit_or(if((token & {WORDS - 1}) = {k}, shiftleft(1L, cast(shiftright(token, 8) & 63 as int)), 0L))"), F.lit(0)).alias(f"b{k}") for k in range(WORDS)]
    held = [f"b{k}" for k in range(WORDS)]
    rows = met(tokens, common, "token").groupBy("node", "root", "size").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"), *bits)
    # size - ceil(percent * size / 100) + 1 shingles come first, those that no other set has at the front of them.
    first = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - (F.col("size") - F.size("own"))
    rows = rows.withColumn("first", first.cast("int")).filter("first > 0")
    rows = rows.select("node", "root", "size", F.array(*held).alias("bits"), F.size("own").cast("long").alias("known"), F.posexplode(F.slice("own", 1, F.col("first"))).alias("at", "x"))
    # From this shingle on: what the set can share if this is the first that it shares.
    rows = rows.select("node", "root", "size", "bits", "known", (F.col("known") - F.col("at")).alias("most"), "x.token")
    rows = materialise(rows, "first")
    main = rows.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots")).filter("roots > 1")
    main = materialise(main.select("token", F.col("m.root").alias("main")), "main")
    # Sets that are similar enough differ in size by a factor of 100 / percent at most: by one class of sizes.
    size_class = F.floor(F.log("size") / F.log(F.lit(100 / percent) * (1 + 1e-9))).cast("int")
    rows = materialise(met(rows, main, "token").withColumn("cls", size_class), "first")
    # A frequent token's sets of a class are dealt to several tasks, and those they are compared with go to each of them.
    classes = materialise(rows.groupBy("token", "cls").agg(F.count("*").alias("n")).withColumn("deals", F.ceil(F.col("n") / DEALT)), "classes")
    l = met(rows.filter("root != main").withColumn("cls", F.explode(F.sequence(F.col("cls") - 1, F.col("cls") + 1))), classes, ["token", "cls"])
    work = l.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, -(-int(work) // WORK)))
    l = l.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).repartition(tasks, "token", "cls", "deal").alias("l")
    r = met(rows, classes, ["token", "cls"]).withColumn("deal", F.pmod(F.xxhash64("node"), F.col("deals"))).repartition(tasks, "token", "cls", "deal").alias("r")
    # Over arrays, so that the join's loop stays small enough to be compiled; it is reached by few pairs.
    apart = lambda a, b: F.aggregate(F.zip_with(f"{a}.bits", f"{b}.bits", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda x, y: x + y)
    enough = lambda most: 100 * most >= percent * (F.col("l.size") + F.col("r.size") - most)
    # The cheap tests come first: most pairs fail them.
    fits = (F.col("l.root") != F.col("r.root")) & ((F.col("r.root") == F.col("r.main")) | (F.col("l.node") < F.col("r.node"))) & enough(F.least("l.most", "r.most")) & enough(F.col("l.known") - apart("l", "r")) & enough(F.col("r.known") - apart("r", "l"))
    pairs = met(l, r, (F.col("l.token") == F.col("r.token")) & (F.col("l.cls") == F.col("r.cls")) & (F.col("l.deal") == F.col("r.deal")) & fits).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
    out = materialise(pairs, "pairs")
    for t in (tokens, common, main, rows, classes):
        discard(t)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node that it is connected with) for the nodes of the links: large and small stars in turn."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = met(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = materialise(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = met(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        small = materialise(small, "edges")
        same = edges.count() == small.count() and met(edges, small, ["u", "v"], "left_anti").isEmpty()
        discard(edges)
        discard(large)
        edges = small
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return met(rows, roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def linked(docs: DataFrame, nodes: DataFrame, n: int, m: int, percent: int) -> DataFrame:
    """node, root for the nodes that have links."""
    table = buckets(nodes, m)
    shared = materialise(table.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("n")).filter("n > 1"), "shared")
    # Two nodes are a pair at once; more are found again by their key.
    many = shared.filter("n > 2").select("key", "lead")
    active = materialise(met(table, many, "key").filter("node != lead"), "active")
    pairs = materialise(shared.filter("n = 2").select(F.col("lead").alias("a"), F.col("last").alias("b")).union(active.select("lead", "node")).distinct(), "pairs")
    discard(shared)
    texts = texts_of(nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), docs)
    links = verified(pairs, texts, n, percent)
    discard(pairs)
    roots = components(links)
    # The lead was compared with all others; what else a bucket of several components holds may still be linked.
    rows = _rooted(active.select("key", "node"), roots)
    open_ = materialise(rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key"), "open")
    left = _rooted(met(rows.select("key", "node"), open_, "key").select("node").distinct(), roots)
    more = verified(across(met(texts, left, "node"), n, percent), texts, n, percent)
    discard(active)
    return components(links.union(more))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, m: int = 10, t: int = 2, seed: int = 0) -> DataFrame:
    """A row (doc, own, n_shingles, component, group) for each row of docs: own is the hash of the text."""
    source = docs.select("doc_id", "text")
    marks = materialise(signatures(source, n, m, t, seed), "signatures")
    # Equal sets are one node, of the least document; its number is a fixed one, as the table is written.
    nodes = marks.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(F.struct("doc", "own")).alias("least"), F.min("halves").alias("halves"))
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "least.doc", "least.own", "halves"), "nodes")
    roots = linked(source, nodes.select("node", "doc", "own", "halves"), n, m, percent)
    named = _rooted(nodes.select("node", "digest", "doc"), roots)
    first = materialise(named.groupBy("root").agg(F.min("doc").alias("component")), "components")
    named = materialise(met(named, first, "root").select("digest", "root", "component"), "named")
    out = met(marks.select("doc", "own", "n_shingles", "digest"), named, "digest", "left")
    return out.select("doc", "own", "n_shingles", F.coalesce("component", "doc").alias("component"), F.col("root").alias("group"))


def _id(c: str) -> Column:
    return F.when(F.col(c) == NO_ID, None).otherwise(F.col(c))


def with_components(found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, for the rows of near_duplicates()."""
    return found.select(_id("doc").alias("doc_id"), "n_shingles", _id("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs, of which one row of each component stays, that of the smallest doc_id; all rows without words stay."""
    found = near_duplicates(docs, **options).filter("doc = component").select(F.col("doc").alias("__mh_doc"), F.col("own").alias("__mh_own"), F.col("group").alias("__mh_group")).distinct()
    # Of rows with the same id and set, the text that hashes lowest stays.
    found = found.groupBy("__mh_doc", F.coalesce(F.col("__mh_group"), F.col("__mh_own")).alias("__mh_group"), F.col("__mh_group").isNull().alias("__mh_none")).agg(F.min("__mh_own").alias("__mh_own"))
    own = docs.withColumns({"__mh_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__mh_own": F.xxhash64("text")})
    out = own.join(found, ["__mh_doc", "__mh_own"])
    words = out.filter("not __mh_none").dropDuplicates(["__mh_doc", "__mh_own"])
    return words.unionByName(out.filter("__mh_none")).select(*docs.columns)
