"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows get a fixed number each and are dealt into blocks. The matrix of how many rows each block sends to each shard is
drawn exactly, as a uniform shuffle would make it: the table of all blocks is halved again and again, and each half's
counts are a multivariate hypergeometric draw from what its parent sends. Each block is permuted and cut at its row of
the matrix; after the exchange each shard is permuted again, which numbers its rows.

All is DataFrame and SQL functions. Rows are never gathered: a block and a stretch of a shard have about ``block_rows``
rows (more only beyond ``2**max_levels`` blocks, which bounds the matrix), and the draws of a level run side by side.

Defined results: every row, repeated or with nulls, gets one place. A null text has the size 16 and the CRC-32 of the
empty text. Shards differ by one row at most (the first shards have one more). Equal rows are told apart by their
number; the places depend on the seed and on the order of the input's rows, which is fixed by a written table.
An empty table gives an empty one. ``shard`` and ``slot`` replace columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def hypergeometric(u: str, total: str, marked: str, drawn: str) -> str:
    """SQL for the number of marked among ``drawn`` of ``total``, of which ``marked`` are: the inverse of the distribution function at u in [0, 1).

    Weights follow from their ratios, from the mode to 12 standard deviations each side; what lies beyond is under 1e-30.
    """
    ratio = "(cast(h.m - k as double) * (h.n - k)) / (cast(k + 1 as double) * (h.t - h.m - h.n + k + 1))"
    back = "(cast(k as double) * (h.t - h.m - h.n + k)) / (cast(h.m - k + 1 as double) * (h.n - k + 1))"
    steps = "named_struct('p', cast(1 as double), 'sum', cast(0 as double))"
    up = f"aggregate(if(h.hi > h.mode, sequence(h.mode, h.hi - 1), cast(array() as array<bigint>)), {steps}, (a, k) -> named_struct('p', a.p * {ratio}, 'sum', a.sum + a.p * {ratio}))"
    down = f"aggregate(if(h.lo < h.mode, sequence(h.mode, h.lo + 1), cast(array() as array<bigint>)), {steps}, (a, k) -> named_struct('p', a.p * {back}, 'sum', a.sum + a.p * {back}))"
    scan = "aggregate(if(h.hi > h.lo, sequence(h.lo, h.hi - 1), cast(array() as array<bigint>)), named_struct('p', d.low, 'sum', d.low, 'at', h.lo), (a, k) -> if(a.sum > d.goal, a, named_struct('p', a.p * {0}, 'sum', a.sum + a.p * {0}, 'at', k + 1)), a -> a.at)".format(ratio)
    pick = _let("d", _let("s", f"named_struct('up', {up}, 'down', {down})", f"named_struct('low', s.down.p, 'goal', ({u}) * (1 + s.up.sum + s.down.sum))"), scan)
    ends = "named_struct('t', g.t, 'm', g.m, 'n', g.n, 'mode', g.mode, 'lo', greatest(g.least, g.mode - g.width), 'hi', least(g.most, g.mode + g.width))"
    shape = (
        "named_struct('t', f.t, 'm', f.m, 'n', f.n, 'least', greatest(0L, f.n - (f.t - f.m)), 'most', least(f.n, f.m), "
        "'mode', greatest(greatest(0L, f.n - (f.t - f.m)), least(least(f.n, f.m), cast(floor((f.n + 1.0D) * (f.m + 1.0D) / (f.t + 2.0D)) as bigint))), "
        "'width', cast(ceil(12 * sqrt(greatest(0.0D, cast(f.n as double) * f.m / greatest(f.t, 1L) * (1 - cast(f.m as double) / greatest(f.t, 1L)) * (f.t - f.n) / greatest(f.t - 1, 1L)))) as bigint) + 12)"
    )
    return _let("f", f"named_struct('t', {total}, 'm', {marked}, 'n', {drawn})", _let("g", shape, _let("h", ends, pick)))


def split_counts(seed: int) -> str:
    """SQL for what the left half of a node sends to each shard; the node has ``sends`` and the rows ``n_left`` of that half."""
    u = f"cast(shiftrightunsigned(xxhash64({seed}L, level, node, i), 11) as double) / 9007199254740992D"
    draw = hypergeometric(u, "acc.t", "sends[i]", "acc.n")
    step = _let("x", draw, "named_struct('t', acc.t - sends[i], 'n', acc.n - x, 'out', concat(acc.out, array(x)))")
    zero = "named_struct('t', aggregate(sends, 0L, (a, v) -> a + v), 'n', n_left, 'out', cast(array() as array<bigint>))"
    return f"aggregate(sequence(0, size(sends) - 1), {zero}, (acc, i) -> {step}, acc -> acc.out)"


def communication_matrix(spark: SparkSession, counts: DataFrame, levels: int, n_shards: int, seed: int = 0) -> DataFrame:
    """block, sends (array of n_shards): an exact draw, for counts (block, n) of 2**levels blocks."""
    held = spark.range(2**levels).withColumnRenamed("id", "block").join(counts, "block", "left")
    held = held.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", F.coalesce("n", F.lit(0)).cast("long").alias("n")))), lambda x: x["n"]).alias("held"))
    total = "aggregate(held, 0L, (a, v) -> a + v)"
    nodes = held.selectExpr("0L as node", "held", f"transform(sequence(0, {n_shards - 1}), s -> cast({total} div {n_shards} as bigint) + if(s < {total} % {n_shards}, 1L, 0L)) as sends")
    for level in range(levels):
        half = 2 ** (levels - level - 1)
        nodes = nodes.selectExpr("node", f"{level} as level", f"slice(held, 1, {half}) as l", f"slice(held, {half + 1}, {half}) as r", "sends")
        nodes = nodes.withColumn("n_left", F.expr("aggregate(l, 0L, (a, v) -> a + v)")).withColumn("left", F.expr(split_counts(seed)))
        both = "array(named_struct('node', 2 * node, 'held', l, 'sends', left), named_struct('node', 2 * node + 1, 'held', r, 'sends', zip_with(sends, left, (a, b) -> a - b)))"
        nodes = nodes.select(F.explode(F.expr(both)).alias("x")).select("x.node", "x.held", "x.sends")
        if level == 5 and levels > 6:
            nodes = nodes.repartition(64, "node")
    return nodes.select(F.col("node").alias("block"), "sends")


def uniform_shards(df: DataFrame, n_shards: int = 40, seed: int = 0, block_rows: int = 1024, max_levels: int = 20) -> DataFrame:
    """df with shard (0 to n_shards - 1) and slot (from 0, without gaps, in a shard). Blocks hold about block_rows rows up to 2**max_levels blocks; beyond that many rows they grow, and their sorts spill."""
    spark = df.sparkSession
    if n_shards < 1:
        raise ValueError("n_shards must be 1 at least")
    named = df.drop("shard", "slot").withColumn("__sh_row", F.monotonically_increasing_id())
    named = materialise(named, "rows")
    n = named.count()
    levels = min(max_levels, max(0, math.ceil(math.log2(max(1, n / block_rows)))))
    block = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("block"), "__sh_row"), 64 - levels) if levels else F.lit(0).cast("long")
    rows = named.withColumns({"__sh_block": block, "__sh_rank": F.xxhash64(F.lit(seed), F.lit("local"), "__sh_row")})
    counts = rows.groupBy("__sh_block").agg(F.count("*").alias("n")).withColumnRenamed("__sh_block", "block")
    matrix = materialise(communication_matrix(spark, counts, levels, n_shards, seed), "matrix")
    ends = matrix.select(F.col("block").alias("__sh_block"), F.expr("aggregate(sends, named_struct('sum', 0L, 'out', cast(array() as array<bigint>)), (a, x) -> named_struct('sum', a.sum + x, 'out', concat(a.out, array(a.sum + x))), a -> a.out)").alias("__sh_ends"))
    place = F.row_number().over(W.partitionBy("__sh_block").orderBy("__sh_rank", "__sh_row"))
    sent = rows.withColumn("__sh_place", place).join(ends, "__sh_block")
    sent = sent.withColumn("shard", F.size(F.filter("__sh_ends", lambda e: e < F.col("__sh_place"))).cast("int"))
    sent = materialise(sent.drop("__sh_block", "__sh_rank", "__sh_place", "__sh_ends"), "sent")
    bits = min(max_levels, max(0, math.ceil(math.log2(max(1, n / n_shards / block_rows)))))
    final = F.xxhash64(F.lit(seed), F.lit("final"), "__sh_row")
    sent = sent.withColumns({"__sh_rank": final, "__sh_part": F.shiftrightunsigned(F.shiftleft(F.lit(1).cast("long"), 63).bitwiseXOR(final), 64 - bits) if bits else F.lit(0).cast("long")})
    # Stretches of a shard in the order of the last permutation, so that no task has to number a whole shard.
    before = sent.groupBy("shard", "__sh_part").agg(F.count("*").alias("n"))
    before = before.withColumn("__sh_before", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("__sh_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    at = F.row_number().over(W.partitionBy("shard", "__sh_part").orderBy("__sh_rank", "__sh_row")) - 1
    out = sent.withColumn("__sh_at", at).join(before, ["shard", "__sh_part"]).withColumn("slot", (F.col("__sh_at") + F.col("__sh_before")).cast("long"))
    return out.drop("__sh_part", "__sh_rank", "__sh_row", "__sh_at", "__sh_before")
