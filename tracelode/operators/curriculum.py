"""A curriculum of problems by pass rate: bands, what still teaches, and the tilt of the draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The bands from easy to hard, their first tilt, and when it shifts.
BANDS = ("high", "mid", "low")
TILT = {"high": 0.75, "mid": 0.15, "low": 0.10}
SHIFT_BELOW = 1 / 3


def band(p: Column) -> Column:
    return F.when(p >= 5 / 8, "high").when(p >= 3 / 8, "mid").when(p >= 1e-9, "low").otherwise("zero")


def observed(problems: DataFrame, results: DataFrame) -> DataFrame:
    """problems (uid, p_hat) with band and retired after results (uid, right, n): what was measured last counts, and a problem that is always solved retires until it isn't."""
    r = results.select("uid", (F.col("right") / F.greatest(F.lit(1), F.col("n"))).alias("live"), (F.col("right") == F.col("n")).alias("done"))
    out = problems.join(r, "uid", "left")
    return out.withColumns({"band": band(F.coalesce("live", "p_hat")), "retired": F.coalesce("done", F.lit(False))}).drop("done")


def live_share(problems: DataFrame) -> DataFrame:
    """band, n, live, share: of each band, a row even where it is empty, how many problems haven't retired."""
    bands = problems.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, BANDS))).alias("band"))
    g = problems.groupBy("band").agg(F.count("*").alias("n"), F.count_if(~F.col("retired")).alias("live"))
    out = bands.join(g, "band", "left").na.fill(0)
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("live"), F.col("n")), F.lit(0.0)))


def retilted(shares: DataFrame, shifts: int = 0) -> DataFrame:
    """band, tilt, shifts after one look: where too little of the first band still teaches, three quarters of the draw move one band down and the rest to those below."""
    top = shares.filter(F.col("band") == BANDS[0]).agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("top"))
    moves = F.lit(shifts) + ((F.col("top") < SHIFT_BELOW) & F.lit(shifts < len(BANDS) - 1)).cast("int")
    place = F.array_position(F.array(*map(F.lit, BANDS)), F.col("band")) - 1
    first = F.element_at(F.create_map(*(F.lit(x) for kv in TILT.items() for x in kv)), F.col("band"))
    below = F.lit(len(BANDS) - 1) - F.col("shifts")
    moved = F.when(place < F.col("shifts"), 0.0).when(place == F.col("shifts"), F.when(below == 0, 1.0).otherwise(0.75)).otherwise(0.25 / below)
    out = shares.join(F.broadcast(top)).withColumn("shifts", moves)  # a single row
    return out.select("band", F.when(F.col("shifts") == 0, first).otherwise(moved).alias("tilt"), "shifts")


def draw(problems: DataFrame, tilt: DataFrame, n: int, seed: str) -> DataFrame:
    """n problems that haven't retired, each once, by the tilt; a band that runs dry leaves its places to the others.

    In each band problems come in the order of a digest. The p-th of a band with tilt t has the place p / t among all, so
    a top-n over all takes from the bands by their tilt, as long as they last. The generator differs from a random
    number's by design: the draw doesn't depend on how rows are dealt.
    """
    live = problems.filter(~F.col("retired")).join(F.broadcast(tilt.filter("tilt > 0").select("band", "tilt")), "band")  # three rows
    key = F.md5(F.concat(F.lit(seed), F.col("uid").cast("string")))
    parts = live.withColumn("__h", key).withColumn("__salt", F.substring("__h", 1, 2))
    # Of each salt of a band only the first n can be drawn.
    few = parts.withColumn("__p", F.row_number().over(W.partitionBy("band", "__salt").orderBy("__h", "uid"))).filter(F.col("__p") <= n)
    place = F.row_number().over(W.partitionBy("band").orderBy("__h", "uid"))
    return few.withColumn("place", place / F.col("tilt")).orderBy("place", "band").limit(n).select("uid", "band")
