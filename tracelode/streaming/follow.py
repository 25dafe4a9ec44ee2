"""Append-only logs as streams: scoring what is new once, and request and response files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(spark: SparkSession, source: str, schema, score: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, keys: list[str], within: tuple[str, str] | None = None, once: bool = True):
    """Scores each key of a growing folder once and appends the scores.

    Rows that score() leaves null are errors: they go to a folder beside the target, and their keys aren't marked as
    done, as the state holds keys with whether they were scored. So a key that failed is scored when it comes again, and
    retried() scores what still waits. With ``within`` (a time column and how late a repeat may come) the state is bounded.
    """
    rows = score(spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(source)).withColumn("__done", F.col("score").isNotNull())
    held = [*keys, "__done"]
    rows = rows.withWatermark(*within).dropDuplicatesWithinWatermark(held) if within else rows.dropDuplicates(held)

    def sink(batch: DataFrame, number: int) -> None:
        both = batch.withColumn("batch", F.lit(number)).persist()
        both.filter("__done").drop("__done").write.mode("overwrite").parquet(f"{target}/batch={number}")
        both.filter("NOT __done").drop("__done", "score").write.mode("overwrite").parquet(f"{target}_errors/batch={number}")
        both.unpersist()

    writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="2 seconds").start()


def retried(spark: SparkSession, score: Callable[[DataFrame], DataFrame], target: str, keys: list[str]) -> DataFrame:
    """The scores of keys that failed and haven't been scored since, as score() finds them now; null where they still fail."""
    failed = spark.read.parquet(f"{target}_errors").dropDuplicates(keys)
    return score(failed.join(spark.read.parquet(target).select(*keys), keys, "left_anti"))


def progress(query) -> list[dict]:
    """Of each micro-batch of a query its number, its rows and the rows of its state."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "state": sum(s["numRowsTotal"] for s in p["stateOperators"])} for p in query.recentProgress]


def windowed_rates(spark: SparkSession, source: str, schema, target: str, checkpoint: str, width: str = "10 minutes", late: str = "1 hour"):
    """Counts and means of event-time windows, each written once it can't change."""
    rows = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    flat = out.select(F.col("window.start").alias("start"), "event_type", "n", "mean")
    return flat.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def annealed_budget(rows: DataFrame, start: float = 400.0, floor: float = 120.0, rate: float = 0.995, least_std: float = 40.0) -> DataFrame:
    """The budget of each run, as groups (run, step, n, std) come in: the state is one number for a run."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        budget, moves = state.get if state.exists else (start, 0)
        for frame in frames:
            for n, std in frame.sort_values("step")[["n", "std"]].itertuples(index=False):
                if n < 2 or std >= least_std:
                    budget, moves = max(floor, budget * rate), moves + 1
        state.update((budget, moves))
        yield pd.DataFrame({"run": [key[0]], "budget": [budget], "moves": [moves]})

    return rows.groupBy("run").applyInPandasWithState(step, "run string, budget double, moves long", "budget double, moves long", "update", GroupStateTimeout.NoTimeout)


def answered(requests: DataFrame, responses: DataFrame, done: DataFrame) -> DataFrame:
    """requests (step) with state: answered once the marker of their step is there, which is written last; writing while there are only rows; else waiting. And how many rows there are."""
    r = responses.groupBy("step").agg(F.count("*").alias("rows"))
    out = requests.join(r, "step", "left").join(done.select("step", F.lit(True).alias("__done")).distinct(), "step", "left")
    state = F.when(F.col("__done"), "answered").when(F.col("rows") > 0, "writing").otherwise("waiting")
    return out.withColumn("state", state).withColumn("rows", F.coalesce("rows", F.lit(0))).drop("__done")


def staleness(workers: DataFrame, heartbeats: DataFrame, now, limit: float) -> DataFrame:
    """worker, age (seconds since its last sign of life) and state, for workers that were started or not."""
    last = heartbeats.groupBy("worker").agg(F.max("ts").alias("__ts"))
    age = F.col("now").cast("double") - F.col("__ts").cast("double")
    out = workers.join(last, "worker", "left").withColumn("now", now).withColumn("age", F.round(age, 1))
    return out.select("worker", "age", F.when(F.col("age").isNull(), "never started").when(F.col("age") > limit, "stale").otherwise("alive").alias("state"))


def audit_due(n_problems: int, n_judged: int, every: int = 50, each: int = 10, most: int = 40) -> int:
    """How many judgments a round makes: ``each`` for ``every`` problems, less those that there are, ``most`` at a time."""
    return max(0, min(most, n_problems // every * each - n_judged))
