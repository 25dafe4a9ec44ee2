"""The test tables, and the views of them that stand for pools, rollouts, logs and token arrays."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession, name: str) -> str:
    """A new folder that all machines see, in spark.checkpoint.dir; only a session of one machine may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines see")
        found = "file://" + tempfile.mkdtemp(prefix="tracelode-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as tasks can run at once, if it has fewer, as a small table in one file has; a larger one stays where it lies."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts of a problem: an order's lines in a fixed order. One shuffle by problem, which later steps reuse."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.col("l_orderkey").alias("uid"),
        (F.row_number().over(order) - 1).alias("k"),
        F.substring("o_orderpriority", 1, 1).alias("level"),
        (F.col("o_orderstatus") == "F").alias("seen"),
        (F.col("l_returnflag") == "R").alias("strict"),
        (F.col("l_linestatus") == "F").cast("int").alias("g"),
        F.col("l_quantity").cast("int").alias("think_len"),
        (F.col("l_extendedprice") % 600).cast("int").alias("answer_len"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_partkey").alias("part"),
    )


#: The same view in SQL.
CANDIDATES_SQL = """
cand AS (
  SELECT l_orderkey AS uid,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS k,
         substr(o_orderpriority, 1, 1) AS level, o_orderstatus = 'F' AS seen, l_returnflag = 'R' AS strict,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS g, CAST(trunc(l_quantity) AS int) AS think_len,
         CAST(trunc(l_extendedprice % 600) AS int) AS answer_len, l_discount AS discount, l_tax AS tax, l_extendedprice AS price, l_partkey AS part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append log: events numbered within their users, so that no order over all rows is needed."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("step", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))


STEPS_SQL = "steps AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)"
