"""What the corpus operators share: the shared folder, materialised tables, text rules."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII white space that separates words: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id where ids are compared: larger than any other.
NO_ID = 2**63 - 1


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir, or, in a session of one machine (as in tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines see: intermediate tables go there")
        found = "file://" + tempfile.mkdtemp(prefix="tracelode-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again: lineage ends here, and its size is known."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tracelode_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what materialise() wrote, once nothing reads it any more."""
    remove(df.sparkSession, df.tracelode_path)
    tidy(df.sparkSession)


def tidy(spark: SparkSession) -> None:
    """Lets go of the shuffle files of tables that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shared_files(path: str):
    """The file system of a path in the shared folder, for Python, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as tasks can run at once, if it has fewer, as a small table in one file has; a larger one stays where it lies."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def plain(pattern: str) -> re.Pattern:
    return re.compile(pattern)


#: Caches of a worker process that outlive a task, and the operator that filled them last.
kept_caches: list[dict] = []
_holder = [""]


def claim(operator: str) -> None:
    """Called by a task: a worker, which serves one operator after another, lets go of what others keep."""
    if _holder[0] != operator:
        for cache in kept_caches:
            cache.clear()
        _holder[0] = operator
        gc.collect()
