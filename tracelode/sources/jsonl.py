"""JSON lines in and out, with side files for what a run counts, and versioned tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A broken line fails the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Broken lines, as a run that was cut off leaves them, are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_suites(spark: SparkSession, glob: str, schema: str, without: list[str] | None = None) -> DataFrame:
    """All files of a folder, each a suite that has the file's name."""
    df = spark.read.schema(schema).json(glob).withColumn("suite", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl?$", 1))
    return df.filter(~F.col("suite").isin(without)) if without else df


def write(df: DataFrame, path: str, keep: tuple[str, ...] = ("_uid",), frozen: bool = False) -> None:
    """Columns that begin with _ are private and stay behind, but for ``keep``; a frozen target is never overwritten."""
    private = [c for c in df.columns if c.startswith("_") and c not in keep]
    df.drop(*private).write.mode("errorifexists" if frozen else "overwrite").json(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """A side file of what was counted, in the same file system; written under another name, then renamed."""
    fs, at = _fs(spark, f"{path}.meta.json")
    _, temporary = _fs(spark, f"{path}.meta.json.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(meta, ensure_ascii=False, sort_keys=True).encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(temporary, at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file by its name."""
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}.meta.json", wholetext=True).collect()))


def publish(df: DataFrame, root: str, version: int) -> None:
    """A version of a table in a folder of its own; the pointer moves once it is complete."""
    df.write.mode("overwrite").parquet(f"{root}/v{version}")
    write_meta(df.sparkSession, f"{root}/CURRENT", {"version": version})


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v{read_meta(spark, f'{root}/CURRENT')['version']}")


def prune(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Removes all but the last versions; the current one stays in any case."""
    fs, at = _fs(spark, root)
    found = sorted(int(f.getPath().getName()[1:]) for f in fs.listStatus(at) if f.isDirectory() and f.getPath().getName()[1:].isdigit())
    gone = [v for v in found[:-keep] if v != read_meta(spark, f"{root}/CURRENT")["version"]]
    for v in gone:
        fs.delete(_fs(spark, f"{root}/v{v}")[1], True)
    return gone


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last writer wins: a maximum for each key, its rows aren't sorted."""
    return df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), order).alias("__x")).select(key, "__x.*")


def sections(spark: SparkSession, path: str) -> DataFrame:
    """title, body of each second-level section of Markdown files, comments left out."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?s)<!--.*?-->", "").alias("t"))
    part = text.select(F.posexplode(F.split("t", r"(?m)^(?=## )")).alias("place", "s")).filter(F.col("s").startswith("## "))
    return part.select("place", F.regexp_extract("s", r"^## +(.*)", 1).alias("title"), F.regexp_replace("s", r"^## .*\n?", "").alias("body"))


def fenced(body):
    """What the first fenced block of a text holds."""
    return F.regexp_extract(body, r"(?s)```[^\n]*\n(.*?)```", 1)


def without_exemplars(text, first: int):
    """A card without its sections ``### Exemplar N`` from N = first on; a section of a higher level that follows one stays, with the rule before it."""
    parts = F.split(text, r"(?m)^(?=### Exemplar \d)", -1)
    number = lambda p: F.regexp_extract(p, r"^### Exemplar (\d+)", 1).try_cast("int")
    rest = lambda p: F.regexp_extract(p, r"(?sm)((?:^---\n+)?^## .*)", 1)
    return F.array_join(F.transform(parts, lambda p: F.when(number(p) >= first, rest(p)).otherwise(p)), "")


def with_exemplars(text, exemplars: list[str]):
    """A card with exemplars behind its own, numbered on."""
    n = F.regexp_count(text, F.lit(r"(?m)^### Exemplar \d"))
    out = F.regexp_replace(text, r"\s+$", "")
    for i, body in enumerate(exemplars, 1):
        out = F.concat(out, F.lit("\n\n### Exemplar "), (n + i).cast("string"), F.lit("\n\n" + body))
    return F.concat(out, F.lit("\n"))


def tolerant_json(c, schema: str):
    """A reply as JSON: without its fence, else what its outermost brackets hold, else null."""
    bare = F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", "")
    whole, inner = (F.from_json(x, schema, {"mode": "PERMISSIVE"}) for x in (bare, F.regexp_extract(c, r"(?s)(\{.*\})", 1)))
    ok = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(ok(bare), whole).when(ok(F.regexp_extract(c, r"(?s)(\{.*\})", 1)), inner)
