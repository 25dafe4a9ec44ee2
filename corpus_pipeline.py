"""A training corpus from raw documents: each stage works on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from tracelode.llm.common import materialise, spread, table


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with other names for all columns but doc_id and text, so that none clashes with an operator's, and how to undo it."""
    names = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(names), {v: k for k, v in names.items()}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from the labels that aren't held out, on the table of documents. Null and empty texts have the score of a text without words; rows that repeat are judged each; an empty table stays empty."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id"))))
    own, names = aside(docs)
    return toxicity.score(own, model).filter("predicted = 0").select(*own.columns).withColumnsRenamed(names).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that other documents have too stay in the document with the smallest id only; n_chars follows the text. A null text becomes an empty one; documents stay, even without lines."""
    own, names = aside(docs)
    out = line_dedup.dedup_lines(own).select(*own.columns).withColumnsRenamed(names)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near copies (five-word shingles, a similarity of 0.8 or more, and what that connects) the one with the smallest id stays. Null and empty texts have no words, are near nothing and stay."""
    own, names = aside(docs)
    return minhash.drop_near_duplicates(own, n=5, percent=80).select(*own.columns).withColumnsRenamed(names).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go. Null and empty texts hold none and stay; an empty benchmark takes nothing."""
    own, names = aside(docs)
    return decontaminate.decontaminate(own, table(spark, sf_dir, "benchmark")).select(*own.columns).withColumnsRenamed(names).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of what is left, and a digest of the text that the ids decode to."""
    import public_tokenizers

    out = bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=False)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("MinHash near-dedup", drop_near_copies), ("benchmark decontamination", drop_benchmark), ("byte-level BPE", encode)]
#: Learned scores, near copies and token ids have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each result written before the next reads it."""
    docs = spread(table(spark, sf_dir, "documents"))
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}")
    return docs
