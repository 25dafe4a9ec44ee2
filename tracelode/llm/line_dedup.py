"""Line deduplication over a corpus.

Lines are exploded, normalised and hashed; distinct documents are counted per hash; lines whose hash is in at least
``min_docs`` documents go everywhere but in the document with the smallest id; texts are put together by position.

Defined results: a null or empty text is one empty line. Rows with the same doc_id are one document, and a null doc_id
counts as the largest id. Keys of under ``min_chars`` code points are never dropped. Columns of the input stay as they
are, but for ``text``; ``n_lines`` and ``n_dropped`` replace columns of these names. An empty table gives an empty one.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, NO_ID, claim, discard, materialise, whole

_blanks = BLANKS.encode()


def lines_of(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def line_key(line: bytes) -> bytes:
    """A line in UTF-8 without ASCII white space at its ends, and A-Z lower-cased (what bytes.lower() does)."""
    return line.strip(_blanks).lower()


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode())


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row (document, text, place, hash) for each line with a key of min_chars code points; 128 bits tell keys apart."""

    def run(batches):
        claim("line_dedup")
        for batch in batches:
            owner, place, hashes = [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                for k, line in enumerate(text.as_py().split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and code_points(key) >= min_chars:
                        owner.append(i)
                        place.append(k)
                        hashes.append(xxhash.xxh3_128_digest(key))
            at = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(place, pa.int32()), pa.array(hashes, pa.binary())], names=["__ld_doc", "__ld_text", "__ld_pos", "__ld_hash"])

    return docs.mapInArrow(run, "__ld_doc long, __ld_text long, __ld_pos int, __ld_hash binary")


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """docs, text without repeated lines, and n_lines (before) and n_dropped."""
    # Rows of one document can have different texts, so places belong to a document and a text.
    doc, own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64("text")
    keyed = materialise(line_hashes(docs.select(doc.alias("__ld_doc"), own.alias("__ld_text"), whole(F.col("text"))), min_chars), "lines")
    if min_docs == 2:  # two documents differ in their least and greatest id: sums of a fixed size for each key
        found = keyed.groupBy("__ld_hash").agg(F.min("__ld_doc").alias("__ld_keep"), F.max("__ld_doc").alias("__ld_last")).filter("__ld_keep < __ld_last")
    else:
        pairs = keyed.select("__ld_hash", "__ld_doc").distinct()
        found = pairs.groupBy("__ld_hash").agg(F.min("__ld_doc").alias("__ld_keep"), F.count("*").alias("__ld_docs")).filter(F.col("__ld_docs") >= min_docs)
    # As a table of its own, so that the join can split the lines of a hot key.
    found = materialise(found.select("__ld_hash", "__ld_keep"), "repeated")
    gone = keyed.join(found, "__ld_hash").filter("__ld_doc != __ld_keep")
    gone = materialise(gone.groupBy("__ld_doc", "__ld_text").agg(F.collect_set("__ld_pos").alias("__ld_gone")), "gone")
    discard(keyed)
    discard(found)
    out = docs.withColumns({"__ld_doc": doc, "__ld_text": own}).join(gone, ["__ld_doc", "__ld_text"], "left")
    lines, gone_at = lines_of(F.col("text")), F.coalesce("__ld_gone", F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone_at)
    text = F.when(F.col("__ld_gone").isNull(), whole(F.col("text"))).otherwise(F.array_join(F.transform(stay, lambda i: lines[i]), "\n"))
    # n_lines counts what was there, so it is taken before the text is replaced.
    out = out.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": F.size(gone_at).cast("long"), "__ld_out": text})
    return out.withColumn("text", F.col("__ld_out")).drop("__ld_doc", "__ld_text", "__ld_gone", "__ld_out")
