"""The queries of the corpus operators: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, license_scan, line_dedup, minhash, quality_mcd, sharding, suffix_dedup, toxicity, warc
from .common import spread, table, whole


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    out = toxicity.score(docs, model, keep_text=False)
    return out.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.capture_histories(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_components(minhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), n=2, percent=80))


def op6_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = whole(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.uniform_shards(docs, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=False)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), 400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_paragraphs", "n_candidates", F.size("licences").cast("long").alias("n_licences"), F.array_join("families", ",").alias("families"))


def op10_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_mcd.judge(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("distance", 3).alias("distance"), "kept")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_decontaminate": op4_decontaminate,
    "op5_minhash": op5_minhash,
    "op6_hypergeometric_shards": op6_hypergeometric_shards,
    "op7_bpe": op7_bpe,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_quality_mcd": op10_quality_mcd,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = f"translate(trim(line, {_BLANKS}), {_AZ})"
_WORDS = f"regexp_extract_all(translate(text, {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES = {
    # Texts as hexadecimal digits; the 400-byte strings of a piece of 799 bytes at a time, by their digests.
    "op8_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, n, s, substr(h, 800 * s + 1, 1598) AS part FROM (SELECT doc_id, n, h, unnest(range(0, n // 400)) AS s FROM d WHERE n >= 400)),
w AS (SELECT doc_id, 400 * s + i AS p, md5(substr(part, 2 * i + 1, 800)) AS g FROM (SELECT *, unnest(range(0, least(400, n - 399 - 400 * s))) AS i FROM s)), r AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
c AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w WHERE g IN (SELECT g FROM r)), i AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c),
runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS b, coalesce(lag(max(p) + 400) OVER (PARTITION BY doc_id ORDER BY run), 0) AS left_ FROM i GROUP BY doc_id, run),
k AS (SELECT runs.doc_id, string_agg(substr(h, 2 * left_ + 1, 2 * (a - left_)), '' ORDER BY run) AS front, max(b) AS last, sum(b - a) AS gone, count(*) AS spans FROM runs JOIN d ON runs.doc_id = d.doc_id GROUP BY 1)
SELECT d.doc_id, CAST(n AS bigint) AS n_bytes, CAST(coalesce(gone, 0) AS bigint) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op1_line_dedup": f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_KEY} AS key FROM l), g AS (SELECT key, min(doc_id) AS keep FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
m AS (SELECT k.*, g.keep IS NOT NULL AND g.keep <> doc_id AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op3_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, 5 * i + 1, 5) AS bigint)) AS v FROM m)
SELECT page_id, CAST(octet_length(encode(html)) AS bigint) AS payload_bytes, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) & 31 AS int) + 1, 1)), '')), '') AS payload_digest,
 CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM g""",
    "op4_decontaminate": f"""WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win, least(13, len(w)) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win), pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n),
found AS (SELECT DISTINCT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND array_to_string(w[i:i + pos.n - 1], ' ') = win.win),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM found) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT CAST(item_id AS varchar))), ',')) AS digest FROM found GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""",
    "op5_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) = 1 THEN w ELSE [] END AS s FROM w),
h AS (SELECT s, min(doc_id) AS head FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s), member AS (SELECT s.doc_id, head FROM s JOIN h ON list_sort(s.s) = h.s),
t AS (SELECT head, len(s) AS n, unnest(s) AS x FROM h), f AS (SELECT x FROM t GROUP BY x HAVING count(*) > 1),
p AS (SELECT a.head AS a, b.head AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM (SELECT t.* FROM t SEMI JOIN f ON t.x = f.x) a JOIN t b ON a.x = b.x AND a.head < b.head GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c) UNION SELECT b, a FROM p WHERE 100 * c >= 80 * (na + nb - c)),
r AS (SELECT head AS x, head AS root FROM h UNION SELECT e.b, r.root FROM r JOIN e ON r.x = e.a),
c AS (SELECT x, min(root) AS component FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s) AS bigint) AS n_shingles, coalesce(component, s.doc_id) AS component_id, coalesce(component, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN member ON s.doc_id = member.doc_id LEFT JOIN c ON member.head = c.x""",
}
