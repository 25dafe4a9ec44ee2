"""Benchmark decontamination by suffix arrays of the training text.

Training documents are indexed shard by shard: the words of a shard get numbers (0 for words that no benchmark item
has, which nothing can match across), the suffixes that can hold a whole window are sorted, and every suffix of every
benchmark item is looked up by binary search. That gives its longest verbatim match in the shard, and where each whole
window occurs. A window is ``window`` consecutive words of an item; a shorter item is one window.

The documents stay where they are: a shard is a record batch, so its memory is bounded, and nothing is shuffled. The
benchmark is dealt to blocks of about ``block_bytes``, one pass over the batch for each. A benchmark of up to
``broadcast_bytes`` is broadcast; of a larger one a task reads block after block from the shared folder and holds one at
a time. Of a block's suffixes only those are looked up whose first window has no pair of neighbours that the shard lacks.

Defined results: A-Z are lower-cased; words are runs of 0-9, a-z and characters beyond ASCII. Null and empty texts have
no words and are never contaminated. Items without words have no window. Items with the same id are one item. Rows that repeat are judged each. Matches
never cross documents or items. Columns of the input stay; those named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, kept_caches, new_path, plain, shared_files

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_word = plain(WORD)
_az = {i: i + 32 for i in range(65, 91)}
FOUND = [("item_id", T.StringType()), ("item_at", T.IntegerType()), ("doc_at", T.IntegerType()), ("n", T.IntegerType())]
MATCH = T.ArrayType(T.StructType([T.StructField(n, t, False) for n, t in FOUND]), False)
NEW = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType(), False)), ("matches", MATCH), ("contaminated", T.BooleanType())]


def words_of(text: str | None) -> list[str]:
    # str.lower() would change other letters too
    return _word.findall(text.translate(_az)) if text else []


class Numbers(dict):
    """Words to numbers; 0 for any other."""

    def __missing__(self, word: str) -> int:
        return 0


class Index:
    """The suffix array of one shard, over word numbers, as deep as a window."""

    def __init__(self, docs: list[np.ndarray], depth: int, least: int):
        sizes = np.array([len(d) for d in docs], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # a 0 after each document
        text = np.zeros(self.starts[-1] + depth, np.uint32)
        for d, at in zip(docs, self.starts, strict=False):
            text[at : at + len(d)] = d
        self.text = text
        # How many known words follow each other from here on; a suffix with fewer than ``least`` holds no window.
        stops = np.flatnonzero(text == 0)
        run = stops[np.searchsorted(stops, np.arange(self.starts[-1]))] - np.arange(self.starts[-1])
        at = np.flatnonzero(run >= least)
        deep = np.lib.stride_tricks.sliding_window_view(text, depth)[at] if len(at) else np.zeros((0, depth), np.uint32)
        # Beyond the first 0 a suffix has ended.
        deep = np.where(np.arange(depth) < np.minimum(run[at], depth)[:, None], deep, 0).astype(">u4")
        keys = [row.tobytes() for row in deep]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.keys, self.suffixes = [keys[i] for i in order], at[order]

    def longest(self, key: bytes) -> int:
        """Words of the longest match of this suffix; its neighbours in the array have it."""
        at, most = bisect_left(self.keys, key), 0
        for k in (at - 1, at):
            if 0 <= k < len(self.keys):
                other = self.keys[k]
                n = 0
                while n < len(key) and key[n : n + 4] == other[n : n + 4] and key[n : n + 4] != b"\0\0\0\0":
                    n += 4
                most = max(most, n // 4)
        return most

    def occurrences(self, key: bytes) -> np.ndarray:
        """Where this whole window begins."""
        return self.suffixes[bisect_left(self.keys, key) : bisect_right(self.keys, key + b"\xff" * 4 * (len(self.keys[0]) // 4 - len(key) // 4 + 1) if self.keys else key)]

    def extended(self, item: np.ndarray, item_at: int, at: int, n: int) -> int:
        """The length of a match beyond the depth of the array."""
        while item_at + n < len(item) and self.text[at + n] and self.text[at + n] == item[item_at + n]:
            n += 1
        return n

    def place(self, at: int) -> tuple[int, int]:
        d = int(np.searchsorted(self.starts, at, "right")) - 1
        return d, int(at - self.starts[d])


class Block:
    """A part of the benchmark: its words' numbers, and all its pairs of neighbours in one array."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.number = Numbers((w, i) for i, w in enumerate(sorted({w for _, words in items for w in words}), 1))
        self.window = window
        self.items = [(name, np.array([self.number[w] for w in words], np.uint32)) for name, words in items if words]
        self.least = min([window, *(len(x) for _, x in self.items)])
        sizes = np.array([len(x) for _, x in self.items], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        words = np.concatenate([x for _, x in self.items]) if self.items else np.zeros(0, np.uint32)
        self.pairs = pairs_of(words) if len(words) else np.zeros(0, np.uint64)
        place = np.arange(len(words)) - np.repeat(self.starts[:-1], sizes)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.size = np.minimum(window, sizes)[self.owner]  # of the windows of each place's item
        self.begins = place + self.size <= sizes[self.owner]
        self.first = place

    def candidates(self, text: np.ndarray) -> np.ndarray:
        """The places, in all items together, of windows whose words and pairs of neighbours all occur in a text."""
        if not len(self.owner):
            return np.zeros(0, np.int64)
        there = np.isin(self.pairs, np.unique(pairs_of(text))) if len(text) > 1 else np.zeros(len(self.pairs), bool)
        missing = np.concatenate([[0], np.cumsum(~there)])
        at = np.flatnonzero(self.begins)
        last = np.minimum(at + self.size[at] - 1, len(missing) - 1)
        return at[missing[last] == missing[np.minimum(at, len(missing) - 1)]]


def pairs_of(words: np.ndarray) -> np.ndarray:
    return words[:-1].astype(np.uint64) << np.uint64(32) | words[1:].astype(np.uint64)


def search(texts: list[str | None], block: Block) -> list[tuple[int, set[int], list[tuple[str, int, int, int]]]]:
    """For each text: its number of words, the words that are hit, and its maximal matches of a window or more."""
    window, number = block.window, block.number
    docs, counts = [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        docs.append(np.array(list(map(number.__getitem__, words)), np.uint32))
    index = Index(docs, window, block.least)
    hit: list[set[int]] = [set() for _ in texts]
    found: list[dict[tuple[str, int, int], int]] = [{} for _ in texts]
    for at in block.candidates(index.text):  # every suffix of every item that can match
        (name, item), s, size = block.items[block.owner[at]], int(block.first[at]), int(block.size[at])
        key = item[s : s + window].astype(">u4").tobytes()
        if index.longest(key) < size:
            continue
        for at in index.occurrences(item[s : s + size].astype(">u4").tobytes()):
            d, word = index.place(at)
            hit[d].update(range(word, word + size))
            if not (s and word and item[s - 1] == index.text[at - 1]):  # else it goes on to the left
                found[d][name, s, word] = index.extended(item, s, int(at), size)
    return [(n, h, sorted((*k, v) for k, v in f.items())) for n, h, f in zip(counts, hit, found, strict=True)]


def _items(rows) -> list[tuple[str, list[str]]]:
    return [(i, words) for i, words in ((i, words_of(t)) for i, t in rows) if words]


def blocks_of(benchmark: DataFrame, window: int, block_bytes: int, broadcast_bytes: int):
    """The stated query set as blocks of about block_bytes: a function that gives a task one after another."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).filter("i is not null and t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size <= broadcast_bytes:  # so many bytes at most go through the driver
        held, parts, left = [[]], [(r["i"], r["t"]) for r in rows.collect()], block_bytes
        for i, t in parts:
            if left < 0:
                held.append([])
                left = block_bytes
            held[-1].append((i, t))
            left -= len(t)
        sent = [(uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(b)) for b in held if b]

        def given():
            for k, b in sent:
                if k not in _blocks:
                    if len(_blocks) > len(sent):  # those of earlier jobs
                        _blocks.clear()
                    _blocks[k] = Block(_items(b.value), window)
                yield _blocks[k]

        return given
    n = -(-size // block_bytes)
    path = new_path(rows.sparkSession, "benchmark")
    rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n))).repartition(min(n, 4096), "block").write.partitionBy("block").parquet(path)
    fs, root = shared_files(path)
    folders = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.Directory]

    def read():
        fs, _ = shared_files(path)
        for folder in folders:
            part = ds.dataset(folder, filesystem=fs, format="parquet").to_table(columns=["i", "t"])
            yield Block(_items(zip(part.column("i").to_pylist(), part.column("t").to_pylist(), strict=True)), window)

    return read


#: Blocks that a worker has prepared, by name.
_blocks: dict[str, Block] = {}
kept_caches.append(_blocks)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, hit_percent: int = 5, block_bytes: int = 8 << 20, broadcast_bytes: int = 32 << 20, shard_rows: int = 2000) -> DataFrame:
    """docs with n_words, n_hit, items (whose windows occur), matches (longest verbatim ones, with places) and contaminated."""
    new = [n for n, _ in NEW]
    source = docs.drop(*new)
    blocks = blocks_of(benchmark, window, block_bytes, broadcast_bytes)
    schema = T.StructType([*source.schema.fields, *(T.StructField(n, t, False) for n, t in NEW)])

    def run(batches):
        claim("decontaminate")
        for whole in batches:
            for at in range(0, whole.num_rows, shard_rows):
                batch = whole.slice(at, shard_rows)
                texts = batch.column(batch.schema.names.index("text")).to_pylist()
                counts, hit, found = None, [set() for _ in texts], [[] for _ in texts]
                for b in blocks():
                    results = search(texts, b)
                    counts = [r[0] for r in results]
                    for h, f, r in zip(hit, found, results, strict=True):
                        h |= r[1]
                        f += r[2]
                counts = counts or [len(words_of(t)) for t in texts]
                rows = [{"n_words": n, "n_hit": len(h), "items": sorted({m[0] for m in f}), "matches": [dict(zip([x for x, _ in FOUND], m, strict=True)) for m in f], "contaminated": len(h) > 0 and 100 * len(h) >= hit_percent * n} for n, h, f in zip(counts, hit, found, strict=True)]
                made = pa.Table.from_pylist(rows, arrow).to_batches()[0]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made.columns], names=[*batch.schema.names, *new])

    found = pa.list_(pa.struct([pa.field(n, pa.string() if n == "item_id" else pa.int32(), False) for n, _ in FOUND]))
    arrow = pa.schema([pa.field("n_words", pa.int64()), pa.field("n_hit", pa.int64()), pa.field("items", pa.list_(pa.string())), pa.field("matches", found), pa.field("contaminated", pa.bool_())])
    return source.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that are contaminated."""
    return find_contamination(docs.drop(*(n for n, _ in NEW)), benchmark, **options).filter("not contaminated").select(*[c for c in docs.columns if c not in dict(NEW)])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
