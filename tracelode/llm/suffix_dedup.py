"""Repeated passages: every byte that a string of ``length`` bytes covers which also starts elsewhere in the corpus.

Suffixes are sorted block by block, and only those that can have an equal. Every ``length`` bytes hold windows of half
that length, and each of these has a minimiser, the gram that hashes lowest; equal strings have equal ones. So a suffix
is a candidate if all minimisers of its windows occur twice or more in the corpus; all others are unique. Candidates are
bucketed by the minimiser of their whole ``length`` bytes, which equal suffixes share, at the same place. A bucket gets
the stretch of text that its suffixes need.

A task sorts the suffixes of one bucket after another (small buckets in one go). Within a bucket all suffixes are aligned
by their minimiser, so one residue class of places is a difference cover for them: the blocks of 16 bytes at these
places are ranked, and by doubling so are those of 32 to 256 bytes. Two suffixes are compared by the bytes before the
next sample place and after its last one (16 in all), and by the ranks of the sample in between, so that long ties take
no longer. Ranks and bytes decide; hashes only give an order.

Memory is that of a bucket. A bucket beyond ``hot`` stretches is dealt over several tasks: suffixes with an equal in the
same task are settled there, for others a digest is counted over all tasks. No text is gathered by key, and the text of
a document goes through two joins by its id.

Defined results: texts are UTF-8 bytes; a null text is empty. Rows that repeat are documents each, so long ones are
removed as a whole. What is kept may be no UTF-8, so it is binary. Columns of the input stay, but for the text; those
of ``NEW`` replace columns of these names. Nothing in, nothing out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, discard, materialise, tidy, whole

NEW = ["n_bytes", "n_removed", "spans", "kept"]
GRAM = 32  # a power of two
BLOCK = 16
CHUNK = 2 << 20  # bytes of text, or of stretches, that a task works on at once


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash for the GRAM bytes from each place on."""
    h, base, size = text.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while size < GRAM:
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base % 2**64, 2 * size
    return _mix(h)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def minimisers(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of width grams, the place of the leftmost gram that hashes lowest."""
    least = sliding_min(h, width)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    ends = np.append(starts[1:], len(least))
    firsts, sizes, found = [], [], []
    while len(starts):  # a second round only where a gram repeats within a window
        at = np.empty(len(starts), np.int64)
        for k in range(0, len(starts), 2000):
            s = starts[k : k + 2000]
            at[k : k + 2000] = s + np.argmax(np.lib.stride_tricks.sliding_window_view(h, width)[s] == least[s, None], 1)
        stop = np.minimum(ends, at + 1)
        firsts.append(starts)
        sizes.append(stop - starts)
        found.append(at)
        more = stop < ends
        starts, ends = stop[more], ends[more]
    order = np.argsort(np.concatenate(firsts), kind="stable")
    return np.repeat(np.concatenate(found)[order], np.concatenate(sizes)[order])


def chunks(batches, text: int, least: int):
    """Batches cut so that their texts of ``least`` bytes or more have about CHUNK bytes: rows, the bytes of their texts together, where each starts, and the batch."""
    for batch in batches:
        values = batch.column(text).cast(pa.binary())
        rows, parts, size = [], [], 0
        for i, value in enumerate(values):
            value = value.as_py() or b""
            if len(value) >= least:
                rows.append(i)
                parts.append(value)
                size += len(value)
                if size >= CHUNK:
                    yield rows, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), batch
                    rows, parts, size = [], [], 0
        if rows:
            yield rows, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), batch


def _within(starts: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For n windows of size bytes: the text that each begins in, and whether it ends there too."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    return owner, np.arange(n) + size <= starts[owner + 1]


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """doc, own, hash, n: the distinct minimisers of a document's windows, and at how many places each is."""

    def run(batches):
        for rows, data, starts, batch in chunks(batches, 2, length):
            h = gram_hashes(data)
            at = minimisers(h, length // 2 - GRAM + 1)
            _, good = _within(starts, len(at), length // 2)
            places = np.unique(at[good])
            owner = np.searchsorted(starts, places, "right") - 1
            order = np.lexsort((h[places], owner))
            owner, hashes = owner[order], h[places][order]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])]))
            back = pa.array(np.array(rows)[owner[new]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(back), batch.column(1).take(back), pa.array(hashes[new].view(np.int64)), pa.array(np.diff(np.append(new, len(owner))), pa.int64())], names=["doc", "own", "hash", "n"])

    return texts.mapInArrow(run, "doc long, own long, hash long, n long")


def stretches(texts: DataFrame, length: int, hot: int) -> DataFrame:
    """key, salt, doc, own, start, anchor, data: candidate suffixes that share a minimiser, and the text they need. texts has seen (hash, n), what repeats."""

    def run(batches):
        for rows, data, starts, batch in chunks(batches, 2, length):
            h = gram_hashes(data)
            at = minimisers(h, length // 2 - GRAM + 1)
            owner, good = _within(starts, len(at), length // 2)
            flat = [x for i in rows for x in batch.column(3)[i].as_py()]
            known = np.array([x["hash"] for x in flat], np.int64).view(np.uint64)
            counts = np.array([x["n"] for x in flat], np.int64)
            # What repeats anywhere repeats for every document that has it, so one sorted list serves the chunk.
            known, first = np.unique(known, return_index=True)
            if not len(known):
                continue
            counts = counts[first]
            bad = ~good
            place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            bad |= known[place] != h[at]
            gone = np.concatenate([[0], np.cumsum(bad)])
            n = len(data) - length + 1
            if n <= 0:
                continue
            half = length - length // 2 + 1  # windows of half the length in one suffix
            owner, good = _within(starts, n, length)
            suffixes = np.flatnonzero(good & (gone[half : half + n] == gone[:n]))
            if not len(suffixes):
                continue
            anchor = minimisers(h, length - GRAM + 1)[suffixes]
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(suffixes) != 1) | (np.diff(anchor) != 0)]))
            first, last = suffixes[cut], suffixes[np.append(cut[1:], len(suffixes)) - 1]
            anchor = anchor[cut]
            who = owner[first]
            back = pa.array(np.array(rows)[who])
            key = h[anchor]
            many = counts[np.minimum(np.searchsorted(known, key), len(known) - 1)]
            doc, own = batch.column(0).take(back), batch.column(1).take(back)
            spread = _mix(np.asarray(own).view(np.uint64) + np.asarray(doc).view(np.uint64)) >> np.uint64(33)
            salt = np.where(many > hot, spread.astype(np.int64) % np.maximum(-(-many // hot), 1) + 1, 0)
            text = data.tobytes()
            for k in range(0, len(first), 4000):
                s = slice(k, k + 4000)
                yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), pa.array(salt[s], pa.int32()), doc[s], own[s], pa.array(first[s] - starts[who[s]], pa.int64()), pa.array(anchor[s] - first[s], pa.int32()), pa.array([text[a : b + length] for a, b in zip(first[s], last[s], strict=True)], pa.binary())], names=["key", "salt", "doc", "own", "start", "anchor", "data"])

    return texts.mapInArrow(run, "key long, salt int, doc long, own long, start long, anchor int, data binary")


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ranks of pairs of ranks."""
    return np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)[1]


def sort_bucket(parts: list[bytes], anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of ``length`` bytes of the stretches: the stretch and the place of each, their order, and which are equal to the next in it."""
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"".join(parts) + bytes(2 * length), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # The cover sample: blocks at the anchors' residues, in each stretch.
    lead = anchor % BLOCK
    blocks = (sizes - lead) // BLOCK
    block0 = np.concatenate([[0], np.cumsum(blocks)])
    at = np.repeat(starts + lead - BLOCK * block0[:-1], blocks) + BLOCK * np.arange(block0[-1])
    words = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    ranks = [_paired(np.unique(words[at], return_inverse=True)[1], np.unique(words[at + 8], return_inverse=True)[1])]
    size = 1
    while 2 * size <= length // BLOCK - 1:
        moved = np.concatenate([ranks[-1][size:], np.zeros(min(size, len(ranks[-1])), ranks[-1].dtype)])
        ranks.append(_paired(ranks[-1], moved))
        size *= 2
    count = sizes - length + 1
    total = int(count.sum())
    which = np.repeat(np.arange(len(parts)), count)
    place = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    p = starts[which] + place
    head = (anchor[which] - place) % BLOCK  # bytes before the first sample place
    block = block0[which] + (place + head - lead[which]) // BLOCK
    # head bytes from the front, 16 - head from the end
    full = np.uint64(2**64 - 1)
    low = np.array([(1 << 8 * min(e, 8)) - 1 for e in range(BLOCK)], np.uint64)[head]
    high = np.array([(1 << 8 * max(e - 8, 0)) - 1 for e in range(BLOCK)], np.uint64)[head]
    end = p + length - BLOCK
    columns = [(words[p] & low) | (words[end] & (low ^ full)), (words[p + 8] & high) | (words[end + 8] & (high ^ full)), head.astype(np.uint64)]
    left, k = length // BLOCK - 1, len(ranks) - 1
    while left:
        if 1 << k <= left:
            columns.append(ranks[k][block].astype(np.uint64))
            block, left = block + (1 << k), left - (1 << k)
        k -= 1
    mixed = columns[0].copy()
    for c in columns[1:]:
        mixed = _mix(mixed) + c
    mixed = _mix(mixed)
    order = np.argsort(mixed)
    near = mixed[order[1:]] == mixed[order[:-1]]
    equal = near.copy()
    for c in columns:
        equal &= c[order[1:]] == c[order[:-1]]
    if (near & ~equal).any():  # two different suffixes with one hash: sort by all columns
        order = np.lexsort(columns)
        equal = np.ones(max(0, total - 1), bool)
        for c in columns:
            equal &= c[order[1:]] == c[order[:-1]]
    return which, place, order, equal


def repeats(rows: DataFrame, length: int) -> DataFrame:
    """doc, own, start, stop of what repeats; for buckets that are dealt over tasks also what is open, with a mark (and for what is settled a mark without doc)."""

    def solve(held):
        key, salt, doc, own, start, anchor, parts = zip(*held, strict=True)
        which, place, order, equal = sort_bucket(parts, np.array(anchor, np.int64), length)
        again = np.zeros(len(order), bool)
        again[order[1:][equal]] = True
        firsts = order[:-1][equal & ~np.concatenate([[False], equal[:-1]])] if len(equal) else order[:0]
        again[firsts] = True
        start = np.array(start, np.int64)
        i = np.flatnonzero(again)
        at = start[which[i]] + place[i]
        new = np.concatenate([[True], (np.diff(which[i]) != 0) | (np.diff(at) > length)]) if len(i) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(i))[: len(first)] - 1
        out = [[doc[k] for k in which[i[first]]], [own[k] for k in which[i[first]]], at[first].tolist(), (at[last] + length).tolist(), [None] * len(first)]
        salt = np.array(salt)
        dealt = salt[which] > 0
        if dealt.any():
            for k in np.flatnonzero(dealt & ~again):
                w, d = which[k], int(place[k])
                for c, v in zip(out, (doc[w], own[w], int(start[w]) + d, int(start[w]) + d + length, xxhash.xxh3_128_digest(parts[w][d : d + length])), strict=True):
                    c.append(v)
            for k in firsts:
                if dealt[k]:
                    w, d = which[k], int(place[k])
                    for c, v in zip(out, (None, None, None, None, xxhash.xxh3_128_digest(parts[w][d : d + length])), strict=True):
                        c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["doc", "own", "start", "stop", "mark"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= CHUNK and row[:2] != held[-1][:2]:  # buckets stay whole
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield solve(held)

    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(run, "doc long, own long, start long, stop long, mark binary")


def repeated_spans(texts: DataFrame, length: int, hot: int) -> DataFrame:
    """doc, own, spans (start, stop; they may overlap) for texts (doc, own, text)."""
    marks = materialise(anchors(texts, length), "anchors")
    seen = materialise(marks.groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1"), "repeated")
    found = marks.drop("n").join(seen, "hash").groupBy("doc", "own").agg(F.collect_set(F.struct("hash", "n")).alias("seen"))
    found = materialise(found, "marked")
    is_hot = not seen.filter(F.col("n") > hot).isEmpty()
    discard(marks)
    discard(seen)
    rows = materialise(repeats(stretches(texts.join(found, ["doc", "own"]).select("doc", "own", "text", "seen"), length, hot), length), "repeats")
    discard(found)
    spans = rows.filter("mark is null").select("doc", "own", "start", "stop")
    if is_hot:
        twice = materialise(rows.filter("mark is not null").groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "marks")
        spans = spans.union(rows.filter("mark is not null and doc is not null").join(twice, "mark").select("doc", "own", "start", "stop"))
    out = materialise(spans.groupBy("doc", "own").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    discard(rows)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 400, hot: int = 8192) -> DataFrame:
    """docs without the text, with n_bytes, n_removed, spans (the removed runs) and kept (the remaining bytes)."""
    if length % BLOCK or length < 4 * GRAM:
        raise ValueError(f"length must be a multiple of {BLOCK}, and {4 * GRAM} at least")
    names = [c for c in docs.columns if c not in ("text", *NEW)]
    doc, own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64("text")
    spans = repeated_spans(docs.select(doc.alias("doc"), own.alias("own"), whole(F.col("text")).alias("text")), length, hot)
    tidy(docs.sparkSession)
    spans = spans.select(F.col("doc").alias("__sd_doc"), F.col("own").alias("__sd_own"), "spans")
    source = docs.select(*names, doc.alias("__sd_doc"), own.alias("__sd_own"), whole(F.col("text")).alias("text")).join(spans, ["__sd_doc", "__sd_own"], "left").select(*names, "spans", "text")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType(), False), T.StructField("stop", T.LongType(), False)]), False)
    schema = T.StructType([*(f for f in source.schema.fields[:-2]), T.StructField("n_bytes", T.LongType(), False), T.StructField("n_removed", T.LongType(), False), T.StructField("spans", span, False), T.StructField("kept", T.BinaryType(), False)])
    kind = pa.list_(pa.struct([pa.field("start", pa.int64(), False), pa.field("stop", pa.int64(), False)]))

    def run(batches):
        for batch in batches:
            size, removed, runs, kept = [], [], [], []
            for found, text in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).cast(pa.binary()), strict=True):
                text = text.as_py()
                gone = merged([(x["start"], x["stop"]) for x in found.as_py() or ()])
                edges = [0, *(x for r in gone for x in r), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                size.append(len(text))
                removed.append(sum(b - a for a, b in gone))
                runs.append([{"start": a, "stop": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], names=[*batch.schema.names[:-2], *NEW])

    return source.mapInArrow(run, schema)
