"""WARC archives of pages, and their index by an external merge.

``write_archives`` writes a record for each page into gzip members, a file (or more) for each task. Of pages with equal
payloads the one with the largest id is a response, the others are revisits that refer to it.
``index_archives`` reads the files back, record by record, checks the digests and leaves sorted runs of captures, each
with a sparse index at its end. ``merge_runs`` merges them: a task for each range of the key (URL key, time, record)
seeks to the range in every run and merges the k streams by a loser tree, so its memory is a block for each run. Beyond
``fan_in`` lists of runs, groups of lists are merged first, piece by piece of the keys, into lists of runs that don't
overlap. Ranges and pieces are cut by the whole key, so one URL can fill many. Which runs a task reads is part of its
input, a table; neither the driver nor a closure holds their names.

All files go through a file system that is found by the folder's URI; names hold the task's attempt, so a task that
runs again disturbs nothing, and only files of tasks that ended are listed.

Defined results: a null html is an empty payload. A null url has the key "-" and no target header. Pages without an id
are never referred to; rows that repeat the largest id are responses each. Payloads under ``min_payload`` bytes are all
responses. Pages without a time get one from their id. Other columns of the input aren't archived. No pages: no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, new_path

EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "url_key string, captured_at timestamp, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, file string, file_offset long, file_length long"
BLOCK = 256  # captures between two entries of a run's sparse index
CUTS = 256  # keys of a run, at most about, among which the cuts between ranges are chosen


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def url_key(url: str | None) -> str:
    """The host's parts in reverse order, then the path and the sorted query, in lower case; the fragment goes."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return quote(url.lower(), safe="%/:?&=,;()+")
    port = f":{port}" if port and port not in (80, 443) else ""
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){(parts.path or '/')}{query}".lower()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, at: datetime, refers_to: int | None) -> bytes:
    """A record as a gzip member; a revisit has the HTTP header only."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {at:%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(quote(c) if c <= " " or c == "\x7f" else c for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    out = zlib.compressobj(4, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + out.flush()


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """The place, the length and the content of each gzip member of a file, one at a time."""
    at, data, start = 0, b"", 0
    while True:
        data = data or stream.read(chunk)
        if not data:
            return
        one, parts, start = zlib.decompressobj(31), [], at
        while True:
            parts.append(one.decompress(data))
            if one.eof:
                at += len(data) - len(one.unused_data)
                data = one.unused_data
                break
            at += len(data)
            data = stream.read(chunk)
            if not data:
                raise ValueError("an archive ends within a record")
        yield start, at - start, b"".join(parts)


def parse(content: bytes) -> tuple[dict[str, str], bytes, dict[str, str], bytes]:
    """A record's header, block, HTTP header and payload."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, block, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(kind: str, suffix: str) -> str:
    task = TaskContext.get()
    return f"{kind}-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}{suffix}"


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, time_column: str | None = None, file_bytes: int = 256 << 20) -> DataFrame:
    """Writes the archives under path; file, records and bytes of each."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    at = F.col(time_column).cast("timestamp") if time_column else F.lit(None).cast("timestamp")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at")).withColumn("sha1", F.unhex(F.sha1("payload")))
    # A row for each payload that several pages have; joined by its digest, where one digest can be in any share of the pages.
    heads = rows.filter(F.octet_length("payload") >= min_payload).groupBy("sha1").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(heads, "sha1", "left").select("page_id", "url", "payload", "at", F.when(~F.coalesce(F.col("page_id") == F.col("head"), F.lit(False)), F.col("head")).alias("refers_to"))

    def run(batches):
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        out, name, count, size = None, "", 0, 0
        done = []
        for batch in batches:
            for page_id, url, payload, at, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                page_id, payload = page_id.as_py(), payload.as_py()
                when = datetime.strptime(at.as_py(), "%Y-%m-%d %H:%M:%S").replace(tzinfo=UTC) if at.is_valid else EPOCH + timedelta(seconds=(page_id or 0) % 2**31)
                if out is None:
                    name, count, size = _name("pages", ".warc.gz"), 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                made = record(page_id, url.as_py(), payload, len(payload), base32_sha1(payload), when, refers_to.as_py())
                out.write(made)
                count, size = count + 1, size + len(made)
                if size >= file_bytes:
                    out.close()
                    out = None
                    done.append((f"{path}/{name}", count, size))
        if out is not None:
            out.close()
            done.append((f"{path}/{name}", count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["file", "records", "bytes"])

    return materialise(rows.mapInArrow(run, "file string, records long, bytes long"), "archives")


def capture_of(file: str, offset: int, length: int, content: bytes) -> list:
    """What the index holds of a record, its key first; the digest of a response is checked."""
    fields, _, http, payload = parse(content)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (base32_sha1(payload) != digest or len(payload) != int(http["Content-Length"])):
        raise ValueError(f"the payload at {offset} of {file} has another digest")
    ids = [int(x) if (x := fields.get(k, "").removeprefix("<urn:page:").removesuffix(">")) else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
    url = fields.get("WARC-Target-URI")
    return [[url_key(url), fields["WARC-Date"], -1 if ids[0] is None else ids[0], file, offset], ids[0], url, kind, digest, int(http["Content-Length"]), ids[1], length]


class RunWriter:
    """Writes captures, which come in order, and a sparse index behind them."""

    def __init__(self, fs, path: str):
        self.out, self.at, self.n, self.index, self.last = fs.open_output_stream(path), 0, 0, [], None

    def add(self, capture: list) -> None:
        if self.n % BLOCK == 0:
            self.index.append([capture[0], self.at])
        line = json.dumps(capture).encode() + b"\n"
        self.out.write(line)
        self.at, self.n, self.last = self.at + len(line), self.n + 1, capture[0]

    def close(self) -> list[list]:
        foot = json.dumps(self.index).encode()
        self.out.write(foot + struct.pack("<QQ", self.at, len(foot)))
        self.out.close()
        return [k for k, _ in self.index]


def read_run(fs, path: str, low: list | None, high: list | None) -> Iterator[list]:
    """The captures of a run with low <= key < high, read from the block where they begin."""
    with fs.open_input_file(path) as f:
        f.seek(f.size() - 16)
        end, size = struct.unpack("<QQ", f.read(16))
        f.seek(end)
        index = json.loads(f.read(size))
        at = 0
        for key, offset in index:
            if low is not None and key < low:
                at = offset
            else:
                break
        f.seek(at)
        left = b""
        while at < end:
            data = f.read(min(1 << 16, end - at))
            at += len(data)
            *lines, left = (left + data).split(b"\n")
            for line in lines:
                capture = json.loads(line)
                if high is not None and capture[0] >= high:
                    return
                if low is None or capture[0] >= low:
                    yield capture


class LoserTree:
    """Merges k sorted streams: a match for each inner node keeps its loser, and only the path of the last winner is played again."""

    def __init__(self, streams: list[Iterator[list]]):
        self.streams = streams
        self.heads = [next(s, None) for s in streams]
        self.k = len(streams)
        self.nodes = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.nodes[node]
            if other == -1:  # the first to come here waits for the other side
                self.nodes[node] = i
                return
            if self._before(other, i):
                self.nodes[node], i = i, other
            node //= 2
        self.nodes[0] = i

    def __iter__(self) -> Iterator[list]:
        while self.k:
            i = self.nodes[0]
            if self.heads[i] is None:
                return
            yield self.heads[i]
            self.heads[i] = next(self.streams[i], None)
            node = (i + self.k) // 2
            while node > 0:
                if self._before(self.nodes[node], i):
                    self.nodes[node], i = i, self.nodes[node]
                node //= 2
            self.nodes[0] = i


#: A table of runs: the list it belongs to (runs of a list don't overlap), its records, some of its keys, and the last.
RUNS = "list string, run string, n long, keys string, last string"


def _run_row(list_: str, name: str, writer: RunWriter) -> tuple:
    keys = writer.close()
    return list_, name, writer.n, json.dumps(keys[:: max(1, len(keys) // CUTS)]), json.dumps(writer.last)


def _runs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()], strict=True)], names=["list", "run", "n", "keys", "last"])


def index_archives(archives: DataFrame, path: str, run_records: int = 50_000) -> DataFrame:
    """Sorted runs of what the archives hold, read back from first to last: a table RUNS, each run a list of its own."""
    n = max(1, archives.count())

    def run(batches):
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        held, done = [], []

        def close():
            name = _name("run", ".jsonl")
            writer = RunWriter(fs, f"{root}/{name}")
            for capture in sorted(held, key=lambda c: c[0]):
                writer.add(capture)
            done.append(_run_row(name, f"{path}/{name}", writer))
            held.clear()

        for batch in batches:
            for file in batch.column(0).to_pylist():
                source, at = _open(file)
                with source.open_input_stream(at, compression=None) as stream:
                    for offset, length, content in members(stream):
                        held.append(capture_of(file, offset, length, content))
                        if len(held) >= run_records:
                            close()
        if held:
            close()
        if done:
            yield _runs(done)

    files = archives.select("file").repartition(min(n, 4096))
    return materialise(files.mapInArrow(run, RUNS), "runs")


def _cut(runs: list[tuple], piece: int) -> list[list | None]:
    """Keys that part the records of runs (n, keys) into pieces of about so many: None, keys, None."""
    keys = sorted(k for _, some in runs for k in some)
    n = max(1, min(len(keys), -(-sum(n for n, _ in runs) // piece)))
    return [None, *(keys[len(keys) * i // n] for i in range(1, n)), None]


def _within(first: list, last: list, low: list | None, high: list | None) -> bool:
    """Whether a run has a key with low <= key < high, by its first and last."""
    return (high is None or first < high) and (low is None or last >= low)


def _merge_lists(runs: DataFrame, lists: int, path: str, fan_in: int, piece: int) -> DataFrame:
    """Lists merged, about fan_in together, each piece of the keys by a task of its own: what a task writes is bounded, whatever the lists hold."""
    groups = -(-lists // fan_in)
    held = runs.withColumn("group", F.pmod(F.xxhash64("list"), F.lit(groups))).groupBy("group").agg(F.collect_list(F.struct("run", "n", "keys", "last")).alias("runs"))  # names and some keys

    def plan(batches):
        for batch in batches:
            for g, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = [(r["run"], r["n"], json.loads(r["keys"]), json.loads(r["last"])) for r in own]
                cuts = _cut([(n, k) for _, n, k, _ in known], piece)
                rows = [(str(g), json.dumps(low), json.dumps(high), [r for r, _, k, last in known if _within(k[0], last, low, high)]) for low, high in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.string(), pa.list_(pa.string())], strict=True)], names=["list", "low", "high", "runs"])

    def merge(batches):
        fs, root = _open(path)
        for batch in batches:
            for list_, low, high, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = _name("merged", ".jsonl")
                writer = RunWriter(fs, f"{root}/{name}")
                for capture in LoserTree([read_run(*_open(r), json.loads(low), json.loads(high)) for r in own]):
                    writer.add(capture)
                row = _run_row(list_, f"{path}/{name}", writer)
                if writer.n:
                    yield _runs([row])

    tasks = materialise(held.mapInArrow(plan, "list string, low string, high string, runs array<string>"), "pieces")
    out = materialise(tasks.repartition(max(1, min(tasks.count(), 20_000))).mapInArrow(merge, RUNS), "runs")
    discard(tasks)
    return out


#: Keys, a sample of those in the runs' tables, that the last ranges are cut by at most.
MOST_CUTS = 100_000


def merge_runs(runs: DataFrame, path: str, fan_in: int = 128, range_records: int = 4096, piece: int = 400_000) -> DataFrame:
    """The capture histories of all runs in the order of URL key and time: row i of range r is before row i + 1, and all of range r before range r + 1.

    Lists of runs are merged, fan_in at a time and piece by piece, until there are fan_in at most; then each range of
    keys is merged from the runs that have some of it. The driver holds only the keys that cut the ranges, a sample of
    bounded size, which decides how even the ranges are and nothing else.
    """
    spark = runs.sparkSession
    while (lists := runs.select("list").distinct().count()) > fan_in:
        before, runs = runs, _merge_lists(runs, lists, path, fan_in, piece)
        discard(before)
    keys = runs.select(F.explode(F.from_json("keys", "array<string>")).alias("key"))
    total = runs.agg(F.sum("n").alias("n"), F.sum(F.json_array_length("keys")).alias("keys")).first()
    kept = keys if (total["keys"] or 0) <= MOST_CUTS else keys.filter(F.pmod(F.xxhash64("key"), F.lit(10_000_000)) < F.lit(int(1e7 * MOST_CUTS / total["keys"])))
    cuts = spark.sparkContext.broadcast(_cut([(total["n"] or 0, [json.loads(r["key"]) for r in kept.collect()])], range_records))
    n = len(cuts.value) - 1

    def spread(batches):
        inner = cuts.value[1:-1]
        for batch in batches:
            rows = []
            for name, some, last in zip(batch.column("run").to_pylist(), batch.column("keys").to_pylist(), batch.column("last").to_pylist(), strict=True):
                rows += [(r, name) for r in range(bisect_right(inner, json.loads(some)[0]), bisect_right(inner, json.loads(last)) + 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.string()], strict=True)], names=["range", "run"])

    def run(batches):
        for batch in batches:
            for r, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                merged = LoserTree([read_run(*_open(name), cuts.value[r], cuts.value[r + 1]) for name in sorted(names)])
                for i, (key, page_id, url, kind, digest, size, refers_to, length) in enumerate(merged):
                    rows.append((r, i, key[0], datetime.strptime(key[1], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC), page_id, url, kind, digest, size, refers_to, key[3], key[4], length))
                    if len(rows) == 2000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    # Of each of at most fan_in lists, the few runs that have some of a range.
    ranges = runs.select("run", "keys", "last").mapInArrow(spread, "range long, run string").repartition(max(1, min(n, 4096)), "range").groupBy("range").agg(F.collect_list("run").alias("runs"))
    return ranges.mapInArrow(run, "range long, place long, " + CAPTURE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["range", "place", *(x.split()[0] for x in CAPTURE.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def capture_histories(pages: DataFrame, min_payload: int = 0, time_column: str | None = None, path: str | None = None) -> DataFrame:
    """Archives the pages under path, reads the archives back and merges their index; a row for each record."""
    path = path or new_path(pages.sparkSession, "warc")
    archives = write_archives(pages, path, min_payload, time_column)
    runs = index_archives(archives, f"{path}/index")
    discard(archives)
    return merge_runs(runs, f"{path}/index")
