"""Byte-level BPE: a lazily determinised finite-state transducer encodes, a UTF-8 state machine decodes.

Encoding. The last token of the encoding of each prefix of a piece decides the whole encoding: it is the longest token
that ends there and may stand after the last token of what is before it (two tokens may stand side by side where the
merges turn their joined bytes into just these two). A state holds, for each place where a coming token may still
begin, the last token before it and the node that the bytes since lead to in the tree of all tokens. A step (state,
byte) gives the next state, which knows the last token of the prefix so far. Tokens are emitted once all places of the
state agree on them; this is looked at whenever as many bytes as the longest token has have come, so the lookahead is
bounded by a multiple of that. Pieces shorter than this lookahead, nearly all, are emitted at their end, from the last
tokens backwards. States and steps are made when first met, and are then a table look-up.

Decoding. Ids come in runs; the state between runs is that of an incremental UTF-8 machine, the bytes of an unfinished
character. Bytes that are no UTF-8 give U+FFFD, as usual.

Defined results: a null text is encoded as the empty text (no ids). Special tokens are ordinary text. Rows that repeat
are encoded each; other columns stay. ``ids`` and ``decoded`` replace columns of these names.
"""

from __future__ import annotations

import base64
import codecs
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, kept_caches

#: States and steps that a worker keeps at most; then it starts anew. Of pieces, this many since the last turn and as many from before it. Results don't depend on it.
KEPT_STATES, KEPT_STEPS, KEPT_PIECES = 120_000, 300_000, 200_000
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class Transducer:
    """Encodes a piece by the ranks of merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.token = ranks, {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.beside: dict[int, bool] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        # The tree of tokens: node << 8 | byte to the next node; by node, the token that ends there, or -1, and whether it has further ones.
        self.next: dict[int, int] = {}
        ends: dict[int, int] = {}
        for data, i in ranks.items():
            node = 0
            for byte in data:
                node = self.next.setdefault(node << 8 | byte, len(self.next) + 1)
            ends[node] = i
        self.ends = [ends.get(node, -1) for node in range(len(self.next) + 1)]
        self.inner = bytearray(len(self.next) + 1)
        for key in self.next:
            self.inner[key >> 8] = 1
        self.longest = max(map(len, ranks), default=0)
        self.clear()

    def clear(self) -> None:
        # A state: node and last token by turns, for each place where a coming token may begin, the farthest first.
        start = (0, -1)
        self.ids = {start: 0}
        self.states = [start]
        self.last = [-1]  # of each state, the last token of what is read
        self.steps: dict[int, int] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; None for one byte, or where merges never make it."""
        if token not in self.splits:
            parts = [self.token[token][i : i + 1] for i in range(len(self.token[token]))]
            while len(parts) > 2:
                best, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if best == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.splits[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.splits[token]

    def may_follow(self, last: int, token: int) -> bool:
        """Whether merges leave last and token as they are, side by side.

        They don't if, on the way to either, a merge across the border comes first. The tokens at the border are undone
        merge by merge, the latest first; at each point the merge across must be later than the one that was undone.
        """
        if last < 0:  # the start of a piece
            return len(self.token[token]) == 1 or self.halves(token) is not None
        key = last << 20 | token
        known = self.beside.get(key)
        if known is None:
            known = self.beside[key] = self.may_follow(-1, token) and self._apart(last, token)
        return known

    def _apart(self, left: int, right: int) -> bool:
        limit, rank, token, splits = NEVER, self.ranks.get, self.token, self.splits
        while True:
            across = rank(token[left] + token[right])
            if across is not None and across < limit:
                return False
            # Of the two, the one that was merged later is undone; a merge on the left comes first where both are the same.
            of_left = splits[left] if left in splits else self.halves(left)
            of_right = splits[right] if right in splits else self.halves(right)
            if of_left and (left > right or not of_right):
                limit, left = left, of_left[1]
            elif of_right:
                limit, right = right + 1, of_right[0]
            else:
                return True

    def step(self, state: int, byte: int) -> int:
        """The next state."""
        new, found = [], -1
        children, inner, ends, beside = self.next.get, self.inner, self.ends, self.beside
        places = iter(self.states[state])
        for node, before in zip(places, places):  # noqa: B905
            node = children(node << 8 | byte)
            if node is not None:
                if found < 0:  # the longest token that fits
                    token = ends[node]
                    if token >= 0:
                        fits = beside.get(before << 20 | token)
                        if self.may_follow(before, token) if fits is None else fits:
                            found = token
                if inner[node]:
                    new.append(node)
                    new.append(before)
        new.append(0)
        new.append(found)
        new = tuple(new)
        i = self.ids.get(new)
        if i is None:
            i = self.ids[new] = len(self.states)
            self.states.append(new)
            self.last.append(found)
        return i

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """The tokens of a piece that comes byte by byte. A token is emitted once nothing that follows can change it, which is looked at whenever as many bytes as the longest token has have come; twice as many are held at most, and what a state leaves open."""
        every, read = max(self.longest, 1), []
        state = self._start()
        for byte in data:
            state = self._next(state, byte)
            read.append(state)
            if len(read) >= 2 * every and len(read) % every == 0:
                settled = self._settled(read)
                yield from settled
                del read[: sum(self.size[t] for t in settled)]
        yield from self._back(read, len(read))

    def _start(self) -> int:
        if len(self.steps) > KEPT_STEPS or len(self.states) > KEPT_STATES:
            self.clear()
        return 0

    def _next(self, state: int, byte: int) -> int:
        key = state << 8 | byte
        found = self.steps.get(key)
        if found is None:
            found = self.steps[key] = self.step(state, byte)
        return found

    def _back(self, read: list[int], end: int) -> list[int]:
        """The tokens of the first ``end`` bytes, by the states after each."""
        out, size, last = [], self.size, self.last
        while end > 0:
            token = last[read[end - 1]]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out

    def _settled(self, read: list[int]) -> list[int]:
        """What the encodings up to all places of a state begin with."""
        reach = self.longest if len(self.states[read[-1]]) > 2 else 0  # how far back a coming token may begin, at most
        chains = [self._back(read, len(read) - k) for k in range(min(reach + 1, len(read)))]
        out = []
        for tokens in zip(*chains, strict=False):
            if len(set(tokens)) > 1:
                break
            out.append(tokens[0])
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) >= 2 * self.longest:
            return list(self.stream(piece))
        # The lookahead covers the whole piece: nothing can be emitted before its end.
        state, steps, read = self._start(), self.steps, []
        for byte in piece:
            key = state << 8 | byte
            state = steps.get(key)
            if state is None:
                state = steps[key] = self.step(key >> 8, byte)
            read.append(state)
        return self._back(read, len(read))


class Decoder:
    """Ids to text, some at a time: feed() gives what is complete, finish() what is left. The state is that of an incremental UTF-8 machine, the bytes of an unfinished character."""

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Sequence[int], size: int = 1024) -> Iterator[str]:
        for at in range(0, len(ids), size):
            yield self.machine.decode(b"".join(map(self.token.__getitem__, ids[at : at + size])))

    def finish(self) -> str:
        left = self.machine.decode(b"", True)
        self.machine.reset()
        return left


def ascii_pattern(pattern: str) -> re.Pattern | None:
    """What finds the same in ASCII text by the standard library, which is faster there; None for a pattern with other escapes, flags or nested sets."""
    known, out, inside = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}, [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part in known:
            part = known[part] if inside else f"[{known[part]}]"
        elif part[0] == "\\" and part not in (r"\s", r"\S") or part == "[" and inside:
            return None
        elif part in "[]":
            inside = part == "["
        out.append(part)
    return None if re.search(r"\(\?[^!=:]", "".join(out)) else re.compile("".join(out), re.ASCII)


class Codec:
    """A whole text to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer, self.split = Transducer(ranks), regex.compile(pattern)
        self.split_ascii = ascii_pattern(pattern) or self.split
        self.decoder = Decoder(self.transducer.token)
        # Pieces met since the last turn, and before it: what goes on being met stays.
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        pieces = (self.split_ascii if text.isascii() else self.split).findall(text)
        if len(self.pieces) > KEPT_PIECES:
            self.pieces, self.older = {}, self.pieces
        known = self.pieces
        found = list(map(known.get, pieces))
        i = -1
        for _ in range(found.count(None)):
            i = found.index(None, i + 1)
            piece = pieces[i]
            ids = known.get(piece) or self.older.get(piece) or tuple(self.transducer.encode(piece.encode()))
            found[i] = ids
            if len(piece) <= 64:
                known[piece] = ids
        return list(chain.from_iterable(found))

    def decode(self, ids: Sequence[int]) -> str:
        return "".join(self.decoder.feed(ids)) + self.decoder.finish()


_codecs: dict[tuple[str, str], Codec] = {}
kept_caches.append(_codecs)


def codec(path: str, pattern: str) -> Codec:
    """One for each worker; the vocabulary's file is installed on every machine."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with ids (array<int>) and decoded (the text that they decode to); no shuffle, one document at a time."""
    kept = [c for c in docs.columns if c not in ("ids", "decoded") and (keep_text or c != text)]
    source = docs.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__bpe_text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)])

    def run(batches):
        claim("bpe")
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                flat, ends, back = [], [0], []
                for value in part.column(part.num_columns - 1):
                    ids = c.encode(value.as_py())
                    flat += ids
                    ends.append(len(flat))
                    back.append(c.decode(ids))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, pa.array(back, pa.string())], names=[*part.schema.names[:-1], "ids", "decoded"])

    return source.mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with decoded, for a column of ids; null ids give the empty text."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != "decoded"), T.StructField("decoded", T.StringType(), False)])
    source = df.drop("decoded")

    def run(batches):
        claim("bpe")
        c = codec(path, pattern)
        for batch in batches:
            back = [c.decode(v.as_py() or ()) for v in batch.column(batch.schema.names.index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=[*batch.schema.names, "decoded"])

    return source.mapInArrow(run, schema)
