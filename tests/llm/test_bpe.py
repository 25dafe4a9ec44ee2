import random

import public_tokenizers
import tiktoken

from tracelode.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = ["", " ", "Hello, world!", "  two  spaces \n\n\tand tabs\r\n", "élève ñandú Straße 漢字 🙂🙃", "<|endoftext|>", "a" * 3000, " " * 500, "=-" * 300, "12345 6789's don't we'LL", "\x00​﻿", "é"]


def test_against_the_library():
    ranks = bpe.read_ranks(PATH)
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.Codec(ranks, PATTERN)
    r = random.Random(2)
    letters = " \n\t aàéß漢🙂bcdefgh12--==_'́\x00"
    texts = TEXTS + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        ids = ours.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert ours.decode(ids) == t


def test_states_are_dropped_when_there_are_many(monkeypatch):
    ranks = bpe.read_ranks(PATH)
    whole, small = bpe.Codec(ranks, PATTERN), bpe.Codec(ranks, PATTERN)
    want = [whole.encode(t) for t in TEXTS]
    monkeypatch.setattr(bpe, "KEPT_STATES", 5)
    monkeypatch.setattr(bpe, "KEPT_STEPS", 5)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 2)
    assert [small.encode(t) for t in TEXTS] == want
    assert [small.decode(i) for i in want] == TEXTS


def test_decoding_any_ids():
    ranks = bpe.read_ranks(PATH)
    token = {i: b for b, i in ranks.items()}
    r = random.Random(3)
    d = bpe.Decoder(token)
    for _ in range(500):
        ids = [r.randrange(len(token)) if r.random() < 0.5 else r.randrange(256) for _ in range(r.randint(0, 30))]
        got = "".join(d.feed(ids)) + d.finish()
        assert got == b"".join(token[i] for i in ids).decode("utf-8", "replace")


def test_frames(spark):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = {r["doc_id"]: r for r in bpe.encode_decode(df, PATH, PATTERN).collect()}
    assert all(out[i]["decoded"] == (t or "") for i, t, _ in rows) and out[len(TEXTS)]["ids"] == []
    back = bpe.decode_ids(spark.createDataFrame([(1, [15496]), (2, None)], "a int, ids array<int>"), PATH, PATTERN).collect()
    assert [r["decoded"] for r in sorted(back)] == ["Hello", ""]
    assert bpe.encode_decode(df.limit(0), PATH, PATTERN).collect() == []


def test_ascii_texts_are_split_alike():
    import regex

    ours, theirs = bpe.ascii_pattern(PATTERN), regex.compile(PATTERN)
    assert ours is not None and bpe.ascii_pattern(r"\p{Lu}+") is None and bpe.ascii_pattern(r"(?i:'s)|x") is None
    r = random.Random(4)
    for _ in range(5000):
        t = "".join(chr(r.choice([r.randrange(128), 32, 39, 115, 9, 10, 28, 31, 65, 48])) for _ in range(r.randrange(14)))
        assert ours.findall(t) == theirs.findall(t)


def test_tokens_come_while_a_long_piece_is_read():
    ranks = bpe.read_ranks(PATH)
    t = bpe.Transducer(ranks)
    r = random.Random(5)
    data = bytes(r.choice(b"abcdefghij") for _ in range(20 * t.longest))
    read, seen = 0, []

    def bytes_read():
        nonlocal read
        for b in data:
            read += 1
            yield b

    for token in t.stream(bytes_read()):
        seen.append((read, len(t.token[token])))
    out = 0
    for at, size in seen:
        out += size
        assert at == len(data) or at - out < 4 * t.longest
    assert seen[0][0] < len(data) and out == len(data)
