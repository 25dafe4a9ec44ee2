import hashlib
import random

from tracelode.llm import line_dedup as L

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, min_docs=2):
    owners = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            owners.setdefault(key(line), set()).add(2**63 if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        d = 2**63 if d is None else d
        kept = [x for x in lines if len(key(x)) < 10 or len(owners[key(x)]) < min_docs or min(owners[key(x)]) == d]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n_lines int")
    return sorted((r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in L.dedup_lines(df, **options).collect())


def corpus():
    r = random.Random(1)
    lines = ["", "short", "  A line that repeats\t", "a LINE that repeats", "Ünïcode line É here", "ünïcode line É here", "nine char", "ten chars!", "\x0b ten chars!\r", "x" * 5000]
    rows = [(i, "\n".join(r.choice(lines + [f"own line number {i} {r.random()}"] * 6) for _ in range(r.randint(0, 12)))) for i in range(120)]
    return rows + [(None, "a line that repeats\nshort"), (200, None), (201, ""), rows[5], rows[5], (7, "another text of 7\nten chars!")]


def test_against_a_plain_loop(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_higher_threshold(spark):
    rows = corpus()
    assert run(spark, rows, min_docs=9) == brute(rows, 9)


def test_other_columns_stay_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a\nb", "q")], "doc_id long, text string, extra string")
    assert L.dedup_lines(df).columns == ["doc_id", "text", "extra", "n_lines", "n_dropped"]
    assert L.dedup_lines(df.limit(0)).collect() == []
