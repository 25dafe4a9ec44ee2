"""Shaping of generated text: labels, trailers, chunks and completions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelode.functions import text as T

# What ends a rewrite, and what is junk at its end.
FENCE = r"^\s*```"
FINAL_ANSWER = r"(?i)^\s*(?:#{1,6}\s*)?\**\s*final\s+answer\b"
BOXED = r"\\boxed\{"
JUNK = r"^\s*(?:-{3,}|\*{3,}|_{3,}|\$\$|```)\s*$"
CHUNK_MARK = r"\n(?:COMPACT CHUNK|ORIGINAL CHUNK)\s*\d+"
CONCLUSION = r"(?i)^\s*(?:⇒|=>|answer\s*[:=]|final\s+answer)"


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def rows_of(c: Column) -> Column:
    return F.split(c, r"\r\n|\r|\n", -1)


def let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_place(rows: Column, test) -> Column:
    """Where the first row that passes is, from 0; the number of rows if none does."""
    found = F.array_position(F.transform(rows, test), True)
    return F.when(found > 0, (found - 1).cast("int")).otherwise(F.size(rows))


def keep_upto_last(rows: Column, test) -> Column:
    """The rows up to the last that passes."""
    n = F.coalesce(F.array_max(F.transform(rows, lambda x, i: F.when(test(x), i + 1).otherwise(0))), F.lit(0))
    return F.slice(rows, F.lit(1), n)


def strip_labels(c: Column, markers: list[str]) -> tuple[Column, Column]:
    """Of each line the first marker that it begins with goes, and white space after it; what is before stays. And how many went."""
    return replace_labels(c, [(m, None) for m in markers])


def replace_labels(c: Column, pairs: list[tuple[str, str | None]]) -> tuple[Column, Column]:
    """Of each line the first label that it begins with gives way to another; None takes it away."""

    def line(x: Column) -> Column:
        body = lstrip(x)
        out = body
        for old, new in reversed(pairs):
            rest = lstrip(F.substring(body, F.lit(len(old) + 1), F.length(body)))
            out = F.when(F.startswith(body, F.lit(old)), rest if new is None else T.strip(F.concat(F.lit(new + " "), rest))).otherwise(out)
        return F.concat(F.substring(x, F.lit(1), F.length(x) - F.length(body)), out)

    def hit(x: Column) -> Column:
        out = F.lit(False)
        for old, _ in pairs:
            out |= F.startswith(lstrip(x), F.lit(old))
        return out

    rows = F.split(c, "\n", -1)
    return F.array_join(F.transform(rows, line), "\n"), F.size(F.filter(rows, hit))


def without_chunk_marks(c: Column) -> Column:
    """Up to the first mark of a chunk; lines without white space at their ends, blank ones left out."""
    rows = F.transform(rows_of(T.strip(F.get(F.split(c, CHUNK_MARK, 2), F.lit(0)))), rstrip)
    return F.array_join(F.filter(rows, lambda x: T.strip(x) != ""), "\n")


def one_shot(c: Column) -> Column:
    """struct(text, flags): a rewrite without its fence and all that follows it, without a final answer or a box and what follows, without junk at the end, indented by as little as possible; and what was found."""
    top = F.regexp_replace(F.regexp_replace(c, r"^\n+|\n+$", ""), r"(?U)\s+$", "")
    rows = F.filter(rows_of(top), lambda x: x.isNotNull())
    skip = first_place(rows, lambda x: T.strip(x) != "")

    def opened(body: Column) -> Column:
        return F.when(F.get(body, F.lit(0)).rlike(FENCE), F.slice(body, F.lit(2), F.size(body))).otherwise(body)

    def cut(body: Column) -> Column:
        fence = first_place(body, lambda x: x.rlike(FENCE))
        inner = F.slice(body, F.lit(1), fence)
        trailer = F.when(fence < F.size(body) - 1, F.lit("fence_trailer"))

        def told(inner: Column) -> Column:
            at = first_place(inner, lambda x: x.rlike(FINAL_ANSWER) | x.rlike(BOXED))
            line = F.get(inner, at)
            flag = F.when(line.rlike(BOXED), F.lit("boxed_in_think")).when(line.isNotNull(), F.lit("final_answer_trailer"))
            left = F.filter(F.transform(keep_upto_last(F.slice(inner, F.lit(1), at), lambda x: ~x.rlike(JUNK)), rstrip), lambda x: T.strip(x) != "")

            def out(left: Column) -> Column:
                indent = F.array_min(F.transform(left, lambda x: F.length(x) - F.length(lstrip(x))))
                found = F.array_compact(F.array(trailer, flag))
                flags = F.when((F.size(left) == 0) & (F.size(found) == 0), F.array(F.lit("empty"))).otherwise(found)
                return F.struct(F.array_join(F.transform(left, lambda x: F.substring(x, indent + 1, F.length(x))), "\n").alias("text"), flags.alias("flags"))

            return let(left, out)

        return let(inner, told)

    return let(F.slice(rows, skip + 1, F.size(rows)), lambda body: let(opened(body), cut))


def chunks_by_size(c: Column, most: int) -> Column:
    """Paragraphs packed into chunks of about ``most`` tokens (a token for each four characters); a paragraph beyond it comes sentence by sentence. A fold over the pieces of one text."""
    tokens = lambda x: F.greatest(F.lit(1), F.floor(F.length(x) / 4).cast("int"))
    parts = F.filter(F.transform(F.split(c, r"\n(?U)\s*\n"), T.strip), lambda x: x != "")
    piece = lambda x, sep: F.struct(x.alias("x"), F.lit(sep).alias("sep"))
    pieces = F.flatten(F.transform(parts, lambda p: F.when(tokens(p) > most, F.transform(F.split(p, r"(?U)(?<=[.!?])\s+"), lambda s: piece(s, " "))).otherwise(F.array(piece(p, "\n\n")))))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        full = (a["cur"] != "") & (a["n"] + tokens(p["x"]) > most)
        joined = F.when(a["cur"] == "", p["x"]).otherwise(T.strip(F.concat(a["cur"], p["sep"], p["x"])))
        cur = F.when(full, p["x"]).otherwise(joined)
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]).alias("done"), cur.alias("cur"), tokens(cur).alias("n"))

    return F.aggregate(pieces, zero, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))


def dealt(chunks: Column, most: int) -> Column:
    """At most ``most`` chunks: chunk i joins bucket i modulo most."""
    buckets = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda b: F.array_join(F.filter(chunks, lambda x, i: i % most == b), "\n\n"))
    return F.when(F.size(chunks) <= most, chunks).otherwise(buckets)


def without_conclusion(c: Column) -> Column:
    """Blank lines and conclusions at the end go; a conclusion before other lines stays."""
    return F.array_join(keep_upto_last(rows_of(rstrip(c)), lambda x: ~((T.strip(x) == "") | x.rlike(CONCLUSION))), "\n")


def completion(think: Column, answer: Column) -> Column:
    return F.concat(F.lit("<think>\n"), think, F.lit("\n</think>\n\n"), answer)


def family(topic: Column, source: Column) -> Column:
    """The second part of a path of topics, else the source."""
    parts = F.split(F.coalesce(topic, F.lit("")), "->")
    return F.coalesce(T.strip(F.get(parts, F.lit(1))), F.when(source != "", source), F.lit("_"))


def year(*values: Column, name: Column) -> Column:
    """The first year that is given, else four digits that a name begins with, else 0."""
    return F.coalesce(*(v.cast("int") for v in values), F.regexp_extract(F.coalesce(name, F.lit("")), r"^(\d{4})", 1).try_cast("int"), F.lit(0))


def audit_verdict(audit: Column) -> Column:
    """An audit (struct of flags and a quality) passes if nothing says that a self-correction was lost (null says nothing), and all else is said to hold."""
    held = F.coalesce(audit["faithful"], F.lit(False)) & F.coalesce(audit["preserves_load_bearing"], F.lit(False)) & F.coalesce(audit["compact_register"], F.lit(False)) & (F.coalesce(audit["compression_quality"], F.lit(0)) >= 3)
    return F.when(F.coalesce(~audit["preserves_self_correction"], F.lit(False)), "fail").when(held, "pass").otherwise("fail")
