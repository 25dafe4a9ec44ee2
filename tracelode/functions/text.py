"""Normalisation, ids and features of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of word characters in any script; Java's \w is ASCII, or has marks that others don't count.
WORD = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    """White space of any kind goes at both ends; trim() leaves line ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm_text(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def match_key(c: Column) -> Column:
    return F.lower(norm_text(c))


def match_head(c: Column, chars: int) -> Column:
    """The first characters of the match key, without working through all of a long text where its beginning is enough."""
    few = match_key(F.substring(c, 1, 5 * chars))
    return F.substring(F.when(F.length(few) > chars, few).otherwise(match_key(c)), 1, chars)


def dedup_key(c: Column) -> Column:
    return F.substring(F.sha1(norm_text(c)), 1, 16)


def uid(source: Column, c: Column) -> Column:
    return F.concat(source, F.lit(":"), F.substring(F.sha1(norm_text(c)), 1, 8))


def folded_key(c: Column) -> Column:
    """The other recipe for ids: lower case first, then strip, then collapse."""
    return F.sha1(F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), r"(?U)\s+", " "))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), 1)


def word_grams(c: Column, n: int = 8, first_chars: int | None = 400) -> Column:
    """The distinct runs of n words of the first characters of the match key (None: of all); fewer words are one run, none is no run.

    The words are bound to a variable, or each run would take them from the text again.
    """

    def runs(toks: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)), lambda i: F.array_join(F.slice(toks, i, n), " "))
        return F.when(F.size(toks) >= n, F.array_distinct(every)).when(F.size(toks) > 0, F.array(F.array_join(toks, " "))).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(words(match_key(c) if first_chars is None else match_head(c, first_chars))), runs), 1)


def hex_mod(hex32: Column, n: int) -> Column:
    """A 128-bit hexadecimal number modulo n, in two halves, as no type holds it."""
    half = lambda at: F.conv(F.substring(hex32, at, 16), 16, 10).cast("decimal(20,0)") % n
    return ((half(1) * (2**64 % n) + half(17)) % n).cast("int")


def shard(key: Column, n: int) -> Column:
    return hex_mod(F.md5(key), n)


def seed(key: Column, *parts: Column) -> Column:
    """The first 32 bits of a digest of a key and numbers."""
    return F.conv(F.substring(F.sha1(F.concat_ws(":", key, *parts)), 1, 8), 16, 10).cast("long")


def level_from_difficulty(d: Column) -> Column:
    """Rounded half up; outside 1 to 10 there is none."""
    level = F.floor(d + 0.5).cast("int")
    return F.when(level.between(1, 10), level)


def lines(c: Column) -> Column:
    """Lines without white space at their ends, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), strip), lambda x: x != "")


def chunks(c: Column) -> Column:
    """Paragraphs: parts between blank lines, blank ones left out."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "\n\n"), lambda x: strip(x) != "")


def longest_run(items: Column) -> Column:
    """The length of the longest run of equal neighbours: a fold of constant size."""
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"] == x, a["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(items, zero, step, lambda a: a["best"])


def neighbours(items: Column, test) -> Column:
    """How many neighbours (a, b) pass a test."""
    n = F.size(items)
    pairs = F.zip_with(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), F.slice(items, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: test(a, b))
    return F.size(F.filter(pairs, lambda x: x))


def word_stutter(c: Column) -> Column:
    return neighbours(words(F.coalesce(c, F.lit(""))), lambda a, b: (a == b) & (F.length(a) > 2))


def occurrences(c: Column, marker: str) -> Column:
    """How often a string is found, overlaps not counted."""
    return F.coalesce(((F.length(c) - F.length(F.replace(c, F.lit(marker), F.lit("")))) / len(marker)).cast("int"), F.lit(0))


# What loops may differ in.
TEMPLATE = (r"\$[^$]*\$", r"\\[A-Za-z]+\{[^{}]*\}", r"\([^)]*\)", r"[-+]?\d+(?:[.,]\d+)*", r"\\[A-Za-z]+")


def template(chunk: Column) -> Column:
    """The first 12 tokens without formulas, arguments, numbers and commands, in lower case: what looped text has in common."""
    t = F.array_join(F.slice(F.split(strip(chunk), r"(?U)\s+"), 1, 12), " ")
    for pattern in TEMPLATE:
        t = F.regexp_replace(t, pattern, " ")
    return strip(F.regexp_replace(F.lower(t), r"(?U)\s+", " "))


def percentile_linear(c: str, p: float) -> Column:
    """Interpolated between neighbours, as numpy does."""
    return F.percentile(c, p)


def percentile_nearest(c: str, p: float) -> Column:
    """The value at place floor(p * n), the last at most: by counts of distinct values, no list of a group's rows."""
    return F.expr(f"percentile_disc({min(p + 1e-9, 1.0)!r}) WITHIN GROUP (ORDER BY {c})")


def upper_median(c: str) -> Column:
    return percentile_nearest(c, 0.5)


# The kinds of problems by their words; the first that has one counts.
TOPICS = [
    ("geometry", r"\b(triangle|circle|angle|polygon|radius|perimeter|area of|rectangle|square|sphere|cylinder|parallel|tangent|vertex|vertices|hypotenuse|coordinates?)\b"),
    ("combinatorics", r"\b(how many ways|permutation|combination|choose|distinct arrangements|probability|binomial|factorial|subsets?|counting)\b"),
    ("number_theory", r"\b(divisor|prime|modulo|mod |remainder|gcd|lcm|integer solutions|digits?)\b"),
    ("calculus", r"\b(integral|derivative|limit|\\int|\\lim|converges?|diverges?|series|\\sum)\b"),
    ("algebra", r"\b(solve for|equation|polynomial|roots?|factor|simplify|expression|inequality|function|x\^|matrix)\b"),
]


def topic(c: Column) -> Column:
    low, out = F.lower(c), F.lit("other")
    for name, pattern in reversed(TOPICS):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out
