"""Toxic passages by maximum-scoring segments.

Fit: token log-odds between toxic and other labelled documents, with a Dirichlet prior of the tokens' overall shares.
Tokens are words and the first 3 to 8 characters of words. Those of significant and large log-odds are kept; a word
counts as the longest of them that it matches, and their log-odds are then taken anew over these words. All other words
share the log-odds of what is left, which is below 0.
Search: a linear scan finds every maximal-scoring segment of a text. Calibration: the best score of a text of n tokens
without toxicity has an extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x)); lambda solves E exp(lambda w) = 1
over the tokens of other documents, K comes from their best segments. The segments' significance is summed up, and a
logistic function of that and of the best segment's gives the score.

The model comes from at most ``max_rows`` labelled rows (those whose ids hash lowest), so it is small and goes to every
task; every document is scored, whole, where it is.

Defined results: a null or empty text has no token and gets the score of a text without segments. A document with
several labels is toxic if one says so; labels of null or of unknown documents aren't used; without labels of both
kinds the score is their smoothed share. Rows that repeat are scored each. Columns of the input stay; ``n_tokens``,
``segments``, ``score`` and ``predicted`` replace columns of these names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, discard, materialise

_token = re.compile(r"[^\W\d_]+")


def tokens_of(text: str | None) -> list[str]:
    return _token.findall(text.lower()) if text else []


def parts_of(word: str) -> list[str]:
    """What a word is counted as, the longest first."""
    return [word + "$", *(word[:k] for k in range(min(8, len(word)), 2, -1))]


class Weights(dict):
    """Log-odds by word, from those of kept tokens; 0 stands for any other word. Remembers words that were asked for."""

    def __init__(self, tokens: dict[str, float]):
        super().__init__()
        self.tokens, self.heads = tokens, {t[:3] for t in tokens}

    def __reduce__(self):
        return Weights, (self.tokens,)

    def token(self, word: str) -> str | None:
        if word[:3] in self.heads or word + "$" in self.tokens:
            return next((t for t in parts_of(word) if t in self.tokens), None)
        return None

    def __missing__(self, word: str) -> float:
        found = self.token(word)
        weight = self.tokens[found] if found else 0.0
        if len(self) > 100_000:
            self.clear()
        self[word] = weight
        return weight


@dataclass
class Model:
    weights: Weights = field(default_factory=lambda: Weights({}))
    rest: float = -1.0  # the log-odds of any token without its own
    scale: float = 1.0  # lambda
    log_k: float = 0.0
    logit: tuple[float, float, float] = (0.0, 0.0, 0.0)


def maximal_segments(places: list[int], scores: list[float], rest: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence that has ``scores`` at ``places`` and ``rest`` (below 0) elsewhere; in linear time.

    Each candidate knows the sum before it, the sum to its end, and the nearest one to its left with a lower sum before it.
    """
    out: list[list] = []  # first, last, sum before, sum to the end, nearest to the left
    total, at = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        total += rest * (place - at)
        at = place + 1
        if score <= 0:
            total += score
            continue
        new = [place, place, total, total + score, -1]
        total += score
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= new[3]:
                new[4] = j
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3], -1]
            del out[j:]
    return [(a, b, end - before) for a, b, before, end, _ in out]


def features(tokens: list[str], model: Model) -> tuple[list[tuple[int, int, float, float]], float, float]:
    """The segments (first, last, score, log of 1 / P), the best one's log of 1 / P, and the sum over what is significant."""
    weights = list(map(model.weights.__getitem__, tokens))
    places = [i for i, w in enumerate(weights) if w]
    if not places:
        return [], 0.0, 0.0
    base = model.log_k + math.log(len(tokens))
    found, best, total = [], 0.0, 0.0
    for a, b, s in maximal_segments(places, [weights[i] for i in places], model.rest):
        excess = model.scale * s - base
        # -log(1 - exp(-exp(-excess))): about the excess itself where that is large
        surprise = excess if excess > 30 else -math.log(max(-math.expm1(-math.exp(-excess)), 1e-300))
        found.append((a, b, s, surprise))
        best, total = max(best, surprise), total + max(0.0, excess)
    return found, best, total


def score_of(best: float, total: float, model: Model) -> float:
    a, b, c = model.logit
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * best + c * total))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text and toxic of at most max_rows labelled documents."""
    few = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("__tx_id")).agg(F.max(F.col("toxic").cast("int")).alias("__tx_toxic"))
    few = few.orderBy(F.xxhash64("__tx_id"), "__tx_id").limit(max_rows)
    # max_rows rows of two numbers: the size is bounded by the parameter
    return docs.select(F.col("doc_id").alias("__tx_doc"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), F.col("__tx_doc") == F.col("__tx_id")).select("text", F.col("__tx_toxic").alias("toxic"))


def _counts(rows: DataFrame, kept: Weights | None = None) -> DataFrame:
    """token, other and toxic: the documents with it by kind, or the words that count as it if tokens are kept; a null token has the sums."""
    sent = rows.sparkSession.sparkContext.broadcast(kept)

    def run(batches):
        claim("toxicity")
        for batch in batches:
            held: dict[str | None, list[int]] = {None: [0, 0]}
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                words, kind = tokens_of(text.as_py()), int(toxic.as_py() > 0)
                tokens = {t for w in set(words) for t in parts_of(w)} if sent.value is None else [t for w in words if sent.value[w] and (t := sent.value.token(w))]
                for t in tokens:
                    held.setdefault(t, [0, 0])[kind] += 1
                held[None][kind] += len(tokens) if sent.value is None else len(words)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names=["token", "other", "toxic"])

    return rows.select("text", "toxic").mapInArrow(run, "token string, other long, toxic long").groupBy("token").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, prior: float = 500.0, least: float = 0.5, min_docs: int = 5, min_log_odds: float = 1.0, min_z: float = 4.0) -> Model:
    """A model from at most max_rows labelled documents; the Dirichlet prior is ``prior`` times a token's share, plus ``least``."""
    rows = materialise(training_rows(docs, labels, max_rows), "labelled")
    kinds = {int(r["toxic"] > 0): r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    model = Model()
    share = (kinds.get(1, 0) + 1) / (sum(kinds.values()) + 2)
    model.logit = (math.log(share / (1 - share)), 0.0, 0.0)
    if len(kinds) == 2:
        counts = materialise(_counts(rows).filter((F.col("other") + F.col("toxic") >= min_docs) | F.col("token").isNull()), "tokens")
        sums = counts.filter("token is null").first()
        n0, n1 = sums["other"], sums["toxic"]
        if n0 and n1:
            a = F.lit(prior) * (F.col("other") + F.col("toxic")) / (n0 + n1) + least
            odds = lambda y, n: F.log(F.try_divide(y + a, n + prior - y))
            z = counts.filter(F.col("token").isNotNull()).select("token", (odds(F.col("toxic"), n1) - odds(F.col("other"), n0)).alias("w"), F.sqrt(F.try_divide(F.lit(1.0), F.col("toxic") + a) + F.try_divide(F.lit(1.0), F.col("other") + a)).alias("sd"))
            # at most the vocabulary of max_rows documents
            kept = {r["token"]: float(r["w"]) for r in z.filter((F.col("w") >= min_log_odds) & (F.col("w") >= min_z * F.col("sd"))).collect()}
            if kept:
                _calibrate(model, rows, kept, prior, least)
        discard(counts)
    discard(rows)
    return model


def _calibrate(model: Model, rows: DataFrame, kept: dict[str, float], prior: float, least: float) -> None:
    counts = {r["token"]: (r["other"], r["toxic"]) for r in _counts(rows, Weights(kept)).collect()}
    n0, n1 = counts.pop(None)
    share = {t: prior * (y0 + y1) / (n0 + n1) + least for t, (y0, y1) in counts.items()}
    p0 = {t: (y0 + share[t]) / (n0 + prior) for t, (y0, y1) in counts.items()}
    p1 = {t: (y1 + share[t]) / (n1 + prior) for t, (y0, y1) in counts.items()}
    tokens = {t: math.log(p1[t] / p0[t]) for t in counts if p1[t] > 1.5 * p0[t]}
    if not tokens:
        return
    q0, q1 = sum(p0[t] for t in tokens), sum(p1[t] for t in tokens)
    model.weights = Weights(tokens)
    model.rest = min(-1e-3, math.log(max(1e-9, 1 - q1) / max(1e-9, 1 - q0)))
    ws = np.array([*tokens.values(), model.rest])
    ps = np.array([*(p0[t] for t in tokens), 1 - q0])
    low, high = 1e-6, 1.0
    while (ps * np.exp(np.minimum(high * ws, 700))).sum() < 1 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (ps * np.exp(np.minimum(mid * ws, 700))).sum() < 1 else (low, mid)
    model.scale, model.log_k = low, 0.0
    got = _measure(rows, model)  # a row of five numbers for each of at most max_rows documents
    y, n, raw = (np.array([r[k] for r in got], float) for k in ("toxic", "n", "raw"))
    clean = (y == 0) & (n > 0) & (raw > 0)
    if clean.any():  # the Gumbel law's mean is log K + Euler's constant; fitted where there is a segment at all
        model.log_k = float(np.mean(model.scale * raw[clean] - np.log(n[clean]))) - 0.5772156649
    got = _measure(rows, model)
    y, best, total = (np.array([r[k] for r in got], float) for k in ("toxic", "best", "total"))
    model.logit = tuple(map(float, _logistic(np.stack([np.ones_like(best), best, total], 1), (y > 0).astype(float))))


def _measure(rows: DataFrame, model: Model) -> list:
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        claim("toxicity")
        for batch in batches:
            out = []
            for text in batch.column(0):
                tokens = tokens_of(text.as_py())
                found, best, total = features(tokens, sent.value)
                out.append((len(tokens), max((s[2] for s in found), default=0.0), best, total))
            n, raw, best, total = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(raw, pa.float64()), pa.array(best, pa.float64()), pa.array(total, pa.float64())], names=["toxic", "n", "raw", "best", "total"])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, n long, raw double, best double, total double").collect()


NEW = ("n_tokens", "segments", "score", "predicted")


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, segments (first and last token, score, log of 1 / P), score and predicted."""
    source = docs.select(*[c for c in docs.columns if c not in NEW and (keep_text or c != "text")], F.col("text").cast("string").alias("__tx_text"))
    segment = T.StructType([T.StructField("first", T.IntegerType(), False), T.StructField("last", T.IntegerType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("surprise", T.DoubleType(), False)])
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_tokens", T.LongType(), False), T.StructField("segments", T.ArrayType(segment, False), False), T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([pa.field("first", pa.int32(), False), pa.field("last", pa.int32(), False), pa.field("score", pa.float64(), False), pa.field("surprise", pa.float64(), False)]))

    def run(batches):
        claim("toxicity")
        for batch in batches:
            n, segments, scores = [], [], []
            for text in batch.column(batch.num_columns - 1):
                tokens = tokens_of(text.as_py())
                found, best, total = features(tokens, sent.value)
                n.append(len(tokens))
                segments.append([{"first": a, "last": b, "score": s, "surprise": p} for a, b, s, p in found])
                scores.append(score_of(best, total, sent.value))
            new = [pa.array(n, pa.int64()), pa.array(segments, kind), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *NEW])

    return source.mapInArrow(run, schema)
