"""Toxic passages by maximum-scoring segments.

Words and beginnings of words get log-odds of standing in a toxic document, under a symmetric Dirichlet prior in each class; a word's score is that of its most significant part, less a constant drift. One pass over the scores finds
all maximal segments (Ruzzo and Tompa). The best segment of ordinary text follows an extreme-value law, fitted on clean
documents: it turns a segment's score and the text's length into a p-value, and a logistic curve turns that into a score
between 0 and 1.

The model is fitted on ``SAMPLE`` labelled documents at most; labels decide nothing else.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .arrow import blocks, map_rows

#: Labelled documents that the model is fitted on, those of the least hash of their id.
SAMPLE = 8000
#: Beginnings of words, in bytes.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Weight of the prior, in counts; least documents with a part; least significance of a part, in standard deviations.
PRIOR, LEAST, SIGNIFICANT = 0.5, 4, 3.5
#: What each word costs a segment, beyond what clean words score on average; p-value of a passage that is reported.
DRIFT, PASSAGE = 0.1, 0.01


@dataclass
class Model:
    """Parts (hashes, ascending) with log-odds and significance, the extreme-value law and the logistic curve."""

    parts: np.ndarray
    odds: np.ndarray
    sure: np.ndarray
    rate: float = 1.0
    size: float = 1.0
    shift: float = -4.0
    slope: float = 1.0
    drift: float = 0.1

    def evidence(self, score: float, n: int) -> float:
        """-log of the p-value of a best segment of this score in ``n`` words."""
        if score <= 0 or not n:
            return 0.0
        expected = self.size * n * math.exp(-self.rate * score)
        return -math.log(max(-math.expm1(-expected), 1e-300))

    def least(self, n: int) -> float:
        """Just below the least score whose p-value in ``n`` words is ``PASSAGE``."""
        return math.log(self.size * n / -math.log1p(-PASSAGE)) / self.rate - 1e-6

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.shift + self.slope * evidence))))


def word_scores(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Log-odds of each word less the drift; a word that only repeats the one before it in its text adds nothing."""
    out = np.zeros(len(starts))
    if len(model.parts):
        best = np.zeros(len(starts))
        for column in W.prefix_hashes(data, starts, ends, PREFIXES).T:
            at = np.minimum(np.searchsorted(model.parts, column), len(model.parts) - 1)
            better = (model.parts[at] == column) & (np.abs(model.sure[at]) > best)
            out[better] = model.odds[at[better]]
            best[better] = np.abs(model.sure[at[better]])
        whole = W.hashes(data, starts, ends)
        again = np.zeros(len(starts), bool)
        again[1:] = whole[1:] == whole[:-1]
        again[begin[begin < len(starts)]] = False
        out[again & (out > 0)] = 0
    return out - model.drift


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, after the last, score), in one pass (Ruzzo and Tompa).

    A candidate keeps the place of the last one before it that has a smaller sum to its left, so that a search steps over all
    between; candidates before a new least sum are final. Neighbouring positive scores are one segment in any case.
    """
    up = scores > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]])))
    if not len(edge):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])[edge].tolist()
    edge, done, found = edge.tolist(), [], []  # found: first, after the last, sum before it, sum up to its end, place
    for k in range(0, len(edge), 2):
        first, left, right, j = edge[k], total[k], total[k + 1], len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0:
                done += found
                found = []
                break
            if found[j][3] >= right:
                break
            first, _, left, _, before = found[j]
            del found[j:]
            j = before
        found.append((first, edge[k + 1], left, right, j))
    return [(a, b, right - left) for a, b, left, right, _ in done + found]


def _documents(batch, text: str):
    """Words of each block: bytes, starts, ends, where the words of each row begin."""
    for low, high, data, offsets in blocks(batch.column(text)):
        data = W.LOWER[data]
        starts, ends, row = W.find(data, offsets, W.LETTERS)
        yield low, high, data, starts, ends, np.searchsorted(row, np.arange(high - low + 1))


def training_rows(docs: DataFrame, labels: DataFrame, *, id_: str, text: str, label: str) -> DataFrame:
    """text and toxic of the sample; the list of ids, ``SAMPLE`` at most, is broadcast."""
    chosen = (labels.where(F.col(label).isNotNull() & F.col(id_).isNotNull() & (held_out(F.col(id_)) == F.lit(False)))
              .groupBy(F.col(id_).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
              .orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE))
    return docs.select(F.col(id_).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id").select("text", "toxic")


def held_out(id_):
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, id_: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """The model, or None without documents of both classes."""
    rows = training_rows(docs, labels, id_=id_, text=text, label=label)
    count = T.StructType([T.StructField("part", T.LongType()), T.StructField("bad", T.LongType()), T.StructField("good", T.LongType())])

    def work(batch):
        toxic, parts, marks = np.array(batch.column(1).to_pylist()), [], []
        for low, high, data, starts, ends, begin in _documents(batch, "text"):
            hashed = W.prefix_hashes(data, starts, ends, PREFIXES)
            for k in range(high - low):
                own = np.unique(hashed[begin[k]:begin[k + 1]])
                own = own[own != 0]
                parts.append(own)
                marks.append(np.full(len(own), toxic[low + k]))
        part, mark = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (parts, marks))
        part, inverse = np.unique(part, return_inverse=True)
        bad = np.bincount(inverse, mark, minlength=len(part)).astype(np.int64)
        return {"part": part.view(np.int64), "bad": bad, "good": np.bincount(inverse, minlength=len(part)) - bad}

    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    n_bad, n_good = n[1], n[0]
    a, b = F.col("bad") + F.lit(PRIOR), F.col("good") + F.lit(PRIOR)
    parts = (map_rows(rows, work, count, text="text").groupBy("part").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
             .where(F.col("bad") + F.col("good") >= LEAST)
             .select("part", (F.log(a / (n_bad + PRIOR - F.col("bad"))) - F.log(b / (n_good + PRIOR - F.col("good")))).alias("odds"),
                     F.sqrt(1 / a + 1 / b).alias("spread"))
             .where(F.abs(F.col("odds")) >= SIGNIFICANT * F.col("spread")).collect())
    part = np.array([r["part"] for r in parts], np.int64).view(np.uint64)
    order = np.argsort(part)
    odds = np.array([r["odds"] for r in parts], float)
    model = Model(part[order], odds[order], (odds / np.array([r["spread"] for r in parts], float))[order])
    calibrate(model, rows)
    return model


def calibrate(model: Model, rows: DataFrame) -> None:
    """Fit the drift and the extreme-value law on clean and the curve on all sample documents.

    The law needs scores that are negative on average, so the drift is ``DRIFT`` above what clean words score on average, if
    that is positive. Counts of scores and one short row for each sample document come to the driver.
    """
    tally = T.StructType([T.StructField("cell", T.LongType()), T.StructField("n", T.LongType())])
    best_of = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("best", T.DoubleType())])
    model.drift = 0.0

    def counted(batch):
        parts = [np.round(word_scores(model, data, starts, ends, begin) / _CELL).astype(np.int64)
                 for _, _, data, starts, ends, begin in _documents(batch, "text")]
        cell, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
        return {"cell": cell, "n": n}

    clean = map_rows(rows.where("toxic = 0"), counted, tally, text="text").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    s, n = np.array([r["cell"] for r in clean], float) * _CELL, np.array([r["n"] for r in clean], float)
    model.drift = DRIFT + (max(0.0, float((s * n).sum() / n.sum())) if len(s) else 0.0)
    model.rate = _karlin(s - model.drift, n)

    def best(batch):
        out = {"n": [], "best": []}
        for low, high, data, starts, ends, begin in _documents(batch, "text"):
            scores = word_scores(model, data, starts, ends, begin)
            for k in range(high - low):
                own = scores[begin[k]:begin[k + 1]]
                out["n"].append(len(own))
                out["best"].append(max((s for _, _, s in segments(own)), default=0.0))
        return out | {"toxic": batch.column(1)}

    rows = map_rows(rows, best, best_of, text="text").collect()
    law = [(r["n"], r["best"]) for r in rows if not r["toxic"] and r["best"] > 0]
    if law:
        model.size = len(law) / sum(n * math.exp(-model.rate * s) for n, s in law)
    model.shift, model.slope = logistic(np.array([model.evidence(r["best"], r["n"]) for r in rows]),
                                        np.array([float(r["toxic"]) for r in rows]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Shift and slope of the curve by Newton's method; a step that does not lower the loss is halved, so it can't run away."""
    scale = float(x.std()) or 1.0
    design, beta = np.stack([np.ones(len(x)), x / scale], 1), np.zeros(2)

    def loss(b):
        z = design @ b
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * (b @ b))

    now = loss(beta)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (p - y) + ridge * beta
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), grad)
        while (after := loss(beta - step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if not after < now:
            break
        beta, now = beta - step, after
    return float(beta[0]), float(beta[1] / scale)


_CELL = 0.05


def _karlin(s: np.ndarray, n: np.ndarray) -> float:
    """The positive root of sum p(s) exp(rate s) = 1 for scores s seen n times; they are negative on average."""
    if not len(s) or s.max() <= 0 or (s * n).sum() >= 0:
        return 1.0
    low, high = 1e-6, 50.0 / s.max()
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (n * np.exp(middle * s)).sum() / n.sum() < 1 else (low, middle)
    return low


def score(docs: DataFrame, labels: DataFrame, *, id_: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """All columns of ``docs``, and score, passages (first word, last word, score, p-value of it alone), n_words.

    Null and empty texts have no passages and the score of no evidence. Without labels of both classes every score is 0.
    """
    model = fit(docs, labels, id_=id_, text=text, label=label)
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("score", T.DoubleType()),
                         T.StructField("p", T.DoubleType())])
    new = [T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(span)), T.StructField("n_words", T.LongType())]
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in new}]

    def work(batch):
        out: dict = {"score": [], "passages": [], "n_words": []}
        for low, high, data, starts, ends, begin in _documents(batch, text):
            scores = word_scores(model, data, starts, ends, begin) if model else np.zeros(len(starts))
            for k in range(high - low):
                own = scores[begin[k]:begin[k + 1]]
                n = len(own)
                all_ = segments(own)
                # evidence grows with the score, so only what may be significant needs a p-value
                least = model.least(n) if all_ else 0.0
                found = [(a, b, s, model.evidence(s, n)) for a, b, s in all_ if s >= least]
                out["score"].append(model.probability(model.evidence(max((s for *_, s in all_), default=0.0), n)) if model else 0.0)
                out["passages"].append([{"first": a, "last": b - 1, "score": s, "p": math.exp(-e)} for a, b, s, e in found if math.exp(-e) <= PASSAGE])
                out["n_words"].append(n)
        return {f.name: batch.column(f.name) for f in kept} | out

    return map_rows(docs, work, T.StructType(kept + new), text=text)


def keep_clean(docs: DataFrame, labels: DataFrame, *, most: float = 0.5, **options) -> DataFrame:
    """The documents, with their columns, whose score is below ``most``."""
    own = [c for c in ("score", "passages", "n_words") if c in docs.columns]
    held = docs.select("*", F.struct(*own).alias("_own")) if own else docs
    return score(held, labels, **options).where(F.col("score") < most).select(
        *[F.col(f"_own.{c}").alias(c) if c in own else F.col(c) for c in docs.columns])
