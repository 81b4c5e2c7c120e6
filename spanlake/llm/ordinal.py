"""Ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector over hashed text features is shared by
all grades, ordered thresholds cut its line. The model is fitted on a bounded sample of rated texts
(``SAMPLE`` rows, those of smallest id hash; a model has a fixed number of weights), by proximal gradient steps with an L1 penalty, so words that say nothing weigh nothing. Scoring
reads every whole text once.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import arrow_map, text_or_empty

SAMPLE = 10_000
DIMS = 1 << 17
STEPS = 500
L1 = 1e-4
#: Share of the sample that a feature must occur in to get a weight: a rarer one only fits noise.
SUPPORT = 0.0015
#: Tail probability from which a text is selected; grades count alike in the fit, though the best one is the most common.
LEAST = 0.3
#: Tokens whose bucket a worker remembers.
MEMORY = 200_000
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")


@dataclass(frozen=True)
class Model:
    """Weights of the hashed features and ascending thresholds; grades are 0 .. len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: float) -> list[float]:
        """Probability of each grade."""
        upto = [1 / (1 + math.exp(min(700.0, max(-700.0, score - t)))) for t in self.thresholds] + [1.0]
        return [b - a for a, b in zip([0.0, *upto[:-1]], upto, strict=True)]


@functools.lru_cache(maxsize=MEMORY)
def bucket(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode()) % DIMS


def counts(text: str) -> Counter:
    """Token counts, with marks for shouting, doubled words and joined symbols."""
    tokens = _TOKEN.findall(text)
    found = Counter(t.lower() for t in tokens)
    capitals = sum(t.isupper() and len(t) > 1 for t in tokens)
    doubled = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    n = max(1, len(tokens))
    for name, k in (("capitals", capitals), ("doubled", doubled), ("symbols", sum(not t[0].isalnum() for t in tokens))):
        for part in (0.05, 0.15, 0.3, 0.6):
            if k > part * n:
                found[f"\x00{name}>{part}"] = n  # a full-strength feature
    return found


def features(text: str) -> tuple[list[int], list[float]]:
    """Buckets and values; a token's value grows with the logarithm of its count against the length's."""
    found = counts(text)
    scale = 1 / math.log1p(max(3, sum(found.values())))
    pairs: dict[int, float] = {}
    for token, k in found.items():
        b = bucket(token)
        pairs[b] = pairs.get(b, 0.0) + (1.0 if token[0] == "\x00" else math.log1p(k) * scale)
    return list(pairs), list(pairs.values())


def _design(rated: DataFrame) -> list[tuple[int, list[int], list[float]]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column(0)]
            yield pa.record_batch([batch.column(1), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))], names=["grade", "at", "value"])

    table = arrow_map(rated.select("text", "grade"), run, "grade int, at array<int>, value array<float>").toArrow()
    return list(zip(table["grade"].to_pylist(), table["at"].to_pylist(), table["value"].to_pylist(), strict=True))


def rated_sample(docs: DataFrame, ratings: DataFrame, grades: int, sample: int) -> DataFrame:
    """text and grade of the ``sample`` ids of smallest hash that have both: one row for an id, so the bound holds whatever repeats."""
    held = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    graded = ratings.filter("doc_id is not null").select("doc_id", F.col("grade").cast("int").alias("grade")).filter(F.col("grade").between(0, grades - 1))
    graded = graded.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = graded.join(held.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return held.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("grade").alias("grade")).select("text", "grade")  # at most ``sample`` small rows are broadcast


def fit(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = SAMPLE, steps: int = STEPS, l1: float = L1) -> Model:
    """Fit on at most ``sample`` rows of ``docs`` (doc_id, text) rated by ``ratings`` (doc_id, grade in 0 .. grades - 1).

    Null ratings, ids and texts are left out, and ratings outside the grades. Of conflicting ratings of
    one id the lowest counts, of several texts the first in order; ratings without a text and texts
    without a rating have no part. Without ratings the model has no weights and evenly spaced
    thresholds around its start.
    """
    rows = _design(rated_sample(docs, ratings, grades, sample))
    rows.sort()  # sums don't depend on the order in which rows came
    cuts = np.linspace(-1.0, 1.0, grades - 1) if grades > 2 else np.zeros(1)
    weights = np.zeros(DIMS)
    if not rows:
        return Model(weights, cuts)
    y = np.array([r[0] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    at = np.concatenate([np.array(r[1], np.int64) for r in rows])
    value = np.concatenate([np.array(r[2], np.float64) for r in rows])
    used, col, held = np.unique(at, return_inverse=True, return_counts=True)
    often = held >= max(3, SUPPORT * len(rows))
    used, keep = used[often], often[col]
    row, value, col = row[keep], value[keep], (np.cumsum(often) - 1)[col[keep]]
    balance = len(y) / (grades * np.maximum(1, np.bincount(y, minlength=grades)))[y]
    balance = np.minimum(balance, 10.0)
    w, second, gaps = np.zeros(len(used)), np.full(len(used), 1e-8), np.diff(cuts)
    first, sq = float(cuts[0]), np.full(grades - 1, 1e-8)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(steps):
        cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, value * w[col], len(rows))
        high = np.where(y < grades - 1, sigmoid(cuts[np.minimum(y, grades - 2)] - score), 1.0)
        low = np.where(y > 0, sigmoid(cuts[np.maximum(y - 1, 0)] - score), 0.0)
        p = np.maximum(high - low, 1e-9)
        dh, dl = high * (1 - high) / p * balance, low * (1 - low) / p * balance  # d log p by each cut
        slope = (dh - dl) / len(rows)  # of -log p by the score
        grad = np.bincount(col, value * slope[row], len(used))
        second += grad**2
        rate = 0.5 / np.sqrt(second)
        w = w - rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0.0)
        cut_grad = -(np.bincount(np.minimum(y, grades - 2)[y < grades - 1], dh[y < grades - 1], grades - 1) - np.bincount(y[y > 0] - 1, dl[y > 0], grades - 1)) / len(rows)
        moves = np.array([cut_grad[k:].sum() for k in range(grades - 1)])
        sq += moves**2
        moves = 0.5 * moves / np.sqrt(sq)
        first -= float(moves[0])
        gaps = np.maximum(gaps - moves[1:], 0.05)
    weights[used] = w
    return Model(weights, first + np.concatenate([[0.0], np.cumsum(gaps)]))


def score(docs: DataFrame, model: Model, tail: int) -> DataFrame:
    """doc_id, score, expected_grade and tail_probability (of grade ``tail`` or better) of each row.

    Null and empty texts have score 0; a null doc_id stays null; rows are kept as they come, repeated
    ones too; texts of any length are scored whole; an empty table gives none. Other columns are dropped.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        heavy: dict[str, float] = {}
        for batch in batches:
            out = [[], [], []]
            for text in batch.column(1):
                found = counts(text.as_py())
                scale = 1 / math.log1p(max(3, sum(found.values())))
                total = 0.0
                for token, k in found.items():
                    weight = heavy.get(token)
                    if weight is None:
                        if len(heavy) >= MEMORY:
                            heavy.clear()
                        weight = heavy[token] = float(model.weights[bucket(token)])
                    if weight:
                        total += weight * (1.0 if token[0] == "\x00" else math.log1p(k) * scale)
                chances = model.probabilities(total)
                for o, v in zip(out, (total, sum(k * p for k, p in enumerate(chances)), sum(chances[tail:])), strict=True):
                    o.append(round(v, 9))
            yield pa.record_batch([batch.column(0), *(pa.array(o, pa.float64()) for o in out)], names=["doc_id", "score", "expected_grade", "tail_probability"])

    return arrow_map(docs.select("doc_id", text_or_empty().alias("text")), run, "doc_id long, score double, expected_grade double, tail_probability double")


def select(docs: DataFrame, ratings: DataFrame, grades: int = 3, tail: int | None = None, least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """Fit on the rated texts, score all, and mark as ``kept`` those whose tail probability is at least ``least``."""
    tail = grades - 1 if tail is None else tail
    return score(docs, fit(docs, ratings, grades, sample), tail).withColumn("kept", F.col("tail_probability") >= least)
