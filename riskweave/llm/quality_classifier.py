"""Quality by ordinal regression: a cumulative-link model on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): one set of weights for hashed words, and
ordered thresholds (the first free, the others by positive steps).  Scores are the
expected grade and the tail probability P(grade >= k) for selection.

The fit reads at most ``max_labelled`` rated documents (the bound is a parameter);
scoring is one pass over whole texts, without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweave.llm.common import Cache, staged

BUCKETS = 1 << 14
SHAPES = ("!!", "|", "#", "$", "%", "*", "&")


def slot(token: str, buckets: int) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(token) % buckets


def shape(word: str) -> str:
    """Letters to their case, digits to 9, runs shortened: how a word is written, not what it says."""
    kinds = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "9", word))
    return re.sub(r"(.)\1+", r"\1", kinds)[:12]


def features(texts: list[str | None], cache: Cache, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, values) per text: distinct hashed words and word shapes by log frequency, length one.

    Besides words there are marks for the share of repeated words and for very short texts.
    """
    out = []
    for text in texts:
        words = (text or "").split()
        both = np.array([cache[w] for w in words], np.int64)
        slots, counts = np.unique(np.concatenate([both // buckets, both % buckets]), return_counts=True)
        values = np.log1p(counts)
        repeated = int(10 * (1 - len(set(words)) / len(words))) if words else 0
        extra = np.array([slot(f"repeat {repeated}", buckets), slot(f"length {min(len(words), 1 << 20).bit_length()}", buckets)])
        norm = np.sqrt((values ** 2).sum()) or 1.0
        out.append((np.concatenate([slots, extra]), np.concatenate([values / norm, [0.5, 0.5]])))
    return out


def word_slots(buckets: int):
    """A word's slot and its shape's, in one number."""
    return lambda w: slot(w.lower(), buckets) * buckets + slot("shape " + shape(w), buckets)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray   # ascending, one less than there are grades
    grades: tuple[int, ...]
    buckets: int = BUCKETS

    def tails(self, rows) -> np.ndarray:
        """P(grade >= k) for each grade after the first, a row per text."""
        x = np.array([self.weights[s] @ v for s, v in rows])
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.thresholds[None, :], -500, 500)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], ratings: np.ndarray, buckets: int = BUCKETS, rounds: int = 200, ridge: float = 1e-4, rate: float = 0.3) -> Model:
    """Maximum likelihood by Adam on all rows at once.

    With a single grade there is no threshold: every text has that grade.
    """
    grades = tuple(sorted(set(ratings.tolist())))
    if len(grades) < 2:
        return Model(np.zeros(buckets), np.empty(0), grades or (0,), buckets)
    y = np.searchsorted(grades, ratings)
    index, value = np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])
    owner, n, k = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows]), len(rows), len(grades)
    share = np.clip(np.cumsum(np.bincount(y, minlength=k))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    # thresholds are first, first + exp(step), ...: they stay in order
    theta = np.concatenate([np.zeros(buckets), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, rounds + 1):
        w, steps = theta[:buckets], np.exp(theta[buckets + 1:])
        cuts = theta[buckets] + np.concatenate([[0.0], np.cumsum(steps)])
        x = np.bincount(owner, w[index] * value, n)
        upper = np.where(y < k - 1, sigmoid(cuts[np.minimum(y, k - 2)] - x), 1.0)
        lower = np.where(y > 0, sigmoid(cuts[np.maximum(y - 1, 0)] - x), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_x = du - dl                                     # d(-log p) / dx
        by_cut = np.bincount(np.minimum(y, k - 2), np.where(y < k - 1, -du, 0.0), k - 1) + np.bincount(np.maximum(y - 1, 0), np.where(y > 0, dl, 0.0), k - 1)
        g = np.concatenate([np.bincount(index, by_x[owner] * value, buckets) / n + ridge * w,
                            [by_cut.sum() / n], np.cumsum(by_cut[::-1])[::-1][1:] * steps / n])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate / np.sqrt(1 + t / 20) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    cuts = theta[buckets] + np.concatenate([[0.0], np.cumsum(np.exp(theta[buckets + 1:]))])
    return Model(theta[:buckets], cuts, grades, buckets)


def learn(docs: DataFrame, ratings: DataFrame, *, max_labelled: int = 6_000, buckets: int = BUCKETS) -> Model:
    """Fits on rows of docs that ``ratings`` (doc_id, grade) covers, the smallest hashes of their ids.

    NULL ids and grades are left out; of several grades of a document the lowest counts.
    """
    rated = (ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id"))
             .agg(F.min("grade").cast("int").alias("grade")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))

    def hashed(batches):
        cache = Cache(word_slots(buckets))
        for batch in batches:
            rows = features(batch.column(0).to_pylist(), cache, buckets)
            yield pa.RecordBatch.from_pydict({
                "slots": pa.array([s.astype("<i4").tobytes() for s, _ in rows], pa.binary()),
                "values": pa.array([x.astype("<f4").tobytes() for _, x in rows], pa.binary()), "grade": batch.column(1)})

    made = staged(texts.join(rated, "_id").select("text", "grade").mapInArrow(hashed, "slots binary, values binary, grade int"), "ratings")
    drawn = made.collect()
    rows = [(np.frombuffer(r[0], "<i4").astype(np.int64), np.frombuffer(r[1], "<f4").astype(np.float64)) for r in drawn]
    return fit(rows, np.array([r[2] for r in drawn], np.int64), buckets)


def scores(docs: DataFrame, model: Model, *, at_least: int, share: float = 0.5) -> DataFrame:
    """Per row: doc_id, expected_grade, tail (P(grade >= at_least)), kept (tail >= share).

    NULL and empty texts are scored as texts without words; repeated rows each.
    A model of one grade gives that grade.
    """
    def run(batches):
        cache, grades = Cache(word_slots(model.buckets)), np.array(model.grades, np.float64)
        for batch in batches:
            tails = model.tails(features(batch.column(1).to_pylist(), cache, model.buckets))
            expected = grades[0] + tails @ np.diff(grades)
            above = np.searchsorted(grades, at_least)
            tail = np.ones(len(tails)) if above == 0 else np.zeros(len(tails)) if above == len(grades) else tails[:, above - 1]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "expected_grade": pa.array(expected, pa.float64()),
                                              "tail": pa.array(tail, pa.float64()), "kept": pa.array(tail >= share, pa.bool_())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, expected_grade double, tail double, kept boolean")
