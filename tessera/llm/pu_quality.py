"""Operator 3: quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; unlabelled texts are all documents as they come. Labels of 0 are not used. A
linear model minimises the non-negative unbiased risk  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))  with the squared loss
(1 - y z)**2 / 4. That loss needs no more of the texts than the moments of their features, so the unlabelled part covers every document
however many there are: each task sums its moments, and the driver gets one matrix. The minimum is found in closed form
(where the second part would fall below 0, at the weight of it that keeps it at 0).

The class prior pi is estimated from positives and unlabelled texts alone, by the best bin: with a first classifier of
positives against unlabelled texts, the share of unlabelled texts above a threshold over the share of positives there is
at least pi, and near it where only positives score so high; the threshold with the least upper bound gives pi.
A text's score is z's probability scale, (z + 1) / 2, bent into 0 to 1 at its ends.

Inputs are of the text alone: shares of character classes, of changes between them, and of repeated lines, words and 3-word
windows. Rows whose crc32(doc_id as text) mod 5 is 0 are held out: neither their labels nor their texts are used to fit.
The positives of the fit are those of at most ``SAMPLE`` doc_ids, of least hash; all else covers all rows.

Defined results: null and empty texts are scored by the features of an empty text; rows are independent, so repeated rows get
equal scores; labels of rows without a document, null labels and repeated labels do no harm; without any positive every
score is 0.5; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

SAMPLE = 5000
#: Weight of the penalty on standardised weights; bins of the first classifier's scores from -LIMIT to LIMIT.
RIDGE, LIMIT, BINS = 0.05, 3.0, 1200
#: Scores of this and less, and of 1 less this and more, are bent.
BEND = 0.02
#: Character classes, one string each; other ASCII signs are class 1, other bytes (letters with marks) class 0.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!", "?", "#", "*", "$", "%", "&", "|", "<>", "()[]{}", "\"'`", "-_=+", "/\\@~^"]
N = len(CLASSES)
WIDTH = N + N * N + 9


def _class_of() -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[:128] = 1
    for k, chars in enumerate(CLASSES):
        out[[ord(c) for c in chars]] = k
    return out


CLASS_OF = _class_of()


def features(text: str | None) -> np.ndarray:
    """Roots of the shares, which evens their spread."""
    x = np.zeros(WIDTH, np.float32)
    data = (text or "").encode()
    if not data:
        return x
    c = CLASS_OF[np.frombuffer(data, np.uint8)]
    x[:N] = np.bincount(c, minlength=N) / len(c)
    runs = c[np.concatenate([[True], c[1:] != c[:-1]])]
    if len(runs) > 1:
        x[N : N + N * N] = np.bincount(runs[:-1] * N + runs[1:], minlength=N * N) / (len(runs) - 1)
    w = data.split()
    lines = [p for p in data.split(b"\n") if p.strip()]
    if w:
        windows = max(1, len(w) - 2)
        same = sum(a == b for a, b in zip(w, w[1:], strict=False))
        counts = Counter(w).most_common(2)
        x[-9:] = np.maximum(0, (same / len(w), counts[0][1] / len(w) if len(w) > 20 else 0, counts[1][1] / len(w) if len(counts) > 1 and len(w) > 20 else 0, 1 - len(set(w)) / len(w), 1 - len(set(lines)) / len(lines), 1 - len(set(zip(w, w[1:], w[2:], strict=False))) / windows if len(w) > 2 else 0, min(4, len(data) / len(w) / 8), math.log1p(len(w)) / 10, math.log1p(len(data) / len(lines)) / 10))
    return np.sqrt(x)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Moments:
    """Of rows of features with a constant 1 behind them: how many, and the mean of their outer products."""

    n: int
    second: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return self.second[-1]


def with_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x), x.dtype)])


def moments_of(x: np.ndarray) -> Moments:
    x = with_one(x.astype(np.float64))
    return Moments(len(x), x.T @ x / max(1, len(x)))


def moments(docs: DataFrame) -> Moments:
    """Of the texts of ``docs``: a matrix for each task, added up by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WIDTH + 1, WIDTH + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                x = with_one(rows_of(batch.slice(at, 1000)))
                total += x.T @ x
        some = range(WIDTH + 1) if total[-1, -1] else ()
        yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.int32()), pa.array([total[i].tobytes() for i in some], pa.binary())], ["i", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, sums in zip(batch.column("i").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(sums)
                total[i] = total[i] + x if i in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["i", "sums"])

    out = np.zeros((WIDTH + 1, WIDTH + 1))
    for r in docs.select("text").mapInArrow(run, "i int, sums binary").repartition("i").mapInArrow(add, "i int, sums binary").collect():  # WIDTH + 1 rows
        out[r.i] = np.frombuffer(r.sums)
    n = int(round(out[-1, -1]))
    return Moments(n, out / max(1, n))


def rows_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([features(t) for t in batch.column("text").to_pylist()], np.float32).reshape(-1, WIDTH)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        p = (self.margins(x).astype(np.float64) + 1) / 2
        low, high = BEND * np.exp(np.minimum(p - BEND, 0) / BEND), 1 - BEND * np.exp(np.minimum(1 - BEND - p, 0) / BEND)
        return np.where(p < BEND, low, np.where(p > 1 - BEND, high, p))


def fit_pu(positive: Moments, unlabelled: Moments, prior: float, ridge: float = RIDGE) -> Model:
    """Minimises the non-negative risk; its parts are quadratic in the weights."""
    p1, p2, u1, u2 = positive.first, positive.second, unlabelled.first, unlabelled.second
    spread = np.maximum(np.diag(u2) - u1**2, 1e-5)
    spread[-1] = 1e-9  # of the constant
    penalty = np.diag(2 * ridge * spread)

    def at(share: float) -> np.ndarray:
        """Where the gradient of pi * R_p(+) + share * (R_u(-) - pi * R_p(-)) is 0."""
        return np.linalg.solve(prior * (1 - share) * p2 + share * u2 + penalty, prior * (1 + share) * p1 - share * u1)

    def negative(w: np.ndarray) -> float:
        return (1 + 2 * w @ u1 + w @ u2 @ w) / 4 - prior * (1 + 2 * w @ p1 + w @ p2 @ w) / 4

    low, high = 0.0, 1.0
    w = at(1.0)
    if negative(w) < 0:
        for _ in range(50):
            middle = (low + high) / 2
            w = at(middle)
            low, high = (middle, high) if negative(w) >= 0 else (low, middle)
    return Model(w[:-1].astype(np.float32), float(w[-1]), prior)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior, from how often each bin of the first classifier's scores occurs, lowest bin first."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    above_p, above_u = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (positive, unlabelled))
    slack = math.sqrt(math.log(40) / 2 / n_p) + math.sqrt(math.log(40) / 2 / n_u)
    enough = above_p >= 0.1
    bound = np.where(enough, (above_u + slack) / np.maximum(above_p, 1e-9), np.inf)
    k = int(np.argmin(bound))
    return float(min(0.99, max(0.01, above_u[k] / above_p[k])))


def bins(margins: np.ndarray) -> np.ndarray:
    return np.clip(((margins + LIMIT) * (BINS / 2 / LIMIT)).astype(np.int64), 0, BINS - 1)


def histogram(docs: DataFrame, model: Model) -> np.ndarray:
    """How many texts of ``docs`` score in each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            total += np.bincount(bins(model.margins(rows_of(batch))), minlength=BINS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bin", "n"])

    out = np.zeros(BINS, np.int64)
    for r in docs.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS rows at most
        out[r.bin] = r.n
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The driver gets two matrices of moments and two histograms."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter(~held_out(F.col("doc_id")))
    known = labels.select(F.col("doc_id").cast("long"), "quality").filter(~held_out(F.col("doc_id")) & (F.col("quality") == 1))
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(sample)
    trusted = docs.join(F.broadcast(chosen), "doc_id")  # ``sample`` ids at most
    positive = moments(trusted)
    if not positive.n:
        return Model(np.zeros(WIDTH, np.float32), 0.0, 0.5)
    unlabelled = moments(docs)
    both = Moments(positive.n + unlabelled.n, (positive.second + unlabelled.second) / 2)
    first = fit_pu(positive, both, 0.5)
    return fit_pu(positive, unlabelled, best_bin(histogram(trusted, first), histogram(docs, first)))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(rows_of(batch)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
