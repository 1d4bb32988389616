"""Operator 7: toxicity by cumulative-link ordinal regression.

Severity has grades 0 (clean) to ``GRADES``. One weight vector is shared by all thresholds: P(grade >= k) = s(w.x - t_k) with
t_1 <= t_2 <= ...; the expected severity is the sum of these. x holds log(1 + count) of sparse text features: words and
word beginnings of 4 to 6 letters. Features are those that enough labelled toxic texts have and few clean ones do.

Labels know only toxic or not, so a toxic training text's grade is censored: it is one of 1 to ``GRADES``, and its likelihood is that
of the whole interval. That fixes the weights and t_1. What labels cannot say, how toxic texts are spread over the grades, is
a stated convention: the further thresholds give each grade an equal expected share of the toxic training texts. No grade is
made from the features. Rows whose crc32(doc_id as text) mod 5 is 0 are held out of the fit.

The fit sees the labelled rows of at most ``SAMPLE`` doc_ids, of least hash, each different text once, and the model has at most
``MOST_FEATURES`` features, the most frequent; both are parameters of the model. Scoring covers all rows and whole texts.

Defined results: null and empty texts have no features, so they are as severe as a text without any sign, which is clean;
rows are independent, so repeated rows get equal results; null and repeated labels and labels without a document do no
harm; without toxic labels nothing is toxic; an empty table gives no rows; ``with_toxicity`` keeps all other columns and
overwrites one of the name that it is given.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table
from tessera.llm.pu_quality import held_out

GRADES, SAMPLE, MOST_FEATURES = 3, 12000, 3000
WORD = re.compile(r"[^\W\d_]+")


def keys(word: str) -> list[str]:
    """Features of a lower-case word: itself and its beginnings."""
    return [word + "$", *(word[:k] for k in (4, 5, 6) if len(word) >= k)]


@dataclass
class Model:
    place: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, texts, memo: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """(expected severity, P(grade >= 1)) of each text. ``memo`` remembers words' features."""
        z = np.zeros(len(texts))
        for i, text in enumerate(texts):
            if text:
                z[i] = sum(self.weights[k] * math.log1p(n) for k, n in counted(text, self.place, memo).items())
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -50, 50)))
        return p.sum(axis=1), p[:, 0]


def counted(text: str, place: dict[str, int], memo: dict[str, tuple[int, ...]]) -> Counter:
    """Counts of features."""
    out: Counter = Counter()
    for word in WORD.findall(text.lower()):
        hit = memo.get(word)
        if hit is None:
            hit = tuple(place[k] for k in keys(word) if k in place)
            if len(memo) < 150_000:
                memo[word] = hit
        if hit:
            out.update(hit)
    return out


def fit_ordinal(x: np.ndarray, grades: np.ndarray, counts: np.ndarray | None = None, n_grades: int = GRADES, rounds: int = 500, rate: float = 0.05, decay: float = 1e-4, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of least penalised negative log-likelihood, by Adam; thresholds stay in order. ``counts`` says how
    often each row occurs. With ``most``, a row's grade is known to be from ``grades`` to ``most`` only."""
    most = grades if most is None else most
    counts = np.ones(len(grades)) if counts is None else counts.astype(float)
    total = counts.sum()
    w = np.zeros(x.shape[1])
    # t_1, then logs of the steps between thresholds
    share = np.array([counts[grades >= k].sum() / total for k in range(1, n_grades + 1)]).clip(1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    t = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.05))])
    params = np.concatenate([w, t])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    toxic = max(1.0, counts[grades > 0].sum())
    balance = np.where(grades > 0, 0.5 / toxic, 0.5 / max(1.0, total - toxic)) * total
    weight = np.sqrt(balance) * counts / total  # between plain and balanced
    for step in range(1, rounds + 1):
        w, t = params[: x.shape[1]], params[x.shape[1] :]
        cuts = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        z = x @ w
        p = np.column_stack([np.ones(len(z)), sigmoid(z[:, None] - cuts[None, :]), np.zeros(len(z))])
        at = np.arange(len(z))
        likely = np.maximum(p[at, grades] - p[at, most + 1], 1e-9)
        slope = p * (1 - p)
        g_z = -weight * (slope[at, grades] - slope[at, most + 1]) / likely
        g_cut = np.zeros(n_grades)
        for k in range(1, n_grades + 1):
            g_cut[k - 1] = ((grades == k) * weight * slope[:, k] / likely - (most == k - 1) * weight * slope[:, k] / likely).sum()
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([x.T @ g_z + decay * w, tail[:1], tail[1:] * np.exp(t[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, t = params[: x.shape[1]], params[x.shape[1] :]
    return w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


def spread_evenly(z: np.ndarray, counts: np.ndarray, first: float, n_grades: int = GRADES) -> np.ndarray:
    """Thresholds from ``first`` on that give each grade the same expected share of the texts, by bisection."""
    above = lambda t: (counts / (1 + np.exp(-np.clip(z - t, -50, 50)))).sum()
    out = [first]
    for k in range(1, n_grades):
        want, low, high = above(first) * (n_grades - k) / n_grades, first, first + 100.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) > want else (low, middle)
        out.append(low)
    return np.array(out)


def chosen_features(sample: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """Features of at least 3 and 0.4 percent of toxic texts, 8 times as frequent there as in clean ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic].update({k for word in set(WORD.findall((text or "").lower())) for k in keys(word)})
        names = list({**counts[0], **counts[1]})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][k] for k in names], pa.int64()), pa.array([counts[0][k] for k in names], pa.int64())], ["key", "toxic", "clean"])

    counts = sample.select("text", "toxic").mapInArrow(run, "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    enough = counts.filter((F.col("toxic") >= max(3, math.ceil(0.004 * n_toxic))) & (F.col("toxic") * n_clean >= 8 * n_toxic * (F.col("clean") + 0.3)))
    return sorted(r.key for r in enough.orderBy(F.desc("toxic"), "key").limit(MOST_FEATURES).collect())


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The driver gets at most MOST_FEATURES features and a row of their counts for each text of the sample."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    nothing = Model({}, np.zeros(0), np.linspace(9, 11, GRADES))
    if not counts.get(1):
        return nothing
    names = chosen_features(texts, counts[1], counts.get(0, 0))
    place = {k: i for i, k in enumerate(names)}
    if not place:
        return nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            found = [counted(t or "", place, memo) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["toxic", "at", "n"])

    alike: Counter = Counter()  # most clean texts have no feature at all
    for r in texts.select("text", "toxic").mapInArrow(run, "toxic int, at array<int>, n array<int>").toLocalIterator():  # texts of ``sample`` ids
        alike[(r.toxic, *sorted(zip(r.at, r.n, strict=True)))] += 1
    seen = sorted(alike.items())
    x = np.zeros((len(seen), len(place)), np.float32)
    for i, ((_, *found), _) in enumerate(seen):
        for k, n in found:
            x[i, k] = math.log1p(n)
    toxic, often = np.array([k[0] for k, _ in seen]), np.array([n for _, n in seen])
    weights, thresholds = fit_ordinal(x, toxic, often, most=toxic * GRADES)
    return Model(place, weights, spread_evenly((x @ weights)[toxic == 1], often[toxic == 1], float(thresholds[0])))


def with_toxicity(docs: DataFrame, model: Model, name: str = "_toxicity") -> DataFrame:
    """``docs`` with a struct column (severity, p_toxic, toxic)."""

    @F.pandas_udf("severity double, p_toxic double, toxic boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fresh()
        memo: dict = {}
        for text in batches:
            severity, p = model.severity([t if isinstance(t, str) else None for t in text], memo)
            yield pd.DataFrame({"severity": severity, "p_toxic": p, "toxic": p >= 0.5})

    return docs.withColumn(name, of(F.col("text")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = with_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.col("_toxicity.severity").alias("severity"), F.col("_toxicity.p_toxic").alias("p_toxic"), F.col("_toxicity.toxic").alias("toxic"))
