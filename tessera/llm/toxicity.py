"""Toxicity: a linear classifier on character n-grams whose presence is scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calibrate
from .common import MULTIPLIER, fold, labelled_sample


SLICE = 500  # rows that are scored at a time


@dataclass(frozen=True)
class ToxicityParams:
    """per_class bounds the labelled rows that training takes of each class, max_chars the length of their texts; bits is the log of the number of feature buckets."""

    per_class: int = 1500
    max_chars: int = 200_000
    orders: tuple[int, ...] = (3, 4, 5)
    bits: int = 20
    smooth: float = 1.0
    epochs: int = 8
    rate: float = 0.05
    decay: float = 1e-4
    least_rows: int = 4
    threshold: float = 0.7
    folds: int = 3
    held_out: int = 1


def ngrams(text: str | None, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Buckets of the n-grams of the lower-cased text between two spaces, white space runs as one space; with repetitions."""
    body = " " + " ".join((text or "").lower().split()) + " "
    c = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out, shift = [], np.uint64(64 - bits)
    h = c
    with np.errstate(over="ignore"):
        for n in range(2, max(orders) + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * MULTIPLIER + c[n - 1 :]
            if n in orders:
                out.append((h * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


class ToxicityModel:
    def __init__(self, params: ToxicityParams):
        self.params, self.weights, self.bias, self.cut, self.slope = params, np.zeros(1 << params.bits, dtype=np.float32), 0.0, 0.0, 1.0

    def fit(self, texts: list[str], y: np.ndarray) -> ToxicityModel:
        """Trains on all rows but every fifth, which place the cut. With rows of one class only that class is predicted, without rows 0."""
        p = self.params
        if not len(y) or y.min() == y.max():
            self.cut = -np.inf if len(y) and y[0] == 1 else np.inf
            return self
        rows = [np.unique(ngrams(t, p.orders, p.bits)).astype(np.int32) for t in texts]
        held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), dtype=bool)
        train = np.flatnonzero(~held)
        if y[train].min() == y[train].max():
            train, held = np.arange(len(y)), ~held & held
        counts = np.zeros((2, 1 << p.bits))
        for i in train:
            counts[int(y[i]), rows[i]] += 1
        n = [max(1, int((y[train] == k).sum())) for k in (0, 1)]
        present = counts.sum(0) >= min(p.least_rows, max(1, len(train) // 20))
        ratio = np.where(present, np.log((counts[1] + p.smooth) / (n[1] + 2 * p.smooth)) - np.log((counts[0] + p.smooth) / (n[0] + 2 * p.smooth)), 0.0)
        used = [r[present[r]] for r in rows]
        w, b, seen = np.zeros(1 << p.bits), 0.0, np.full(1 << p.bits, 1e-6)
        rng = np.random.default_rng(0)
        side = {k: 0.5 * len(train) / n[k] for k in (0, 1)}
        for _ in range(p.epochs):
            for i in rng.permutation(train):
                f = used[i]
                x = ratio[f] / np.sqrt(len(f) + 1.0)
                g = (1 / (1 + np.exp(-np.clip(w[f] @ x + b, -30, 30))) - y[i]) * side[int(y[i])]
                step = g * x + p.decay * w[f]
                seen[f] += step * step
                w[f] -= p.rate * step / np.sqrt(seen[f])
                b -= 0.01 * g
        self.weights, self.bias = (w * ratio).astype(np.float32), b
        z = self.raw(texts)
        at = held if held.any() and y[held].min() < y[held].max() else np.ones(len(y), dtype=bool)
        self.cut, self.slope = calibrate.cut_point(z[at], y[at])
        return self

    def raw(self, texts: list[str | None]) -> np.ndarray:
        p, z = self.params, np.zeros(len(texts))
        last = np.zeros(1 << p.bits, dtype=np.int32)
        for i, t in enumerate(texts):
            f = ngrams(t, p.orders, p.bits)
            at = np.arange(len(f), dtype=np.int32)
            last[f] = at
            f = f[last[f] == at]  # each once
            w = self.weights[f]
            z[i] = w.sum(dtype=np.float64) / np.sqrt(np.count_nonzero(w) + 1.0) + self.bias
        return z

    def score(self, texts: list[str | None]) -> np.ndarray:
        return calibrate.score(self.raw(texts), self.cut, self.slope, self.params.threshold)


def train(documents: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Learns from at most 2 * per_class labelled rows outside the held-out fold, texts of at most max_chars characters; only texts and labels enter."""
    return ToxicityModel(params).fit(*labelled_sample(documents, labels, "toxic", params.folds, params.held_out, params.per_class, params.max_chars))


def score_documents(documents: DataFrame, model, folds: int, held_out: int, threshold: float) -> DataFrame:
    """documents' rows as doc_id, held_out, score, predicted.

    Each row is scored from its whole text alone, a null text as the empty one; rows with a null id count in the fold of the empty text.
    The weights are of a fixed size and go out as one broadcast.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "score": pa.array(m.score(part.column(1).to_pylist()), pa.float64())})

    scored = documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(documents: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Each row of documents(doc_id, text, ...) as doc_id, held_out, score, predicted; a null or empty text has the score of the bias alone.

    Repeated rows and ids give a row each; rows with a null id count in the fold of the empty text; an empty table gives no rows; other
    columns aren't read. Without labels, or with one class only, all rows are predicted alike (without any: 0).
    """
    return score_documents(documents, train(documents, labels, params), params.folds, params.held_out, params.threshold)


def filter_documents(documents: DataFrame, model, threshold: float, reject_at_least: bool) -> DataFrame:
    """The rows of documents whose score is below (reject_at_least) or not below the threshold, with all their columns; same defaults as score_documents for nulls."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                s = m.score(part.column("text").to_pylist())
                yield part.filter(pa.array(s < threshold if reject_at_least else s >= threshold))

    return documents.mapInArrow(run, documents.schema)
