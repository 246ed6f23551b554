"""Quality classifier: learned hashed vectors of words and of their character n-grams, averaged per document, softmax output, numpy SGD."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import calibrate
from .common import MULTIPLIER, labelled_sample, span_hashes
from .toxicity import score_documents


@dataclass(frozen=True)
class QualityParams:
    """per_class bounds the labelled rows that training takes of each class, max_chars the length of their texts; 2**bits vectors of `dim` numbers are learned."""

    per_class: int = 1200
    max_chars: int = 200_000
    orders: tuple[int, ...] = (3, 4)
    bits: int = 17
    dim: int = 8
    epochs: int = 6
    rate: float = 0.5
    threshold: float = 0.3
    folds: int = 5
    held_out: int = 0


def features(text: str | None, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Buckets of a text's words and of the n-grams of each word between two marks, with repetitions; case counts."""
    words = (text or "").split()
    body = " " + " ".join(words) + " " if words else ""
    c = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(c):
        return np.zeros(0, dtype=np.int64)
    gap = np.flatnonzero(c == 32)
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        out = [span_hashes(c, gap[:-1] + 1, gap[1:]) >> shift]
        c = c.astype(np.uint64)
        blank = np.concatenate([[0], np.cumsum(c == 32)])
        h = c
        for n in range(2, max(orders) + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * MULTIPLIER + c[n - 1 :]
            if n in orders:  # a space may only be the first or the last character
                inner = blank[n - 1 : len(c)] - blank[1 : len(c) - n + 2]
                out.append(h[inner == 0] * np.uint64(0xD6E8FEB86659FD93) >> shift)
    return np.concatenate(out).astype(np.int64)


class QualityModel:
    def __init__(self, params: QualityParams):
        self.params = params
        rng = np.random.default_rng(1)
        self.vectors = rng.uniform(-1 / params.dim, 1 / params.dim, (1 << params.bits, params.dim)).astype(np.float32)
        self.output = np.zeros((params.dim, 2), dtype=np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        self.cut, self.slope, self.margin = 0.0, 1.0, None

    def fit(self, texts: list[str], y: np.ndarray) -> QualityModel:
        """SGD on the softmax loss over all rows but every fifth, which place the cut. With rows of one class only that class is predicted, without rows 1."""
        p = self.params
        self.margin = np.zeros(1 << p.bits, dtype=np.float32)
        if not len(y) or y.min() == y.max():
            self.cut = np.inf if len(y) and y[0] == 0 else -np.inf
            return self
        held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), dtype=bool)
        rows = [np.unique(features(t, p.orders, p.bits), return_counts=True) for t in texts]
        train = np.flatnonzero(~held)
        n = [max(1, int((y[train] == k).sum())) for k in (0, 1)]
        side = [0.5 * len(train) / x for x in n]
        rng, steps, total = np.random.default_rng(2), 0, p.epochs * len(train)
        for _ in range(p.epochs):
            for i in rng.permutation(train):
                f, count = rows[i]
                rate = p.rate * (1 - steps / total)
                steps += 1
                if not len(f):
                    continue
                share = (count / count.sum()).astype(np.float32)
                hidden = share @ self.vectors[f]
                out = hidden @ self.output + self.bias
                e = np.exp(out - out.max())
                g = e / e.sum()
                g[int(y[i])] -= 1
                g *= side[int(y[i])]
                back = self.output @ g
                self.output -= rate * np.outer(hidden, g)
                self.bias -= 0.1 * rate * g
                # the rate for vectors isn't divided by the number of features: share already is
                self.vectors[f] -= rate * len(f) * share[:, None] * back / 10
        self.margin = (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32)
        z = self.raw(texts)
        at = held if held.any() and y[held].min() < y[held].max() else np.ones(len(y), dtype=bool)
        self.cut, self.slope = calibrate.cut_point(z[at], y[at])
        return self

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """Difference of the two softmax inputs. The average of vectors times the output layer is the average of their products, kept as one number a bucket."""
        z = np.full(len(texts), float(self.bias[1] - self.bias[0]))
        for i, t in enumerate(texts):
            f = features(t, self.params.orders, self.params.bits)
            if len(f):
                z[i] += self.margin[f].mean(dtype=np.float64)
        return z

    def score(self, texts: list[str | None]) -> np.ndarray:
        return calibrate.score(self.raw(texts), self.cut, self.slope, self.params.threshold)

    def __getstate__(self):
        return self.__dict__ | {"vectors": None}  # scoring needs the products only


def train(documents: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Learns from at most 2 * per_class labelled rows outside the held-out fold, texts of at most max_chars characters; only texts and labels enter."""
    return QualityModel(params).fit(*labelled_sample(documents, labels, "quality", params.folds, params.held_out, params.per_class, params.max_chars))


def classify(documents: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Each row of documents(doc_id, text, ...) as doc_id, held_out, score, predicted; odd rows and tables as in toxicity.classify, but without labels all rows are predicted 1."""
    return score_documents(documents, train(documents, labels, params), params.folds, params.held_out, params.threshold)
