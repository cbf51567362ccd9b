"""Quality classifier: random-indexing word vectors, pooled, and a calibrated two-layer network.

Every word, and every word's shape (its run-collapsed classes of characters),
has a sparse random index vector, found by hashing. A word's vector adds the
index vectors of its neighbours in the training sample. A document is the mean
of its words' vectors with a few ratios of repetition; a network of one hidden
layer scores it, and a temperature fitted on held-back rows calibrates the
probability.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternwatch.llm.langid import remainder
from lanternwatch.llm.samples import labelled

BUCKETS, DIM, NONZERO, HIDDEN = 1 << 14, 96, 8, 32
#: Labelled documents drawn of each class, the bound of the sample.
PER_CLASS = 2500
#: Documents of the sample from which the neighbours of words are learnt.
CONTEXT_DOCS = 500
THRESHOLD = 0.3
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(7)
    table = np.zeros((BUCKETS, DIM), np.float32)
    at = rng.integers(0, DIM, (BUCKETS, NONZERO))
    np.put_along_axis(table, at, rng.choice([-1.0, 1.0], (BUCKETS, NONZERO)).astype(np.float32), axis=1)
    return table


def buckets(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the words and of their shapes."""
    classes = np.frombuffer(raw.translate(_SHAPE), np.uint8)
    words, shapes = raw.lower().split(), classes[np.append(True, classes[1:] != classes[:-1])[: len(classes)]].tobytes().split()
    w = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    s = np.fromiter((zlib.crc32(x, 1) for x in shapes), np.uint32, len(shapes))
    return w % BUCKETS, s % BUCKETS


def ratios(w: np.ndarray, raw: bytes) -> list[float]:
    n = max(1, len(w))
    lines = raw.split(b"\n")
    same = lambda k: float((w[k:] == w[:-k]).mean()) if len(w) > k else 0.0
    pairs = w[:-1].astype(np.int64) * BUCKETS + w[1:]
    return [same(1), same(2), same(3), len(np.unique(w)) / n ** 0.9, len(np.unique(pairs)) / max(1, len(pairs)), len(set(lines)) / len(lines), np.log1p(n) / 8, len(raw) / n / 16 if n > 1 else 1.0]


class Quality:
    """Fitted vectors, network and temperature."""

    def __init__(self, texts, y, weight, seed: int = 3):
        index = index_vectors()
        context = np.zeros_like(index)
        for t in texts[:: max(1, len(texts) // CONTEXT_DOCS)]:
            w, _ = buckets(self._raw(t))
            for k in (1, 2):
                if len(w) > k:
                    np.add.at(context, w[k:], index[w[:-k]])
                    np.add.at(context, w[:-k], index[w[k:]])
        norm = np.linalg.norm(context, axis=1, keepdims=True)
        self.table = (index / np.sqrt(NONZERO) + context / np.maximum(norm, 1e-6)).astype(np.float32)
        self.shapes = (index / np.sqrt(NONZERO)).astype(np.float32)
        x = np.stack([self.pool(t) for t in texts]) if len(texts) else np.zeros((0, 2 * DIM + 8))
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (0.0, 1.0)
        rng, x, y = np.random.default_rng(seed), (x - self.mean) / self.scale, np.asarray(y, float)
        width = 2 * DIM + 8
        self.p = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        self.constant = None
        back = rng.random(len(y)) < 0.2
        self._train(x[~back], y[~back], np.asarray(weight)[~back])
        self._calibrate(x[back], y[back], np.asarray(weight)[back])

    @staticmethod
    def _raw(text) -> bytes:
        return (text or "").encode("utf-8", "surrogatepass")

    def pool(self, text) -> np.ndarray:
        raw = self._raw(text)
        w, s = buckets(raw)
        mean = lambda table, ids: sum(table[ids[i : i + 4096]].sum(axis=0) for i in range(0, len(ids), 4096)) / len(ids) if len(ids) else np.zeros(DIM, np.float32)
        return np.concatenate([mean(self.table, w), mean(self.shapes, s), ratios(w, raw)])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.p
        return np.tanh(x @ a + b) @ c + d

    def _train(self, x, y, weight, epochs: int = 200, rate: float = 0.015) -> None:
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for t in range(1, epochs + 1):
            hidden = np.tanh(x @ self.p[0] + self.p[1])
            g = weight * (1 / (1 + np.exp(-(hidden @ self.p[2] + self.p[3]))) - y) / len(y)
            gh = np.outer(g, self.p[2]) * (1 - hidden**2)
            grads = [x.T @ gh + 1e-4 * self.p[0], gh.sum(0), hidden.T @ g + 1e-4 * self.p[2], np.array([g.sum()])]
            for i, grad in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.999 * v[i] + 0.001 * grad**2
                self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def _calibrate(self, x, y, weight) -> None:
        """The temperature of the least weighted log loss on the rows held back."""
        z = self._logit(x)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [float((weight * np.logaddexp(0, -(2 * y - 1) * z / t)).sum()) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))]) if len(y) else 1.0

    def score(self, texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = np.stack([self.pool(t) for t in texts]) if len(texts) else np.zeros((0, 2 * DIM + 8))
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -60, 60)))


def scorer(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0):
    """A fitted model as a function of a text column; the model is broadcast."""
    sample = labelled(docs, labels, "quality", PER_CLASS, modulus, held)
    model = docs.sparkSession.sparkContext.broadcast(Quality(sample["text"].tolist(), sample["y"], sample["weight"]))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(texts.tolist()))

    return score


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document row; null texts count as empty.

    Without labels of both classes every score is the mean label, or 0.5.
    """
    score = scorer(docs, labels, modulus, held)
    held_out = (remainder(F.col("doc_id"), modulus) == held).alias("held_out")
    return docs.select("doc_id", held_out, score("text").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted 1, all columns as they are."""
    return docs.where(scorer(docs, labels)(docs["text"]) >= THRESHOLD)
