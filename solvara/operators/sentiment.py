"""Three-class text scores through a pluggable scorer, and a scorer learned over all rows.

A scorer turns a list of texts into probabilities (negative, neutral, positive).  ``score_text`` takes a
factory, which runs once in each Python worker, so a model is loaded once and not for every batch.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.operators.descent import Adam, summed
from solvara.sources import saved

Scorer = Callable[[Sequence[str]], np.ndarray]
CLASSES = ("negative", "neutral", "positive")
_WORD = re.compile(r"\w+")


def hashed(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's words and word pairs and their weights: log counts with a norm of 1."""
    words = _WORD.findall(text.lower())
    grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    at, n = np.unique(np.array([zlib.crc32(g.encode("utf-8", "replace")) for g in grams], np.int64) & (2**bits - 1), return_counts=True)
    w = np.log1p(n)
    return at.astype(np.int32), w / max(float(np.linalg.norm(w)), 1e-12)


@dataclass
class SoftmaxScorer:
    """Softmax regression over hashed n-grams; an empty text gets the classes' biases alone."""

    weights: np.ndarray
    bias: np.ndarray
    bits: int

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        z = np.tile(self.bias, (len(texts), 1))
        for k, text in enumerate(texts):
            at, w = hashed(text, self.bits)
            z[k] += w @ self.weights[at]
        return _softmax(z)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def score_text(df: DataFrame, text: str, scorer: Callable[[], Scorer]) -> DataFrame:
    """Adds positive, negative, neutral (they sum to 1) and index = positive - negative.

    ``scorer`` is called once in each worker and gives the function that scores a batch of texts; a null
    text counts as empty.
    """

    @F.pandas_udf("negative double, neutral double, positive double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for texts in batches:
            yield pd.DataFrame(np.asarray(score(texts.fillna("").tolist()), float).reshape(len(texts), 3), columns=list(CLASSES))

    out = df.withColumn("__s", run(F.col(text).cast("string")))
    return out.select(*df.columns, "__s.positive", "__s.negative", "__s.neutral", (F.col("__s.positive") - F.col("__s.negative")).alias("index"))


def fit_scorer(train: DataFrame, text: str, label: str, bits: int = 14, steps: int = 30, rate: float = 0.3, l2: float = 1e-4) -> SoftmaxScorer:
    """A ``SoftmaxScorer`` from rows labelled 0 (negative), 1 (neutral) or 2 (positive), classes weighted alike.

    Texts are hashed once and written as bytes, which pass to Python as they are; each step is one job in which the tasks add up the gradient of all
    rows.  Rows without such a label take no part, null texts count as empty, and without rows every
    probability is a third.
    """
    rows = train.select(F.col(text).cast("string").alias("t"), F.col(label).cast("int").alias("y")).where(F.col("y").between(0, 2))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hashed(t or "", bits) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary()), b.column(1)], ["at", "w", "y"])

    data = saved(rows.mapInArrow(features, "at binary, w binary, y int"), "n-grams")
    counts = {r.y: r.n for r in data.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = np.array([total / (len(counts) * counts[k]) if k in counts else 0.0 for k in range(3)])
    width = 2**bits
    theta, adam = np.zeros((width + 1, 3)), Adam(0)
    adam.m = adam.v = np.zeros_like(theta)
    for _ in range(steps if total else 0):
        now = theta

        def gradient(b: pa.RecordBatch, now: np.ndarray = now) -> np.ndarray:
            at, y = b.column(0).to_pylist(), b.column(2).to_numpy()
            flat, w = np.frombuffer(b"".join(at), np.int32), np.frombuffer(b"".join(b.column(1).to_pylist()))
            row = np.repeat(np.arange(len(y)), [len(x) // 4 for x in at])
            z = np.tile(now[width], (len(y), 1))
            for k in range(3):
                z[:, k] += np.bincount(row, w * now[flat, k], len(y))
            d = (_softmax(z) - np.eye(3)[y]) * share[y, None]
            out = np.stack([np.bincount(flat, w * d[row, k], width + 1) for k in range(3)], axis=1)
            out[width] = d.sum(axis=0)
            return out.reshape(-1)

        found = summed(data, gradient, theta.size).reshape(theta.shape) / total
        found[:width] += l2 * theta[:width]
        theta = adam.step(theta, found, rate)
    return SoftmaxScorer(theta[:width], theta[width], bits)
