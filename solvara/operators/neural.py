"""A multilayer network with an asymmetric loss, trained over all rows wherever they lie.

Loss of a row: ``y * cost_fn * softplus(-z) + (1 - y) * cost_fp * softplus(z)`` of its margin z, times its
weight.  A step is one job over one of the mini-batches (rows dealt by a hash): each task runs all layers forward and
back over its rows and sends one gradient; the driver clips their mean, and takes an Adam step with
decoupled weight decay and a rate that falls as a cosine.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.operators.descent import Adam, summed
from solvara.sources.files import shared_path


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Network:
    """Layer sizes and all weights and biases in one vector; hidden layers are ``h * sigmoid(h)``."""

    sizes: tuple[int, ...]
    theta: np.ndarray

    @classmethod
    def drawn(cls, sizes: Sequence[int], seed: int = 42) -> Network:
        rng = np.random.default_rng(seed)
        parts = [x for a, b in zip(sizes, sizes[1:]) for x in (rng.normal(0, math.sqrt(2 / (a + b)), a * b), np.zeros(b))]
        return cls(tuple(sizes), np.concatenate(parts))

    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((self.theta[at : at + a * b].reshape(a, b), self.theta[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        layers = self.layers()
        for w, b in layers[:-1]:
            h = x @ w + b
            x = h * _sigmoid(h)
        return (x @ layers[-1][0] + layers[-1][1])[:, 0]

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost_fn: float, cost_fp: float) -> tuple[float, np.ndarray]:
        """The weighted sum of losses of the rows, and its gradient."""
        layers, inputs, raw = self.layers(), [x], []
        for w, b in layers[:-1]:
            raw.append(inputs[-1] @ w + b)
            inputs.append(raw[-1] * _sigmoid(raw[-1]))
        z = (inputs[-1] @ layers[-1][0] + layers[-1][1])[:, 0]
        loss = float((weight * (y * cost_fn * np.logaddexp(0, -z) + (1 - y) * cost_fp * np.logaddexp(0, z))).sum())
        back = (weight * ((1 - y) * cost_fp * _sigmoid(z) - y * cost_fn * _sigmoid(-z)))[:, None]
        found = []
        for k in range(len(layers) - 1, -1, -1):
            found = [(inputs[k].T @ back).reshape(-1), back.sum(axis=0), *found]
            if k:
                s = _sigmoid(raw[k - 1])
                back = (back @ layers[k][0].T) * (s * (1 + raw[k - 1] * (1 - s)))
        return loss, np.concatenate(found)


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    return x, b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)


def fit_network(
    train: DataFrame, features: Sequence[str], label: str, hidden: Sequence[int] = (32, 16), cost_fn: float = 24.0, cost_fp: float = 1.0, weight: str | None = None,
    valid: DataFrame | None = None, epochs: int = 12, batches: int = 4, rate: float = 0.02, decay: float = 1e-4, patience: int = 4, seed: int = 42,
) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``margin`` and ``score``; it has ``network`` and ``history`` (loss of each epoch).

    Nulls and NaN in features count as 0, features are standardised by the training rows (constant ones become 0), rows
    without a label take no part.  Training stops once the mean loss of ``valid`` (else of the training rows) hasn't
    fallen for ``patience`` epochs, and the best weights are taken.  Without training rows the drawn weights stay.
    """
    features = list(features)
    clean = lambda df: [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features]
    stats = train.where(F.col(label).isNotNull()).select(*[x.alias(f"c{k}") for k, x in enumerate(clean(train))])
    row = stats.agg(*[g(f"c{k}").alias(f"{n}{k}") for k in range(len(features)) for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([row[f"m{k}"] or 0.0 for k in range(len(features))])
    std = np.array([row[f"s{k}"] or 0.0 for k in range(len(features))])
    scale = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = shared_path(df.sparkSession, name)
        x = F.array(*[(c - float(m)) * float(s) for c, m, s in zip(clean(df), mean, scale)]).alias("x")
        w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight and weight in df.columns else F.lit(1.0)
        rows = df.where(F.col(label).isNotNull()).select(x, F.col(label).cast("double").alias("y"), w.alias("w"))
        rows = rows.withColumn("batch", F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(batches)).cast("int"))
        rows.write.partitionBy("batch").parquet(path)
        return df.sparkSession.read.schema("x array<double>, y double, w double, batch int").parquet(path)

    def sums(rows: DataFrame, net: Network) -> tuple[float, float, np.ndarray]:
        def one(b: pa.RecordBatch) -> np.ndarray:
            x, y, w = _arrays(b)
            loss, gradient = net.loss_and_gradient(x, y, w, cost_fn, cost_fp)
            return np.concatenate([[loss, w.sum()], gradient])

        total = summed(rows.select("x", "y", "w"), one, 2 + len(net.theta))
        return total[0], total[1], total[2:]

    def mean_loss(rows: DataFrame, net: Network) -> float:
        def one(b: pa.RecordBatch) -> np.ndarray:
            x, y, w = _arrays(b)
            z = net.margins(x)
            return np.array([(w * (y * cost_fn * np.logaddexp(0, -z) + (1 - y) * cost_fp * np.logaddexp(0, z))).sum(), w.sum()])

        loss, n = summed(rows.select("x", "y", "w"), one, 2)
        return loss / n if n else 0.0

    data = kept(train, "network")
    held = kept(valid, "network-valid") if valid is not None else data
    net, adam = Network.drawn([len(features), *hidden, 1], seed), Adam(0, decay)
    adam.m = adam.v = np.zeros(len(net.theta))
    best, best_loss, history, worse = net, math.inf, [], 0
    for epoch in range(epochs):
        now = 1e-6 + (rate - 1e-6) * 0.5 * (1 + math.cos(math.pi * epoch / epochs))
        for k in range(batches):
            _, n, gradient = sums(data.where(F.col("batch") == k), net)
            if n:
                gradient = gradient / n
                gradient *= min(1.0, 1.0 / max(float(np.linalg.norm(gradient)), 1e-12))
                net = Network(net.sizes, adam.step(net.theta, gradient, now))
        history.append(mean_loss(held, net))
        worse = 0 if history[-1] < best_loss else worse + 1
        if not worse:
            best, best_loss = net, history[-1]
        if worse == patience:
            break

    def score(df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(best)

        @F.pandas_udf("double")
        def margin(*columns: pd.Series) -> pd.Series:
            x = np.nan_to_num(np.stack([c.to_numpy(float) for c in columns], axis=1), nan=0.0)
            return pd.Series(shared.value.margins((x - mean) * scale))

        return df.withColumn("margin", margin(*clean(df))).withColumn("score", 1.0 / (1.0 + F.exp(-F.col("margin"))))

    score.network, score.history = best, history
    return score
