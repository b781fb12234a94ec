"""Additive attributions of tree models: exact path-dependent Shapley values of every row.

A leaf of a tree is reached when each feature on its path lies in one interval.  For a set S of known
features the tree's value is the sum over leaves of ``value * prod(S: inside) * prod(not S: share)``,
where share is the part of training rows that went the leaf's way at that feature's splits.  The Shapley
value of one leaf and feature is then an integral over t from 0 to 1 of a product of ``share * (1 - t) +
inside * t`` over the other features, a polynomial that Gauss-Legendre nodes integrate exactly: no
subsets are enumerated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.sources.files import shared_path

#: Leaves of up to so many conditions have a table of all patterns; beyond, the patterns that occur are looked for.
TABLE_BITS = 8


@dataclass
class Leaf:
    """The value of a leaf and, per feature on its path: index, interval ``low < x <= high`` and share."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


@dataclass
class Ensemble:
    """All leaves of weighted trees over ``features``; ``base`` is the mean over training rows of the sum."""

    features: list[str]
    leaves: list[Leaf] = field(default_factory=list)
    base: float = 0.0

    def add_tree(self, nodes: dict[int, tuple[float, float, int, float, int, int]], weight: float = 1.0, root: int = 0) -> None:
        """``nodes``: id to (value, cover, feature, threshold, left, right); a leaf has left -1."""
        stack: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(root, {})]
        while stack:
            at, path = stack.pop()
            value, cover, feature, cut, left, right = nodes[at]
            if left < 0:
                own = sorted(path)
                low, high, share = (np.array([path[f][k] for f in own], float) for k in range(3))
                self.leaves.append(Leaf(weight * value, np.array(own, int), low, high, share))
                self.base += weight * value * float(np.prod(share))
                continue
            for child, lower in ((left, False), (right, True)):
                low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
                share *= nodes[child][1] / cover if cover > 0 else 0.5
                stack.append((child, path | {feature: (max(low, cut), high, share) if lower else (low, min(high, cut), share)}))

    def explain(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margins, attributions) of rows of feature values."""
        columns, margin, phi = np.ascontiguousarray(x.T), np.zeros(len(x)), np.zeros(x.shape[::-1])
        for leaf in self.leaves:
            m = len(leaf.features)
            if not m:
                margin += leaf.value
                continue
            inside = [(columns[f] > low) & (columns[f] <= high) for f, low, high in zip(leaf.features, leaf.low, leaf.high)]
            # rows of one pattern of kept and broken conditions have one attribution
            if m <= TABLE_BITS:
                code = np.zeros(len(x), np.int64)
                for k, own in enumerate(inside):
                    code |= own.astype(np.int64) << k
                margin += leaf.value * (code == (1 << m) - 1)
                kept = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
            else:
                own = np.stack(inside, axis=1)
                margin += leaf.value * own.all(axis=1)
                patterns, code = np.unique(np.packbits(own, axis=1), axis=0, return_inverse=True)
                kept, code = np.unpackbits(patterns, axis=1, count=m).astype(float), code.reshape(-1)
            for f, part in zip(leaf.features, (leaf.value * _parts(kept, leaf.share)).T):
                phi[f] += part[code]
        return margin, phi.T


def _parts(kept: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of ``prod(kept or share)`` for rows of kept conditions (1 or 0)."""
    m = kept.shape[1]
    nodes, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
    t, w = (nodes + 1) / 2, weights / 2
    factors = share[None, :, None] * (1 - t) + kept[:, :, None] * t
    before, after = np.ones_like(factors), np.ones_like(factors)
    before[:, 1:] = np.cumprod(factors[:, :-1], axis=1)
    after[:, :-1] = np.cumprod(factors[:, :0:-1], axis=1)[:, ::-1]
    return (kept - share) * ((before * after) @ w)


def ensemble_of(score: Callable[[DataFrame], DataFrame], features: Sequence[str], spark) -> Ensemble:
    """The trees of a fitted forest, boosted model or tree, read from its saved node table.

    The margin is the log-odds half of boosted classifiers (their raw prediction), the probability of the second
    class of forests, and the prediction of regressors.  A node table is bounded by the model's depth and trees.
    """
    model = score.model if hasattr(score, "model") else score
    path = shared_path(spark, "trees")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    several = "treeID" in data.columns
    rows = data.select(F.col("treeID") if several else F.lit(0).alias("treeID"), "nodeData.*" if several else "*").collect()
    classes = getattr(model, "numClasses", 0) if "Classif" in type(model).__name__ and "GBT" not in type(model).__name__ else 0
    weights = list(getattr(model, "treeWeights", [1.0]))
    total = sum(weights) if "RandomForest" in type(model).__name__ else 1.0
    trees: dict[int, dict[int, tuple]] = {}
    for r in rows:
        stats, split = list(r.impurityStats), r.split
        if r.leftChild >= 0 and split.numCategories != -1:
            raise ValueError("attributions are for numeric splits")
        value = stats[1] / sum(stats) if classes else r.prediction
        cover = sum(stats) if classes else stats[0]
        cut = split.leftCategoriesOrThreshold[0] if r.leftChild >= 0 else 0.0
        trees.setdefault(r.treeID, {})[r.id] = (value, cover, split.featureIndex, cut, r.leftChild, r.rightChild)
    out = Ensemble(list(features))
    for k, nodes in sorted(trees.items()):
        out.add_tree(nodes, weights[k] / total)
    return out


def with_covers(df: DataFrame, features: Sequence[str], trees: Sequence[dict[int, tuple[float, str, float, int, int]]]) -> Ensemble:
    """An ensemble of given trees, id to (value, feature, threshold, left, right), whose covers are counted over ``df`` in one pass.

    Nulls and NaN count as 0, as where models are fitted.
    """
    features, asked = list(features), []
    filled = df.fillna(0.0, features)
    for k, nodes in enumerate(trees):
        stack = [(0, F.lit(True))]
        while stack:
            at, here = stack.pop()
            asked.append(F.count_if(here).alias(f"{k}|{at}"))
            _, name, cut, left, right = nodes[at]
            if left >= 0:
                stack += [(left, here & (F.col(name) <= cut)), (right, here & (F.col(name) > cut))]
    counts = filled.agg(*asked).first().asDict()
    out = Ensemble(features)
    for k, nodes in enumerate(trees):
        out.add_tree({i: (v, counts[f"{k}|{i}"], features.index(f) if left >= 0 else -1, cut, left, right) for i, (v, f, cut, left, right) in nodes.items()})
    return out


def explained(df: DataFrame, key: str, trees: Ensemble) -> DataFrame:
    """(key, base, margin, phis): for each row the margin, and its parts by feature, ``base + sum(phis) = margin``.

    Nulls and NaN in features count as 0.  Rows are dealt to all cores and explained a batch at once; repeated keys give a
    row each, an empty table gives none.
    """
    features = trees.features
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Ensemble = shared.value
        for b in batches:
            x = np.stack([np.nan_to_num(b.column(k + 1).to_numpy(zero_copy_only=False), nan=0.0, posinf=np.inf, neginf=-np.inf) for k in range(len(features))], axis=1)
            margin, phi = held.explain(x)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, phi.size + 1, phi.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(phi).reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(x), held.base)), pa.array(margin), parts], [key, "base", "margin", "phis"])

    rows = df.select(F.col(key), *[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"__x{k}") for k, f in enumerate(features)])
    # a table of vectors is few splits of a file, each of many rows to explain
    rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism * 4)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, base double, margin double, phis array<double>")


def tree_attributions(df: DataFrame, key: str, trees: Ensemble) -> DataFrame:
    """(key, base, margin, feature, phi): ``explained``, one row per feature; feeds importance and top drivers."""
    names = F.array(*[F.lit(f) for f in trees.features])
    return explained(df, key, trees).select(key, "base", "margin", F.explode(F.arrays_zip(names.alias("feature"), F.col("phis").alias("phi"))).alias("p")).select(key, "base", "margin", "p.feature", "p.phi")
