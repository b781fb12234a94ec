"""Attributions of trees against the definition by subsets, and on fitted models."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from solvara.operators import explain, models


def random_tree(r, features, depth, ident=0, nodes=None, cover=100.0):
    nodes = {} if nodes is None else nodes
    if depth == 0 or r.random() < 0.15:
        nodes[ident] = (r.uniform(-2, 2), cover, -1, 0.0, -1, -1)
        return nodes
    part = r.uniform(0.1, 0.9)
    nodes[ident] = (0.0, cover, r.randrange(features), r.uniform(-1, 1), 2 * ident + 1, 2 * ident + 2)
    random_tree(r, features, depth - 1, 2 * ident + 1, nodes, cover * part)
    random_tree(r, features, depth - 1, 2 * ident + 2, nodes, cover * (1 - part))
    return nodes


def value(nodes, x, known, at=0):
    v, cover, f, cut, left, right = nodes[at]
    if left < 0:
        return v
    if f in known:
        return value(nodes, x, known, left if x[f] <= cut else right)
    return sum(nodes[k][1] / cover * value(nodes, x, known, k) for k in (left, right))


def by_subsets(nodes, x):
    m = len(x)
    phi = np.zeros(m)
    for i in range(m):
        for size in range(m):
            for s in itertools.combinations([j for j in range(m) if j != i], size):
                w = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                phi[i] += w * (value(nodes, x, {*s, i}) - value(nodes, x, set(s)))
    return phi


@pytest.mark.parametrize("depth", [0, 1, 3, 6])
def test_equal_to_subsets(depth):
    r = random.Random(depth)
    for _ in range(6):
        first, second = random_tree(r, 5, depth), random_tree(r, 5, depth)
        e = explain.Ensemble(list("abcde"))
        e.add_tree(first, 0.7)
        e.add_tree(second, -1.3)
        x = np.array([[r.uniform(-1.2, 1.2) for _ in range(5)] for _ in range(8)])
        margin, phi = e.explain(x)
        for k, row in enumerate(x):
            want = 0.7 * by_subsets(first, row) - 1.3 * by_subsets(second, row)
            assert np.allclose(phi[k], want, atol=1e-12)
            assert math.isclose(margin[k], 0.7 * value(first, row, set(range(5))) - 1.3 * value(second, row, set(range(5))))
        assert math.isclose(e.base, 0.7 * value(first, x[0], set()) - 1.3 * value(second, x[0], set()))
        assert np.allclose(e.base + phi.sum(axis=1), margin, atol=1e-9)


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_fitted_models_add_up(spark, kind):
    r = random.Random(1)
    rows = [(k, *[r.gauss(0, 1) for _ in range(3)], None if k % 50 == 0 else r.random()) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double").withColumn("y", ((F.col("a") * F.col("b") > 0.1) | (F.col("c") > 1)).cast("int"))
    fitted = models.fit_classifier(df, list("abcd"), "y", kind, maxDepth=5)
    trees = explain.ensemble_of(fitted, list("abcd"), spark)
    got = {x.id: x for x in explain.explained(df, "id", trees).collect()}
    assert len(got) == 600 and all(abs(x.base + sum(x.phis) - x.margin) < 1e-6 for x in got.values())
    for s in fitted(df).select("id", "score").collect():
        m = got[s.id].margin
        assert abs((1 / (1 + math.exp(-2 * m)) if kind == "boosted" else m) - s.score) < 1e-9
    # training rows' mean margin is the base where every tree saw all rows
    if kind == "boosted":
        assert abs(np.mean([x.margin for x in got.values()]) - trees.base) < 1e-6
    assert explain.explained(df.limit(0), "id", trees).count() == 0


def test_covers_of_given_trees(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, 5.0)], "id int, a double")
    trees = explain.with_covers(df, ["a"], [{0: (0.0, "a", 0.5, 1, 2), 1: (-1.0, "", 0.0, -1, -1), 2: (1.0, "", 0.0, -1, -1)}])
    got = {r.id: (r.base, r.margin, r.phi) for r in explain.tree_attributions(df, "id", trees).collect()}
    assert got == {1: (0.0, 1.0, 1.0), 2: (0.0, -1.0, -1.0), 3: (0.0, -1.0, -1.0), 4: (0.0, 1.0, 1.0)}


def test_rows_of_one_file_are_dealt_to_all_cores(spark, tmp_path):
    r = random.Random(9)
    e = explain.Ensemble(list("abc"))
    e.add_tree(random_tree(r, 3, 4))
    rows = [(k, *(r.uniform(-1.2, 1.2) for _ in range(3))) for k in range(200)]
    spark.createDataFrame(rows, "id int, a double, b double, c double").coalesce(1).write.parquet(f"file://{tmp_path}/one")
    got = explain.explained(spark.read.parquet(f"file://{tmp_path}/one"), "id", e)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    margin, phi = e.explain(np.array([x[1:] for x in rows]))
    assert all(math.isclose(x.margin, margin[x.id], abs_tol=1e-12) and np.allclose(x.phis, phi[x.id], atol=1e-12) for x in got.collect())


def test_long_paths_equal_tables(monkeypatch):
    r = random.Random(5)
    e = explain.Ensemble(list("abcdefghijkl"))
    e.add_tree(random_tree(r, 12, 9))
    x = np.array([[r.uniform(-1.2, 1.2) for _ in range(12)] for _ in range(50)])
    with_tables = e.explain(x)
    monkeypatch.setattr(explain, "TABLE_BITS", 0)
    without = e.explain(x)
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(with_tables, without))
