"""The network's gradient against differences, its 24-fold loss, and odd inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from solvara.operators import metrics, neural


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    net = neural.Network.drawn([4, 5, 3, 1], 1)
    x, y, w = rng.normal(size=(20, 4)), (rng.random(20) < 0.4).astype(float), rng.random(20)
    loss, gradient = net.loss_and_gradient(x, y, w, 24.0, 1.0)
    for k in rng.choice(len(net.theta), 25, replace=False):
        step = np.zeros(len(net.theta))
        step[k] = 1e-6
        up, down = (neural.Network(net.sizes, net.theta + s).loss_and_gradient(x, y, w, 24.0, 1.0)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - gradient[k]) < 1e-4 * max(1, abs(gradient[k]))
    z = net.margins(x)
    assert abs(loss - (w * (y * 24 * np.log1p(np.exp(-z)) + (1 - y) * np.log1p(np.exp(z)))).sum()) < 1e-9


def rows_of(spark, n=1500):
    r = random.Random(4)
    rows = []
    for k in range(n):
        a, b = r.gauss(0, 1), r.gauss(0, 1)
        rows.append((k, a, b if k % 40 else None, 7.0, int(a * b + r.gauss(0, 0.7) > 1.2), "clash"))
    return spark.createDataFrame(rows, "id long, a double, b double, flat double, y int, w string")


def test_asymmetric_loss_is_lower_than_unweighted(spark):
    df = rows_of(spark)
    train, test = df.where("id % 3 <> 0"), df.where("id % 3 = 0")
    options = {"hidden": (8,), "epochs": 10, "batches": 3, "rate": 0.05, "valid": test.where("id % 2 = 0")}
    own = neural.fit_network(train, ["a", "b", "flat"], "y", **options)
    plain = neural.fit_network(train, ["a", "b", "flat"], "y", cost_fn=1.0, **options)
    loss = lambda f: metrics.asymmetric_loss(f(test), "margin", "y", 24.0).first()["loss"]
    assert loss(own) < 0.8 * loss(plain)
    assert min(own.history) < own.history[0] and len(own.history) <= 10
    auc = metrics.roc_auc(metrics.score_counts(own(test), "score", "y")).first()["roc_auc"]
    assert auc > 0.8
    # the same rows give the same network
    again = neural.fit_network(train, ["a", "b", "flat"], "y", **options)
    assert np.allclose(again.network.theta, own.network.theta)


def test_weights_count_as_repeated_rows(spark):
    df = rows_of(spark, 200)
    twice = df.unionByName(df.where("y = 1"))
    weighted = df.withColumn("n", F.when(F.col("y") == 1, 2.0).otherwise(1.0))
    options = {"hidden": (4,), "epochs": 2, "batches": 1, "cost_fn": 1.0}
    # standardised alike: the features' means must not differ
    a = neural.fit_network(weighted.withColumn("a", F.lit(1.0)), ["a"], "y", weight="n", **options)
    b = neural.fit_network(twice.withColumn("a", F.lit(1.0)), ["a"], "y", **options)
    assert np.allclose(a.network.theta, b.network.theta)


def test_empty_and_null(spark):
    df = rows_of(spark, 30)
    f = neural.fit_network(df.limit(0), ["a", "b"], "y", epochs=1)
    assert f(df).where("score IS NULL OR isnan(score)").count() == 0 and f(df.limit(0)).count() == 0
    g = neural.fit_network(df.withColumn("y", F.when(F.col("id") > 5, F.col("y"))), ["a", "b"], "y", epochs=1)
    assert np.isfinite(g.network.theta).all()
