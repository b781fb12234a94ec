"""Models: orderings, invariants and repeatability on small frames."""

import random

from pyspark.sql import functions as F

from solvara.operators import models


def frame(spark, n=300):
    r = random.Random(1)
    rows = []
    for k in range(n):
        y = int(r.random() < 0.3)
        rows.append((k, y + r.gauss(0, 0.4), r.gauss(0, 1), y))
    return spark.createDataFrame(rows, "id int, a double, b double, y int")


def test_classifiers_order_classes(spark):
    df = models.balanced_weight(frame(spark), "y")
    for kind in ("logistic", "boosted"):
        score = models.fit_classifier(df, ["a", "b"], "y", kind, "weight")
        mean = {r.y: r.m for r in score(df).groupBy("y").agg(F.avg("score").alias("m")).collect()}
        assert mean[1] > mean[0] + 0.2
    total = {r.y: r.w for r in df.groupBy("y").agg(F.sum("weight").alias("w")).collect()}
    assert abs(total[0] - total[1]) < 1e-6


def test_probes_and_pruning(spark):
    kept = {r.feature: r.kept for r in models.random_probes(frame(spark), ["a", "b"], "y").collect()}
    assert kept["a"]
    rho = [("x", "y", 0.9), ("y", "z", -0.8), ("x", "z", 0.1)]
    assert models.prune_collinear(rho, {"x": 3.0, "y": 2.0, "z": 1.0}) == ["x", "z"]
    assert models.prune_collinear(rho, {"x": 3.0, "y": 2.0, "z": 1.0}, prefer=["y"]) == ["y"]


def test_search_is_repeatable():
    grid = {"a": [1, 2, 3], "b": [0.1, 0.2]}
    assert models.search(grid, lambda p: p["a"] * p["b"]) == ({"a": 1, "b": 0.1}, 0.1)
    assert models.search(grid, lambda p: p["a"], 3) == models.search(grid, lambda p: p["a"], 3)


def test_mixture_is_ordered(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(k, 10.0 * (k % 3) + r.gauss(0, 0.5), r.gauss(0, 1)) for k in range(240)], "id int, x double, z double")
    got = models.mixture(df, ["x", "z"], 3, "x", ["low", "mid", "high"]).groupBy("component_name").agg(F.avg("x").alias("m"), F.min("probability").alias("p")).collect()
    mean = {g.component_name: g.m for g in got}
    assert mean["low"] < mean["mid"] < mean["high"] and all(g.p > 0 for g in got)


def test_isolation_forest_finds_the_far_row(spark):
    df = frame(spark).select("id", "a", "b").unionByName(spark.createDataFrame([(999, 50.0, -50.0), (1000, None, None)], "id int, a double, b double"))
    got = models.isolation_forest(df, "id", ["a", "b"], trees=40)
    top = got.orderBy(F.desc("anomaly")).first()
    assert top.id == 999 and top.flagged and got.where("anomaly < 0 OR anomaly > 1").count() == 0
    assert [tuple(r) for r in got.orderBy("id").collect()] == [tuple(r) for r in models.isolation_forest(df.repartition(3), "id", ["a", "b"], trees=40).orderBy("id").collect()]
    assert models.isolation_forest(df.limit(0), "id", ["a", "b"]).count() == 0


def test_calibration_is_monotone(spark):
    df = frame(spark).withColumn("score", F.least(F.greatest(F.col("a") / 2 + 0.3, F.lit(0.0)), F.lit(1.0)))
    for method in ("isotonic", "sigmoid"):
        values = [r.calibrated for r in models.calibrate(df, "score", "y", method)(df).orderBy("score").collect()]
        assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))


def test_mixture_takes_mllibs_steps_in_one_job_a_round(spark):
    from pyspark.ml.clustering import GaussianMixture

    r = random.Random(4)
    df = spark.createDataFrame([(r.gauss(3 * (k % 3), 1), r.gauss(k % 3 - 1, 0.5)) for k in range(600)], "a double, b double").cache()
    fits = [GaussianMixture(featuresCol="__x", k=3, seed=s, maxIter=12, tol=0.0).fit(models._vector(df, ["a", "b"])) for s in (1, 2)]
    best = max(fits, key=lambda m: m.summary.logLikelihood)
    weights, means, covs = models._likeliest_mixture(df, ["a", "b"], 3, [1, 2], 12, 0.0)
    got = sorted(zip(weights.tolist(), means.tolist(), covs.reshape(3, 4).tolist()))
    want = sorted((w, g["mean"].toArray().tolist(), g["cov"].toArray().ravel().tolist()) for w, g in zip(best.weights, best.gaussiansDF.collect()))
    for g, w in zip(got, want):
        assert abs(g[0] - w[0]) < 1e-9 and all(abs(x - y) < 1e-8 for a, b in zip(g[1:], w[1:]) for x, y in zip(a, b))
