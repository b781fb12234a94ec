"""The pluggable scorer, the learned one, and freshest fields of several sources."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from solvara.operators import scoring, sentiment


def news(spark, n=600):
    r = random.Random(6)
    good, bad, rest = ["gains", "profit", "record growth"], ["loss", "default", "not profitable"], ["the", "board", "met", "in", "spring", "again"]
    rows = []
    for k in range(n):
        y = r.randrange(3)
        words = [r.choice(rest) for _ in range(r.randrange(3, 12))] + ([r.choice(bad)] if y == 0 else [r.choice(good)] if y == 2 else [])
        r.shuffle(words)
        rows.append((k, " ".join(words), y, "clash"))
    return spark.createDataFrame(rows, "id long, text string, y int, label string")


def test_learned_scorer_on_held_out_rows(spark):
    df = news(spark)
    scorer = sentiment.fit_scorer(df.where("id % 3 <> 0"), "text", "y", bits=10)
    out = sentiment.score_text(df, "text", lambda: scorer)
    assert out.where(F.abs(F.col("positive") + F.col("negative") + F.col("neutral") - 1) > 1e-9).count() == 0
    pick = F.when(F.col("positive") >= F.greatest("negative", "neutral"), 2).when(F.col("negative") >= F.col("neutral"), 0).otherwise(1)
    right = out.where("id % 3 = 0").agg(F.avg((pick == F.col("y")).cast("double"))).first()[0]
    assert right > 0.95


def test_scorer_is_loaded_once_a_worker_and_any_will_do(spark):
    def factory():
        import os

        loads = [os.getpid()]
        return lambda texts: np.array([[0.2, 0.3, 0.5] if t else [0.0, 1.0, 0.0] for t in texts])

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id int, text string")
    got = {r.id: (r.negative, r.neutral, r.positive, round(r["index"], 9)) for r in sentiment.score_text(df, "text", factory).collect()}
    assert got == {1: (0.2, 0.3, 0.5, 0.3), 2: (0.0, 1.0, 0.0, 0.0), 3: (0.0, 1.0, 0.0, 0.0)}
    assert sentiment.score_text(df.limit(0), "text", factory).count() == 0


def test_without_labels(spark):
    df = spark.createDataFrame([("a", None), ("b", 7)], "text string, y int")
    assert np.allclose(sentiment.fit_scorer(df, "text", "y", bits=4)(["a", ""]), 1 / 3)


def test_freshest_fields(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    a = spark.createDataFrame([(1, day(0), 1.0), (1, day(5), None), (2, day(9), 3.0), (3, day(30), 9.0)], "k int, d date, x double")
    b = spark.createDataFrame([(1, day(0), 2.0, 7.0), (2, day(1), 4.0, 8.0), (4, day(-50), 5.0, 6.0)], "k int, d date, x double, y double")
    fields = {"x": (10, 0.0), "y": (3, -1.0)}
    got = {(r.k, r.field): (r.value, r.at, r.source) for r in scoring.freshest_fields(scoring.field_values({"a": a, "b": b}, "k", "d", fields), "k", "d", fields, day(10)).collect()}
    none = (None, None)
    assert got == {
        (1, "x"): (2.0, day(0), "b"), (1, "y"): (-1.0, *none), (2, "x"): (3.0, day(9), "a"), (2, "y"): (-1.0, *none),
        (3, "x"): (0.0, *none), (3, "y"): (-1.0, *none), (4, "x"): (0.0, *none), (4, "y"): (-1.0, *none),
    }
