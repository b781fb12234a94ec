"""As-of joins with one key of nearly all rows, and the bootstrap over ranges that share a score."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from solvara.operators import metrics, timejoin

DAY = dt.date(2020, 1, 1)


def test_asof_of_a_hot_key(spark):
    r = random.Random(2)
    key = lambda: "hot" if r.random() < 0.9 else r.choice(["b", "c", None])
    left = spark.createDataFrame([(k, key(), None if k % 97 == 0 else DAY + dt.timedelta(r.randrange(900)), "own") for k in range(2000)], "id int, k string, t date, note string")
    quotes = {(key(), DAY + dt.timedelta(100 + r.randrange(700))): float(n) for n in range(300)}
    right = spark.createDataFrame([(k, q, p) for (k, q), p in quotes.items()] + [("hot", None, -1.0)], "k string, q date, p double")
    own = {}
    for (k, q), p in quotes.items():
        own.setdefault(k, []).append((q, p))
    want = {}
    for x in left.collect():
        fits = [v for v in own.get(x.k, []) if x.k is not None and x.t is not None and v[0] <= x.t]
        want[x.id] = max(fits) if fits else (None, None)
    for limit in (10**6, 100):
        got = timejoin.asof_join(left, right, "k", "t", "q", ["p"], hot_rows=limit)
        assert got.columns == ["id", "k", "t", "note", "asof_q", "p"]
        assert {x.id: (x.asof_q, x.p) for x in got.collect()} == want
    # the hot key's rows lie in several ranges
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        line = left.where("k = 'hot' AND t IS NOT NULL").selectExpr("k AS __by", "t AS __ts", "1 AS __side", "CAST(NULL AS STRUCT<p: DOUBLE>) AS __r")
        rows, _ = timejoin._carried_over_ranges(line)
        sizes = Counter(x[0] for x in rows.select("__range").collect())
        assert len(sizes) > 3 and max(sizes.values()) < 0.6 * sum(sizes.values())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert timejoin.asof_join(left.limit(0), right, "k", "t", "q", ["p"]).count() == 0
    assert timejoin.asof_join(left, right.limit(0), "k", "t", "q", ["p"]).where("p IS NOT NULL").count() == 0


def test_bootstrap_over_ranges_is_that_of_one(spark):
    r = random.Random(8)
    rows = [(k, 0.5 if r.random() < 0.6 else round(r.random(), 2), int(r.random() < 0.3)) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, s double, y int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = metrics.bootstrap(df, "s", "y", "id", 40).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = metrics.bootstrap(df, "s", "y", "id", 40).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
    for a, b in zip(sorted(many), sorted(one)):
        assert a.metric == b.metric and all(abs(x - y) < 1e-9 for x, y in zip(a[1:], b[1:]))
    odd = df.unionByName(spark.createDataFrame([(1, None, 1), (2, 0.5, None), (3, float("nan"), 1)], df.schema))
    assert all(abs(x - y) < 1e-9 for a, b in zip(sorted(metrics.bootstrap(odd, "s", "y", "id", 40).collect()), sorted(one)) for x, y in zip(a[1:], b[1:]))
    assert metrics.bootstrap(df.limit(0), "s", "y", "id", 10).collect() == []
    assert metrics.bootstrap(df.where(F.col("y") == 0), "s", "y", "id", 10).collect() == []


def test_trailing_months(spark):
    rows = [(1, "a", DAY, 1.0), (2, "a", dt.date(2020, 6, 30), 3.0), (3, "a", dt.date(2020, 7, 1), 5.0), (4, "b", dt.date(2020, 6, 1), 7.0), (5, "a", dt.date(2020, 6, 2), None), (6, "a", None, 9.0)]
    df = spark.createDataFrame(rows, "id int, k string, d date, x double")
    got = {r.id: (r.x_avg, r.x_max, r.x_range, r.market_mean) for r in timejoin.trailing_months(df, "k", "d", "x", 6).collect()}
    # January is within six months of June, not of July
    assert got == {1: (1.0, 1.0, 0.0, 1.0), 2: (2.0, 3.0, 2.0, 5.0), 5: (2.0, 3.0, 2.0, 5.0), 3: (4.0, 5.0, 2.0, 5.0), 4: (7.0, 7.0, 0.0, 5.0), 6: (None, None, None, None)}
