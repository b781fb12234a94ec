"""Operators on tiny frames: edges of windows, nulls, ties and formulas by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from solvara import functions as fx
from solvara import sources, streaming
from solvara.operators import finance, frames, metrics, network, scoring, timejoin

DAY = dt.date(2020, 1, 1)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_forward_label_edges(spark):
    days = [(0, 0), (200, 0), (365, 0), (366, 1), (800, 1)]
    df = spark.createDataFrame([(1, DAY + dt.timedelta(d), f) for d, f in days], "e int, d date, f int")
    got = dict((r.d, r.label) for r in timejoin.forward_label(df, "e", "d", "f", 12).collect())
    # 2020 is a leap year: 12 months from day 0 is day 366, which is included
    assert [got[DAY + dt.timedelta(d)] for d, _ in days] == [1, 1, 1, 0, 1]
    without = timejoin.forward_label(df, "e", "d", "f", 12, terminal=False).where("d = date '2022-03-11'").collect()[0]
    assert without.label == 0


def test_same_day_is_not_ahead(spark):
    df = spark.createDataFrame([(1, DAY, 0), (1, DAY, 1), (1, DAY + dt.timedelta(900), 0)], "e int, d date, f int")
    assert {r.label for r in timejoin.forward_label(df, "e", "d", "f", 12).collect()} == {0}


def test_asof_boundary(spark):
    left = spark.createDataFrame([(1, "a", DAY), (2, "a", DAY - dt.timedelta(3)), (3, "b", DAY)], "id int, k string, t date")
    right = spark.createDataFrame([("a", DAY, 5.0), ("a", DAY - dt.timedelta(1), 4.0)], "k string, q date, p double")
    got = {r.id: r.p for r in timejoin.asof_join(left, right, "k", "t", "q", ["p"]).collect()}
    assert got == {1: 5.0, 2: None, 3: None}


def test_band_includes_both_ends(spark):
    cal = spark.createDataFrame([("a", DAY)], "k string, end date")
    ev = spark.createDataFrame([("a", DAY - dt.timedelta(n)) for n in (0, 30, 31)], "k string, day date")
    assert timejoin.band_join_agg(cal, ev, "k", "end", "day", 30, [F.count(F.lit(1)).alias("n")]).first().n == 2


def test_silence_runs(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([1, 0, 0, 1, 0, 0, 0, None])], "k string, t int, n int")
    got = [r.silent_run for r in timejoin.silence(df, "k", "t", "n").orderBy("t").collect()]
    assert got == [0, 1, 2, 0, 1, 2, 3, 4]


def test_restatement_priority(spark):
    df = spark.createDataFrame([(1, "e", "p", "10-K", DAY, 40), (2, "e", "p", "10-K/A", DAY + dt.timedelta(30), 70), (3, "e", "p", "10-K/A", DAY + dt.timedelta(300), 340), (4, "e", "p", "10-K", DAY + dt.timedelta(400), -5)], "id int, e string, p string, form string, filed date, lag int")
    assert [r.id for r in frames.dedup_restated(df, "e", "p", "form", "filed", "lag", "id").collect()] == [2]


def test_variant_and_priority(spark):
    df = spark.createDataFrame([("AB.C",), ("X",)], "k string")
    right = spark.createDataFrame([("AB-C", 1), ("XQ", 2), ("X.PK", 3)], "r string, v int")
    got = frames.variant_match(df, right, "k", [F.col("k"), F.regexp_replace("k", r"\.", "-"), F.concat("k", F.lit("Q")), F.concat("k", F.lit(".PK"))], "r")
    assert sorted((r.k, r.v) for r in got.collect()) == [("AB.C", 1), ("X", 2)]


def test_ratio_nulls_and_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (None, 2.0), (1.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(fx.ratio("a", "b")).collect()] == [0.0, 0.0, 0.0, 0.25]
    assert [r[0] for r in df.select(fx.ratio("a", "b", None)).collect()] == [None, None, None, 0.25]


def test_normal_cdf(spark):
    df = spark.range(-40, 41).select((F.col("id") / 10.0).alias("x"))
    for r in df.select("x", fx.normal_cdf("x").alias("p")).collect():
        assert abs(r.p - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 1e-7


def test_timestamps_money_softmax(spark):
    df = spark.createDataFrame([("Mon, 06 Jan 2020 10:00:00",), ("2020-01-06 10:00:00",), ("20200106T100000",), ("junk",), (None,)], "t string")
    got = [r[0] for r in df.select(fx.parse_timestamp("t", ["dd MMM yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd'T'HHmmss"])).collect()]
    assert got == [dt.datetime(2020, 1, 6, 10)] * 3 + [None, None]
    assert [r[0] for r in spark.createDataFrame([(-2.5e9,), (1234.0,), (7.0,)], "x double").select(fx.money("x")).collect()] == ["-$2.50B", "$1.23K", "$7.00"]
    soft = spark.sql("SELECT array(1D, 2D, 3D) AS v").select(fx.softmax("v").alias("s")).first().s
    assert abs(sum(soft) - 1) < 1e-12 and soft[0] < soft[1] < soft[2]


def test_title_summary_and_intensity(spark):
    df = spark.createDataFrame([("T", "t"), ("T", "nan"), ("T", None), ("T", "more")], "a string, b string")
    assert [r[0] for r in df.select(fx.title_and_summary("a", "b")).collect()] == ["T", "T", "T", "T. more"]
    texts = spark.createDataFrame([("Chapter 11 filing and default",), ("default only",), (None,)], "x string")
    assert [r[0] for r in texts.select(fx.intensity("x", {r"\bchapter 11\b": 1.0, r"\bdefault\b": 0.6})).collect()] == [1.0, 0.6, 0.0]


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1), (0.5, 0)], "s double, y int")
    assert metrics.roc_auc(metrics.score_counts(df, "s", "y")).first().roc_auc == 0.5
    assert metrics.roc_auc(metrics.score_counts(df.where("y = 1"), "s", "y")).first().roc_auc is None


def test_threshold_first_minimum(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 0)], "s double, y int")
    best = metrics.best_threshold(metrics.score_counts(df, "s", "y")).first()
    assert (best.tau, best.value, best.tp, best.fp, best.fn) == (0.21, 0.0, 1, 0, 0)


def test_psi_constant_and_delong_equal(spark):
    one = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert metrics.psi(one, one, "x").first().psi == 0.0
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int").withColumn("b", F.col("s"))
    d = metrics.delong(df, "y", "s", "b").first()
    assert d.auc_a == d.auc_b == 0.75 and d.variance == 0.0 and d.z == 0.0


def test_purged_folds_gap(spark):
    df = spark.createDataFrame([(DAY + dt.timedelta(30 * k),) for k in range(120)], "d date")
    folds = metrics.purged_folds(df, "d", 5, 365).collect()
    assert folds and all((f.valid_start - f.train_end).days > 365 for f in folds)


def forest(spark, pairs):
    return spark.createDataFrame([("m", i, j, w) for i, j, w in pairs], "ym string, i int, j int, distance double")


def test_spanning_forest_against_kruskal(spark):
    import random

    r = random.Random(3)
    edges = [(i, j, round(r.random(), 1)) for i in range(12) for j in range(i + 1, 12)]  # tied weights
    root = list(range(12))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    kept = set()
    for w, i, j in sorted((w, i, j) for i, j, w in edges):
        if find(i) != find(j):
            root[find(i)] = find(j)
            kept.add((i, j))
    got = network.spanning_forest(forest(spark, edges)).collect()
    assert {(r.i, r.j) for r in got} == kept


def test_tree_measures(spark):
    path = forest(spark, [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0)])
    star = forest(spark, [(1, k, 1.0) for k in range(2, 6)])
    between = {r.node: round(r.betweenness, 6) for r in network.subtree_betweenness(path).collect()}
    assert between == {1: 0.0, 2: 0.5, 3: round(4 / 6, 6), 4: 0.5, 5: 0.0}
    assert {r.node: r.betweenness for r in network.subtree_betweenness(star).collect()}[1] == 1.0
    assert {r.node: r.degree for r in network.degree(star).collect()} == {1: 4, 2: 1, 3: 1, 4: 1, 5: 1}
    assert abs(sum(r.pagerank for r in network.pagerank(star).collect()) - 1) < 1e-6
    groups = {r.node: r.community for r in network.communities(forest(spark, [(1, 2, 1.0), (2, 3, 9.0), (3, 4, 1.0)]), cut=0.5).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 3}


def test_impute_levels(spark):
    df = spark.createDataFrame([(1, "a", "x", 1.0), (2, "a", "x", 3.0), (3, "a", "x", None), (4, "b", "x", None), (5, "c", "y", None)], "id int, k string, g string, v double")
    got = {r.id: (r.v_imputed, r.v_imputed_level) for r in finance.hier_impute(df, "v", [["k"], ["g"]], 9.0).collect()}
    assert got == {1: (1.0, 0), 2: (3.0, 0), 3: (2.0, 1), 4: (2.0, 2), 5: (2.0, 3)}


def test_attributions_add_up(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 1.0)], "id int, a double, b double")
    means = df.agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    total = {r.id: r.s for r in scoring.attributions(df, "id", {"a": 2.0, "b": -1.0}, means).groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    assert total == {1: -4.0, 2: 4.0}


def test_freshest_respects_ttl(spark):
    df = spark.createDataFrame([("a", DAY, 1.0, None), ("a", DAY - dt.timedelta(5), 2.0, 7.0), ("a", DAY - dt.timedelta(200), 3.0, 8.0)], "k string, t date, x double, y double")
    got = scoring.freshest([df], "k", "t", {"x": (90, 0.0), "y": (3, -1.0)}, F.lit(DAY)).first()
    assert (got.x, got.y) == (1.0, -1.0)


def test_parsers(spark):
    df = spark.createDataFrame([('{"d": ["1", "2"], "f": ["a", "b"]}', "<rss><channel><item><title>T</title><link>l</link></item><item><title> </title></item></channel></rss>", '<a href="/x">1</a><a href="http://o/y">2</a><a href="/x">3</a>')], "j string, x string, h string").withColumn("id", F.lit(1))
    assert rows(sources.explode_parallel(df.select("j"), "j", {"d": "string", "f": "string"}).select("d", "f")) == [("1", "a"), ("2", "b")]
    assert rows(sources.parse_feed(df.select("x"), "x").select("title", "link")) == [("T", "l")]
    assert [(r.position, r.link) for r in sources.extract_links(df, "id", "h", F.lit("http://s")).orderBy("position").collect()] == [(0, "http://s/x"), (1, "http://o/y")]


def test_swap_and_audit(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    sources.write_swap(spark.read.parquet(path).withColumn("x", F.lit(1)), path)
    assert spark.read.parquet(path).columns == ["id", "x"] and spark.read.parquet(path).count() == 3
    sources.audit_log(spark.range(2), str(tmp_path / "log"), ["id"])
    sources.audit_log(spark.range(2), str(tmp_path / "log"), ["id"])
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = spark.createDataFrame([(k % 3, k, float(k)) for k in range(20)], "k int, t int, v double")
    df.repartition(4).write.parquet(folder)
    assert sorted(rows(streaming.latest_by_key(spark, folder, "k", "t", "v"))) == sorted(rows(df.groupBy("k").agg(F.max("t").alias("t"), F.max_by("v", "t").alias("v"))))
    assert sorted(rows(streaming.stream_counts(spark, folder, "k"))) == sorted(rows(df.groupBy("k").count()))
    target, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    streaming.ingest_folder(spark, folder, target, mark)
    streaming.ingest_folder(spark, folder, target, mark)
    assert spark.read.parquet(target).count() == 20


def test_empty_tables(spark):
    none = spark.createDataFrame([], "e int, d date, f int")
    assert timejoin.forward_label(none, "e", "d", "f").count() == 0
    assert metrics.roc_auc(metrics.score_counts(spark.createDataFrame([], "s double, y int"), "s", "y")).first().roc_auc is None
    assert network.spanning_forest(spark.createDataFrame([], "ym string, i int, j int, distance double")).count() == 0


@pytest.mark.parametrize("n", [1, 5])
def test_sample_repeats(spark, n):
    df = spark.range(50)
    assert rows(frames.sample_rows(df, "id", n)) == rows(frames.sample_rows(df.repartition(7), "id", n))


def test_network_has_every_month(spark):
    from solvara import plans

    folder = "/root/testdata/sf0.001"
    line = sources.table(spark, folder, "lineitem").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b")).first()
    months = {dt.date.fromisoformat(r.ym) for r in plans.QUERIES["net02_correlation"](spark, folder).select("ym").distinct().collect()}
    assert min(months).year <= line.a.year + 1 and (max(months).year, max(months).month) == (line.b.year, line.b.month)


def test_bootstrap_metrics(spark):
    import random

    r = random.Random(5)
    data = [(k, round(r.random(), 1), int(r.random() < 0.4)) for k in range(120)]
    b = 60
    # the row weights as drawn; metrics of each replicate by hand
    drawn = spark.createDataFrame(data, "id long, s double, y int").crossJoin(spark.range(1, b + 1).selectExpr("int(id) AS replicate"))
    u = (F.pmod(F.xxhash64("id", "replicate", F.lit(42)), F.lit(2**30)) + 0.5) / float(2**30)
    limits = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815)
    each = {}
    for x in drawn.select("replicate", "s", "y", u.alias("u")).collect():
        each.setdefault(x.replicate, []).extend([(x.s, x.y)] * sum(x.u > c for c in limits))
    want = {"pr_auc": [], "roc_auc": [], "f2": [], "brier": []}
    for rows_ in each.values():
        pos, neg = [s for s, y in rows_ if y], [s for s, y in rows_ if not y]
        want["roc_auc"].append(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg))
        want["brier"].append(sum((y - s) ** 2 for s, y in rows_) / len(rows_))
        tp, fp = sum(s >= 0.3 for s in pos), sum(s >= 0.3 for s in neg)
        want["f2"].append(5 * tp / (5 * tp + 4 * (len(pos) - tp) + fp))
        area, p0, r0 = 0.0, 1.0, 0.0
        for t in sorted({s for s, _ in rows_}, reverse=True):
            tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
            p1, r1 = tp / (tp + fp), tp / len(pos)
            area, p0, r0 = area + (r1 - r0) * (p1 + p0) / 2, p1, r1
        want["pr_auc"].append(area)
    got = {x.metric: x for x in metrics.bootstrap(drawn.select("id", "s", "y").distinct(), "s", "y", "id", b).collect()}
    assert set(got) == set(want)
    for name, values in want.items():
        assert math.isclose(got[name].mean, sum(values) / b)
        v, at = sorted(values), 0.025 * (b - 1)
        assert math.isclose(got[name].low, v[int(at)] + (at - int(at)) * (v[int(at) + 1] - v[int(at)]))


def test_registered_draws(spark, monkeypatch):
    from solvara.plans import QUERIES

    seen = {}
    for name, count in (("bootstrap", "b"), ("monte_carlo", "n")):
        own = getattr(metrics, name)

        def watched(*args, own=own, name=name, count=count, **kw):
            import inspect

            bound = inspect.signature(own).bind(*args, **kw)
            bound.apply_defaults()
            seen[name] = bound.arguments[count]
            return own(*args, **kw)

        monkeypatch.setattr(metrics, name, watched)
    for q in ("stt03_bootstrap", "str03_monte_carlo"):
        QUERIES[q](spark, "/root/testdata/sf0.001")
    assert seen == {"bootstrap": 1000, "monte_carlo": 1000}


def test_modularity_communities(spark):
    # two stars of equal edges joined by one edge as short as theirs, and a pair in a tree of its own
    edges = [(1, k, 1.0) for k in (2, 3, 4, 5)] + [(6, k, 1.0) for k in (7, 8, 9, 10)] + [(1, 6, 1.0), (20, 21, 3.0)]
    got = {r.node: r.community for r in network.modularity_communities(forest(spark, edges)).collect()}
    assert got == {**dict.fromkeys(range(1, 6), 1), **dict.fromkeys(range(6, 11), 6), 20: 20, 21: 20}


def test_pagerank_meets_its_tolerance(spark):
    # a star with four equal leaves: hub h = 0.03 + 0.85 * (1 - h)
    got = {r.node: r.pagerank for r in network.pagerank(forest(spark, [(1, k, 1.0) for k in range(2, 6)])).collect()}
    hub = 0.88 / 1.85
    assert abs(got[1] - hub) < 1e-5 and all(abs(got[k] - (1 - hub) / 4) < 1e-5 for k in range(2, 6))
