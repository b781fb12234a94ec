"""Running sums, tails, scorecards, mixtures, network panels, streams and scoring on small frames."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from solvara import functions as fx
from solvara import sources, streaming
from solvara.operators import events, finance, frames, models, network, ordered, scoring, timejoin

DAY = dt.date(2020, 1, 1)


def test_running_sums_and_quantiles(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", None]), r.randint(0, 40) / 4, r.randint(1, 9)) for _ in range(400)] + [("one", 7.0, 2), ("a", None, 1)]
    df = spark.createDataFrame(rows, "g string, x double, n long").repartition(5)
    one = df.where("x IS NOT NULL").groupBy("g", "x").agg(F.sum("n").alias("n"))
    got = ordered.running_sums(one, [F.desc("x")], ["n"], ["g"]).collect()
    for row in got:
        own = [(x, n) for g, x, n in rows if g == row.g and x is not None]
        assert (row.n_upto, row.n_all) == (sum(n for x, n in own if x >= row.x), sum(n for _, n in own))
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for row in ordered.quantiles(df, "x", shares, ["g"]).collect():
        assert np.allclose(row.q, np.quantile([x for g, x, _ in rows if g == row.g and x is not None], shares))
    assert ordered.quantiles(df.where("x IS NULL"), "x", [0.5]).first().q is None


def test_tails(spark):
    x = spark.createDataFrame([(k / 4,) for k in range(0, 60)], "x double")
    for r in x.select("x", fx.normal_tail("x").alias("n"), fx.chi2_tail("x", 1).alias("c1"), fx.chi2_tail("x", 2).alias("c2"), fx.chi2_tail("x", 3).alias("c3"), fx.chi2_tail("x", 8).alias("c8")).collect():
        n = 0.5 * math.erfc(r.x / math.sqrt(2))
        assert abs(r.n - n) < 1e-14 and abs(r.n / n - 1) < 1e-4  # as the docstring says
        h = r.x / 2  # chi-squared tails in closed form
        assert abs(r.c1 - math.erfc(math.sqrt(h))) < 3e-7 and abs(r.c2 - math.exp(-h)) < 1e-12
        assert abs(r.c3 - (math.erfc(math.sqrt(h)) + 2 * math.sqrt(h / math.pi) * math.exp(-h))) < 3e-7
        assert abs(r.c8 - math.exp(-h) * sum(h**k / math.factorial(k) for k in range(4))) < 1e-12


def test_topics_and_composite(spark):
    texts = [("files for Chapter 11 after missed payment",), ("SEC probe and covenant relief",), ("nothing here",), (None,), ("class action lawsuit",)]
    df = spark.createDataFrame(texts, "t string").withColumn("neg", F.lit(0.5))
    got = [(r.topic, round(r.intensity, 4), r.flagged) for r in events.distress_topics(df, "t", F.col("neg")).collect()]
    assert got == [("chapter11_bankruptcy", 1.0, 1), ("litigation_fraud", 0.874, 1), ("none", 0.0, 0), ("none", 0.0, 0), ("litigation_fraud", 0.598, 1)]
    # the largest weight counts, whatever stands first
    assert [r[0] for r in spark.createDataFrame([("junk status then debt default",)], "t string").select(fx.intensity("t", fx.DISTRESS_TOPICS["default_covenants"])).collect()] == [1.0]
    shares = events.sentiment_shares(spark.createDataFrame([("Good good bad x",), (None,)], "t string"), "t", ["good"], ["bad"]).collect()
    assert (shares[0].positive, shares[0].negative, shares[0].neutral, shares[0]["index"]) == (0.5, 0.25, 0.25, 0.25) and shares[1].neutral == 1.0


def test_merged_bins():
    for seed in range(200):
        r = random.Random(seed)
        bins = [(float(k), r.randint(0, 40), r.randint(0, 20)) for k in range(r.randint(1, 20))]
        out = models.merged_bins(bins)
        total = sum(g + b for _, g, b in bins)
        assert sum(g for _, g, _ in out) == sum(g for _, g, _ in bins) and sum(b for *_, b in out) == sum(b for *_, b in bins)
        rates = [b / (g + b) for _, g, b in out]
        assert len(out) <= 6 and (rates == sorted(rates) or rates == sorted(rates, reverse=True))
        assert len(out) == 1 or all(g + b >= 0.05 * total for _, g, b in out)
        assert [e for e, *_ in out] == sorted(e for e, *_ in out)


def test_scorecard(spark):
    r = random.Random(5)
    rows = []
    for k in range(1500):
        y = int(r.random() < 0.25)
        rows.append((k, r.gauss(-y, 1), r.gauss(0, 1) if k % 9 else None, y))
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    table = models.woe_table(df, "a", "y")
    for t in table:
        own = [y for _, a, _, y in rows if a is not None and t["low"] < a <= t["high"]]
        assert (t["good"], t["bad"]) == (own.count(0), own.count(1))
        good, bad = sum(1 - y for *_, y in rows), sum(y for *_, y in rows)
        assert abs(t["woe"] - math.log((t["good"] + 0.5) / (good + 0.5) / ((t["bad"] + 0.5) / (bad + 0.5)))) < 1e-12
    assert models.woe_table(df, "b", "y")[-1]["high"] is None  # nulls have a bin
    card = models.woe_scorecard(df, ["a", "b"], "y")
    got = card(df).collect()
    assert all(300 - 1e-9 <= g.points <= 850 + 1e-9 for g in got)
    order = sorted(got, key=lambda g: g.points)
    assert all(x.score >= y.score - 1e-9 for x, y in zip(order, order[1:]))  # more points, less risk
    rated = scoring.rated(spark.createDataFrame([(900.0,), (780.0,), (600.0,), (299.0,)], "p double"), "p").collect()
    assert [(x.p, x.rating, x.service_rating, x.decision, round(x.implied_pd, 4)) for x in rated] == [(850.0, "AAA", "AAA", "approve", 0.0001), (780.0, "AAA", "AAA", "approve", 0.1273), (600.0, "BBB", "BBB", "approve", 0.4545), (300.0, "D", "D", "reject", 0.9999)]


def test_mixtures(spark):
    r = random.Random(2)
    centres = {"x": (0.0, 1.0, 5.0), "t": (9.0, 2.0, 3.0), "c": (1.0, 12.0, -4.0)}
    rows = [(k, *(r.gauss(m, 0.3) for m in centres[k])) for k in "xtc" for _ in range(60)] + [("x", None, None, None)]
    df = spark.createDataFrame(rows, "kind string, rate double, jobless double, growth double")
    order = models.regime_order("rate", "jobless", "growth")
    got = models.named_mixture(df, ["rate", "jobless", "growth"], 3, order, ["expansion", "tightening", "crisis"]).collect()
    names = {"x": "expansion", "t": "tightening", "c": "crisis"}
    assert all(g.component_name == names[g.kind] for g in got if g.rate is not None) and len(got) == len(rows)
    assert all(abs(g.expansion_prob + g.tightening_prob + g.crisis_prob - 1) < 1e-9 for g in got)
    # one component leads in both: the one of least growth is the crisis
    assert order([{"rate": 1, "jobless": 1, "growth": 0}, {"rate": 9, "jobless": 9, "growth": 5}, {"rate": 2, "jobless": 2, "growth": -3}]) == [0, 1, 2]
    assert models.sum_order("a", "b")([{"a": 1, "b": 5}, {"a": 0, "b": 0}]) == [1, 0]
    ll, n, free = models.diagonal_mixture(df.dropna(), ["rate", "jobless"], 3)
    x = np.array([(a, b) for _, a, b, _ in rows if a is not None])
    one = sum(-0.5 * (((x - x.mean(0)) ** 2 / x.var(0)) + np.log(2 * np.pi * x.var(0))).sum(1))
    assert (n, free) == (180, 14) and ll > one + 100
    least = models.diagonal_mixture(df.dropna(), ["rate", "jobless"], 1)
    assert abs(least[0] - one) < 1e-6


def test_network_panels(spark):
    month = lambda k: dt.date(2020 + (k - 1) // 12, (k - 1) % 12 + 1, 1)
    nodes = spark.createDataFrame([(month(m), n, 1.0 * n, 0) for m in (13, 14, 26) for n in (1, 2, 3)] + [(month(13), 9, 1.0, 5)], "ym date, node long, rank double, community int")
    ev = spark.createDataFrame([(1, dt.date(2020, 1, 31)), (2, dt.date(2021, 1, 15)), (9, dt.date(2020, 5, 1)), (None, None)], "node long, day date")
    got = {(r.ym, r.node): r.infection for r in network.prior_distress(nodes, ev, "ym", "node", "community", "day").collect()}
    assert [got[month(13), n] for n in (1, 2, 3)] == [0.0, 0.5, 0.5]  # January 2020 counts up to January 2021
    assert [got[month(14), n] for n in (1, 2, 3)] == [0.5, 0.0, 0.5]  # then only January 2021 does
    assert [got[month(26), n] for n in (1, 2, 3)] == [0.0, 0.0, 0.0] and got[month(13), 9] == 0.0
    filings = spark.createDataFrame([(1, 1, dt.date(2021, 1, 5)), (1, 3, dt.date(2021, 1, 5)), (2, 1, dt.date(2019, 1, 5)), (3, None, dt.date(2021, 1, 5))], "id int, ticker long, day date")
    match = {r.id: (r.ticker, r.rank, r.imputed) for r in network.match_filings(filings, nodes, "id", "ticker", "day", "ym", "rank").collect()}
    assert match == {1: (3, 3.0, 0), 2: (1, None, 1), 3: (None, None, 1)}
    audit = network.network_audit(spark.createDataFrame([(0, 1.0, 0), (0, 3.0, 1), (1, None, 1)], "imputed int, rank double, bad int"), ["rank"], ["bad"], "imputed")
    rows = {r.imputed: (r.rows, r.nulls, r.mean, r.corr_bad) for r in audit.collect()}
    assert rows[0] == (2, 0, 2.0, 1.0) and rows[1][:2] == (1, 1) and rows[None][:3] == (3, 1, 2.0)


def test_alternate_key_and_series(spark):
    right = spark.createDataFrame([("ACME", DAY, 5)], "ticker string, month date, n int")
    by_name = spark.createDataFrame([(1, " acme ", DAY + dt.timedelta(9)), (2, "acme", DAY + dt.timedelta(40)), (3, None, DAY)], "id int, company_name string, day date")
    join = lambda left: {r.id: r.n for r in timejoin.alternate_key_join(left, right, ["ticker", "company_name"], "ticker", "day", "month", {"n": 0}).collect()}
    assert join(by_name) == {1: 5, 2: 0, 3: 0}
    assert join(by_name.withColumn("ticker", F.lit("other"))) == {1: 0, 2: 0, 3: 0}  # a ticker column comes first
    with pytest.raises(ValueError):
        join(by_name.drop("company_name"))
    series = spark.createDataFrame([(DAY, 1.0), (dt.date(2020, 4, 1), None), (dt.date(2020, 6, 1), 6.0)], "month date, v double")
    left = spark.createDataFrame([(k, d) for k, d in enumerate([dt.date(2019, 12, 31), DAY, dt.date(2020, 3, 9), dt.date(2020, 4, 2), dt.date(2020, 9, 9), None])], "id int, d date")
    assert {r.id: r.v for r in timejoin.series_asof(left, series, "d", "month", ["v"]).collect()} == {0: None, 1: 1.0, 2: 1.0, 3: None, 4: 6.0, 5: None}


def test_request_scores(spark):
    schema = "total_assets double, working_capital double, retained_earnings double, ebit double, net_income double, market_value double, total_liabilities double, equity double, revenue double, distance_to_default double"
    df = spark.createDataFrame([(None,) * 10, (100.0, -10.0, 5.0, 0.0, 8.0, 50.0, 0.0, 120.0, None, 0.5), (-5.0, 1.0, 0.0, 1.0, -1.0, 2.0, 4.0, -1.0, 3.0, None)], schema)
    z = [r.altman_z for r in finance.request_altman(df).collect()]
    assert np.allclose(z, [0.6 + 0.999, 1.2 * -0.1 + 1.4 * 0.05 + 3.3 * 0.08 + 0.6 * 50 / 50 + 0.999, 1.2 + 3.3 + 0.6 * 2 / 4 + 0.999 * 3])
    p = [r.pd for r in scoring.fallback_pd(df).collect()]
    s = lambda x: 1 / (1 + math.exp(-x))
    assert np.allclose(p, [s(-2.15), s(-2.15 + 0.85 + 0.75), s(-2.15 + 0.64)])
    v = finance.firm_value_and_sigma(spark.createDataFrame([(1.0, 2.0, None, 0.0, None), (9e4, 1e4, 2e5, 0.01, 0.4), (0.0, 0.0, None, None, 0.4)], "d double, c double, a double, v double, m double"), "d", "c", "a", "v", "m").collect()
    assert [(r.firm_asset_value, r.sigma_asset) for r in v] == [(10_000.0, 0.35), (2e5, 0.05), (10_000.0, 0.4)]
    fitted = finance.fit_median_scale(spark.createDataFrame([(1.0, 200.0), (3.0, 260.0)], "x double, cpi double"), ["x", "cpi"])
    req = spark.createDataFrame([("4", 10.0), ("junk", None), (None, 300.0)], "x string, cpi double")
    got = [(r.x, round(r.cpi, 6)) for r in scoring.prepared_features(req, ["x", "cpi"], {"cpi": 230.0}, fitted, "cpi").collect()]
    assert got == [(2.0, round((236.468 * 1.1 - 230) / 30, 6)), (0.0, 0.0), (0.0, round(70 / 30, 6))]


def test_cohorts_and_synthetic(spark):
    df = spark.range(500).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"), (F.col("id") * 1.0).alias("x"))
    pick = lambda mode, n: scoring.cohort_rows(df, "id", "y", F.col("x") > 250, n, mode).collect()
    assert all(r.x > 250 and not r.y for r in pick("solvent", 50)) and len(pick("solvent", 460)) == 450
    assert all(r.y for r in pick("distressed", 20)) and sum(r.y for r in pick("random", 100)) == 12 and pick("random", 30) == pick("random", 30)
    made = scoring.synthetic_rows(df, ["x"], 4000, ["x"]).agg(F.avg("x").alias("m"), F.stddev("x").alias("s"), F.min("x").alias("lo")).first()
    assert abs(made.m - 249.5) < 2 and abs(made.s - 24.95) < 2 and made.lo >= 0.01


def test_time_split_and_audit(spark):
    df = spark.createDataFrame([(DAY + dt.timedelta(k // 2), k % 2) for k in range(20)], "d date, y int")
    got = {r.d: r.split for r in frames.time_split(df, "d", 2025).collect()}
    assert got[DAY] == "train" and got[DAY + dt.timedelta(9)] == "test"
    wide = df.unionByName(spark.createDataFrame([(dt.date(2026, 1, 1), 0)], "d date, y int"))
    assert {r.split for r in frames.time_split(wide, "d", 2025).where("year(d) = 2026").collect()} == {"test"}
    audit = frames.panel_audit(df, ["d"], "d", "y").first()
    assert (audit.rows, audit.duplicate_keys, audit.positives, audit.negatives) == (20, 10, 10, 10)


def test_streams_expire_and_skip_bad_files(spark, tmp_path):
    at = dt.datetime(2020, 1, 1)
    rows = [("a", at, 1.0), ("a", at + dt.timedelta(days=2), 2.0), ("b", at, 3.0), ("c", at + dt.timedelta(days=9), 4.0), ("d", at + dt.timedelta(days=5), 5.0)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "k string, ts timestamp, v double").repartition(2).write.parquet(folder)
    got = {r.k: r.v for r in streaming.latest_by_key(spark, folder, "k", "ts", "v", "5 days").collect()}
    assert got == {"c": 4.0, "d": 5.0}
    sums = {(r.k, r.window_end.day): (r.rows, round(r.decayed, 6)) for r in streaming.sliding_totals(spark, folder, "k", "ts", "v", window="2 days", half_life=1.0).collect()}
    assert sums["a", 2] == (1, 0.5) and sums["a", 3] == (1, 0.25) and sums["a", 4] == (1, 1.0)
    (tmp_path / "in" / "part-x.parquet").write_bytes(b"not a table")
    target = str(tmp_path / "out")
    streaming.ingest_folder(spark, folder, target, str(tmp_path / "mark"), spark.createDataFrame(rows, "k string, ts timestamp, v double").schema)
    report = streaming.ingest_report(spark, folder, target).groupBy("ingested").agg(F.sum("rows").alias("n")).collect()
    assert {r.ingested: r.n for r in report} == {True: 5, False: 0}


def test_swap_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(3):
        sources.write_swap(spark.range(k + 1), path)
        assert spark.read.parquet(path).count() == k + 1
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
