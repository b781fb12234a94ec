"""Scenarios, entity lookup, learned one-hot, vote weights, earliest events and drift against plain Python."""

import pytest

from solvara.operators import frames, metrics, models, stress
from solvara.sources import earliest_events


def test_scenarios_by_hand(spark):
    df = spark.createDataFrame([(1, 100.0, -10.0, 60.0, 2.0, 50.0), (2, None, 5.0, None, None, None)], "id long, wc double, income double, infl double, dist double, assets double")
    roles = {"working_capital": "wc", "net_income": "income", "inflation": "infl", "distance": "dist"}
    got = {(r.id, r.scenario): r for r in stress.apply_scenarios(df, roles).collect()}
    assert len(got) == 8 and (got[1, "base"].wc, got[1, "base"].income, got[1, "base"].infl) == (100.0, -10.0, 60.0)
    one = got[1, "stagflation"]  # an index rises by per cent; a loss deepens where assets are no role
    assert (one.wc, one.income, one.infl, one.dist, one.assets) == (75.0, -13.0, pytest.approx(63.0), 1.0, 50.0)
    assert got[2, "stagflation"].income == pytest.approx(3.5) and got[2, "recession"].income == -2.5 and got[2, "rates"].wc is None
    with_assets = {(r.id, r.scenario): r for r in stress.apply_scenarios(df, {**roles, "assets": "assets"}).collect()}
    assert with_assets[1, "recession"].assets == 42.5 and with_assets[1, "recession"].income == pytest.approx(-10 - 0.12 * 42.5)
    assert with_assets[2, "rates"].income is None
    low = spark.createDataFrame([(1, 3.0)], "id long, infl double")
    assert {r.scenario: r.infl for r in stress.apply_scenarios(low, {"inflation": "infl"}).collect()} == {"base": 3.0, "stagflation": 8.0, "rates": 3.0, "recession": 3.0}
    assert stress.apply_scenarios(df.limit(0), roles).count() == 0


def test_scenario_losses(spark):
    df = spark.createDataFrame([("base", 0.1), ("base", 0.3), ("bad", 0.6), ("bad", None)], "scenario string, pd double")
    got = {r.scenario: r for r in stress.scenario_losses(df, "pd", 0.5, 100.0, 0.5).collect()}
    assert got["bad"].obligors == 2 and got["bad"].alert_rate == 1.0 and got["bad"].expected_loss == pytest.approx(30.0)
    assert got["base"].increment == 0 and got["bad"].increment == pytest.approx(10.0) and got["bad"].increment_pct == pytest.approx(50.0)


def test_lookup_entity_priorities(spark):
    df = spark.createDataFrame(
        [(1, "abc", "Other", 2000), (2, "zz", " acme ", 2010), (3, "zz", "ACME Inc", 2020), (4, None, "Beta Corp", None), (5, None, "beta ltd", 2001), (6, "zz", "acme", 2010), (7, "", "", 2024)],
        "id long, tick string, company string, year int",
    )
    asked = spark.createDataFrame([("q1", "ABC", "acme"), ("q2", None, "Acme"), ("q3", "none", " beta"), ("q4", "", ""), ("q5", None, None)], "q string, tick string, company string")
    got = {r.q: (r.priority, r.id) for r in frames.lookup_entity(asked, df, "q", {"ticker": "tick", "name": "company"}, "year", "id").collect()}
    assert got == {"q1": (1, 1), "q2": (2, 2), "q3": (3, 5)}  # a null year comes last, ties go to the smallest id


def test_learned_one_hot(spark):
    df = spark.createDataFrame([(1, "b c"), (2, "a"), (3, None), (4, "d")], "id long, x string")
    made = frames.learned_one_hot(df, "x")
    assert made.columns == ["id", "x", "x_b_c", "x_d"]
    assert sorted((r.id, r.x_b_c, r.x_d) for r in made.collect()) == [(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 0, 1)]
    with pytest.raises(ValueError):
        frames.learned_one_hot(df, "x", most=2)


def test_vote_weights_are_curve_areas(spark):
    df = spark.createDataFrame([(0.9, 0.1, 1), (0.8, 0.2, 1), (0.2, 0.8, 0), (0.1, 0.9, 0)], "good double, bad double, y int")
    weight = models.vote_weights(df, ["good", "bad"], "y")
    assert weight["good"] == pytest.approx(1.0) and weight["bad"] < 0.5
    assert models.vote_weights(df.limit(0), ["good"], "y") == {"good": 0.0}


def test_earliest_events(spark):
    rows = [(1, '{"form": ["8-K", "10-K"], "day": ["2020-05-01", "2019-01-01"]}'), (1, '{"form": ["8-K"], "day": ["2018-02-02"]}'), (2, '{"form": ["10-K"], "day": ["2011-01-01"]}'), (3, "broken"), (None, None)]
    df = spark.createDataFrame(rows, "cik long, j string")
    got = {r.cik: (r.day, r.assumed) for r in earliest_events(df, "cik", "j", {"form": "string", "day": "string"}, lambda x: x["form"] == "8-K", "day", {2: "2000-01-01"}, "1999-09-09").collect()}
    assert got == {1: ("2018-02-02", False), 2: ("2000-01-01", True), 3: ("1999-09-09", True), None: ("1999-09-09", True)}


def test_drift_report_equals_single_columns(spark):
    """The grouped report gives what the operators for one column give, with one plan for any number of columns."""
    ref = spark.createDataFrame([(float(k % 7), float(k), None) for k in range(300)], "a double, b double, c double")
    cur = spark.createDataFrame([(float(k % 5), float(k + 90), None) for k in range(200)] + [(None, 1.0, None)], "a double, b double, c double")
    got = {r.feature: r for r in metrics.drift_report(ref, cur, ["a", "b", "c"]).collect()}
    for f in "ab":
        ks = metrics.ks_2samp(ref, cur, f).first()
        assert got[f].psi == pytest.approx(metrics.psi(ref, cur, f).first().psi) and (got[f].ks, got[f].p_value) == (pytest.approx(ks.ks), pytest.approx(ks.p_value))
    assert got["c"].psi is None and got["c"].drifted is False and got["c"].ref_mean is None
