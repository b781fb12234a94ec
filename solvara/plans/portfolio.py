"""Scenarios on features, voting by curve areas, and lookups of entities and their earliest events."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvara import sources
from solvara.operators import frames, models, scoring, stress
from solvara.plans.registry import day_text, query, rounded, scored, sheet

c = F.col

_STRESS = """WITH s AS (SELECT * FROM (VALUES ('base', 1e0, 1e0, 0e0, 0e0), ('stagflation', 0.75e0, 1e0, -1e0, 0.05e0), ('rates', 1e0, 1e0, -2e0, 0.03e0), ('recession', 0.5e0, 0.85e0, -1.8e0, 0.12e0)) x(scenario, wf, af, ds, loss)),
  p AS (SELECT scenario, entity, net_income - loss * abs(total_assets * af) AS net_income, total_assets * af AS total_assets, (current_assets - current_liabilities) * wf AS working_capital, coalesce(net_income, 0) / 2000 + ds AS distance FROM sheet, s),
  q AS (SELECT *, least(greatest(1 / (1 + exp(-(-0.75 * distance - 2.8 * coalesce(working_capital / nullif(total_assets, 0), 0) + 1.10))), 0.001), 0.999) AS pd FROM p)"""
_ROLES = {"working_capital": "working_capital", "net_income": "net_income", "assets": "total_assets", "distance": "distance"}


def _stressed(t):
    s = sheet(t).withColumn("working_capital", c("current_assets") - c("current_liabilities")).withColumn("distance", F.coalesce("net_income", F.lit(0.0)) / 2000)
    rows = stress.apply_scenarios(s, _ROLES)
    ratio = F.coalesce(F.try_divide("working_capital", "total_assets"), F.lit(0.0))
    return rows.withColumn("pd", scoring.structural_pd(c("distance"), ratio))


@query("str01_feature_shocks", _STRESS + " SELECT scenario, entity, round(net_income, 2)::DOUBLE AS net_income, round(total_assets, 2)::DOUBLE AS total_assets, round(working_capital, 2)::DOUBLE AS working_capital, round(distance, 6)::DOUBLE AS distance, round(pd, 8)::DOUBLE AS pd FROM q")
def str01(t):
    rows = _stressed(t).select("scenario", "entity", *_ROLES.values(), "pd")
    return rounded(rounded(rounded(rows, 2, "net_income", "total_assets", "working_capital"), 6, "distance"), 8, "pd")


@query("str02_scenario_losses", _STRESS + """, g AS (SELECT scenario, count(*) AS obligors, avg(pd) AS mean_pd, avg((pd >= 0.5)::INTEGER) AS alert_rate, sum(pd) * 6e6 AS loss FROM q GROUP BY 1), b AS (SELECT loss AS base FROM g WHERE scenario = 'base')
  SELECT scenario, obligors, round(mean_pd, 8)::DOUBLE AS mean_pd, round(alert_rate, 8)::DOUBLE AS alert_rate, round(loss, 0)::DOUBLE AS expected_loss, round(loss - base, 0)::DOUBLE AS increment, round((loss - base) / base * 100, 6)::DOUBLE AS increment_pct FROM g, b""")
def str02(t):
    found = stress.scenario_losses(_stressed(t), "pd")
    return rounded(rounded(rounded(found, 8, "mean_pd", "alert_rate"), 0, "expected_loss", "increment"), 6, "increment_pct")


@query("mdl07_pr_auc_vote", """WITH m AS (SELECT event_id, 'a' AS model, a AS s, y FROM scored UNION ALL SELECT event_id, 'b' AS model, b AS s, y FROM scored), n AS (SELECT model, s, sum(y) AS pos, sum(1 - y) AS neg FROM m GROUP BY 1, 2),
  r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS np FROM n WINDOW w AS (PARTITION BY model ORDER BY s DESC)), k AS (SELECT model, s, tp / (tp + fp) AS pr, tp / np AS re FROM r),
  l AS (SELECT *, coalesce(lag(pr) OVER w, 1) AS p0, coalesce(lag(re) OVER w, 0) AS r0 FROM k WINDOW w AS (PARTITION BY model ORDER BY s DESC)), g AS (SELECT model, sum((re - r0) * (pr + p0) / 2) AS area FROM l GROUP BY 1)
  SELECT event_id, round(sum(s * area) / sum(area), 8)::DOUBLE AS vote FROM m JOIN g USING (model) GROUP BY event_id""")
def mdl07(t):
    rows = scored(t)
    return rounded(models.weighted_vote(rows, models.vote_weights(rows, ["a", "b"], "y")), 8, "vote").select("event_id", "vote")


@query("prj07_learned", "SELECT o_orderkey, (o_orderpriority = '2-HIGH')::INTEGER AS o_orderpriority_2_HIGH, (o_orderpriority = '3-MEDIUM')::INTEGER AS o_orderpriority_3_MEDIUM, (o_orderpriority = '4-NOT SPECIFIED')::INTEGER AS o_orderpriority_4_NOT_SPECIFIED, (o_orderpriority = '5-LOW')::INTEGER AS o_orderpriority_5_LOW FROM orders")
def prj07(t):
    made = frames.learned_one_hot(t("orders"), "o_orderpriority")
    return made.select("o_orderkey", *[n for n in made.columns if n.startswith("o_orderpriority_")])


@query("jn19_entity_lookup", """WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN ' t' || c_nationkey ELSE 'x' END AS ticker, CASE WHEN c_custkey % 9 = 1 THEN lower(n_name) WHEN c_custkey % 9 = 2 THEN n_name || ' Inc ' WHEN c_custkey % 9 = 3 THEN n_name || ' corp' ELSE n_name || ' holding' END AS company, 1990 + c_custkey % 30 AS year FROM customer JOIN nation ON n_nationkey = c_nationkey),
  m AS (SELECT n_nationkey, c_custkey, year, CASE WHEN upper(trim(ticker)) = 'T' || n_nationkey THEN 1 WHEN upper(trim(company)) = n_name THEN 2 WHEN upper(trim(company)) IN (n_name || ' CO', n_name || ' CORP', n_name || ' INC', n_name || ' LTD', n_name || ' COMPANY', n_name || ' CORPORATION') THEN 3 END AS priority FROM nation, k)
  SELECT n_nationkey, c_custkey, year::INTEGER AS year, priority FROM m WHERE priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY priority, year DESC, c_custkey) = 1""")
def jn19(t):
    k = t("customer").join(F.broadcast(t("nation")), c("n_nationkey") == c("c_nationkey"))
    n, key = c("n_name"), c("c_custkey") % 9
    company = F.when(key == 1, F.lower(n)).when(key == 2, F.concat(n, F.lit(" Inc "))).when(key == 3, F.concat(n, F.lit(" corp"))).otherwise(F.concat(n, F.lit(" holding")))
    ticker = F.when(c("c_custkey") % 50 == 0, F.concat(F.lit(" t"), c("c_nationkey").cast("string"))).otherwise("x")
    k = k.select("c_custkey", ticker.alias("ticker"), company.alias("company"), (1990 + c("c_custkey") % 30).cast("int").alias("year"))
    asked = t("nation").select("n_nationkey", F.concat(F.lit("T"), c("n_nationkey").cast("string")).alias("ticker"), c("n_name").alias("company"))
    found = frames.lookup_entity(asked, k, "n_nationkey", {"ticker": "ticker", "name": "company"}, "year", "c_custkey")
    return found.select("n_nationkey", "c_custkey", "year", "priority")


@query("src08_earliest", """WITH e AS (SELECT o_custkey, min(CASE WHEN l_returnflag = 'R' AND l_linestatus LIKE '%F%' THEN strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') END) AS day FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
  SELECT o_custkey, coalesce(day, CASE o_custkey WHEN 1 THEN '2014-10-13' WHEN 4 THEN '2016-10-24' END, '2020-01-01') AS day, day IS NULL AS assumed FROM e""")
def src08(t):
    """An order's lines are packed as parallel arrays, as feeds of filings come."""
    lines = t("lineitem").select("l_orderkey", c("l_returnflag").alias("form"), c("l_linestatus").alias("items"), day_text("l_shipdate").alias("day"))
    packed = lines.groupBy("l_orderkey").agg(F.to_json(F.struct(*[F.collect_list(x).alias(x) for x in ("form", "items", "day")])).alias("j"))
    rows = packed.join(t("orders").select("o_orderkey", "o_custkey"), c("o_orderkey") == c("l_orderkey"))
    fields = {"form": "string", "items": "string", "day": "string"}
    return sources.earliest_events(rows, "o_custkey", "j", fields, lambda x: (x["form"] == "R") & x["items"].contains("F"), "day", {1: "2014-10-13", 4: "2016-10-24"}, "2020-01-01")
