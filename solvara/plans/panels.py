"""Queries of assembled panels: wide statements, network matches and audits, request scoring, drift and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvara import sources
from solvara.operators import finance, frames, metrics, network, scoring, timejoin
from solvara.plans.registry import day_text, filings, query, rounded, scored, sheet

c = F.col


@query("src04_header_facts", """SELECT o_orderkey * 10 + l_linenumber AS id, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, TRY_CAST(o_orderstatus AS INTEGER) AS status, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS filed, l_extendedprice AS value
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def src04b(t):
    # header and values as text files, joined and then tried as types
    spark = t("orders").sparkSession
    at = {n: sources.shared_path(spark, n) for n in ("sub", "num")}
    t("orders").select(c("o_orderkey").alias("adsh"), F.substring("o_orderpriority", 1, 1).alias("priority"), c("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyyMMdd").alias("filed")).write.csv(at["sub"], sep="\t", header=True)
    t("lineitem").select(c("l_orderkey").alias("adsh"), c("l_linenumber").alias("line"), c("l_extendedprice").alias("value")).write.csv(at["num"], sep="\t", header=True)
    raw = sources.joined_facts(sources.read_text_table(spark, at["sub"], ["adsh", "priority", "status", "filed"]), sources.read_text_table(spark, at["num"], ["adsh", "line", "value"]), "adsh", {"priority": "int", "status": "int", "line": "int", "value": "double", "adsh": "bigint"}, {"filed": "yyyyMMdd"})
    return raw.select((c("adsh") * 10 + c("line")).alias("id"), "priority", "status", day_text("filed").alias("filed"), "value")


@query("src13_missing_series", "WITH s AS (SELECT year(o_orderdate) AS y, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) SELECT y::INTEGER AS y, count(v) AS n, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS volatility FROM s GROUP BY y")
def src13b(t):
    s = t("orders").select(F.to_date("o_orderdate").alias("day"), F.when(c("o_orderkey") % 7 == 0, ".").otherwise(c("o_totalprice").cast("string")).alias("value"))
    return rounded(sources.annual_series(s, "day", "value"), 4, "mean", "volatility")


@query("snk03_nested_report", "SELECT count(*) AS filings, count(DISTINCT status)::BIGINT AS kinds, 'F' AS first_status FROM filings")
def snk03(t):
    f = filings(t)
    path = sources.shared_path(f.sparkSession, "nested")
    records = f.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    sources.write_nested_report(records, f.agg(F.count(F.lit(1)).alias("filings")), path, ["status"])
    r = f.sparkSession.read.schema("summary struct<filings:bigint>, records array<struct<status:string,n:bigint>>").json(path)
    return r.select("summary.filings", F.size("records").cast("long").alias("kinds"), F.element_at("records.status", 1).alias("first_status"))


@query("snk02_csv_report", "SELECT form, count(*) AS n, round(avg(amount), 4) AS mean FROM filings GROUP BY form")
def snk02(t):
    report = filings(t).groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("amount"), 4).alias("mean"))
    path = sources.shared_path(report.sparkSession, "report-csv")
    sources.write_report(report, path, "csv")
    return report.sparkSession.read.csv(path, header=True, schema="form string, n bigint, mean double")


@query("snk06_described", "SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE 'double' END AS type, (SELECT count(*) FROM customer) AS rows FROM (DESCRIBE SELECT * FROM customer)")
def snk06(t):
    return sources.described(t("customer"), "solvara_customer")


@query("flt10_split_fallback", """WITH d AS (SELECT id, filed, percent_rank() OVER (ORDER BY filings.filed) AS p FROM filings) SELECT id, CASE WHEN year(filed) <= 1998 THEN 'train' ELSE 'test' END AS by_year, CASE WHEN p <= 0.8 THEN 'train' ELSE 'test' END AS by_rank FROM d""")
def flt10b(t):
    f = filings(t)
    a = frames.time_split(f, "filed", 1998).select("id", c("split").alias("by_year"))
    b = frames.time_split(f, "filed", 2050).select("id", c("split").alias("by_rank"))
    return a.join(b, "id")


@query("pan01_combined", """WITH p AS (SELECT l_orderkey AS id, arg_max(l_extendedprice, l_linenumber * 1e9 + l_extendedprice) FILTER (l_returnflag = 'A') AS a1, arg_max(l_extendedprice, l_linenumber * 1e9 + l_extendedprice) FILTER (l_returnflag = 'N') AS a2, arg_max(l_extendedprice, l_linenumber * 1e9 + l_extendedprice) FILTER (l_returnflag = 'R') AS eq, arg_max(l_quantity, l_linenumber * 1e9 + l_quantity) FILTER (l_linestatus = 'O') AS li FROM lineitem GROUP BY 1),
  q AS (SELECT id, coalesce(a1, a2) AS a, li, eq FROM p) SELECT id, coalesce(a, li + eq) AS assets_combined, coalesce(li, a - eq) AS liabilities, coalesce(eq, a - li) AS equity FROM q""")
def pan01b(t):
    l = t("lineitem")
    tagged = l.select(c("l_orderkey").alias("id"), F.when(c("l_returnflag") == "R", "equity").when(c("l_returnflag") == "A", "assets").otherwise("assets_net").alias("tag"), c("l_extendedprice").alias("value"), (c("l_linenumber") * 1e9 + c("l_extendedprice")).alias("at"))
    owed = l.where("l_linestatus = 'O'").select(c("l_orderkey").alias("id"), F.lit("liabilities").alias("tag"), c("l_quantity").alias("value"), (c("l_linenumber") * 1e9 + c("l_quantity")).alias("at"))
    wide = finance.pivot_facts(tagged.unionByName(owed), "id", "tag", "value", ["assets", "assets_net", "equity", "liabilities"], "at")
    wide = finance.combined_tags(wide, {"assets": ["assets", "assets_net"]})
    return finance.balanced_sheet(wide, "assets_combined", "liabilities", "equity").select("id", "assets_combined", "liabilities", "equity")


_NODES = "nodes AS (SELECT date_trunc('month', l_shipdate)::DATE AS ym, l_suppkey AS node, sum(l_quantity) AS rank, l_suppkey % 7 AS community FROM lineitem GROUP BY ALL)"
_HIT = "hit AS (SELECT DISTINCT l_suppkey AS node, (date_trunc('month', l_shipdate) + to_months(k::INTEGER))::DATE AS ym FROM lineitem, range(1, 13) x(k) WHERE l_discount >= 0.1 AND l_tax <= 0.01)"


def _nodes(t):
    """A month's suppliers with the quantity shipped as their rank and a fixed community."""
    l = t("lineitem")
    return l.groupBy(F.trunc("l_shipdate", "MM").alias("ym"), c("l_suppkey").alias("node")).agg(F.sum("l_quantity").alias("rank")).withColumn("community", c("node") % 7)


def _infected(t):
    events = t("lineitem").where("l_discount >= 0.1 AND l_tax <= 0.01").select(c("l_suppkey").alias("node"), F.to_date("l_shipdate").alias("day"))
    return network.prior_distress(_nodes(t), events, "ym", "node", "community", "day")


_INFECTED = "m AS (SELECT n.*, (h.node IS NOT NULL)::INTEGER AS hit FROM nodes n LEFT JOIN hit h ON h.node = n.node AND h.ym = n.ym), i AS (SELECT *, coalesce((sum(hit) OVER w - hit) / nullif(count(*) OVER w - 1, 0), 0) AS infection FROM m WINDOW w AS (PARTITION BY ym, community))"


@query("net09_prior_distress", f"WITH {_NODES}, {_HIT}, {_INFECTED} SELECT strftime(ym, '%Y-%m-%d') AS ym, node, round(infection, 6) AS infection FROM i")
def net09b(t):
    return _infected(t).select(day_text("ym").alias("ym"), "node", F.round("infection", 6).alias("infection"))


_MATCHED = "s AS (SELECT DISTINCT o_orderkey AS id, l_suppkey AS ticker, date_trunc('month', o_orderdate)::DATE AS month, (o_orderstatus = 'P')::INTEGER AS distressed FROM orders JOIN lineitem ON l_orderkey = o_orderkey), j AS (SELECT s.*, i.rank, i.infection, row_number() OVER (PARTITION BY id ORDER BY i.rank DESC NULLS LAST, ticker) AS k FROM s LEFT JOIN i ON i.node = s.ticker AND i.ym = s.month), u AS (SELECT *, (rank IS NULL)::INTEGER AS imputed FROM j WHERE k = 1)"


def _matched(t):
    f = t("orders").join(t("lineitem"), c("o_orderkey") == c("l_orderkey")).select(c("o_orderkey").alias("id"), c("l_suppkey").alias("ticker"), F.to_date("o_orderdate").alias("day"), (c("o_orderstatus") == "P").cast("int").alias("distressed"))
    # not made distinct: of equal rows the match keeps one, and their map would hold all rows of a task
    return network.match_filings(f, _infected(t), "id", "ticker", "day", "ym", "rank")


@query("net10_filing_node", f"WITH {_NODES}, {_HIT}, {_INFECTED}, {_MATCHED} SELECT id, ticker, rank, round(infection, 6) AS infection, imputed FROM u")
def net10(t):
    return _matched(t).select("id", "ticker", "rank", F.round("infection", 6).alias("infection"), "imputed")


_METRIC = "long AS (SELECT imputed, distressed, unnest(['rank', 'infection']) AS metric, unnest([rank, infection]) AS v FROM u)"


@query("aud02_network_audit", f"""WITH {_NODES}, {_HIT}, {_INFECTED}, {_MATCHED}, {_METRIC}, g AS (SELECT imputed, metric, count(*) AS rows, sum((v IS NULL)::INTEGER)::BIGINT AS nulls, min(v) AS lo, avg(v) AS mean, max(v) AS hi, stddev_samp(v) AS std, corr(v, distressed) AS k FROM long GROUP BY CUBE (imputed, metric))
  SELECT imputed, metric, rows, nulls, round(lo, 6) AS min, round(mean, 6) AS mean, round(hi, 6) AS max, round(std, 6) AS std, round(k, 6) AS corr_distressed FROM g WHERE metric IS NOT NULL""")
def aud02(t):
    a = network.network_audit(_matched(t).withColumn("rank", c("rank").cast("double")), ["rank", "infection"], ["distressed"], "imputed")
    return rounded(a, 6, "min", "mean", "max", "std", "corr_distressed")


@query("aud01_full", """SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) FROM orders GROUP BY ALL HAVING count(*) > 1)) AS duplicate_keys, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)) AS inversions,
  (SELECT count(*) FROM scored WHERE abs(a / nullif(a + b, 0) + b / nullif(a + b, 0) - 1) > 1e-6)::BIGINT AS bad_sums, min(year(filed))::INTEGER AS first_year, max(year(filed))::INTEGER AS last_year, sum((status = 'P')::INTEGER)::BIGINT AS positives, sum((status <> 'P')::INTEGER)::BIGINT AS negatives FROM filings""")
def aud01b(t):
    f = filings(t).withColumn("y", (c("status") == "P").cast("int"))
    rows = t("orders").join(t("lineitem"), c("o_orderkey") == c("l_orderkey")).select(F.to_date("o_orderdate").alias("period"), F.to_date("l_shipdate").alias("filed"))
    p = scored(t).select(F.try_divide("a", c("a") + c("b")).alias("p"), F.try_divide("b", c("a") + c("b")).alias("q"))
    return frames.panel_audit(f, ["entity", "filed"], "filed", "y").join(frames.date_inversions(rows, "period", "filed")).join(frames.bad_probability_sums(p, ["p", "q"]))


@query("mdl10_fallback_pd", """WITH s AS (SELECT entity, current_assets - current_liabilities AS wc, net_income AS ni, CASE WHEN entity % 4 > 0 THEN net_income / 2000 END AS dd, coalesce(nullif(total_assets, 0), 1) AS ta, coalesce(nullif(equity, 0), 1) AS eq FROM sheet)
  SELECT entity, round(1 / (1 + exp(-(-2.15 + CASE WHEN wc < 0 THEN 0.85 ELSE 0 END + CASE WHEN ni < 0 THEN 0.64 ELSE 0 END + CASE WHEN dd < 1 THEN 0.75 ELSE 0 END + CASE WHEN CASE WHEN eq > 0 THEN ta / greatest(eq, 1) ELSE 2.5 END > 3 THEN 0.55 ELSE 0 END))), 8) AS pd FROM s""")
def mdl10(t):
    s = sheet(t).withColumns({"working_capital": c("current_assets") - c("current_liabilities"), "distance_to_default": F.when(c("entity") % 4 > 0, c("net_income") / 2000)})
    return rounded(scoring.fallback_pd(s), 8, "pd").select("entity", "pd")


@query("scr01_prepared", """WITH r AS (SELECT entity, CASE WHEN entity % 5 > 0 THEN equity END AS equity, CASE WHEN entity % 3 > 0 THEN entity % 40 - 10 END::DOUBLE AS inflation FROM sheet),
  f AS (SELECT avg(equity) AS em, stddev_pop(equity) AS es, avg(cash) AS cm, stddev_pop(cash) AS cs FROM sheet), v AS (SELECT entity, coalesce(equity, 1000) AS e, coalesce(CASE WHEN inflation BETWEEN -50 AND 25 THEN 236.468 * (1 + inflation / 100) ELSE inflation END, 240) AS i FROM r)
  SELECT entity, round((e - em) / es, 6) AS equity, round((500 - cm) / cs, 6) AS cash, round((i - 200) / 10, 6) AS inflation FROM v, f""")
def scr01(t):
    s = sheet(t)
    request = s.select("entity", F.when(c("entity") % 5 > 0, c("equity")).cast("string").alias("equity"), F.when(c("entity") % 3 > 0, c("entity") % 40 - 10).alias("inflation"))
    fitted = finance.fit_median_scale(s, ["equity", "cash"]).withColumns({"inflation__median": F.lit(240.0), "inflation__mean": F.lit(200.0), "inflation__std": F.lit(10.0)})
    p = scoring.prepared_features(request, ["equity", "cash", "inflation"], {"equity": 1000.0, "cash": 500.0, "inflation": 240.0}, fitted, "inflation")
    return rounded(p.select("entity", "equity", "cash", "inflation"), 6, "equity", "cash", "inflation")


_LADDER = lambda steps, last: "CASE " + " ".join(f"WHEN pts >= {b} THEN '{n}'" for b, n in steps) + f" ELSE '{last}' END"


@query("scr06_rated", f"""WITH p AS (SELECT entity, least(greatest(575 + net_income / 20, 300), 850) AS pts FROM sheet) SELECT entity, round(pts, 4)::DOUBLE AS points, {_LADDER(scoring.RATING_BANDS, 'D')} AS rating, {_LADDER(scoring.SERVICE_BANDS, 'D')} AS service_rating, {_LADDER(scoring.RATING_DECISIONS, 'reject')} AS decision, round(least(greatest((850 - pts) / 550, 0.0001), 0.9999), 6)::DOUBLE AS implied_pd FROM p""")
def scr06b(t):
    r = scoring.rated(sheet(t).select("entity", (575.0 + c("net_income") / 20).alias("points")), "points")
    return rounded(rounded(r, 4, "points"), 6, "implied_pd")


@query("scr08_cohorts", "SELECT mode, rows::BIGINT AS rows, bad::DOUBLE AS bad FROM (SELECT 'distressed' AS mode, least(30, count(*) FILTER (equity < 0)) AS rows, 1.0 AS bad FROM sheet UNION ALL SELECT 'random', least(12, count(*) FILTER (equity < 0)) + least(88, count(*) FILTER (equity >= 0)), round(least(12, count(*) FILTER (equity < 0)) / (least(12, count(*) FILTER (equity < 0)) + least(88, count(*) FILTER (equity >= 0))), 2) FROM sheet UNION ALL SELECT 'solvent', least(30, count(*) FILTER (equity >= 0)), 0 FROM sheet)")
def scr08(t):
    s = sheet(t).withColumn("y", (c("equity") < 0).cast("int"))
    healthy = (c("current_assets") > c("current_liabilities")) & (c("net_income") > 0)
    parts = [scoring.cohort_rows(s, "entity", "y", healthy, n, m).withColumn("mode", F.lit(m)) for m, n in (("distressed", 30), ("random", 100), ("solvent", 30))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("mode").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("y"), 2).alias("bad"))


@query("scr08_synthetic")
def scr08b(t):
    return scoring.synthetic_rows(sheet(t), ["equity", "total_assets", "cash"], 1000, ["total_assets", "cash"])


_LEVELS = "[" + ", ".join(f"quantile_cont(a, {k / 10}) FILTER (user_id % 2 = 0)" for k in range(1, 10)) + "]"


@query("drf04_score_drift", f"""WITH e AS (SELECT list_distinct({_LEVELS}) AS edges FROM scored), g AS (SELECT len(list_filter(edges, lambda x: a >= x)) AS bucket, sum((user_id % 2 = 0)::INTEGER) AS nr, sum((user_id % 2 = 1)::INTEGER) AS nc FROM scored, e GROUP BY 1),
  p AS (SELECT greatest(nr / sum(nr) OVER (), 1e-4) AS p, greatest(nc / sum(nc) OVER (), 1e-4) AS q FROM g), n AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM p), v AS (SELECT a AS x, sum((user_id % 2 = 0)::INTEGER) AS nr, sum((user_id % 2 = 1)::INTEGER) AS nc FROM scored GROUP BY 1),
  k AS (SELECT abs(sum(nr) OVER (ORDER BY x) / sum(nr) OVER () - sum(nc) OVER (ORDER BY x) / sum(nc) OVER ()) AS gap FROM v)
  SELECT round((SELECT sum((q - p) * ln(q / p)) FROM n), 8) AS psi, round((SELECT max(gap) FROM k), 8) AS ks, round(avg(a) FILTER (user_id % 2 = 0), 8) AS ref_mean, round(avg(a) FILTER (user_id % 2 = 1), 8) AS cur_mean, round(avg((a >= 0.5)::INTEGER) FILTER (user_id % 2 = 0), 8) AS ref_alerts, round(avg((a >= 0.5)::INTEGER) FILTER (user_id % 2 = 1), 8) AS cur_alerts FROM scored""")
def drf04(t):
    s = scored(t)
    d = metrics.score_drift(s.where("user_id % 2 = 0"), s.where("user_id % 2 = 1"), "a", 0.5)
    return rounded(d, 8, "psi", "ks", "ref_mean", "cur_mean", "ref_alerts", "cur_alerts").select("psi", "ks", "ref_mean", "cur_mean", "ref_alerts", "cur_alerts")
