"""Further queries: compositions of the operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from solvara.functions import clip, normal_cdf, word_count, word_pattern
from solvara.operators import events, finance, metrics, ordered, scoring, timejoin
from solvara.plans.registry import day_text, filings, query, quotes, rounded, scored, sheet

c = F.col


@query("src06_frame_as_table", "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def src06(t):
    t("region").createOrReplaceTempView("solvara_region")
    n = t("nation")
    n.createOrReplaceTempView("solvara_nation")
    return n.sparkSession.sql("SELECT r_name, count(*) AS n FROM solvara_region JOIN solvara_nation ON r_regionkey = n_regionkey GROUP BY 1")


@query("jn17_lookup_levels", "WITH a AS (SELECT nation, median(equity) AS m1 FROM sheet GROUP BY 1), b AS (SELECT region, median(equity) AS m2 FROM sheet GROUP BY 1) SELECT entity, m1, m2, (SELECT median(equity) FROM sheet) AS m3 FROM sheet JOIN a USING (nation) JOIN b USING (region)")
def jn17(t):
    s = sheet(t)
    a, b = s.groupBy("nation").agg(F.median("equity").alias("m1")), s.groupBy("region").agg(F.median("equity").alias("m2"))
    return s.join(a, "nation").join(b, "region").crossJoin(F.broadcast(s.agg(F.median("equity").alias("m3")))).select("entity", "m1", "m2", "m3")


@query("jn20_annual_merge", "SELECT id, round(m, 4) AS macro FROM filings LEFT JOIN (SELECT year(l_shipdate) AS y, avg(l_discount) AS m FROM lineitem GROUP BY 1) ON year(filed) = y")
def jn20(t):
    m = t("lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(F.avg("l_discount").alias("m"))
    return filings(t).join(m, F.year("filed") == c("y"), "left").select("id", F.round("m", 4).alias("macro"))


@query("ag23_impute_breakdown", """WITH s AS (SELECT nation, region, CASE WHEN entity % 3 <> 0 AND nation % 5 <> 1 THEN equity END AS v FROM sheet), a AS (SELECT nation, median(v) AS m1 FROM s GROUP BY 1), b AS (SELECT region, median(v) AS m2 FROM s GROUP BY 1),
  l AS (SELECT CASE WHEN v IS NOT NULL THEN 0 WHEN m1 IS NOT NULL THEN 1 WHEN m2 IS NOT NULL THEN 2 ELSE 3 END AS level FROM s JOIN a USING (nation) JOIN b USING (region))
  SELECT level, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM l GROUP BY level""")
def ag23(t):
    s = sheet(t).select("entity", "nation", "region", F.when((c("entity") % 3 != 0) & (c("nation") % 5 != 1), c("equity")).alias("v"))
    n = finance.hier_impute(s, "v", [["nation"], ["region"]], 0.0).groupBy(c("v_imputed_level").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(c("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("wn12_cumulative_positives", "WITH n AS (SELECT a AS score, sum(y)::BIGINT AS pos, count(*) AS rows FROM scored GROUP BY 1) SELECT score, sum(pos) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(n.rows) OVER (ORDER BY score DESC)::BIGINT AS seen FROM n")
def wn12(t):
    counts = metrics.score_counts(scored(t), "a", "y").withColumn("rows", c("pos") + c("neg"))
    return ordered.running_sums(counts, [F.desc("score")], ["pos", "rows"]).select("score", c("pos_upto").alias("tp"), c("rows_upto").alias("seen"))


@query("st01_total_order", "SELECT id, row_number() OVER (ORDER BY filings.filed, id) AS place FROM filings")
def st01(t):
    """The place of each filing among all, from running sums over ranges of (date, id)."""
    one = filings(t).select("id", "filed", F.lit(1).cast("long").alias("one"))
    return ordered.running_sums(one, ["filed", "id"], ["one"]).select("id", c("one_upto").alias("place"))


@query("sc05_intervals", "SELECT id, strftime(filed + INTERVAL 12 MONTH, '%Y-%m-%d') AS a, strftime(filed - INTERVAL 30 DAY, '%Y-%m-%d') AS b, strftime(date_trunc('month', filed), '%Y-%m-%d') AS m FROM filings")
def sc05(t):
    f = filings(t)
    return f.select("id", day_text(F.add_months("filed", 12)).alias("a"), day_text(F.date_sub("filed", 30)).alias("b"), day_text(F.trunc("filed", "MM")).alias("m"))


@query("sc07_word_regex", r"SELECT doc_id, regexp_matches(text, '(?i)(?:^|[^\pL\pN_])(?:the|und|les)(?:[^\pL\pN_]|$)')::INTEGER AS hit FROM documents")
def sc07(t):
    return t("documents").select("doc_id", c("text").rlike(word_pattern(["the", "und", "les"])).cast("int").alias("hit"))


@query("sc13_arrays", "SELECT user_id, len(k)::INTEGER AS kinds, array_to_string(k, ',') AS joined FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS k FROM events GROUP BY user_id)")
def sc13(t):
    k = t("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    return k.select("user_id", F.size("k").alias("kinds"), F.concat_ws(",", "k").alias("joined"))


@query("pan03_master", """WITH p AS (SELECT user_id AS entity, count(*) AS news FROM events GROUP BY 1), m AS (SELECT entity, date_trunc('month', filed)::DATE AS month, count(*) AS filed_n FROM filings GROUP BY ALL)
  SELECT f.id, coalesce(news, 0) AS news, coalesce(filed_n, 0) AS prior FROM filings f LEFT JOIN p ON f.entity = p.entity LEFT JOIN m ON f.entity = m.entity AND m.month = date_trunc('month', f.filed - INTERVAL 1 MONTH)::DATE""")
def pan03(t):
    f = filings(t)
    news = t("events").groupBy(c("user_id").alias("entity")).agg(F.count(F.lit(1)).alias("news"))
    m = f.groupBy("entity", F.trunc("filed", "MM").alias("month")).agg(F.count(F.lit(1)).alias("filed_n"))
    return timejoin.closed_month_join(f.join(news, "entity", "left"), m, "entity", "filed", "month").select("id", F.coalesce("news", F.lit(0)).alias("news"), F.coalesce("filed_n", F.lit(0)).alias("prior"))


@query("lbl03_events", """WITH e AS (SELECT source AS entity, doc_id AS date, 'headline' AS source FROM documents WHERE lower(text) LIKE '%licensed under%' UNION ALL SELECT regexp_replace(source, '9$', ''), min(doc_id), 'suffix' FROM documents WHERE source LIKE '%9' AND length(source) >= 4 GROUP BY 1)
  SELECT entity, min(date) AS first_date, arg_min(source, date * 10 + (source = 'suffix')::INTEGER) AS first_source, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources FROM e GROUP BY entity""")
def lbl03(t):
    d = t("documents")
    return events.merged_events([events.headline_events(d, "source", "doc_id", "text", ["licensed under"]), events.suffix_events(d, "source", "doc_id", "9")])


@query("lbl04_whitelisted", "SELECT source AS entity, min(doc_id) AS first_date FROM documents WHERE lower(text) LIKE '%licensed under%' AND source IN ('src1', 'src2', 'src3') GROUP BY 1")
def lbl04(t):
    d = t("documents")
    white = d.where(c("source").isin("src1", "src2", "src3")).select(c("source").alias("entity")).distinct()
    return events.merged_events([events.headline_events(d, "source", "doc_id", "text", ["licensed under"])], white).select("entity", "first_date")


_STATEMENT = """x AS (SELECT o_orderkey AS id, o_custkey AS entity, CAST(o_orderdate AS DATE) AS day, o_totalprice AS total_assets, o_totalprice * 0.4 AS current_assets, sum(l_extendedprice * l_discount) AS current_liabilities, sum(l_extendedprice * l_tax) * 2 AS long_term_debt,
  sum(l_extendedprice) - o_totalprice AS net_income, sum(l_extendedprice * 0.05) AS ebit, sum(l_quantity) AS inventory, count(*) * 100.0 AS depreciation FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate, o_totalprice),
  y AS (SELECT *, current_liabilities + long_term_debt AS total_liabilities, net_income * 3 AS retained_earnings, total_assets * 0.7 AS market_value, total_assets * 1.1 AS revenue, ebit + depreciation AS ebitda FROM x)"""


def _statement(t):
    """Statements with all positions: sums of an order's lines."""
    l, price = t("lineitem"), c("l_extendedprice")
    s = l.groupBy(c("l_orderkey").alias("id")).agg(
        F.sum(price * c("l_discount")).alias("current_liabilities"), (F.sum(price * c("l_tax")) * 2).alias("long_term_debt"), F.sum(price).alias("sold"),
        F.sum(price * 0.05).alias("ebit"), F.sum("l_quantity").alias("inventory"), (F.count(F.lit(1)) * 100.0).alias("depreciation"),
    )
    x = t("orders").select(c("o_orderkey").alias("id"), c("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day"), c("o_totalprice").alias("total_assets")).join(s, "id")
    x = x.withColumns({"current_assets": c("total_assets") * 0.4, "net_income": c("sold") - c("total_assets"), "total_liabilities": c("current_liabilities") + c("long_term_debt"), "market_value": c("total_assets") * 0.7, "revenue": c("total_assets") * 1.1, "ebitda": c("ebit") + c("depreciation")})
    return x.withColumn("retained_earnings", c("net_income") * 3)


_R = {
    "r1_wc_ta": "(current_assets - current_liabilities) / (total_assets + 1e-5)", "r2_re_ta": "retained_earnings / (total_assets + 1e-5)", "r3_ebit_ta": "ebit / (total_assets + 1e-5)", "r4_mve_tl": "market_value / (total_liabilities + 1e-5)", "r5_sales_ta": "revenue / (total_assets + 1e-5)",
    "r6_current": "current_assets / (current_liabilities + 1e-5)", "r7_quick": "(current_assets - inventory) / (current_liabilities + 1e-5)", "r8_debt_assets": "total_liabilities / (total_assets + 1e-5)", "r9_net_margin": "net_income / (revenue + 1e-5)", "r10_ebitda_margin": "ebitda / (revenue + 1e-5)",
}


@query("rat06_protected", f"WITH {_STATEMENT}, r AS (SELECT id, {', '.join(f'{v} AS {k}' for k, v in _R.items())} FROM y) SELECT id, {', '.join(f'round({k}, 6) AS {k}' for k in _R if k not in ('r6_current', 'r7_quick', 'r4_mve_tl'))}, round(r6_current, 0) AS r6_current, round(r7_quick, 0) AS r7_quick, round(r4_mve_tl, 0) AS r4_mve_tl, round(1.2 * r1_wc_ta + 1.4 * r2_re_ta + 3.3 * r3_ebit_ta + 0.6 * r4_mve_tl + 0.999 * r5_sales_ta, 0) AS z FROM r")
def rat06(t):
    r = finance.epsilon_ratios(_statement(t)).select("id", *_R, "z")
    big = ["r6_current", "r7_quick", "r4_mve_tl", "z"]  # no denominator: values of 1e9 and more
    return rounded(rounded(r, 6, *[k for k in _R if k not in big]), 0, *big)


@query("rat08_request_altman", """WITH r AS (SELECT entity, total_assets AS ta0, nullif(net_income, 0) AS ni, nullif(ebit * (entity % 3), 0) AS eb, nullif(retained_earnings * (entity % 2), 0) AS re, nullif(equity, 0) AS eq, nullif(current_liabilities, 0) AS tl0, nullif(cash, 0) AS mv, nullif(revenue * (entity % 2), 0) AS sales, nullif(current_assets - current_liabilities, 0) AS wc FROM sheet),
  a AS (SELECT *, CASE WHEN coalesce(nullif(ta0, 0), 1) > 0 THEN coalesce(nullif(ta0, 0), 1) ELSE 1 END AS ta FROM r), b AS (SELECT *, coalesce(tl0, ta - coalesce(eq, 0)) AS tl1 FROM a), d AS (SELECT *, CASE WHEN tl1 <= 0 THEN ta * 0.5 ELSE tl1 END AS tl FROM b)
  SELECT entity, round(1.2 * coalesce(wc, 0) / ta + 1.4 * coalesce(re, 0) / ta + 3.3 * coalesce(eb, ni, 0) / ta + 0.6 * coalesce(mv, ta) / tl + 0.999 * coalesce(sales, ta) / ta, 4) AS altman_z FROM d""")
def rat08(t):
    s = sheet(t)
    r = s.select("entity", "total_assets", "net_income", "equity", (c("ebit") * (c("entity") % 3)).alias("ebit"), (c("retained_earnings") * (c("entity") % 2)).alias("retained_earnings"), c("current_liabilities").alias("total_liabilities"), c("cash").alias("market_value"), (c("revenue") * (c("entity") % 2)).alias("revenue"), (c("current_assets") - c("current_liabilities")).alias("working_capital"))
    return rounded(finance.request_altman(r), 4, "altman_z").select("entity", "altman_z")


@query("rat09_structural", f"""WITH {_STATEMENT}, v AS (SELECT *, market_value + total_liabilities AS firm_value, current_liabilities + 0.5 * long_term_debt AS default_point, coalesce(stddev_samp(ebit / (total_assets + 1e-5)) OVER (PARTITION BY entity ORDER BY day, id ROWS 2 PRECEDING), 0.01) AS vol FROM y)
  SELECT id, round(firm_value, 6) AS firm_value, round(default_point, 6) AS default_point, round(vol, 6) AS roa_volatility, round(ln((firm_value + 1e-5) / (default_point + 1e-5)) / (vol + 1e-5), 2) + 0 AS dtd, round((net_income + depreciation) / (total_liabilities + 1e-5), 0) + 0 AS cash_flow_to_debt,
  round((current_assets - current_liabilities) / (revenue + 1e-5), 6) AS working_capital_to_sales, round(ebitda / (long_term_debt * 0.05 + 1e-5), 0) AS interest_cover FROM v""")
def rat09(t):
    s = finance.structural_proxies(_statement(t).withColumn("at", F.struct("day", "id")), "entity", "at")
    s = rounded(rounded(rounded(s, 2, "dtd"), 6, "firm_value", "default_point", "roa_volatility", "working_capital_to_sales"), 0, "cash_flow_to_debt", "interest_cover")
    return s.select("id", "firm_value", "default_point", "roa_volatility", "dtd", "cash_flow_to_debt", "working_capital_to_sales", "interest_cover")


_UPPER = "((SELECT sum(exp(-power(abs(d) + (k + 0.5) * 0.002, 2) / 2)) FROM range(0, 4500) steps(k)) * 0.002 + 0.002 * 0.002 / 24 * abs(d) * exp(-d * d / 2)) / 2.5066282746310002"


@query("rat09_pd", f"WITH s AS (SELECT entity, (ln(total_assets / current_liabilities) + 0.05 - 0.35 * 0.35 / 2) / 0.35 AS d FROM sheet WHERE total_assets > 0 AND current_liabilities > 0), q AS (SELECT entity, d, {_UPPER} AS q FROM s) SELECT entity, round(CASE WHEN d >= 0 THEN q ELSE 1 - q END, 8) AS pd FROM q")
def rat09_pd(t):
    s = sheet(t).where("total_assets > 0 AND current_liabilities > 0")
    return s.select("entity", F.round(normal_cdf(-finance.distance_to_default(c("total_assets"), c("current_liabilities"), F.lit(0.35))), 8).alias("pd"))


@query("mkt05_firm_value", "WITH v AS (SELECT l_suppkey AS id, sum(l_extendedprice * l_discount) AS debt, sum(l_extendedprice) / 10 AS cap, max(l_extendedprice) AS assets, CASE WHEN l_suppkey % 3 > 0 THEN stddev_samp(l_discount) * (l_suppkey % 3 - 1) END AS vol FROM lineitem GROUP BY l_suppkey) SELECT id, round(greatest(debt + cap, assets, 10000), 2) AS firm_asset_value, round(greatest(coalesce(nullif(vol, 0), CASE WHEN id % 2 = 0 THEN 0.3 END, 0.35), 0.05), 8) AS sigma_asset FROM v")
def mkt05(t):
    v = t("lineitem").groupBy(c("l_suppkey").alias("id")).agg(F.sum(c("l_extendedprice") * c("l_discount")).alias("debt"), (F.sum("l_extendedprice") / 10).alias("cap"), F.max("l_extendedprice").alias("assets"), F.stddev_samp("l_discount").alias("sd"))
    v = v.withColumns({"vol": F.when(c("id") % 3 > 0, c("sd") * (c("id") % 3 - 1)), "market": F.when(c("id") % 2 == 0, 0.3)})
    return rounded(rounded(finance.firm_value_and_sigma(v, "debt", "cap", "assets", "vol", "market"), 2, "firm_asset_value"), 8, "sigma_asset").select("id", "firm_asset_value", "sigma_asset")


@query("rat10_velocity", "SELECT id, round(coalesce(amount - lag(amount) OVER w, 0), 4) AS delta_amount, coalesce(id - lag(id) OVER w, 0)::DOUBLE AS delta_id FROM filings WINDOW w AS (PARTITION BY entity ORDER BY filings.filed, id)")
def rat10(t):
    d = timejoin.deltas(filings(t).withColumn("key", c("id")), "entity", ["filed", "key"], ["amount", "id"])
    return d.select(c("key").alias("id"), F.round("delta_amount", 4).alias("delta_amount"), c("delta_id").cast("double").alias("delta_id"))


@query("mkt02_filing_quote", "SELECT f.id, q.price AS price, round(q.r, 8) AS return_21 FROM (SELECT id, entity % 100 + 1 AS ticker, filed FROM filings) f ASOF LEFT JOIN (SELECT ticker, day, price, price / nullif(lag(price, 21) OVER (PARTITION BY ticker ORDER BY day), 0) - 1 AS r FROM quotes) q ON f.ticker = q.ticker AND q.day <= f.filed")
def mkt02(t):
    q = timejoin.returns(quotes(t), "ticker", "day", "price", (21,))
    left = filings(t).select("id", (c("entity") % 100 + 1).alias("ticker"), "filed")
    return timejoin.asof_join(left, q, "ticker", "filed", "day", ["price", "return_21"]).select("id", "price", F.round("return_21", 8).alias("return_21"))


@query("mkt08_request_dtd", "SELECT entity, round(greatest(-2.0, least(10.0, CASE WHEN total_assets > 0 AND current_liabilities > 0 THEN (ln(total_assets / current_liabilities) + 0.05 - 0.25 * 0.25 / 2) / 0.25 END)), 6)::DOUBLE AS dtd FROM sheet WHERE total_assets > 0 AND current_liabilities > 0")
def mkt08(t):
    s = sheet(t).where("total_assets > 0 AND current_liabilities > 0")
    return s.select("entity", F.round(clip(finance.distance_to_default(c("total_assets"), c("current_liabilities"), F.lit(0.25)), -2, 10), 6).alias("dtd"))


@query("nlp08_annual_sentiment", "SELECT y::INTEGER AS y, round(coalesce(m, CASE WHEN y IN (2001, 2008) THEN -0.5 ELSE 0 END), 6)::DOUBLE AS mood FROM (SELECT unnest(range(1994, 2010)) AS y) LEFT JOIN (SELECT year(o_orderdate) AS y, avg((o_orderstatus = 'F')::INTEGER) AS m FROM orders GROUP BY 1) USING (y)")
def nlp08(t):
    m = t("orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.avg((c("o_orderstatus") == "F").cast("int")).alias("m"))
    spine = m.sparkSession.range(1994, 2010).select(c("id").cast("int").alias("y"))
    return spine.join(m, "y", "left").select("y", F.round(F.coalesce("m", F.when(c("y").isin(2001, 2008), -0.5).otherwise(0.0)), 6).alias("mood"))


@query("nlp11_length_profile", r"""WITH d AS (SELECT lang, length(text) AS chars, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS w FROM documents)
  SELECT lang, count(*) AS n, round(avg(chars), 4) AS chars, round(avg(w), 4) AS words, max(w)::INTEGER AS longest, round(quantile_cont(w, 0.95), 4) AS p95 FROM d GROUP BY lang""")
def nlp11(t):
    d = t("documents").select("lang", F.length("text").alias("chars"), word_count("text").alias("w"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("chars"), 4).alias("chars"), F.round(F.avg("w"), 4).alias("words"), F.max("w").alias("longest"), F.round(F.percentile("w", F.lit(0.95)), 4).alias("p95"))


@query("mac02_monthly_macro", "SELECT f.id, round(m.level, 4) AS level FROM filings f ASOF LEFT JOIN (SELECT 1 AS k, date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) AS level FROM orders WHERE month(o_orderdate) % 3 = 1 GROUP BY 2) m ON m.k = 1 AND m.month <= f.filed")
def mac02(t):
    # a series with gaps: two of three months have no value
    m = t("orders").where("month(o_orderdate) % 3 = 1").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.avg("o_totalprice").alias("level"))
    return timejoin.series_asof(filings(t), m, "filed", "month", ["level"]).select("id", F.round("level", 4).alias("level"))


@query("cv02_fold_audit", """WITH d AS (SELECT DISTINCT filed FROM filings), k AS (SELECT filed, ntile(6) OVER (ORDER BY filed) AS chunk FROM d), g AS (SELECT chunk, min(filed) AS lo, max(filed) AS hi FROM k GROUP BY 1),
  f AS (SELECT a.chunk::INTEGER AS fold, a.hi AS te, greatest(b.lo, (a.hi + 31)::DATE) AS vs, b.hi AS ve FROM g a JOIN g b ON b.chunk = a.chunk + 1 WHERE greatest(b.lo, (a.hi + 31)::DATE) <= b.hi)
  SELECT fold, count(*) FILTER (filed <= te) AS train_rows, count(*) FILTER (filed BETWEEN vs AND ve) AS valid_rows, count(*) FILTER (filed BETWEEN vs AND ve AND status = 'P') AS valid_positives, any_value(date_diff('day', te, vs))::INTEGER AS gap FROM filings, f GROUP BY fold""")
def cv02(t):
    f = filings(t).withColumn("y", (c("status") == "P").cast("int"))
    return events.fold_audit(f, "filed", "y", metrics.purged_folds(f, "filed", 5, 30))


@query("mdl05_structural_baseline", "WITH s AS (SELECT stddev_pop(equity) + 1e-5 AS a, stddev_pop(current_assets - current_liabilities) + 1e-5 AS b FROM sheet) SELECT entity, round(1 / (1 + exp(-(-equity / a - (current_assets - current_liabilities) / b))), 8) AS p FROM sheet, s")
def mdl05(t):
    s = sheet(t).withColumn("wc", c("current_assets") - c("current_liabilities"))
    std = s.agg((F.stddev_pop("equity") + 1e-5).alias("a"), (F.stddev_pop("wc") + 1e-5).alias("b"))
    return s.crossJoin(F.broadcast(std)).select("entity", F.round(1 / (1 + F.exp(c("equity") / c("a") + c("wc") / c("b"))), 8).alias("p"))


@query("eva08_business_cost", "SELECT sum((a < 0.5 AND y = 1)::INTEGER) * 6e6 + sum((a >= 0.5 AND y = 0)::INTEGER) * 250e3 AS cost, sum((a >= 0.5 AND y = 1)::INTEGER) * 6e6 - sum((a < 0.5 AND y = 1)::INTEGER) * 6e6 - sum((a >= 0.5 AND y = 0)::INTEGER) * 250e3 AS pnl FROM scored")
def eva08(t):
    k = metrics.confusion(scored(t), "a", "y", 0.5)
    return k.select((c("fn") * 6e6 + c("fp") * 250e3).alias("cost"), (c("tp") * 6e6 - c("fn") * 6e6 - c("fp") * 250e3).alias("pnl"))


@query("eva11_multi_horizon", "SELECT horizon, round(avg((y - s) * (y - s)), 8) AS brier, sum((s >= tau AND y = 1)::INTEGER)::BIGINT AS tp FROM (SELECT y, unnest([12, 24]) AS horizon, unnest([a, b]) AS s, unnest([0.5, 0.6]) AS tau FROM scored) GROUP BY horizon")
def eva11(t):
    both = F.array(*[F.struct(F.lit(h).alias("horizon"), c(s).alias("s"), F.lit(tau).alias("tau")) for h, s, tau in ((12, "a", 0.5), (24, "b", 0.6))])
    s = scored(t).select("y", F.inline(both))
    return s.groupBy("horizon").agg(F.round(F.avg((c("y") - c("s")) * (c("y") - c("s"))), 8).alias("brier"), F.sum(((c("s") >= c("tau")) & (c("y") == 1)).cast("long")).alias("tp"))


@query("eva12_cohorts", """WITH k AS (SELECT a, y, unnest(['all', CASE WHEN event_id % 3 = 0 THEN 'flagged' ELSE 'clean' END]) AS cohort FROM scored)
  SELECT cohort, round((SELECT sum(CASE WHEN p.a > q.a THEN p.n * q.n WHEN p.a = q.a THEN p.n * q.n / 2.0 ELSE 0 END) FROM (SELECT a, count(*) AS n FROM k k1 WHERE y = 1 AND k1.cohort = o.cohort GROUP BY 1) p, (SELECT a, count(*) AS n FROM k k2 WHERE y = 0 AND k2.cohort = o.cohort GROUP BY 1) q) / (sum(y) * sum(1 - y)), 8)::DOUBLE AS roc_auc FROM k o GROUP BY cohort""")
def eva12(t):
    tags = F.array(F.lit("all"), F.when(c("event_id") % 3 == 0, "flagged").otherwise("clean"))
    k = scored(t).select("a", "y", F.explode(tags).alias("cohort"))
    return rounded(metrics.roc_auc(metrics.score_counts(k, "a", "y", ["cohort"]), ["cohort"]), 8, "roc_auc")


@query("eva15_interpolated", "WITH p AS (SELECT p_size AS x, max(p_retailprice) AS y FROM part GROUP BY 1), s AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM p), g AS (SELECT unnest(range(2, 100)) / 2.0 AS p) SELECT CAST(p AS DOUBLE) AS p, round(y + (p - x) / (x1 - x) * (y1 - y), 6)::DOUBLE AS y FROM g JOIN s ON p >= x AND p < x1")
def eva15(t):
    p = t("part").groupBy(c("p_size").cast("double").alias("x")).agg(F.max("p_retailprice").alias("y"))
    grid = p.sparkSession.range(2, 100).select((c("id") / 2.0).alias("p")).join(F.broadcast(p.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))), (c("p") >= c("lo")) & (c("p") < c("hi"))).select("p")
    return rounded(events.interpolate(p, "x", "y", grid, "p"), 6, "y")


@query("str02_increment", "WITH p AS (SELECT least(greatest(1 / (1 + exp(-(1.10 - 0.75 * (net_income / 2000)))), 0.001), 0.999) AS p FROM sheet) SELECT round(sum(p) * 6e6, 0)::DOUBLE AS base, round(sum(1 / (1 + exp(-(ln(p / (1 - p)) + 0.9)))) * 6e6, 0)::DOUBLE AS stressed FROM p")
def str02(t):
    p = sheet(t).select(scoring.structural_pd(c("net_income") / 2000, F.lit(0.0)).alias("p"))
    q = 1.0 / (1.0 + F.exp(-(F.ln(c("p") / (1 - c("p"))) + 0.9)))
    return p.agg(F.round(F.sum("p") * 6e6, 0).alias("base"), F.round(F.sum(q) * 6e6, 0).alias("stressed"))


@query("xai04_notices", """WITH k AS (SELECT entity, equity / 1000 AS e, cash / 10000 AS k, net_income / 1000 AS d FROM sheet)
  SELECT entity, CASE WHEN e > 0 AND k > 0 THEN CASE WHEN e >= k THEN 'e,k' ELSE 'k,e' END WHEN e > 0 THEN 'e' WHEN k > 0 THEN 'k' ELSE '' END || CASE WHEN d < 1.5 THEN '|distance to default' ELSE '' END || CASE WHEN e < 1.81 THEN '|Z score' ELSE '' END AS notices FROM k""")
def xai04(t):
    k = sheet(t).select("entity", (c("equity") / 1000).alias("e"), (c("cash") / 10000).alias("k"), (c("net_income") / 1000).alias("d"))
    n = events.adverse_notices(k, "entity", ["e", "k"], "d", "e")
    warn = F.filter("notices", lambda x: F.length(x) > 1)
    names = F.concat_ws(",", F.filter("notices", lambda x: F.length(x) == 1))
    return n.select("entity", F.concat(names, F.when(F.size(warn) > 0, F.concat(F.lit("|"), F.concat_ws("|", warn))).otherwise("")).alias("notices"))


@query("scr04_compare_models", "SELECT event_id, model, score, CASE WHEN score >= 0.5 THEN 'reject' ELSE 'accept' END AS decision FROM (SELECT event_id, unnest(['a', 'b']) AS model, unnest([a, b]) AS score FROM scored)")
def scr04(t):
    rows = scored(t).unpivot("event_id", ["a", "b"], "model", "score")
    return scoring.score_batch(rows, "score", 0.5).select("event_id", "model", "score", "decision")


@query("scr05_pillar_strength", "WITH m AS (SELECT avg(equity) AS a, stddev_pop(equity) AS b, avg(cash) AS c, stddev_pop(cash) AS d FROM sheet) SELECT entity, 'capital' AS pillar, round(abs((equity - a) / b), 8) AS strength FROM sheet, m UNION ALL SELECT entity, 'liquidity', round(abs((cash - c) / d), 8) FROM sheet, m")
def scr05(t):
    s = sheet(t).select("entity", "equity", "cash")
    z = finance.apply_median_scale(s, finance.fit_median_scale(s, ["equity", "cash"]), ["equity", "cash"])
    return z.select("entity", c("equity").alias("capital"), c("cash").alias("liquidity")).unpivot("entity", ["capital", "liquidity"], "pillar", "z").select("entity", "pillar", F.round(F.abs("z"), 8).alias("strength"))
