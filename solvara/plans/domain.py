"""Domain feature queries: panel, labels, ratios, market, news, network, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvara.functions import DISTRESS_TOPICS, intensity, ratio
from solvara.operators import events, finance, network, timejoin
from solvara.plans.registry import day_text, filings, query, quotes, rounded, sheet

c = F.col

_TAGS = ["AF", "NF", "NO", "RF"]


@query("pan01_pivot_facts", "SELECT l_orderkey AS id, " + ", ".join(f"arg_max(l_extendedprice, l_linenumber * 1e9 + l_extendedprice) FILTER (l_returnflag || l_linestatus = '{x}') AS {x}" for x in _TAGS) + " FROM lineitem GROUP BY 1")
def pan01(t):
    df = t("lineitem").select(c("l_orderkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("tag"), c("l_extendedprice").alias("value"), (c("l_linenumber") * 1e9 + c("l_extendedprice")).alias("at"))
    return finance.pivot_facts(df, "id", "tag", "value", _TAGS, "at")


@query("pan02_lag", "SELECT form, round(avg(lag), 6) AS mean_lag FROM lagged GROUP BY form")
def pan02(t):
    from solvara.plans.registry import lagged

    return lagged(t).groupBy("form").agg(F.round(F.avg("lag"), 6).alias("mean_lag"))


_FULL = """s AS (SELECT *, coalesce(nullif(total_assets - equity, 0), current_liabilities, 0) AS total_liabilities, total_assets AS liabilities_and_equity FROM sheet)"""


def _full(t):
    s = sheet(t).withColumn("liabilities_and_equity", c("total_assets"))
    return s.withColumn("total_liabilities", F.coalesce(F.nullif(c("total_assets") - c("equity"), F.lit(0.0)), c("current_liabilities"), F.lit(0.0)))


def _r(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), 0)"


@query(
    "rat01_ratios",
    f"WITH {_FULL} SELECT entity, round({_r('current_assets', 'current_liabilities')}, 6) AS current_ratio, round({_r('cash', 'current_liabilities')}, 6) AS cash_ratio, round({_r('total_liabilities', 'equity')}, 6) AS debt_to_equity, "
    f"round({_r('total_liabilities', 'total_assets')}, 6) AS debt_to_assets, round({_r('net_income', 'total_assets')}, 6) AS roa, round({_r('net_income', 'equity')}, 6) AS roe, round({_r('revenue', 'total_assets')}, 6) AS asset_turnover, "
    f"round({_r('operating_cash_flow', 'total_liabilities')}, 6) AS cash_flow_to_debt, round({_r('current_assets - current_liabilities', 'total_assets')}, 6) AS working_capital_ratio FROM s",
)
def rat01(t):
    r = finance.accounting_ratios(_full(t).withColumn("inventory", F.lit(0.0)))
    names = ["current_ratio", "cash_ratio", "debt_to_equity", "debt_to_assets", "roa", "roe", "asset_turnover", "cash_flow_to_debt", "working_capital_ratio"]
    return rounded(r, 6, *names).select("entity", *names)


_WC = "current_assets - current_liabilities"


@query(
    "rat02_scores",
    f"""WITH {_FULL} SELECT entity,
    round(1.2 * {_r(_WC, 'total_assets')} + 1.4 * {_r('retained_earnings', 'total_assets')} + 3.3 * {_r('ebit', 'total_assets')} + 0.6 * {_r('equity', 'total_liabilities')} + 0.999 * {_r('revenue', 'total_assets')}, 6) AS altman_z,
    round(-1.32 - 0.407 * ln(greatest(total_assets, 1)) + 6.03 * {_r('total_liabilities', 'total_assets')} - 1.43 * {_r(_WC, 'total_assets')} + 0.0757 * {_r('current_liabilities', 'current_assets')}
      - 1.72 * (total_liabilities > total_assets)::INTEGER - 2.37 * {_r('net_income', 'total_assets')} - 1.83 * {_r('operating_cash_flow', 'total_liabilities')} + 0.285 * (net_income < 0)::INTEGER, 6) AS ohlson_o,
    round(1.03 * {_r(_WC, 'total_assets')} + 3.07 * {_r('ebit', 'total_assets')} + 0.66 * {_r('ebit', 'current_liabilities')} + 0.4 * {_r('revenue', 'total_assets')}, 6) AS springate,
    round(-4.336 - 4.513 * {_r('net_income', 'total_assets')} + 5.679 * {_r('total_liabilities', 'total_assets')} + 0.004 * {_r('current_assets', 'current_liabilities')}, 6) AS zmijewski FROM s""",
)
def rat02(t):
    df = finance.zmijewski(finance.springate(finance.ohlson_o(finance.altman_z(_full(t)))))
    names = ["altman_z", "ohlson_o", "springate", "zmijewski"]
    return rounded(df, 6, *names).select("entity", *names)


@query(
    "rat07_zones",
    f"""WITH {_FULL}, z AS (SELECT greatest(-10.0, least(20.0, 6.56 * {_r(_WC, 'total_assets')} + 3.26 * {_r('retained_earnings', 'total_assets')} + 6.72 * {_r('ebit', 'total_assets')} + 1.05 * {_r('equity', 'total_liabilities')})) AS z FROM s)
    SELECT CASE WHEN z < 1.1 THEN 'distress' WHEN z <= 2.6 THEN 'grey' ELSE 'safe' END AS altman_z2_zone, count(*) AS n, round(avg(z), 6) AS mean FROM z GROUP BY 1""",
)
def rat07(t):
    return finance.altman_z2(_full(t)).groupBy("altman_z2_zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("altman_z2"), 6).alias("mean"))


_DTD = "CASE WHEN total_assets > 0 AND total_liabilities > 0 THEN (ln(total_assets / total_liabilities) + 0.05 - 0.35 * 0.35 / 2) / 0.35 END"


@query("lbl01_distress", f"WITH {_FULL}, d AS (SELECT *, {_DTD} AS dtd FROM s) SELECT entity, round(dtd, 6) AS dtd, CASE WHEN (equity <= 0 OR total_liabilities >= total_assets) AND dtd <= 0.5 AND {_WC} < 0 AND net_income < 0 THEN 1 ELSE 0 END AS distress FROM d")
def lbl01(t):
    d = _full(t).withColumn("distance_to_default", finance.distance_to_default(c("total_assets"), c("total_liabilities"), F.lit(0.35)))
    return finance.distress_flag(d).select("entity", F.round("distance_to_default", 6).alias("dtd"), "distress")


_LABEL = """SELECT f.id, year(f.filed)::INTEGER AS y, CASE WHEN EXISTS (SELECT 1 FROM filings g WHERE g.entity = f.entity AND g.status = 'P' AND g.filed > f.filed AND g.filed <= f.filed + INTERVAL {m} MONTH) THEN 1
  WHEN f.status = 'P' AND NOT EXISTS (SELECT 1 FROM filings h WHERE h.entity = f.entity AND h.filed > f.filed) THEN 1 ELSE 0 END AS label FROM filings f"""


def _label(t, months):
    f = filings(t).withColumn("flag", (c("status") == "P").cast("int"))
    return timejoin.forward_label(f, "entity", "filed", "flag", months)


@query("lbl02_label_12m", _LABEL.replace("{m}", "12"))
def lbl02(t):
    return _label(t, 12).select("id", F.year("filed").alias("y"), "label")


@query("lbl02_label_24m", _LABEL.replace("{m}", "24"))
def lbl02b(t):
    return _label(t, 24).select("id", F.year("filed").alias("y"), "label")


@query("entry_distress_rate", "WITH l AS (" + _LABEL.replace("{m}", "12") + ") SELECT y, count(*) AS filings, sum(label)::BIGINT AS distressed, round(avg(label), 6) AS rate FROM l GROUP BY y")
def entry_query(t):
    return _label(t, 12).groupBy(F.year("filed").alias("y")).agg(F.count(F.lit(1)).alias("filings"), F.sum("label").alias("distressed"), F.round(F.avg("label"), 6).alias("rate"))


@query("mkt03_market_cap", "SELECT p_partkey, coalesce(nullif(p_retailprice * CASE WHEN p_size > 5 THEN p_size END, 0), CAST(p_size AS DOUBLE), 0) AS cap FROM part")
def mkt03(t):
    return t("part").select("p_partkey", finance.market_cap(c("p_retailprice"), F.when(c("p_size") > 5, c("p_size")), c("p_size").cast("double")).alias("cap"))


@query(
    "mkt04_debt_cascade",
    """WITH s AS (SELECT *, nullif(current_liabilities, 0) AS own, CASE WHEN total_assets > 0 THEN nullif(current_liabilities, 0) / total_assets END AS share FROM sheet),
    m AS (SELECT nation, median(own) AS sd, median(share) AS ss FROM s GROUP BY nation)
    SELECT entity, round(coalesce(own, CASE WHEN total_assets > 0 THEN total_assets * coalesce(ss, 0.25) END, sd, (SELECT median(own) FROM s), 10000), 4) AS debt_face FROM s LEFT JOIN m USING (nation)""",
)
def mkt04(t):
    return finance.debt_cascade(sheet(t), "current_liabilities", "total_assets", "nation").select("entity", F.round("debt_face", 4).alias("debt_face"))


@query("mkt06_dtd", f"WITH {_FULL} SELECT entity, round({_DTD}, 6) AS dtd FROM s")
def mkt06(t):
    return _full(t).select("entity", F.round(finance.distance_to_default(c("total_assets"), c("total_liabilities"), F.lit(0.35)), 6).alias("dtd"))


@query(
    "imp01_hierarchical",
    """WITH s AS (SELECT entity, nation, region, CASE WHEN entity % 3 <> 0 AND nation % 5 <> 1 THEN equity END AS v FROM sheet),
    a AS (SELECT nation, median(v) AS m1 FROM s GROUP BY 1), b AS (SELECT region, median(v) AS m2 FROM s GROUP BY 1)
    SELECT entity, coalesce(v, m1, m2, (SELECT median(v) FROM s), 0) AS v_imputed, CASE WHEN v IS NOT NULL THEN 0 WHEN m1 IS NOT NULL THEN 1 WHEN m2 IS NOT NULL THEN 2 ELSE 3 END AS v_imputed_level FROM s JOIN a USING (nation) JOIN b USING (region)""",
)
def imp01(t):
    s = sheet(t).select("entity", "nation", "region", F.when((c("entity") % 3 != 0) & (c("nation") % 5 != 1), c("equity")).alias("v"))
    return finance.hier_impute(s, "v", [["nation"], ["region"]], 0.0).select("entity", "v_imputed", "v_imputed_level")


@query("imp02_median_scale", "WITH f AS (SELECT median(equity) AS md, avg(equity) AS m, stddev_pop(equity) AS s FROM sheet WHERE entity % 2 = 0) SELECT entity, round((equity - m) / s, 6) AS equity FROM sheet, f")
def imp02(t):
    s = sheet(t).select("entity", "equity")
    return finance.apply_median_scale(s, finance.fit_median_scale(s.where("entity % 2 = 0"), ["equity"]), ["equity"]).select("entity", F.round("equity", 6).alias("equity"))


@query("imp04_winsorise", "WITH q AS (SELECT quantile_cont(amount, 0.01) AS a, quantile_cont(amount, 0.99) AS b FROM filings) SELECT id, round(least(greatest(amount, a), b), 4) AS amount FROM filings, q")
def imp04(t):
    return finance.winsorise(filings(t).select("id", "amount"), ["amount"]).select("id", F.round("amount", 4).alias("amount"))


#: Headlines that are put before the given texts, which hold no financial news.
HEADLINES = (
    "Retailer files for Chapter 11 as lenders balk", "Quarter in line with forecasts", "Maker warns of covenant breach", "SEC investigation widens", "Bond default looms for shipper", "New stores in spring",
    "Airline in bankruptcy court over leases", "Cash crunch at builder", "Class action lawsuit against lender", "Auditor raises going concern doubt", "Rating cut to junk", "Financial restructuring agreed",
)
_NEWS = "news AS (SELECT doc_id, CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(HEADLINES)) + " END || chr(10) || coalesce(text, '') AS text FROM documents)"


def _news(t):
    titles = F.array(*[F.lit(x) for x in HEADLINES])
    return t("documents").select("doc_id", F.concat(F.element_at(titles, (c("doc_id") % 12 + 1).cast("int")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


def _topic_sql(p: dict) -> str:
    by: dict[float, list[str]] = {}
    for pattern, weight in p.items():
        by.setdefault(weight, []).append(pattern)
    return "(CASE " + " ".join(f"WHEN regexp_matches(text, '(?i)(?:{'|'.join(by[w])})') THEN {w}" for w in sorted(by, reverse=True)) + " ELSE 0 END)::DOUBLE"


_TOPICS = f"{_NEWS}, i AS (SELECT doc_id, " + ", ".join(f"{_topic_sql(p)} AS {n}" for n, p in DISTRESS_TOPICS.items()) + " FROM news)"


@query("nlp02_topic_intensity", f"WITH {_TOPICS} SELECT * FROM i")
def nlp02(t):
    return _news(t).select("doc_id", *[intensity("text", p).alias(n) for n, p in DISTRESS_TOPICS.items()])


@query(
    "nlp03_composite",
    f"""WITH {_TOPICS}, n AS (SELECT *, (doc_id % 5) / 4.0 AS neg, greatest(chapter11_bankruptcy, 0.9 * default_covenants, 0.8 * litigation_fraud) AS best FROM i), x AS (SELECT *, least(best * (1 + 0.3 * neg), 1.0) AS v FROM n)
    SELECT doc_id, round(v, 6)::DOUBLE AS intensity, (v >= 0.25)::INTEGER AS flagged, CASE WHEN v < 0.2 THEN 'none' WHEN chapter11_bankruptcy >= greatest(default_covenants, litigation_fraud) THEN 'chapter11_bankruptcy' WHEN default_covenants >= litigation_fraud THEN 'default_covenants' ELSE 'litigation_fraud' END AS topic FROM x""",
)
def nlp03(t):
    n = events.distress_topics(_news(t), "text", (c("doc_id") % 5) / 4.0)
    return rounded(n, 6, "intensity").select("doc_id", "intensity", "flagged", "topic")


_GOOD, _BAD = ("agreed", "forecasts", "new", "spring"), ("breach", "default", "crunch", "junk", "doubt", "bankruptcy", "lawsuit")


@query(
    "nlp04_lexicon_sentiment",
    f"""WITH {_NEWS}, w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') AS w FROM news), k AS (SELECT doc_id, greatest(len(w), 1) AS n, len(list_filter(w, lambda x: x IN {_GOOD})) AS g, len(list_filter(w, lambda x: x IN {_BAD})) AS b FROM w)
    SELECT doc_id, round(g / n, 8) AS positive, round(b / n, 8) AS negative, round(1 - g / n - b / n, 8) AS neutral, round(g / n - b / n, 8) AS "index" FROM k""",
)
def nlp04(t):
    s = events.sentiment_shares(_news(t), "text", _GOOD, _BAD)
    return rounded(s.select("doc_id", "positive", "negative", "neutral", "index"), 8, "positive", "negative", "neutral", "index")


@query(
    "nlp05_decay_panel",
    """WITH n AS (SELECT user_id, CAST(ts AS DATE) AS day, value FROM events), cal AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS period FROM n GROUP BY user_id),
    j AS (SELECT cal.user_id, cal.period, value, exp(-ln(2) / 14 * date_diff('day', day, period)) AS w FROM cal LEFT JOIN n ON n.user_id = cal.user_id AND n.day BETWEEN cal.period - 7 AND cal.period)
    SELECT user_id, strftime(period, '%Y-%m-%d') AS period, count(value) AS count_7, round(coalesce(sum(value * w) / sum(w) FILTER (value IS NOT NULL), 0), 6) AS decayed_7, round(coalesce(sum(w) FILTER (value IS NOT NULL), 0), 6) AS volume_7 FROM j GROUP BY ALL""",
)
def nlp05(t):
    n = t("events").select("user_id", F.to_date("ts").alias("day"), "value")
    p = timejoin.decay_panel(timejoin.densify(n, "user_id", "day", "1 day"), n, "user_id", "period", "day", "value", (7,))
    return p.select("user_id", day_text("period").alias("period"), "count_7", F.round("decayed_7", 6).alias("decayed_7"), F.round("volume_7", 6).alias("volume_7"))


@query("nlp10_rank_decay", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1 AS k FROM events QUALIFY k < 15) SELECT user_id, round(sum(value * exp(-0.05 * k)) / sum(exp(-0.05 * k)), 6) AS decayed, round(max(value) - min(value), 6) AS span, round(avg(value), 6) AS mean FROM r GROUP BY user_id")
def nlp10(t):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")) - 1
    w = F.exp(-0.05 * c("k"))
    r = t("events").withColumn("k", k).where("k < 15")
    return r.groupBy("user_id").agg(F.round(F.sum(c("value") * w) / F.sum(w), 6).alias("decayed"), F.round(F.max("value") - F.min("value"), 6).alias("span"), F.round(F.avg("value"), 6).alias("mean"))


def _window(q):
    return network.window_returns(timejoin.returns(q, "ticker", "day", "price", (1,)), "ticker", "day", "return_1", months=2, min_valid=0.1)


@query("net01_window", """WITH r AS (SELECT ticker, day, price / nullif(lag(price) OVER (PARTITION BY ticker ORDER BY day), 0) - 1 AS ret FROM quotes),
    s AS (SELECT ticker, day, ret, (date_trunc('month', day) + to_months(k::INTEGER))::DATE AS ym FROM r, range(0, 2) x(k) WHERE ret IS NOT NULL),
    d AS (SELECT ym, count(DISTINCT day) AS days FROM s GROUP BY ym HAVING max(date_trunc('month', day)::DATE) = ym),
    p AS (SELECT ym, ticker, count(*) AS valid FROM s GROUP BY ALL)
    SELECT strftime(ym, '%Y-%m-%d') AS ym, count(*) AS tickers, sum(valid)::BIGINT AS points FROM p JOIN d USING (ym) WHERE valid >= 0.1 * days GROUP BY 1""")
def net01(t):
    w = _window(quotes(t, dealt=True)).groupBy("ym", "ticker").agg(F.count(F.lit(1)).alias("valid"))
    return w.groupBy(day_text("ym").alias("ym")).agg(F.count(F.lit(1)).alias("tickers"), F.sum("valid").alias("points"))


def _edges(t):
    return network.correlations(_window(quotes(t, dealt=True)), "ticker", "day")


def _forest(t):
    return network.correlation_forest(_window(quotes(t, dealt=True)), "ticker", "day")


@query("net02_correlation", """WITH r AS (SELECT ticker, day, price / nullif(lag(price) OVER (PARTITION BY ticker ORDER BY day), 0) - 1 AS ret FROM quotes),
    s AS (SELECT ticker, day, ret, (date_trunc('month', day) + to_months(k::INTEGER))::DATE AS ym FROM r, range(0, 2) x(k) WHERE ret IS NOT NULL),
    d AS (SELECT ym, count(DISTINCT day) AS days FROM s GROUP BY ym HAVING max(date_trunc('month', day)::DATE) = ym),
    p AS (SELECT ym, ticker, count(*) AS valid, avg(ret) AS mean FROM s GROUP BY ALL), k AS (SELECT ym, ticker, mean FROM p JOIN d USING (ym) WHERE valid >= 0.1 * days),
    c AS (SELECT ym, ticker, day, ret - mean AS x FROM s JOIN k USING (ym, ticker)), n AS (SELECT ym, ticker, sqrt(sum(x * x)) AS norm FROM c GROUP BY ALL), u AS (SELECT ym, ticker, day, x / nullif(norm, 0) AS x FROM c JOIN n USING (ym, ticker)),
    o AS (SELECT a.ym, a.ticker AS i, b.ticker AS j, sum(a.x * b.x) AS rho FROM u a JOIN u b ON a.ym = b.ym AND a.day = b.day AND a.ticker < b.ticker GROUP BY ALL),
    e AS (SELECT a.ym, a.ticker AS i, b.ticker AS j, least(greatest(coalesce(rho, 0), -1), 1) AS rho FROM k a JOIN k b ON a.ym = b.ym AND a.ticker < b.ticker LEFT JOIN o ON o.ym = a.ym AND o.i = a.ticker AND o.j = b.ticker)
    SELECT strftime(ym, '%Y-%m-%d') AS ym, i, j, round(rho, 6) + 0 AS rho, round(sqrt(2 * (1 - rho)), 5) + 0 AS distance FROM e""")
def net02(t):
    e = _edges(t)
    return e.select(day_text("ym").alias("ym"), "i", "j", F.round("rho", 6).alias("rho"), F.round("distance", 5).alias("distance"))


@query("net04_spanning_forest")
def net04(t):
    return _forest(t)


@query("net05_degree")
def net05(t):
    return network.degree(_forest(t))


@query("net06_pagerank")
def net06(t):
    return network.pagerank(_forest(t))


@query("net07_betweenness")
def net07(t):
    return network.subtree_betweenness(_forest(t))


@query("net08_communities")
def net08(t):
    return network.modularity_communities(_forest(t))


@query("net09_spatial_lag", "SELECT entity, round(coalesce((sum((equity < 0)::INTEGER) OVER w - (equity < 0)::INTEGER) / nullif(count(*) OVER w - 1, 0), 0), 6) AS exposure FROM sheet WINDOW w AS (PARTITION BY nation)")
def net09(t):
    s = sheet(t).withColumn("bad", (c("equity") < 0).cast("int"))
    return network.spatial_lag(s, ["nation"], "bad").select("entity", F.round("exposure", 6).alias("exposure"))


@query("ins01_role", "SELECT p_partkey, regexp_matches(upper(coalesce(p_type, '') || ' ' || coalesce(p_name, '')), 'PROMO|STEEL|BRASS')::INTEGER AS role FROM part")
def ins01(t):
    return t("part").select("p_partkey", F.upper(F.concat(F.coalesce("p_type", F.lit("")), F.lit(" "), F.coalesce("p_name", F.lit("")))).rlike("PROMO|STEEL|BRASS").cast("int").alias("role"))


@query("mac01_series", "SELECT coalesce(a.y, b.y)::INTEGER AS y, round(coalesce(m1, 0), 4) AS m1, round(coalesce(m2, 0), 4) AS m2 FROM (SELECT year(o_orderdate) AS y, avg(o_totalprice) AS m1 FROM orders GROUP BY 1) a FULL JOIN (SELECT year(l_shipdate) AS y, avg(l_discount) AS m2 FROM lineitem GROUP BY 1) b ON a.y = b.y")
def mac01(t):
    a = t("orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("m1"))
    b = t("lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(F.avg("l_discount").alias("m2"))
    return rounded(a.join(b, "y", "full").fillna(0.0), 4, "m1", "m2")


@query("mkt07_price_to_book", "SELECT entity, round(CASE WHEN equity > 0 AND total_assets > 0 THEN total_assets / equity ELSE 1 END, 6)::DOUBLE AS ptb FROM sheet")
def mkt07(t):
    return sheet(t).select("entity", F.round(F.when((c("equity") > 0) & (c("total_assets") > 0), ratio("total_assets", "equity", None)).otherwise(1.0), 6).alias("ptb"))
