"""Window-function queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from solvara.operators import finance, frames, timejoin
from solvara.plans.registry import day_text, filings, lagged, query, quotes, sheet

c = F.col


@query("wn01_restatement", "SELECT id, entity, form FROM lagged QUALIFY row_number() OVER (PARTITION BY entity, period, split_part(form, '/', 1) ORDER BY CASE WHEN lag > 180 OR lag < 0 THEN 2 ELSE 1 END, filed DESC, id DESC) = 1")
def wn01(t):
    return frames.dedup_restated(lagged(t), "entity", "period", "form", "filed", "lag", "id").select("id", "entity", "form")


@query("wn02_newest_text", "SELECT max(doc_id) AS doc_id, lower(trim(text)) AS k FROM documents GROUP BY 2")
def wn02(t):
    return frames.first_rows(t("documents").withColumn("k", F.lower(F.trim("text"))), ["k"], [c("doc_id").desc()]).select("doc_id", "k")


@query("wn03_nulls_last", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_totalprice, 0) DESC NULLS LAST, o_orderkey) = 1")
def wn03(t):
    return frames.first_rows(t("orders"), ["o_custkey"], [F.nullif("o_totalprice", F.lit(0.0)).desc_nulls_last(), c("o_orderkey")]).select("o_custkey", "o_orderkey")


_W = "WINDOW w AS (PARTITION BY ticker ORDER BY day)"


@query("wn04_returns", f"SELECT ticker, strftime(day, '%Y-%m-%d') AS day, round(price / nullif(lag(price, 1) OVER w, 0) - 1, 8) AS return_1, round(price / nullif(lag(price, 21) OVER w, 0) - 1, 8) AS return_21, round(price / nullif(lag(price, 63) OVER w, 0) - 1, 8) AS return_63, round(price / nullif(lag(price, 252) OVER w, 0) - 1, 8) AS return_252 FROM quotes {_W}")
def wn04(t):
    lags = (1, 21, 63, 252)
    r = timejoin.returns(quotes(t), "ticker", "day", "price", lags)
    return r.select("ticker", day_text("day").alias("day"), *[F.round(f"return_{k}", 8).alias(f"return_{k}") for k in lags])


@query("wn05_volatility", f"WITH r AS (SELECT ticker, day, price / nullif(lag(price) OVER w, 0) - 1 AS ret FROM quotes {_W}) SELECT ticker, strftime(day, '%Y-%m-%d') AS day, round(coalesce(stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY r.day ROWS 20 PRECEDING) * sqrt(252), 0.20), 6) AS volatility FROM r")
def wn05(t):
    r = timejoin.returns(quotes(t), "ticker", "day", "price", (1,))
    return timejoin.rolling_volatility(r, "ticker", "day", "return_1").select("ticker", day_text("day").alias("day"), F.round("volatility", 6).alias("volatility"))


@query("wn06_unordered", "SELECT entity, round(avg(equity) OVER (PARTITION BY nation), 4) AS mean, median(equity) OVER (PARTITION BY nation) AS mid FROM sheet")
def wn06(t):
    w = Window.partitionBy("nation")
    return sheet(t).select("entity", F.round(F.avg("equity").over(w), 4).alias("mean"), F.median("equity").over(w).alias("mid"))


@query("wn08_deltas", "SELECT id, round(coalesce(amount - lag(amount) OVER (PARTITION BY entity ORDER BY filings.filed, id), 0), 4) AS delta_amount FROM filings")
def wn08(t):
    return timejoin.deltas(filings(t), "entity", ["filed", "id"], ["amount"]).select("id", F.round("delta_amount", 4).alias("delta_amount"))


@query("wn09_rolling_std", "SELECT id, round(coalesce(stddev_samp(amount) OVER (PARTITION BY entity ORDER BY filings.filed, id ROWS 2 PRECEDING), 0.01), 4) AS std FROM filings")
def wn09(t):
    w = Window.partitionBy("entity").orderBy("filed", "id").rowsBetween(-2, 0)
    return filings(t).select("id", F.round(F.coalesce(F.stddev_samp("amount").over(w), F.lit(0.01)), 4).alias("std"))


_CAL = """WITH n AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS hits FROM events WHERE event_type = 'error' GROUP BY ALL),
  cal AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS period FROM (SELECT user_id, CAST(ts AS DATE) AS day FROM events) GROUP BY user_id),
  p AS (SELECT cal.user_id, cal.period, coalesce(hits, 0) AS hits FROM cal LEFT JOIN n ON n.user_id = cal.user_id AND n.day = cal.period)"""


@query(
    "wn10_silence",
    _CAL
    + """, g AS (SELECT *, sum((hits > 0)::INTEGER) OVER (PARTITION BY user_id ORDER BY period) AS island FROM p),
  s AS (SELECT *, sum((hits = 0)::INTEGER) OVER (PARTITION BY user_id, island ORDER BY period)::INTEGER AS silent_run FROM g)
  SELECT user_id, strftime(period, '%Y-%m-%d') AS period, silent_run, (silent_run >= 3)::INTEGER AS silent_3, (silent_run >= 6)::INTEGER AS silent_6, round(avg((hits > 0)::INTEGER) OVER (PARTITION BY user_id ORDER BY s.period ROWS 11 PRECEDING), 6) AS coverage FROM s""",
)
def wn10(t):
    e = t("events").select("user_id", F.to_date("ts").alias("period"), "event_type")
    hits = e.where("event_type = 'error'").groupBy("user_id", "period").agg(F.count(F.lit(1)).alias("hits"))
    panel = timejoin.densify(e, "user_id", "period", "1 day").join(hits, ["user_id", "period"], "left")
    s = timejoin.silence(panel, "user_id", "period", "hits")
    return s.select("user_id", day_text("period").alias("period"), "silent_run", "silent_3", "silent_6", F.round("coverage", 6).alias("coverage"))


@query("wn14_trailing", "SELECT event_id, round(avg(value) OVER w, 6) AS value_avg, round(max(value) OVER w - min(value) OVER w, 6) AS value_range, round(stddev_samp(value) OVER w, 6) AS value_std FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 5 PRECEDING)")
def wn14(t):
    e = t("events").withColumn("at", F.struct("ts", "event_id"))
    w = finance.market_window(e, "user_id", "at", "value", 6)
    return w.select("event_id", F.round("value_avg", 6).alias("value_avg"), F.round(c("value_max") - c("value_min"), 6).alias("value_range"), F.round("value_std", 6).alias("value_std"))


# An odd scale keeps the means off ties of rounding, which two engines may break differently.
@query("nlp07_trailing_months", """WITH r AS (SELECT o_orderkey, o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS m, o_totalprice / 7000.123457 AS v FROM orders)
  SELECT o_orderkey AS id, round(avg(v) OVER w, 6) AS value_avg, round(max(v) OVER w, 6) AS value_max, round(max(v) OVER w - min(v) OVER w, 6) AS value_range, round(stddev_samp(v) OVER w, 6) AS value_std, round(avg(v) OVER (PARTITION BY m), 6) AS market_mean
  FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY m RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def nlp07_months(t):
    o = t("orders").select(c("o_orderkey").alias("id"), "o_custkey", F.to_date("o_orderdate").alias("day"), (c("o_totalprice") / 7000.123457).alias("value"))
    w = timejoin.trailing_months(o, "o_custkey", "day", "value", 6)
    names = ("value_avg", "value_max", "value_range", "value_std", "market_mean")
    return w.select("id", *[F.round(x, 6).alias(x) for x in names])
