"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from solvara.functions import ratio, word_count
from solvara.operators import finance
from solvara.operators.ordered import quantiles
from solvara.plans.registry import filings, lagged, query, quotes, sheet

c = F.col
one = "*"


@query("ag01_summary", "SELECT count(*) AS n, count(DISTINCT entity) AS entities, strftime(min(filings.filed), '%Y-%m-%d') AS first, strftime(max(filings.filed), '%Y-%m-%d') AS last, round(avg(CASE WHEN amount > 100000 THEN amount END), 4) AS large_mean FROM filings")
def ag01(t):
    return filings(t).agg(F.count(one).alias("n"), F.count_distinct("entity").alias("entities"), F.date_format(F.min("filed"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("filed"), "yyyy-MM-dd").alias("last"), F.round(F.avg(F.when(c("amount") > 100000, c("amount"))), 4).alias("large_mean"))


@query("ag02_share", "SELECT form, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM filings GROUP BY form")
def ag02(t):
    n = filings(t).groupBy("form").agg(F.count(one).alias("n"))
    return n.withColumn("share", F.round(c("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


@query("ag03_quartiles", "SELECT form, quantile_cont(lag, 0.25) AS q1, quantile_cont(lag, 0.5) AS q2, quantile_cont(lag, 0.75) AS q3, round(avg(lag), 6) AS mean FROM lagged GROUP BY form")
def ag03(t):
    q = F.percentile("lag", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return lagged(t).groupBy("form").agg(q.alias("q"), F.round(F.avg("lag"), 6).alias("mean")).select("form", c("q")[0].alias("q1"), c("q")[1].alias("q2"), c("q")[2].alias("q3"), "mean")


@query("ag04_tags", "SELECT l_returnflag || l_linestatus AS tag, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def ag04(t):
    return t("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("tag")).agg(F.count(one).alias("n"), F.count_distinct("l_orderkey").alias("orders"))


_PANEL = """SELECT l_suppkey AS entity, year(l_shipdate)::INTEGER AS y, month(l_shipdate)::INTEGER AS m,
  round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE -l_quantity END), 2) AS net_shares,
  round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE -l_extendedprice END), 2) AS net_value,
  round(count(*) FILTER (l_returnflag = 'A') / nullif(count(*), 0), 4) AS buy_ratio,
  count(DISTINCT CASE WHEN l_returnflag <> 'A' THEN l_partkey END) AS sellers, max((l_tax > 0.07)::INTEGER) AS flagged FROM lineitem GROUP BY ALL"""


@query("ag22_insider_panel", _PANEL)
def ag22(t):
    buy = c("l_returnflag") == "A"
    return t("lineitem").groupBy(c("l_suppkey").alias("entity"), F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).agg(
        F.round(F.sum(F.when(buy, c("l_quantity")).otherwise(-c("l_quantity"))), 2).alias("net_shares"),
        F.round(F.sum(F.when(buy, c("l_extendedprice")).otherwise(-c("l_extendedprice"))), 2).alias("net_value"),
        F.round(ratio(F.sum(F.when(buy, 1).otherwise(0)), F.count(one), None), 4).alias("buy_ratio"),
        F.count_distinct(F.when(~buy, c("l_partkey"))).alias("sellers"),
        F.max((c("l_tax") > 0.07).cast("int")).alias("flagged"),
    )


@query("ag09_first_event", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, arg_min(event_type, ts) AS kind FROM events GROUP BY user_id")
def ag09(t):
    return t("events").groupBy("user_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first"), F.min_by("event_type", "ts").alias("kind"))


@query("ag10_year_stats", "SELECT year(filed)::INTEGER AS y, round(avg(amount), 4) AS mean, round(stddev_samp(amount), 4) AS std, round(avg(CASE WHEN amount > 200000 THEN 1.0 ELSE 0.0 END), 6) AS over FROM filings GROUP BY 1")
def ag10(t):
    return filings(t).groupBy(F.year("filed").alias("y")).agg(F.round(F.avg("amount"), 4).alias("mean"), F.round(F.stddev_samp("amount"), 4).alias("std"), F.round(F.avg(F.when(c("amount") > 200000, 1.0).otherwise(0.0)), 6).alias("over"))


@query(
    "ag11_median_levels",
    """SELECT CASE WHEN grouping(region) = 1 THEN 'all' WHEN grouping(nation) = 1 THEN 'region' ELSE 'nation' END AS level, region, nation, median(equity) AS mid FROM sheet
    GROUP BY GROUPING SETS ((region, nation), (region), ())""",
)
def ag11(t):
    s = sheet(t).select("region", "nation", "equity")
    s.createOrReplaceTempView("solvara_levels")
    return s.sparkSession.sql(
        "SELECT CASE WHEN grouping(region) = 1 THEN 'all' WHEN grouping(nation) = 1 THEN 'region' ELSE 'nation' END AS level, region, nation, median(equity) AS mid "
        "FROM solvara_levels GROUP BY GROUPING SETS ((region, nation), (region), ())"
    )


@query("ag12_corr", "SELECT round(corr(l_quantity, l_extendedprice), 8) AS qp, round(corr(l_discount, l_tax), 8) AS dt FROM lineitem")
def ag12(t):
    return t("lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("qp"), F.round(F.corr("l_discount", "l_tax"), 8).alias("dt"))


@query("ag13_nulls", "SELECT 'text' AS feature, sum((text IS NULL)::INTEGER)::BIGINT AS nulls FROM documents UNION ALL SELECT 'lang', sum((lang IS NULL)::INTEGER)::BIGINT FROM documents UNION ALL SELECT 'source', sum((source IS NULL)::INTEGER)::BIGINT FROM documents")
def ag13(t):
    names = ["text", "lang", "source"]
    row = t("documents").agg(*[F.sum(c(x).isNull().cast("long")).alias(x) for x in names])
    return row.unpivot([], names, "feature", "nulls")


@query("ag14_profile", "SELECT count(amount) AS n, min(amount) AS lo, round(avg(amount), 4) AS mean, round(stddev_samp(amount), 4) AS std, max(amount) AS hi, round(quantile_cont(amount, 0.25), 4) AS p25, round(quantile_cont(amount, 0.95), 4) AS p95, round(quantile_cont(amount, 0.999), 4) AS p999 FROM filings")
def ag14(t):
    q = quantiles(filings(t), "amount", [0.25, 0.95, 0.999])
    r = filings(t).agg(F.count("amount").alias("n"), F.min("amount").alias("lo"), F.round(F.avg("amount"), 4).alias("mean"), F.round(F.stddev_samp("amount"), 4).alias("std"), F.max("amount").alias("hi"))
    return r.crossJoin(F.broadcast(q)).select("n", "lo", "mean", "std", "hi", *[F.round(c("q")[k], 4).alias(n) for k, n in enumerate(("p25", "p95", "p999"))])


@query(
    "ag15_tails",
    """WITH q AS (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b FROM filings)
    SELECT round(avg(power(amount - m, 3)) / power(stddev_pop(amount), 3), 6) AS skew, round(kurtosis_pop(amount), 6) AS kurt, round(avg(CASE WHEN amount < a - 1.5 * (b - a) OR amount > b + 1.5 * (b - a) THEN 1.0 ELSE 0.0 END), 6) AS outliers
    FROM filings, q, (SELECT avg(amount) AS m FROM filings)""",
)
def ag15(t):
    f = filings(t)
    q = quantiles(f, "amount", [0.25, 0.75])
    a, b = c("q")[0], c("q")[1]
    out = (c("amount") < a - 1.5 * (b - a)) | (c("amount") > b + 1.5 * (b - a))
    return f.crossJoin(F.broadcast(q)).agg(F.round(F.skewness("amount"), 6).alias("skew"), F.round(F.kurtosis("amount"), 6).alias("kurt"), F.round(F.avg(out.cast("double")), 6).alias("outliers"))


@query("ag16_consolidate", "SELECT user_id AS entity, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_date, arg_min(event_type, ts) AS first_source, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS sources, count(DISTINCT event_type) AS n_sources FROM events GROUP BY 1")
def ag16(t):
    e = t("events").select(c("user_id").alias("entity"), "ts", "event_type")
    return finance.consolidate_events(e, "entity", "ts", "event_type").withColumn("first_date", F.date_format("first_date", "yyyy-MM-dd HH:mm:ss"))


@query("ag17_pivot", "SELECT year(filed)::INTEGER AS y, count(*) FILTER (status = 'F') AS F, count(*) FILTER (status = 'O') AS O, count(*) FILTER (status = 'P') AS P, round(count(*) FILTER (status = 'P') / count(*), 6) AS rate FROM filings GROUP BY 1")
def ag17(t):
    p = filings(t).groupBy(F.year("filed").alias("y")).pivot("status", ["F", "O", "P"]).agg(F.count("form")).fillna(0, ["F", "O", "P"])
    return p.withColumn("rate", F.round(c("P") / (c("F") + c("O") + c("P")), 6))


@query("ag18_segment_rate", "SELECT segment, count(*) AS n, sum((equity < 0)::INTEGER)::BIGINT AS events, round(avg((equity < 0)::INTEGER), 6) AS rate FROM sheet GROUP BY segment")
def ag18(t):
    e = (c("equity") < 0).cast("int")
    return sheet(t).groupBy("segment").agg(F.count(one).alias("n"), F.sum(e).alias("events"), F.round(F.avg(e), 6).alias("rate"))


@query(
    "ag19_coverage",
    r"""WITH d AS (SELECT CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS w FROM documents)
    SELECT lim, round(avg((w <= lim)::INTEGER), 6) AS share, sum((w > lim)::INTEGER)::BIGINT AS beyond FROM d, (SELECT unnest([32, 64, 128, 256, 512]) AS lim) GROUP BY lim""",
)
def ag19(t):
    d = t("documents").select(word_count("text").alias("w"), F.explode(F.array(*map(F.lit, (32, 64, 128, 256, 512)))).alias("lim"))
    return d.groupBy("lim").agg(F.round(F.avg((c("w") <= c("lim")).cast("int")), 6).alias("share"), F.sum((c("w") > c("lim")).cast("int")).alias("beyond"))


@query("ag20_having", "SELECT ticker, count(DISTINCT day) AS days FROM quotes GROUP BY ticker HAVING count(DISTINCT day) > 50")
def ag20(t):
    return quotes(t).groupBy("ticker").agg(F.count_distinct("day").alias("days")).where("days > 50")


@query("ag21_balance", "SELECT toxic, quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY ALL")
def ag21(t):
    n = t("labels").groupBy("toxic", "quality").agg(F.count(one).alias("n"))
    return n.withColumn("share", F.round(c("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("ag24_histogram", "WITH h AS (SELECT floor(amount / 50000)::BIGINT AS bin, count(*) AS n FROM filings GROUP BY 1) SELECT bin, n, sum(n) OVER (ORDER BY bin)::BIGINT AS upto FROM h")
def ag24(t):
    h = filings(t).groupBy(F.floor(c("amount") / 50000).alias("bin")).agg(F.count(one).alias("n"))
    return h.withColumn("upto", F.sum("n").over(Window.orderBy("bin")))
