"""Model queries over the feature columns of the given tables, and jobs over files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvara import sources, streaming
from solvara.operators import frames, metrics, models, neural, scoring, timejoin
from solvara.plans.registry import day_text, filings, query, rounded, scored, sheet

c = F.col
FEATURES = [f"x{k}" for k in range(6)]


def _matrix(t):
    return t("embeddings").select("vec_id", *[c("embedding")[k].cast("double").alias(f"x{k}") for k in range(6)], (c("label") > 4).cast("int").alias("y"))


def _fold(df):
    return df.where("vec_id % 4 <> 0"), df.where("vec_id % 4 = 0")


def _register(kind, ident):
    @query(ident)
    def run(t):
        train, test = _fold(_matrix(t))
        fitted = models.fit_classifier(models.balanced_weight(train, "y"), FEATURES, "y", kind, "weight")
        return fitted(test).select("vec_id", "score", "y")


for _kind, _ident in (("logistic", "mdl01_logistic"), ("forest", "mdl02_forest"), ("boosted", "mdl03_boosted")):
    _register(_kind, _ident)


@query("mdl04_network")
def mdl04(t):
    """The network with its 24-fold loss; a fifth of the training rows says when to stop."""
    train, test = _fold(_matrix(t))
    stop = F.pmod(F.xxhash64("vec_id", F.lit("stop")), F.lit(5)) == 0
    fitted = neural.fit_network(train.where(~stop), FEATURES, "y", valid=train.where(stop))
    return fitted(test).select("vec_id", "margin", "score", "y")


@query("mdl07_weighted_vote", "SELECT event_id, round((a * 0.8 + b * 0.6) / 1.4, 8)::DOUBLE AS vote FROM scored")
def mdl07(t):
    return rounded(models.weighted_vote(scored(t), {"a": 0.8, "b": 0.6}), 8, "vote").select("event_id", "vote")


@query("mdl09_calibration")
def mdl09(t):
    """Fitted on the users with even numbers, applied to the others."""
    rows = scored(t).select("event_id", c("a").alias("score"), "y", "user_id")
    train, s = rows.where("user_id % 2 = 0"), rows.where("user_id % 2 <> 0")
    iso, sig = models.calibrate(train, "score", "y"), models.calibrate(train, "score", "y", "sigmoid")
    a = iso(s).select("event_id", c("calibrated").alias("isotonic"))
    return a.join(sig(s).select("event_id", c("calibrated").alias("sigmoid")), "event_id")


@query("sel01_random_probes")
def sel01(t):
    return models.random_probes(_matrix(t), FEATURES, "y")


@query("sel03_pruned")
def sel03(t):
    m = _matrix(t)
    rho = [tuple(r) for r in metrics.spearman(m, FEATURES).collect()]
    importance = {r["feature"]: r["importance"] for r in models.random_probes(m, FEATURES, "y").collect()}
    kept = models.prune_collinear(rho, importance, 0.75)
    return m.agg(*[F.avg(f).alias(f) for f in kept]).unpivot([], kept, "feature", "mean")


#: A month's economy: mean discount as its rate, orders still open as the unemployed, growth of orders.
def _economy(t):
    o, l = t("orders"), t("lineitem")
    a = o.groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.avg((c("o_orderstatus") == "O").cast("double")).alias("unemployment"), F.count(F.lit(1)).alias("n"))
    b = l.groupBy(F.trunc("l_shipdate", "MM").alias("month")).agg(F.avg("l_discount").alias("rate"))
    before = a.select(F.add_months("month", 12).alias("month"), c("n").alias("before"))
    return a.join(b, "month", "left").join(before, "month", "left").withColumn("growth", F.try_divide(c("n").cast("double"), c("before")) - 1)


@query("gmm01_regimes")
def gmm01(t):
    names = ["expansion", "tightening", "crisis"]
    m = models.named_mixture(_economy(t), ["rate", "unemployment", "growth"], 3, models.regime_order("rate", "unemployment", "growth"), names)
    return m.select(day_text("month").alias("month"), *[f"{n}_prob" for n in names], c("component").alias("label"), c("component_name").alias("name"))


@query("gmm02_archetypes")
def gmm02(t):
    s = sheet(t).withColumn("working_capital", c("current_assets") - c("current_liabilities"))
    names = [f"archetype{k}" for k in range(4)]
    m = models.named_mixture(s, ["working_capital", "current_assets", "net_income", "equity"], 4, models.sum_order("working_capital", "current_assets"), names, winsor=True)
    return m.select("entity", *[f"{n}_prob" for n in names], c("component").alias("label"), c("component_name").alias("name"))


@query("gmm03_bic")
def gmm03(t):
    return models.mixture_selection(_matrix(t), FEATURES[:3])


@query("gmm04_argmax", "WITH q AS (SELECT event_id, a / nullif(a + b, 0) AS p, b / nullif(a + b, 0) AS q FROM scored) SELECT event_id, round(coalesce(p, 0.5), 8) AS x_prob, round(coalesce(q, 0.5), 8) AS y_prob, CASE WHEN coalesce(p, 0.5) >= coalesce(q, 0.5) THEN 'x' ELSE 'y' END AS name FROM q")
def gmm04(t):
    p = models.normalised(scored(t).select("event_id", c("a").alias("x"), c("b").alias("y")), ["x", "y"])
    return rounded(p.select("event_id", "x_prob", "y_prob", c("component_name").alias("name")), 8, "x_prob", "y_prob")


@query("mdl08_scorecard")
def mdl08(t):
    train, test = _fold(_matrix(t))
    fitted = models.woe_scorecard(train, FEATURES, "y")
    return scoring.rated(fitted(test), "points").select("vec_id", "score", "points", "rating", "service_rating", "decision", "implied_pd", "y")


@query("ano01_isolation_forest")
def ano01(t):
    return models.isolation_forest(_matrix(t), "vec_id", FEATURES, trees=50)


@query("src02_union_by_name", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def src02(t):
    a, b = t("customer"), t("supplier").select("s_suppkey", "s_name")
    paths = [sources.shared_path(a.sparkSession, x) for x in ("union-a", "union-b")]
    a.select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_acctbal").alias("balance")).write.csv(paths[0], header=True)
    b.select(c("s_suppkey").alias("id"), c("s_name").alias("name")).write.csv(paths[1], header=True)
    return sources.typed(sources.read_union(a.sparkSession, paths), {"id": "bigint", "balance": "double"}).select("id", "name", "balance")


@query("src08_parallel_json", "SELECT o_orderkey, o_orderstatus AS form, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus = 'P'")
def src08(t):
    packed = t("orders").where("o_orderstatus = 'P'").withColumn("j", F.to_json(F.struct(F.array("o_orderstatus").alias("form"), F.array(day_text("o_orderdate")).alias("day"))))
    return sources.explode_parallel(packed.select("o_orderkey", "j"), "j", {"form": "string", "day": "string"}).select("o_orderkey", "form", "day")


@query("src10_feed", "SELECT s_suppkey, s_name AS title, 'http://x/' || s_suppkey AS link FROM supplier")
def src10(t):
    item = F.concat(F.lit("<rss><channel><item><title>"), c("s_name"), F.lit("</title><link>http://x/"), c("s_suppkey").cast("string"), F.lit("</link></item></channel></rss>"))
    return sources.parse_feed(t("supplier").select("s_suppkey", item.alias("x")), "x").select("s_suppkey", "title", "link")


@query("snk_reports", "SELECT form, count(*) AS n FROM filings GROUP BY form")
def snk(t):
    report = filings(t).groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    path = sources.shared_path(report.sparkSession, "report")
    sources.write_report(report, path, "json")
    return report.sparkSession.read.schema("form string, n bigint").json(path)


@query("snk05_swap", "SELECT n_nationkey, n_name, 1 AS version FROM nation")
def snk05(t):
    n = t("nation").select("n_nationkey", "n_name")
    path = sources.shared_path(n.sparkSession, "swap")
    sources.write_swap(n, path)
    sources.write_swap(n.sparkSession.read.parquet(path).withColumn("version", F.lit(1)), path)
    return n.sparkSession.read.parquet(path)


def _landed(t, name):
    e = t("events").select("event_id", "user_id", "ts", "value")
    path = sources.shared_path(e.sparkSession, name)
    e.repartition(3).write.parquet(path)
    return e.sparkSession, path


def _drop_folder(t):
    """A folder of good files and one that can't be read, ingested."""
    spark, folder = _landed(t, "drop")
    target = sources.shared_path(spark, "ingested")
    schema = spark.read.parquet(folder).schema
    spark.range(1).select(F.lit("no table").alias("value")).coalesce(1).write.mode("append").option("compression", "none").text(f"{folder}/bad")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/bad")
    fs = at.getFileSystem(conf)
    for f in fs.listStatus(at):
        if f.getPath().getName().startswith("part-"):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{folder}/part-bad.parquet"))
    fs.delete(at, True)
    streaming.ingest_folder(spark, folder, target, sources.shared_path(spark, "ingest-mark"), schema)
    return spark, folder, target


@query("stm01_ingest", "SELECT event_id, user_id FROM events")
def stm01(t):
    spark, _, target = _drop_folder(t)
    return spark.read.parquet(target).select("event_id", "user_id")


@query("src05_ingest_report", "SELECT true AS ingested, count(*)::BIGINT AS rows FROM events UNION ALL SELECT false, 0")
def src05(t):
    spark, folder, target = _drop_folder(t)
    return streaming.ingest_report(spark, folder, target).groupBy("ingested").agg(F.sum("rows").alias("rows"))


@query("stm02_sliding", """SELECT user_id, strftime(w, '%Y-%m-%d') AS window_end, count(*) AS rows, round(sum(value), 4) AS total, round(sum(value * exp(-ln(2) / 14 * date_diff('microsecond', ts, CAST(w AS TIMESTAMP)) / 86400e6)), 4) AS decayed
  FROM (SELECT user_id, value, ts, CAST(ts AS DATE) + 1 + unnest(range(0, 30))::INTEGER AS w FROM events) GROUP BY ALL""")
def stm02(t):
    spark, folder = _landed(t, "sliding-in")
    s = streaming.sliding_totals(spark, folder, "user_id", "ts", "value")
    return s.select("user_id", F.date_format("window_end", "yyyy-MM-dd").alias("window_end"), "rows", F.round("total", 4).alias("total"), F.round("decayed", 4).alias("decayed"))


@query("stm03_latest", "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, arg_max(value, ts) AS value FROM events GROUP BY user_id HAVING max(ts) > (SELECT max(ts) FROM events) - INTERVAL 12 HOUR")
def stm03(t):
    spark, folder = _landed(t, "latest-in")
    return streaming.latest_by_key(spark, folder, "user_id", "ts", "value", "12 hours").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("jn18_alternate_key", """WITH f AS (SELECT upper(trim(c_name)) AS k, date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
  SELECT o_orderkey AS id, coalesce(n, 0) AS n, coalesce(v, -1.0) AS v FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN f ON k = upper(trim(c_name)) AND m = (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE""")
def jn18(t):
    # filings without a ticker meet the next month's news features by company name, written otherwise there
    o = t("orders").join(t("customer"), c("o_custkey") == c("c_custkey")).select(c("o_orderkey").alias("id"), c("c_name").alias("company_name"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    news = o.groupBy(F.concat(F.lit(" "), F.lower("company_name")).alias("ticker"), F.trunc("day", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("v"))
    left = o.select("id", "company_name", F.add_months("day", 1).alias("day"))
    return timejoin.alternate_key_join(left, news, ["ticker", "company_name"], "ticker", "day", "month", {"n": 0, "v": -1.0}).select("id", "n", "v")


@query("prj08_sanitised", "SELECT r_regionkey AS \"r_regionkey\", r_name AS r_name_ FROM region")
def prj08(t):
    return frames.sanitised(t("region").select("r_regionkey", c("r_name").alias("r name!")))
