"""Scans, projections, filters, joins, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvara import functions as fx
from solvara import sources
from solvara.operators import frames, timejoin
from solvara.plans.registry import day_text, filings, lagged, query, quotes, rounded, scored, sheet

c = F.col


@query("src01_text_table", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def src01(t):
    df = t("customer").select("c_custkey", "c_name", "c_nationkey")
    path = sources.shared_path(df.sparkSession, "text")
    df.write.csv(path, sep="\t", header=True)
    return sources.read_text_table(df.sparkSession, path, df.columns)


@query("src03_pruned_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45")
def src03(t):
    return t("lineitem").where("l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_quantity")


@query("src04_typed_ingest", "SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS INTEGER) AS brand_no, TRY_CAST(p_type AS INTEGER) AS type_no FROM part")
def src04(t):
    df = t("part").select("p_partkey", F.substring("p_brand", 7, 99).alias("brand_no"), F.col("p_type").alias("type_no"))
    return sources.typed(df, {"brand_no": "int", "type_no": "int"})


@query("src07_seed_lookup", "SELECT event_type, weight, count(*) AS n FROM events JOIN (VALUES ('error', 3), ('click', 1)) AS s(kind, weight) ON event_type = kind GROUP BY ALL")
def src07(t):
    e = t("events")
    seed = e.sparkSession.createDataFrame([("error", 3), ("click", 1)], "event_type string, weight int")
    return e.join(F.broadcast(seed), "event_type").groupBy("event_type", "weight").agg(F.count(F.lit(1)).alias("n"))


@query("src09_json_map", "SELECT event_id, unnest(json_keys(props)) AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events")
def src09(t):
    return sources.explode_map(t("events").select("event_id", "props"), "props", "bigint").select("event_id", "key", "value")


@query(
    "src11_links",
    """WITH h AS (SELECT page_id, rtrim(regexp_extract(url, '^https?://[^/]+'), '/') AS base, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages),
    u AS (SELECT page_id, base, unnest(l) AS href, unnest(range(0, len(l)))::INTEGER AS position FROM h),
    v AS (SELECT page_id, position, CASE WHEN href LIKE '/%' THEN base || href ELSE href END AS link FROM u)
    SELECT page_id, min(position) AS position, link FROM v GROUP BY page_id, link""",
)
def src11(t):
    return sources.extract_links(t("pages"), "page_id", "html", F.regexp_extract("url", "^https?://[^/]+", 0))


@query("src12_unpivot", "SELECT * FROM (SELECT s_suppkey, 'balance' AS field, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier) WHERE value > 0")
def src12(t):
    df = t("supplier").select("s_suppkey", c("s_acctbal").alias("balance"), c("s_nationkey").cast("double").alias("nation"))
    return df.unpivot("s_suppkey", ["balance", "nation"], "field", "value").where("value > 0")


@query("src13_yearly_series", "SELECT year(o_orderdate)::INTEGER AS y, round(avg(o_totalprice), 4) AS level, round(stddev_samp(o_totalprice), 4) AS volatility FROM orders GROUP BY 1")
def src13(t):
    df = t("orders").select(F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("string").try_cast("double").alias("v"))
    return df.groupBy("y").agg(F.round(F.avg("v"), 4).alias("level"), F.round(F.stddev_samp("v"), 4).alias("volatility"))


@query("src14_row_acceptance", "SELECT doc_id FROM documents WHERE TRY_CAST(substr(CAST(n_chars AS VARCHAR), 1, 4) AS INTEGER) BETWEEN 1990 AND 2030 AND trim(text) <> ''")
def src14(t):
    y = F.substring(c("n_chars").cast("string"), 1, 4).try_cast("int")
    return t("documents").where(y.between(1990, 2030) & (F.trim("text") != "")).select("doc_id")


@query("prj01_exclude", "SELECT * EXCLUDE (s_name) FROM supplier")
def prj01(t):
    return t("supplier").drop("s_name")


@query("prj02_rename", "SELECT c_custkey AS entity, c_acctbal AS x1, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS label FROM customer")
def prj02(t):
    df = t("customer").withColumnsRenamed({"c_custkey": "entity", "c_acctbal": "x1"})
    return df.select("entity", "x1", F.when(c("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("label"))


@query("prj03_aliases", "SELECT s_suppkey, coalesce(nullif(s_acctbal, 0), CAST(s_nationkey AS DOUBLE)) AS balance FROM supplier")
def prj03(t):
    df = t("supplier").select("s_suppkey", F.nullif("s_acctbal", F.lit(0.0)).alias("acctbal"), c("s_nationkey").cast("double").alias("fallback"))
    return frames.resolve_aliases(df, {"balance": ["balance_usd", "acctbal", "fallback"]}).select("s_suppkey", "balance")


@query("prj04_double_entry", "SELECT entity, coalesce(CASE WHEN entity % 2 = 0 THEN current_assets END, current_assets - current_liabilities) AS wc FROM sheet")
def prj04(t):
    df = sheet(t).withColumn("known", F.when(c("entity") % 2 == 0, c("current_assets")))
    return df.select("entity", F.coalesce("known", c("current_assets") - c("current_liabilities")).alias("wc"))


@query("prj05_defaults", "SELECT r_regionkey, r_name, 0.2::DOUBLE AS sigma FROM region")
def prj05(t):
    return frames.with_defaults(t("region").select("r_regionkey", "r_name"), {"r_name": "?", "sigma": 0.2})


@query("prj06_screening", "SELECT unnest(['c_nationkey', 'c_acctbal']) AS feature, (SELECT count(*) FROM customer) AS n")
def prj06(t):
    df = t("customer")
    kept = frames.screen_features(df, ["c_custkey"], ["^target_"])
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*map(F.lit, kept))).alias("feature"), "n")


@query("prj07_one_hot", "SELECT o_orderkey, (o_orderstatus = 'O')::INTEGER AS o_orderstatus_O, (o_orderstatus = 'P')::INTEGER AS o_orderstatus_P FROM orders")
def prj07(t):
    return frames.one_hot(t("orders"), "o_orderstatus", ["O", "F", "P"]).select("o_orderkey", "o_orderstatus_O", "o_orderstatus_P")


@query("prj09_pillars", "SELECT event_type, CASE event_type WHEN 'error' THEN 'risk' WHEN 'purchase' THEN 'revenue' ELSE 'activity' END AS pillar, count(*) AS n FROM events GROUP BY ALL")
def prj09(t):
    m = F.create_map(*[F.lit(x) for x in ("error", "risk", "purchase", "revenue")])
    return t("events").groupBy("event_type", F.coalesce(m[c("event_type")], F.lit("activity")).alias("pillar")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj10_sic_division",
    """SELECT p_partkey, CASE WHEN p_partkey BETWEEN 100 AND 999 THEN 'Agriculture' WHEN p_partkey BETWEEN 1000 AND 1499 THEN 'Mining' WHEN p_partkey BETWEEN 1500 AND 1799 THEN 'Construction'
    WHEN p_partkey BETWEEN 2000 AND 3999 THEN 'Manufacturing' WHEN p_partkey BETWEEN 4000 AND 4999 THEN 'Transport and utilities' WHEN p_partkey BETWEEN 5000 AND 5199 THEN 'Wholesale'
    WHEN p_partkey BETWEEN 5200 AND 5999 THEN 'Retail' WHEN p_partkey BETWEEN 6000 AND 6799 THEN 'Finance' WHEN p_partkey BETWEEN 7000 AND 8999 THEN 'Services'
    WHEN p_partkey BETWEEN 9100 AND 9729 THEN 'Public administration' ELSE 'Other' END AS division FROM part""",
)
def prj10(t):
    return t("part").select("p_partkey", fx.sic_division("p_partkey").alias("division"))


@query("prj11_title_summary", "SELECT doc_id, CASE WHEN trim(source) = '' OR lower(trim(source)) = 'nan' OR lower(trim(source)) = lower(trim(lang)) THEN trim(lang) ELSE trim(lang) || '. ' || trim(source) END AS joined FROM documents")
def prj11(t):
    return t("documents").select("doc_id", fx.title_and_summary("lang", "source").alias("joined"))


@query("prj12_name_ticker", "SELECT s_suppkey, CASE WHEN length(regexp_replace(split_part(trim(s_name), ' ', 1), '[^A-Za-z]', '', 'g')) >= 2 THEN upper(regexp_replace(split_part(trim(s_name), ' ', 1), '[^A-Za-z]', '', 'g')) END AS ticker FROM supplier")
def prj12(t):
    return t("supplier").select("s_suppkey", fx.name_ticker("s_name").alias("ticker"))


@query("flt01_whitelist", "SELECT id, form FROM filings WHERE form IN ('1-URGENT', '2-HIGH') AND amount IS NOT NULL")
def flt01(t):
    return filings(t).where(c("form").isin("1-URGENT", "2-HIGH") & c("amount").isNotNull()).select("id", "form")


@query("flt02_date_sanity", "SELECT id, lag FROM lagged WHERE filed >= period")
def flt02(t):
    return lagged(t).where("filed >= period").select("id", "lag")


@query("flt03_phrases", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%licensed under%' OR lower(text) LIKE '%copyright%' OR lower(text) LIKE '%idiot%'")
def flt03(t):
    return t("documents").where(fx.phrase_any("text", ["licensed under", "copyright", "idiot"])).select("doc_id")


@query("flt04_suffix", "SELECT doc_id, regexp_replace(source, '9$', '') AS stem FROM documents WHERE source LIKE '%9' AND length(source) >= 4")
def flt04(t):
    return t("documents").where(c("source").endswith("9") & (F.length("source") >= 4)).select("doc_id", F.regexp_replace("source", "9$", "").alias("stem"))


@query("flt05_id_whitelist", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def flt05(t):
    return t("customer").join(F.broadcast(t("nation").where("n_regionkey = 1")), c("c_nationkey") == c("n_nationkey"), "left_semi").select("c_custkey")


@query("flt06_valid_ticker", "SELECT doc_id FROM documents WHERE regexp_full_match(source, '[A-Za-z0-9.-]+') AND length(source) <= 4")
def flt06(t):
    return t("documents").where(fx.valid_ticker("source", 4)).select("doc_id")


@query("flt07_null_year", "SELECT id FROM filings WHERE nullif(year(filed), 1997) >= 1999 OR nullif(year(filed), 1997) IS NULL")
def flt07(t):
    y = F.nullif(F.year("filed"), F.lit(1997))
    return filings(t).where((y >= 1999) | y.isNull()).select("id")


@query("flt08_lag_range", "SELECT id, lag FROM lagged WHERE lag BETWEEN 0 AND 180")
def flt08(t):
    return lagged(t).where(c("lag").between(0, 180)).select("id", "lag")


@query("flt09_cohorts", "SELECT cohort, count(*) AS n, sum(y)::BIGINT AS positives FROM (SELECT y, unnest(['all', CASE WHEN event_id % 3 = 0 THEN 'flagged' ELSE 'clean' END]) AS cohort FROM scored) GROUP BY cohort")
def flt09(t):
    tags = F.array(F.lit("all"), F.when(c("event_id") % 3 == 0, "flagged").otherwise("clean"))
    return scored(t).select("y", F.explode(tags).alias("cohort")).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


@query("flt10_out_of_time", "SELECT CASE WHEN year(filed) <= 1998 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM filings GROUP BY 1")
def flt10(t):
    return filings(t).groupBy(F.when(F.year("filed") <= 1998, "train").otherwise("test").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("jn01_header_facts", "SELECT o_orderkey, l_linenumber, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def jn01(t):
    return t("orders").where("o_orderstatus = 'F'").join(t("lineitem"), c("o_orderkey") == c("l_orderkey")).select("o_orderkey", "l_linenumber", "o_custkey")


@query("jn02_three_way", "SELECT o_orderkey, l_linenumber, s_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderpriority = '1-URGENT'")
def jn02(t):
    j = t("orders").where("o_orderpriority = '1-URGENT'").join(t("lineitem"), c("o_orderkey") == c("l_orderkey"))
    return j.join(t("supplier"), c("s_suppkey") == c("l_suppkey")).select("o_orderkey", "l_linenumber", "s_name")


@query("jn03_left_defaults", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def jn03(t):
    n = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t("customer").join(n, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "jn04_closed_month",
    """WITH m AS (SELECT entity, date_trunc('month', filed)::DATE AS month, count(*) AS filed_n FROM filings GROUP BY ALL)
    SELECT f.id, strftime(date_trunc('month', f.filed - INTERVAL 1 MONTH), '%Y-%m-%d') AS month, filed_n
    FROM filings f LEFT JOIN m ON f.entity = m.entity AND m.month = date_trunc('month', f.filed - INTERVAL 1 MONTH)::DATE""",
)
def jn04(t):
    f = filings(t)
    m = f.groupBy("entity", F.trunc("filed", "MM").alias("month")).agg(F.count(F.lit(1)).alias("filed_n"))
    return timejoin.closed_month_join(f, m, "entity", "filed", "month").select("id", day_text("month").alias("month"), "filed_n")


@query("jn05_asof", "SELECT f.id, q.price, strftime(q.day, '%Y-%m-%d') AS day FROM (SELECT id, entity % 100 + 1 AS ticker, filed FROM filings) f ASOF LEFT JOIN quotes q ON f.ticker = q.ticker AND q.day <= f.filed")
def jn05(t):
    left = filings(t).select("id", (c("entity") % 100 + 1).alias("ticker"), "filed")
    return timejoin.asof_join(left, quotes(t), "ticker", "filed", "day", ["price"]).select("id", "price", day_text("asof_day").alias("day"))


@query("jn06_map_join", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def jn06(t):
    return t("supplier").join(F.broadcast(t("nation")), c("s_nationkey") == c("n_nationkey")).join(F.broadcast(t("region")), c("n_regionkey") == c("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("jn07_text_key", "SELECT count(*) AS n, sum(quality)::BIGINT AS q FROM documents d LEFT JOIN labels l ON upper(trim(CAST(d.doc_id AS VARCHAR))) = upper(trim(CAST(l.doc_id AS VARCHAR)))")
def jn07(t):
    key = lambda x: F.upper(F.trim(x.cast("string")))
    d = t("documents").select(key(c("doc_id")).alias("k"))
    return d.join(t("labels").select(key(c("doc_id")).alias("k"), "quality"), "k", "left").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("q"))


_NEWS = "WITH n AS (SELECT user_id, CAST(ts AS DATE) AS day, value FROM events), cal AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS period FROM n GROUP BY user_id)"


def _news(t):
    n = t("events").select("user_id", F.to_date("ts").alias("day"), "value")
    return n, timejoin.densify(n, "user_id", "day", "1 day")


@query("jn08_band", _NEWS + " SELECT cal.user_id, strftime(cal.period, '%Y-%m-%d') AS period, count(n.day) AS hits FROM cal LEFT JOIN n ON n.user_id = cal.user_id AND n.day BETWEEN cal.period - 7 AND cal.period GROUP BY ALL")
def jn08(t):
    n, cal = _news(t)
    got = timejoin.band_join_agg(cal, n, "user_id", "period", "day", 7, [F.count(F.lit(1)).alias("hits")])
    return got.select("user_id", day_text("period").alias("period"), F.coalesce("hits", F.lit(0)).alias("hits"))


@query("jn09_densify", _NEWS + " SELECT user_id, count(*) AS days FROM cal GROUP BY user_id")
def jn09(t):
    return _news(t)[1].groupBy("user_id").agg(F.count(F.lit(1)).alias("days"))


@query("jn10_one_row", "SELECT p_partkey, round(p_retailprice - (SELECT avg(p_retailprice) FROM part), 4) AS gap FROM part")
def jn10(t):
    p = t("part")
    return p.crossJoin(F.broadcast(p.agg(F.avg("p_retailprice").alias("m")))).select("p_partkey", F.round(c("p_retailprice") - c("m"), 4).alias("gap"))


@query("jn11_future_exists", "SELECT id, (EXISTS (SELECT 1 FROM filings g WHERE g.entity = f.entity AND g.status = 'P' AND g.filed > f.filed AND g.filed <= f.filed + INTERVAL 12 MONTH))::INTEGER AS label FROM filings f")
def jn11(t):
    f = filings(t).withColumn("flag", (c("status") == "P").cast("int"))
    return timejoin.forward_label(f, "entity", "filed", "flag", 12, terminal=False).select("id", "label")


@query("jn12_month_key", "SELECT ym, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS ym FROM orders) JOIN (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS ym FROM lineitem) USING (ym) GROUP BY ym")
def jn12(t):
    months = t("lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("ym")).distinct()
    return t("orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("ym")).join(months, "ym").groupBy("ym").agg(F.count(F.lit(1)).alias("n"))


@query("jn13_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jn13(t):
    return t("customer").join(t("orders"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("jn14_semi", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def jn14(t):
    return t("supplier").join(t("lineitem").where("l_quantity > 49"), c("s_suppkey") == c("l_suppkey"), "left_semi").select("s_suppkey")


@query("jn15_full_outer", "SELECT coalesce(a.y, b.y)::INTEGER AS y, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines FROM (SELECT year(o_orderdate) AS y, count(*) AS orders FROM orders GROUP BY 1) a FULL JOIN (SELECT year(l_shipdate) AS y, count(*) AS lines FROM lineitem GROUP BY 1) b ON a.y = b.y")
def jn15(t):
    a = t("orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("orders"))
    b = t("lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(F.count(F.lit(1)).alias("lines"))
    return a.join(b, "y", "full").fillna(0)


@query("jn16_spine_fill", "SELECT y::INTEGER AS y, coalesce(n, CASE WHEN y < 1995 THEN -1 ELSE 0 END) AS n FROM (SELECT unnest(range(1992, 2004)) AS y) LEFT JOIN (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) USING (y)")
def jn16(t):
    o = t("orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    spine = o.sparkSession.range(1992, 2004).select(c("id").cast("int").alias("y"))
    return spine.join(o, "y", "left").select("y", F.coalesce("n", F.when(c("y") < 1995, -1).otherwise(0)).cast("long").alias("n"))


@query("jn19_priority_lookup", "WITH q AS (SELECT n_nationkey AS q, n_name AS name FROM nation), m AS (SELECT q, s_suppkey, 1 AS priority FROM q JOIN supplier ON s_suppkey = q UNION ALL SELECT q, s_suppkey, 2 FROM q JOIN supplier ON s_nationkey = q) SELECT q, arg_min(s_suppkey, priority * 1000000 + s_suppkey) AS s_suppkey, min(priority)::INTEGER AS priority FROM m GROUP BY q")
def jn19(t):
    q = t("nation").select(c("n_nationkey").alias("q"))
    rules = [(c("q").cast("long"), c("s_suppkey")), (c("q").cast("long"), c("s_nationkey").cast("long"))]
    return frames.lookup_priority(q, t("supplier"), rules, "q", [c("s_suppkey")]).select("q", "s_suppkey", "priority")


@query("jn21_variants", "WITH v AS (SELECT p_partkey, p_partkey * 4 AS variant, 0 AS r FROM part UNION ALL SELECT p_partkey, p_partkey, 1 FROM part), m AS (SELECT p_partkey, o_orderkey, r FROM v JOIN orders ON o_orderkey = variant) SELECT p_partkey, o_orderkey FROM m QUALIFY r = min(r) OVER (PARTITION BY p_partkey)")
def jn21(t):
    return frames.variant_match(t("part").select("p_partkey"), t("orders").select("o_orderkey"), "p_partkey", [c("p_partkey") * 4, c("p_partkey")], "o_orderkey")


@query("st02_top_groups", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def st02(t):
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10)


@query("st03_newest", "SELECT id, strftime(filed, '%Y-%m-%d') AS filed FROM filings ORDER BY filings.filed DESC, id LIMIT 100")
def st03(t):
    return filings(t).orderBy(F.desc("filed"), "id").limit(100).select("id", day_text("filed").alias("filed"))


@query("st04_sample")
def st04(t):
    return frames.sample_rows(t("orders"), "o_orderkey", 500)


@query("st05_arg_max", "SELECT user_id, arg_max(event_id, value * 1e9 - event_id) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def st05(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -c("event_id"))).alias("event_id"), F.max("value").alias("value"))


@query("st06_balanced")
def st06(t):
    return frames.balanced(scored(t), "y", "event_id")


@query("set01_union_tagged", "SELECT c_custkey AS id, c_name AS name, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def set01(t):
    a = t("customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), F.lit("customer").alias("source"))
    return a.unionByName(t("supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"), F.lit("supplier").alias("source")))


@query("set02_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def set02(t):
    return t("lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("set03_key_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set03(t):
    return t("customer").select(c("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("set04_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def set04(t):
    return t("part").select("p_partkey").subtract(t("lineitem").where("l_quantity > 40").select("l_partkey"))


@query("set05_first_occurrence", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def set05(t):
    return frames.first_rows(t("documents"), ["text"], [c("doc_id")]).select("doc_id", "text")


@query("sc01_try_cast", "SELECT event_id, TRY_CAST(event_type AS INTEGER) AS bad, TRY_CAST(CAST(user_id AS VARCHAR) AS INTEGER) AS good FROM events")
def sc01(t):
    return t("events").select("event_id", fx.tried("event_type", "int").alias("bad"), fx.tried(c("user_id").cast("string"), "int").alias("good"))


@query("sc02_formats", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM events")
def sc02(t):
    text = F.when(c("event_id") % 3 == 0, F.date_format("ts", "yyyyMMdd'T'HHmmss")).when(c("event_id") % 3 == 1, F.concat(F.lit("Mon, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parsed = fx.parse_timestamp(text, ["yyyy-MM-dd HH:mm:ss", "dd MMM yyyy HH:mm:ss", "yyyyMMdd'T'HHmmss"])
    return t("events").select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("sc03_dates", "SELECT id, date_diff('day', DATE '1995-01-01', filed)::INTEGER AS days, strftime(last_day(filed), '%Y-%m-%d') AS month_end, strftime(filed - INTERVAL 1 MONTH, '%Y-%m-%d') AS month_before, year(filed)::INTEGER AS y, month(filed)::INTEGER AS m FROM filings")
def sc03(t):
    f = filings(t).withColumns({"month_end": F.last_day("filed"), "month_before": F.add_months("filed", -1)})
    return f.select("id", F.datediff("filed", F.lit("1995-01-01").cast("date")).alias("days"), day_text("month_end").alias("month_end"), day_text("month_before").alias("month_before"), F.year("filed").alias("y"), F.month("filed").alias("m"))


@query("sc06_strings", "SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS padded, upper(trim(s_name)) AS name, length(s_name)::INTEGER AS n FROM supplier")
def sc06(t):
    return t("supplier").select("s_suppkey", F.lpad(c("s_suppkey").cast("string"), 10, "0").alias("padded"), F.upper(F.trim("s_name")).alias("name"), F.length("s_name").alias("n"))


@query("sc08_math", "SELECT event_id, round(ln(value), 6) AS l, round(sqrt(value), 6) AS s, round(greatest(-2.0, least(10.0, value / 10)), 6) AS clipped, round(sign(value - 50) * log10(1 + abs(value - 50)), 6) AS signed FROM events WHERE value > 0")
def sc08(t):
    v = c("value")
    return t("events").where("value > 0").select("event_id", F.round(F.ln(v), 6).alias("l"), F.round(F.sqrt(v), 6).alias("s"), F.round(fx.clip(v / 10, -2, 10), 6).alias("clipped"), F.round(F.signum(v - 50) * F.log10(1 + F.abs(v - 50)), 6).alias("signed"))


@query("sc10_integer_division", "SELECT p_partkey, p_partkey // 100 AS group_no FROM part")
def sc10(t):
    return t("part").selectExpr("p_partkey", "p_partkey div 100 AS group_no")


@query("sc11_logistic", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 20)), 8) AS p, round(greatest((value - 50) / 20, 0) + ln(1 + exp(-abs((value - 50) / 20))), 8) AS sp FROM events")
def sc11(t):
    z = (c("value") - 50) / 20
    return t("events").select("event_id", F.round(fx.logistic(z), 8).alias("p"), F.round(fx.softplus(z), 8).alias("sp"))


@query("sc12_normal_cdf", "WITH z AS (SELECT event_id, (value - 50) / 20 AS z FROM events), q AS (SELECT event_id, z, ((SELECT sum(exp(-power(abs(z) + (k + 0.5) * 0.002, 2) / 2)) FROM range(0, 4500) steps(k)) * 0.002 + 0.002 * 0.002 / 24 * abs(z) * exp(-z * z / 2)) / 2.5066282746310002 AS q FROM z) SELECT event_id, round(CASE WHEN z >= 0 THEN 1 - q ELSE q END, 8) AS p FROM q")
def sc12(t):
    return t("events").select("event_id", F.round(fx.normal_cdf((c("value") - 50) / 20), 8).alias("p"))


@query("sc15_text_length", r"SELECT doc_id, length(text)::INTEGER AS chars, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END::INTEGER AS words FROM documents")
def sc15(t):
    return t("documents").select("doc_id", F.length("text").alias("chars"), fx.word_count("text").alias("words"))


@query("sc16_inflation", "SELECT p_partkey, round(CASE WHEN p_size <= 25 THEN 236.468 * (1 + p_size / 100.0) ELSE p_size END, 6)::DOUBLE AS base, round(p_size * 15.0 + 200, 6)::DOUBLE AS linear FROM part")
def sc16(t):
    return t("part").select("p_partkey", F.round(fx.inflation_level("p_size", "base"), 6).alias("base"), F.round(fx.inflation_level("p_size", "linear"), 6).alias("linear"))
