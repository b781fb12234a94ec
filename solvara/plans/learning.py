"""Queries of learned models over purged folds, and of attributions of their trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvara.operators import articles, events, explain, folds, models, scoring, sentiment, tables
from solvara.plans.modelling import FEATURES, _fold, _matrix
from solvara.plans.registry import filings, query, rounded, scored, sheet

c = F.col

#: Two trees over the balance sheet: id to (value, feature, threshold, left, right).
TREES = (
    {0: (0.0, "equity", 40000.0, 1, 4), 1: (0.0, "cash", 100000.0, 2, 3), 2: (-1.0, "", 0.0, -1, -1), 3: (0.5, "", 0.0, -1, -1), 4: (0.0, "cash", 200000.0, 5, 6), 5: (0.25, "", 0.0, -1, -1), 6: (2.0, "", 0.0, -1, -1)},
    {0: (0.0, "total_assets", 500000.0, 1, 2), 1: (0.75, "", 0.0, -1, -1), 2: (-0.5, "", 0.0, -1, -1)},
)

#: The same by the definition: means over both orders of knowing equity and cash.
_TREES_SQL = """WITH s AS (SELECT entity, equity <= 40000 AS e, cash <= 100000 AS c1, cash <= 200000 AS c2, total_assets <= 500000 AS t FROM sheet),
n AS (SELECT avg(e::INTEGER) AS pe, avg(CASE WHEN e THEN c1::INTEGER END) AS p1, avg(CASE WHEN NOT e THEN c2::INTEGER END) AS p2, avg(t::INTEGER) AS pt FROM s),
v AS (SELECT entity, pe, t, 0.75 * pt - 0.5 * (1 - pt) AS bt, CASE WHEN t THEN 0.75 ELSE -0.5 END AS ft,
  -p1 + 0.5 * (1 - p1) AS left_mean, 0.25 * p2 + 2.0 * (1 - p2) AS right_mean, CASE WHEN c1 THEN -1.0 ELSE 0.5 END AS left_known, CASE WHEN c2 THEN 0.25 ELSE 2.0 END AS right_known, e FROM s, n),
g AS (SELECT entity, ft, bt, pe * left_mean + (1 - pe) * right_mean AS nothing, CASE WHEN e THEN left_mean ELSE right_mean END AS only_e, pe * left_known + (1 - pe) * right_known AS only_c, CASE WHEN e THEN left_known ELSE right_known END AS full_value FROM v),
p AS (SELECT entity, nothing + bt AS base, full_value + ft AS margin, 'equity' AS feature, ((only_e - nothing) + (full_value - only_c)) / 2 AS phi FROM g
  UNION ALL SELECT entity, nothing + bt, full_value + ft, 'cash', ((only_c - nothing) + (full_value - only_e)) / 2 FROM g UNION ALL SELECT entity, nothing + bt, full_value + ft, 'total_assets', ft - bt FROM g)"""


def _given(t):
    s = sheet(t)
    return explain.tree_attributions(s, "entity", explain.with_covers(s, ["equity", "cash", "total_assets"], TREES))


@query("xai01_given_trees", _TREES_SQL + " SELECT entity, round(base, 8)::DOUBLE AS base, round(margin, 8)::DOUBLE AS margin, feature, round(phi, 8)::DOUBLE AS phi FROM p")
def xai01_given(t):
    return rounded(_given(t), 8, "base", "margin", "phi")


@query("xai02_tree_importance", _TREES_SQL + ", a AS (SELECT feature, avg(abs(phi)) AS v FROM p GROUP BY 1) SELECT feature, CASE feature WHEN 'equity' THEN 'capital' WHEN 'cash' THEN 'liquidity' ELSE 'size' END AS pillar, round(v / sum(v) OVER (), 8)::DOUBLE AS share FROM a")
def xai02_trees(t):
    return rounded(scoring.global_importance(_given(t), {"equity": "capital", "total_assets": "size", "cash": "liquidity"}), 8, "share")


@query("xai03_tree_drivers", _TREES_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY abs(round(phi, 10)) DESC, feature) AS rank FROM p) SELECT entity, feature, round(phi, 8)::DOUBLE AS phi, rank::INTEGER AS rank, CASE WHEN phi > 0 THEN 'raises' ELSE 'lowers' END AS direction FROM r WHERE rank <= 2")
def xai03_trees(t):
    phi = _given(t).select("entity", "feature", F.round("phi", 10).alias("phi"))
    return rounded(scoring.top_drivers(phi, "entity", 2), 8, "phi")


def _fitted_trees(kind):
    def run(t):
        train, _ = _fold(_matrix(t))
        fitted = models.fit_classifier(models.balanced_weight(train, "y"), FEATURES, "y", kind, "weight")
        trees = explain.ensemble_of(fitted, FEATURES, train.sparkSession)
        rows = explain.tree_attributions(_matrix(t), "vec_id", trees)
        return rows.select("vec_id", "base", "margin", "feature", "phi")

    return run


query("xai01_trees")(_fitted_trees("boosted"))
query("xai01_forest")(_fitted_trees("forest"))


# ---------------------------------------------------------------- purged folds with separated entities

#: Filings of customers; positives are the orders of the two most urgent kinds.
_FILED = "y AS (SELECT id, entity, filed, amount, CASE WHEN form IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS y FROM filings)"


def _filed(t):
    f = filings(t).withColumn("y", c("form").isin("1-URGENT", "2-HIGH").cast("int"))
    return f.select("id", "entity", "filed", "amount", "y")


@query("cv01_entity_parts", f"""WITH {_FILED}, e AS (SELECT entity, count(*) AS n, sum(y)::BIGINT AS p FROM y GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p DESC, n DESC, entity) - 1 AS k FROM e)
SELECT entity, (1 + CASE WHEN (k // 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END)::INTEGER AS part, n AS rows, p AS positives FROM r""")
def cv01_parts(t):
    return folds.entity_parts(_filed(t), "entity", "y", 5)


@query("cv01_grouped_folds", f"""WITH {_FILED}, e AS (SELECT entity, count(*) AS n, sum(y) AS p FROM y GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p DESC, n DESC, entity) - 1 AS k FROM e),
g AS (SELECT entity, 1 + CASE WHEN (k // 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END AS part FROM r),
d AS (SELECT DISTINCT filed FROM y), k AS (SELECT filed, ntile(6) OVER (ORDER BY filed) AS chunk FROM d), h AS (SELECT chunk, min(filed) AS lo, max(filed) AS hi FROM k GROUP BY 1),
f AS (SELECT a.chunk AS fold, a.hi AS train_end, greatest(b.lo, (a.hi + 366)::DATE) AS valid_start, b.hi AS valid_end FROM h a JOIN h b ON b.chunk = a.chunk + 1 WHERE greatest(b.lo, (a.hi + 366)::DATE) <= b.hi),
s AS (SELECT fold, entity, filed, y, CASE WHEN part <> fold AND filed <= train_end THEN 'train' WHEN part = fold AND filed BETWEEN valid_start AND valid_end THEN 'valid' END AS role FROM y JOIN g USING (entity), f)
SELECT fold::INTEGER AS fold, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'train' AND y = 1) AS train_positives, count(*) FILTER (role = 'valid') AS valid_rows, count(*) FILTER (role = 'valid' AND y = 1) AS valid_positives,
  date_diff('day', max(filed) FILTER (role = 'train'), min(filed) FILTER (role = 'valid'))::INTEGER AS gap_days, 0::BIGINT AS shared_entities FROM s WHERE role IS NOT NULL GROUP BY 1""")
def cv01_grouped(t):
    rows, _ = folds.grouped_folds(_filed(t), "filed", "entity", "y")
    return folds.fold_summary(rows, "filed", "entity", "y")


@query("cv03_search")
def cv03(t):
    """All trials of a search over purged folds with separated customers, by business cost at each fold's own threshold."""
    buyers = t("customer").select(c("c_custkey").alias("entity"), "c_acctbal", "c_nationkey")
    rows = _filed(t).join(buyers, "entity").withColumns({"size": F.log("amount"), "month": F.month("filed").cast("double")})
    dealt, _ = folds.grouped_folds(rows, "filed", "entity", "y")
    trials = folds.drawn_trials({"l2": [0.001, 0.1], "positive_weight": [1.0, 5.0, 24.0], "rate": [0.03, 0.1]}, 8)
    return folds.search_folds(dealt, ["size", "c_acctbal", "c_nationkey", "month"], "y", trials, (4, 8, 16))


# ---------------------------------------------------------------- articles

_KIND = "CASE {k} % 4 WHEN 0 THEN strftime({d}, '%Y-%m-%d') WHEN 1 THEN strftime({d}, '%Y%m%dT%H%M%S') WHEN 2 THEN strftime({d}, '%a, %d %b %Y %H:%M:%S GMT') ELSE 'soon' END"


def _time_text(key, day):
    text = F.when(key % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 4 == 1, F.date_format(day, "yyyyMMdd'T'HHmmss"))
    return text.when(key % 4 == 2, F.concat(F.date_format(day, "EEE"), F.lit(", "), F.date_format(day, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise(F.lit("soon"))


def _articles(t):
    """Orders as an old source (1992 to 2022), events as a recent one (2024); some times can't be read."""
    o = t("orders").withColumn("day", F.add_months(c("o_orderdate"), (c("o_orderkey") % 3 * 144).cast("int")).cast("timestamp"))
    old = o.select(F.concat(F.lit(" c"), c("o_custkey") % 40).alias("symbol"), F.concat(c("o_orderpriority"), F.lit(" "), c("o_orderkey") % 9).alias("headline"), _time_text(c("o_orderkey"), c("day")).alias("date"), c("o_orderstatus").alias("publisher"))
    e = t("events").select(F.concat(F.lit("C"), c("user_id") % 40).alias("ticker"), F.concat(F.initcap("event_type"), F.lit(" ")).alias("title"), _time_text(c("event_id"), c("ts")).alias("time_published"), c("props").alias("summary"), c("event_id").cast("string").alias("url"))
    return (
        articles.aligned(old, "old", {"ticker": "symbol", "title": "headline", "time_published": "date", "authors": "publisher"}, (1999, 2020)),
        articles.aligned(e, "recent", {x: x for x in ("ticker", "title", "time_published", "summary", "url")}, (2021, None), keep_undated=True),
    )


_ARTICLES_SQL = f"""WITH o AS (SELECT *, (o_orderdate + to_months((o_orderkey % 3 * 144)::INTEGER))::TIMESTAMP AS day FROM orders),
h AS (SELECT upper('c' || o_custkey % 40) AS ticker, NULL::VARCHAR AS company_name, o_orderpriority || ' ' || o_orderkey % 9 AS title, NULL::VARCHAR AS url, {_KIND.format(k='o_orderkey', d='day')} AS time_published, CASE WHEN o_orderkey % 4 < 3 THEN year(day) END::INTEGER AS pub_year, o_orderstatus AS authors, o_orderpriority || ' ' || o_orderkey % 9 AS summary, 'old' AS source_dataset FROM o),
r AS (SELECT 'C' || user_id % 40 AS ticker, NULL::VARCHAR AS company_name, upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS title, event_id::VARCHAR AS url, {_KIND.format(k='event_id', d='ts')} AS time_published, CASE WHEN event_id % 4 < 3 THEN year(ts) END::INTEGER AS pub_year, NULL::VARCHAR AS authors, props AS summary, 'recent' AS source_dataset FROM events),
a AS (SELECT * FROM h WHERE pub_year BETWEEN 1999 AND 2020 UNION ALL SELECT * FROM r WHERE pub_year >= 2021 OR pub_year IS NULL)
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY ticker, lower(title), pub_year ORDER BY time_published DESC, source_dataset DESC, title DESC, url DESC NULLS LAST, authors DESC NULLS LAST) = 1"""


@query("nlp01_consolidated", _ARTICLES_SQL)
def nlp01(t):
    return articles.consolidated(_articles(t))


@query("nlp01_merged_loads", _ARTICLES_SQL)
def nlp01_merged(t):
    """The same table from three loads one after the other, the second of them twice."""
    from solvara.sources import shared_path

    old, recent = _articles(t)
    spark, path = old.sparkSession, shared_path(old.sparkSession, "articles")
    early = F.coalesce(c("pub_year"), F.lit(0)) <= 2010
    for load in (old.where(early), old.where(~early), old.where(~early), recent):
        articles.merge_articles(spark, path, load)
    return spark.read.parquet(path).drop("bucket")


# ---------------------------------------------------------------- sentiment


@query("nlp04_learned_sentiment")
def nlp04_learned(t):
    """A scorer learned from the lexicon's decisions on three quarters of the news, applied to all of it."""
    from solvara.plans.domain import _BAD, _GOOD, _news

    news = _news(t)
    decided = events.sentiment_shares(news, "text", _GOOD, _BAD).withColumn("y", (F.signum("index") + 1).cast("int"))
    scorer = sentiment.fit_scorer(decided.where("doc_id % 4 <> 2"), "text", "y")
    return sentiment.score_text(news, "text", lambda: scorer).select("doc_id", "positive", "negative", "neutral", "index")


# ---------------------------------------------------------------- freshest record of several sources

_LIVES = {"assets": (90, 0.0), "balance": (1500, -1.0)}
_FRESH = """WITH l AS (SELECT o_custkey AS k, l_shipdate::DATE AS d, l_extendedprice AS assets, CASE WHEN l_returnflag = 'R' THEN l_quantity END AS balance FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT o_custkey AS k, 'filing' AS source, o_orderdate::DATE AS d, 'assets' AS field, o_totalprice AS v FROM orders UNION ALL SELECT k, 'market', d, 'assets', assets FROM l UNION ALL SELECT k, 'market', d, 'balance', balance FROM l
  UNION ALL SELECT c_custkey, 'register', DATE '1995-06-01', 'balance', c_acctbal FROM customer),
n AS (SELECT max(d) AS now FROM r), f AS (SELECT * FROM r, n WHERE v IS NOT NULL AND now - d BETWEEN 0 AND CASE field WHEN 'assets' THEN 90 ELSE 1500 END),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k, field ORDER BY d DESC, source DESC, v DESC) = 1),
a AS (SELECT * FROM (SELECT DISTINCT k FROM r), (VALUES ('assets', 0.0), ('balance', -1.0)) AS x(field, other))
SELECT a.k AS entity, a.field, coalesce(v, other)::DOUBLE AS value, strftime(d, '%Y-%m-%d') AS at, source FROM a LEFT JOIN b ON a.k = b.k AND a.field = b.field"""


def _sources(t):
    l = t("lineitem").join(t("orders"), c("l_orderkey") == c("o_orderkey")).select(c("o_custkey").alias("entity"), F.to_date("l_shipdate").alias("day"), c("l_extendedprice").alias("assets"), F.when(c("l_returnflag") == "R", c("l_quantity")).alias("balance"))
    o = t("orders").select(c("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day"), c("o_totalprice").alias("assets"))
    r = t("customer").select(c("c_custkey").alias("entity"), F.lit("1995-06-01").cast("date").alias("day"), c("c_acctbal").alias("balance"))
    return scoring.field_values({"filing": o, "market": l, "register": r}, "entity", "day", _LIVES)


@query("scr07_freshest_sources", _FRESH)
def scr07_sources(t):
    rows = _sources(t)
    found = scoring.freshest_fields(rows, "entity", "day", _LIVES, rows.agg(F.max("day")).first()[0])
    return found.select("entity", "field", "value", F.date_format("at", "yyyy-MM-dd").alias("at"), "source")


@query("stm03_freshest_fields", _FRESH[: _FRESH.index(",\na AS")] + " SELECT k AS entity, field, strftime(d, '%Y-%m-%d') AS at, source, v::DOUBLE AS value FROM b")
def stm03_fields(t):
    """The same sources landed as files and read as a stream, with a state for each customer and field."""
    from solvara import sources, streaming

    rows = _sources(t)
    path = sources.shared_path(rows.sparkSession, "fields")
    rows.write.parquet(path)
    found = streaming.freshest_fields_stream(rows.sparkSession, path, "entity", "day", {f: days for f, (days, _) in _LIVES.items()})
    return found.select("entity", "field", F.date_format("at", "yyyy-MM-dd").alias("at"), "source", "value")


# ---------------------------------------------------------------- metric tables


def _table_sql(rows: str, by: str) -> str:
    """The table by its definition over ``rows``, a query that gives (<by>, s, y)."""
    return f"""WITH k AS ({rows}), c AS (SELECT {by}, s, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM k GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {by}) AS p, sum(neg) OVER (PARTITION BY {by}) AS n FROM c WINDOW w AS (PARTITION BY {by} ORDER BY s DESC)),
m AS (SELECT {by}, any_value(p) AS p, any_value(n) AS n, sum(neg * (tp - pos / 2)) / any_value(p * n) AS roc_auc, sum(pos / p * (tp / (tp + fp) + CASE WHEN tp + fp > pos + neg THEN (tp - pos) / (tp + fp - pos - neg) ELSE 1 END) / 2) AS pr_auc,
  sum(pos / p * tp / (tp + fp)) AS average_precision, sum(pos * (1 - s) * (1 - s) + neg * s * s) / any_value(p + n) AS brier FROM r GROUP BY {by}),
g AS (SELECT {by}, g, sum(CASE WHEN round(s * 100) >= g THEN pos ELSE 0 END) AS tp, sum(CASE WHEN round(s * 100) >= g THEN neg ELSE 0 END) AS fp FROM c, range(1, 100) AS t(g) GROUP BY ALL),
o AS (SELECT g.*, p, n, (p - tp) * 6e6 + fp * 250e3 AS cost FROM g JOIN m USING ({by})),
b AS (SELECT *, 'optimal' AS rule FROM o QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY cost, g) = 1 UNION ALL SELECT *, 'fixed' FROM o WHERE g = 50),
x AS (SELECT {by}, rule, g / 100.0 AS tau, (p + n)::BIGINT AS rows, p::BIGINT AS positives, roc_auc, pr_auc, average_precision, brier, tp::BIGINT AS tp, fp::BIGINT AS fp, (m.p - tp)::BIGINT AS fn, (m.n - fp)::BIGINT AS tn, coalesce(tp / nullif(m.p, 0), 0) AS recall,
  coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce((m.n - fp) / nullif(m.n, 0), 0) AS specificity, coalesce(2 * tp / nullif(tp + fp + m.p, 0), 0) AS f1, cost, (m.n - fp) * 250e3 + tp * 6e6 - cost AS pnl_full, (m.n - fp) * 250e3 - cost AS pnl_margin
  FROM (SELECT * EXCLUDE (p, n) FROM b) JOIN m USING ({by}))"""


_RATES = ("tau", "roc_auc", "pr_auc", "average_precision", "brier", "recall", "precision", "specificity", "f1")
_ROUNDED = ", ".join(f"round({x}, 8)::DOUBLE AS {x}" for x in _RATES)
_HORIZONS = "SELECT unnest([12, 24])::INTEGER AS horizon, unnest([a, b]) AS s, y FROM scored"
_COHORTS = "SELECT unnest(['all', CASE WHEN event_id % 3 = 0 THEN 'flagged' ELSE 'clean' END]) AS cohort, a AS s, y FROM scored"
_MODELS = "SELECT unnest(['first', 'second']) AS model, (user_id % 5)::INTEGER AS fold, unnest([a, b]) AS s, y FROM scored"


@query("eva11_horizon_table", _table_sql(_HORIZONS, "horizon") + f" SELECT * REPLACE ({_ROUNDED}) FROM x")
def eva11_table(t):
    both = F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), c(s).alias("s")) for h, s in ((12, "a"), (24, "b"))]))
    return rounded(tables.metric_table(scored(t).select(both, "y"), "s", "y", ["horizon"]), 8, *_RATES)


@query("eva12_cohort_table", _table_sql(_COHORTS, "cohort") + f" SELECT * REPLACE ({_ROUNDED}) FROM x")
def eva12_table(t):
    tags = F.explode(F.array(F.lit("all"), F.when(c("event_id") % 3 == 0, "flagged").otherwise("clean")))
    return rounded(tables.metric_table(scored(t).select(tags.alias("cohort"), c("a").alias("s"), "y"), "s", "y", ["cohort"]), 8, *_RATES)


@query("eva10_model_table", _table_sql(_MODELS, "model, fold") + " SELECT model, count(*) AS folds, " + ", ".join(f"round(avg({x}), 6)::DOUBLE AS {x}" for x in (*_RATES, "cost", "pnl_full", "pnl_margin")) + " FROM x WHERE rule = 'optimal' AND positives BETWEEN 1 AND rows - 1 GROUP BY model")
def eva10_table(t):
    both = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), c(s).alias("s")) for m, s in (("first", "a"), ("second", "b"))]))
    rows = scored(t).select("user_id", both, "y").withColumn("fold", (c("user_id") % 5).cast("int"))
    return rounded(tables.fold_table(rows, "s", "y", ["model"], "fold"), 6, *_RATES, "cost", "pnl_full", "pnl_margin")
