"""Evaluation, statistics, drift, risk and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvara.functions import clip
from solvara.operators import finance, metrics, scoring
from solvara.plans.registry import day_text, filings, query, rounded, scored, sheet

c = F.col

#: The upper tail of the standard normal distribution by the midpoint rule.
_TAIL = "(SELECT sum(exp(-power({z} + (k + 0.5) * 0.001, 2) / 2)) * 0.001 / 2.5066282746310002 FROM range(0, 12000) steps(k))"

_CURVE = """WITH n AS (SELECT a AS s, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1),
  r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM n WINDOW w AS (ORDER BY s DESC))"""


def _counts(t):
    return metrics.score_counts(scored(t), "a", "y")


@query("eva01_roc_auc", "SELECT round((SELECT sum(CASE WHEN p.a > q.a THEN p.n * q.n WHEN p.a = q.a THEN p.n * q.n / 2.0 ELSE 0 END) FROM (SELECT a, count(*) AS n FROM scored WHERE y = 1 GROUP BY 1) p, (SELECT a, count(*) AS n FROM scored WHERE y = 0 GROUP BY 1) q) / (sum(y) * sum(1 - y)), 8)::DOUBLE AS roc_auc FROM scored")
def eva01(t):
    return rounded(metrics.roc_auc(_counts(t)), 8, "roc_auc")


@query("eva02_pr_auc", _CURVE + """, k AS (SELECT s, tp / (tp + fp) AS pr, tp / P AS re FROM r),
  l AS (SELECT *, coalesce(lag(pr) OVER (ORDER BY s DESC), 1) AS p0, coalesce(lag(re) OVER (ORDER BY s DESC), 0) AS r0 FROM k)
  SELECT round(sum((re - r0) * (pr + p0) / 2), 8) AS pr_auc, round(sum((re - r0) * pr), 8) AS average_precision FROM l""")
def eva02(t):
    return rounded(metrics.pr_auc(_counts(t)), 8, "pr_auc", "average_precision")


@query("eva04_brier", "SELECT round(avg((y - a) * (y - a)), 8) AS brier FROM scored")
def eva04(t):
    return rounded(metrics.brier(scored(t), "a", "y"), 8, "brier")


@query("eva05_confusion", """WITH k AS (SELECT sum((a >= 0.5 AND y = 1)::INTEGER)::BIGINT AS tp, sum((a >= 0.5 AND y = 0)::INTEGER)::BIGINT AS fp, sum((a < 0.5 AND y = 1)::INTEGER)::BIGINT AS fn, sum((a < 0.5 AND y = 0)::INTEGER)::BIGINT AS tn FROM scored)
  SELECT tp, fp, fn, tn, round(tp / (tp + fn), 8) AS recall, round(tp / (tp + fp), 8) AS precision, round(tn / (tn + fp), 8) AS specificity, round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM k""")
def eva05(t):
    return rounded(metrics.confusion(scored(t), "a", "y", 0.5), 8, "recall", "precision", "specificity", "f1")


_GRID = """WITH g AS (SELECT k, sum((a >= k / 100.0 AND y = 1)::INTEGER)::BIGINT AS tp, sum((a >= k / 100.0 AND y = 0)::INTEGER)::BIGINT AS fp, sum((a < k / 100.0 AND y = 1)::INTEGER)::BIGINT AS fn FROM scored, range(1, 100) x(k) GROUP BY k)"""


@query("eva06_f2_threshold", _GRID + ", v AS (SELECT *, 5.0 * tp / nullif(5.0 * tp + 4.0 * fn + fp, 0) AS value FROM g) SELECT (k / 100.0)::DOUBLE AS tau, round(value, 8)::DOUBLE AS value, tp, fp, fn FROM v ORDER BY v.value DESC, k LIMIT 1")
def eva06(t):
    return rounded(metrics.best_threshold(_counts(t), "f2"), 8, "value")


@query("eva07_cost_threshold", _GRID + ", v AS (SELECT *, fn * 6e6 + fp * 250e3 AS value FROM g) SELECT (k / 100.0)::DOUBLE AS tau, value::DOUBLE AS value, tp, fp, fn FROM v ORDER BY v.value, k LIMIT 1")
def eva07(t):
    return metrics.best_threshold(_counts(t), "cost")


@query("eva09_asymmetric_loss", "SELECT round(avg(y * 24 * (greatest(-z, 0) + ln(1 + exp(-abs(z)))) + (1 - y) * (greatest(z, 0) + ln(1 + exp(-abs(z))))), 8) AS loss FROM (SELECT y, (a - 0.5) * 4 AS z FROM scored)")
def eva09(t):
    return rounded(metrics.asymmetric_loss(scored(t).withColumn("z", (c("a") - 0.5) * 4), "z", "y"), 8, "loss")


@query("eva10_by_group", "SELECT user_id % 5 AS fold, round(avg((y - a) * (y - a)), 8) AS brier, count(*) AS n FROM scored GROUP BY 1")
def eva10(t):
    return scored(t).groupBy((c("user_id") % 5).alias("fold")).agg(F.round(F.avg(F.pow(c("y") - c("a"), F.lit(2.0))), 8).alias("brier"), F.count(F.lit(1)).alias("n"))


@query("eva13_reliability", "SELECT least(floor(a * 10), 9)::INTEGER AS bin, count(*) AS rows, round(avg(a), 8) AS mean_score, round(avg(y), 8) AS event_rate FROM scored GROUP BY 1")
def eva13(t):
    return rounded(metrics.reliability(scored(t), "a", "y"), 8, "mean_score", "event_rate")


@query("eva14_gains", _CURVE + """, z AS (SELECT *, pos + neg AS m, sum(pos + neg) OVER (ORDER BY s DESC) AS hi FROM r), d AS (SELECT k, floor((SELECT count(*) FROM scored) * k / 10)::BIGINT AS cut FROM range(1, 11) x(k))
  SELECT k::INTEGER AS part, cut AS k, round(sum(pos * least(greatest((cut - (hi - m)) / m, 0), 1)), 6)::DOUBLE AS captured, round(sum(pos * least(greatest((cut - (hi - m)) / m, 0), 1)) / max(P), 8)::DOUBLE AS gain FROM z, d GROUP BY ALL""")
def eva14(t):
    return rounded(rounded(metrics.gains_lift(_counts(t)), 6, "captured"), 8, "gain").select("part", "k", "captured", "gain")


@query("stt01_delong", """WITH p AS (SELECT row_number() OVER () AS i, a, b FROM scored WHERE y = 1), q AS (SELECT row_number() OVER () AS j, a, b FROM scored WHERE y = 0),
  x AS (SELECT i, j, CASE WHEN p.a > q.a THEN 1 WHEN p.a = q.a THEN 0.5 ELSE 0 END::DOUBLE AS u, CASE WHEN p.b > q.b THEN 1 WHEN p.b = q.b THEN 0.5 ELSE 0 END::DOUBLE AS v FROM p, q),
  m AS (SELECT avg(u) AS u, avg(v) AS v FROM x GROUP BY i), n AS (SELECT avg(u) AS u, avg(v) AS v FROM x GROUP BY j),
  s AS (SELECT (SELECT var_samp(u - v) / count(*) FROM m) + (SELECT var_samp(u - v) / count(*) FROM n) AS variance, (SELECT avg(u) FROM m) AS auc_a, (SELECT avg(v) FROM m) AS auc_b)
  SELECT round(auc_a, 8) AS auc_a, round(auc_b, 8) AS auc_b, round(variance, 10) AS variance, round((auc_a - auc_b) / sqrt(variance), 5) AS z, round(2 * """ + _TAIL.format(z="abs((auc_a - auc_b) / sqrt(variance))") + """, 5) AS p_value FROM s""")
def stt01(t):
    d = metrics.delong(scored(t), "y", "a", "b")
    return rounded(rounded(rounded(d, 8, "auc_a", "auc_b"), 10, "variance"), 5, "z", "p_value")


@query("stt02_mcnemar", """WITH k AS (SELECT (a >= 0.5) = (y = 1) AS ka, (b >= 0.5) = (y = 1) AS kb FROM scored), n AS (SELECT sum((ka AND NOT kb)::INTEGER)::BIGINT AS b, sum((NOT ka AND kb)::INTEGER)::BIGINT AS c FROM k)
  SELECT b, c, round(x, 8)::DOUBLE AS chi2, round(2 * """ + _TAIL.format(z="sqrt(x)") + """, 5) AS p_value FROM (SELECT *, coalesce(power(greatest(abs(b - c) - 1, 0), 2) / nullif(b + c, 0), 0)::DOUBLE AS x FROM n)""")
def stt02(t):
    return rounded(rounded(metrics.mcnemar(scored(t), "y", "a", "b", 0.5, 0.5), 8, "chi2"), 5, "p_value")


@query("stt03_bootstrap")
def stt03(t):
    return metrics.bootstrap(scored(t), "a", "y", "event_id")


_EDGES = "list_distinct([" + ", ".join(f"quantile_cont({{c}}, {k / 10})" for k in range(1, 10)) + "])"


@query("stt04_hosmer_lemeshow", f"""WITH e AS (SELECT {_EDGES.format(c='a')} AS edges FROM scored), g AS (SELECT len(list_filter(edges, lambda x: a > x)) AS bin, count(*) AS n, sum(y) AS o, sum(a) AS e FROM scored, e GROUP BY 1),
  h AS (SELECT sum(power(o - e, 2) / nullif(e * (1 - e / n), 0)) AS s, (count(*) - 2)::BIGINT AS df FROM g)
  SELECT round(s, 6) AS statistic, df, round((SELECT sum(power(s + (k + 0.5) * 0.01, df / 2.0 - 1) * exp(-(s + (k + 0.5) * 0.01) / 2)) * 0.01 / (power(2, df / 2.0) * gamma(df / 2.0)) FROM range(0, 40000) steps(k)), 5) AS p_value FROM h""")
def stt04(t):
    return rounded(rounded(metrics.hosmer_lemeshow(scored(t), "a", "y"), 6, "statistic"), 5, "p_value")


def _halves(t):
    l = t("lineitem").select("l_extendedprice", "l_quantity", F.year("l_shipdate").alias("y"))
    return l.where("y <= 1998"), l.where("y > 1998")


@query("drf01_psi", f"""WITH e AS (SELECT {_EDGES.format(c='l_extendedprice')} AS edges FROM lineitem WHERE year(l_shipdate) <= 1998), g AS (SELECT len(list_filter(edges, lambda x: l_extendedprice >= x)) AS bucket, sum((year(l_shipdate) <= 1998)::INTEGER) AS nr, sum((year(l_shipdate) > 1998)::INTEGER) AS nc FROM lineitem, e GROUP BY 1),
  p AS (SELECT greatest(nr / sum(nr) OVER (), 1e-4) AS p, greatest(nc / sum(nc) OVER (), 1e-4) AS q FROM g), n AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM p) SELECT round(sum((q - p) * ln(q / p)), 8) AS psi FROM n""")
def drf01(t):
    return rounded(metrics.psi(*_halves(t), "l_extendedprice"), 8, "psi")


@query("drf02_ks", """WITH v AS (SELECT l_extendedprice AS x, sum((year(l_shipdate) <= 1998)::INTEGER) AS nr, sum((year(l_shipdate) > 1998)::INTEGER) AS nc FROM lineitem GROUP BY 1),
  k AS (SELECT abs(sum(nr) OVER (ORDER BY x) / sum(nr) OVER () - sum(nc) OVER (ORDER BY x) / sum(nc) OVER ()) AS gap FROM v), m AS (SELECT max(gap) AS d, (SELECT sum(nr) * sum(nc) / sum(nr + nc) FROM v) AS en FROM k)
  SELECT round(d, 8) AS ks, round(CASE WHEN sqrt(en) * d < 0.2 THEN 1 ELSE greatest(0, least(1, (SELECT sum(CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * j * j * en * d * d)) FROM range(1, 101) x(j)))) END, 6)::DOUBLE AS p_value FROM m""")
def drf02(t):
    return rounded(rounded(metrics.ks_2samp(*_halves(t), "l_extendedprice"), 8, "ks"), 6, "p_value")


def _drift_parts(f: str) -> str:
    """Tables of one feature: its edges, bucket counts, counts of values and gaps."""
    return f"""e_{f} AS (SELECT {_EDGES.format(c=f)} AS edges FROM l WHERE y <= 1998), g_{f} AS (SELECT len(list_filter(edges, lambda x: {f} >= x)) AS bucket, sum((y <= 1998)::INTEGER) AS nr, sum((y > 1998)::INTEGER) AS nc FROM l, e_{f} GROUP BY 1),
      v_{f} AS (SELECT {f} AS x, sum((y <= 1998)::INTEGER) AS nr, sum((y > 1998)::INTEGER) AS nc FROM l GROUP BY 1), k_{f} AS (SELECT abs(sum(nr) OVER (ORDER BY x) / sum(nr) OVER () - sum(nc) OVER (ORDER BY x) / sum(nc) OVER ()) AS gap FROM v_{f})"""


def _drift_row(f: str) -> str:
    shares = f"(SELECT greatest(nr / sum(nr) OVER (), 1e-4) AS p, greatest(nc / sum(nc) OVER (), 1e-4) AS q FROM g_{f})"
    side = lambda f_, name, where: f"avg({f_}) FILTER ({where}) AS {name}_mean, stddev_pop({f_}) FILTER ({where}) AS {name}_std"
    return f"""SELECT '{f}' AS feature, (SELECT sum((q - p) * ln(q / p)) FROM (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM {shares})) AS psi, (SELECT max(gap) FROM k_{f}) AS ks, (SELECT sum(nr) * sum(nc) / sum(nr + nc) FROM v_{f}) AS en,
      {side(f, 'ref', 'y <= 1998')}, {side(f, 'cur', 'y > 1998')} FROM l"""


_DRIFT = "WITH l AS (SELECT l_extendedprice, l_quantity, year(l_shipdate) AS y FROM lineitem), " + ", ".join(_drift_parts(f) for f in ("l_extendedprice", "l_quantity")) + ", r AS (" + " UNION ALL ".join(_drift_row(f) for f in ("l_extendedprice", "l_quantity")) + """),
  d AS (SELECT *, CASE WHEN sqrt(en) * ks < 0.2 THEN 1 ELSE greatest(0, least(1, (SELECT sum(CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * j * j * en * ks * ks)) FROM range(1, 101) steps(j)))) END AS p FROM r)"""


@query("drf03_report", _DRIFT + """ SELECT feature, round(psi, 8) AS psi, round(ks, 8) AS ks, round(p, 6)::DOUBLE AS p_value, round(ref_mean, 4) AS ref_mean, round(ref_std, 4) AS ref_std, round(cur_mean, 4) AS cur_mean, round(cur_std, 4) AS cur_std,
  CASE WHEN psi >= 0.25 THEN 'severe' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS band, psi >= 0.1 OR (p < 0.01 AND ks > 0.05) AS drifted FROM d""")
def drf03(t):
    r = metrics.drift_report(*_halves(t), ["l_extendedprice", "l_quantity"])
    return rounded(rounded(rounded(r, 8, "psi", "ks"), 6, "p_value"), 4, "ref_mean", "ref_std", "cur_mean", "cur_std")


@query("drf05_verdict", _DRIFT + " SELECT count(*) AS features, sum((psi >= 0.25)::INTEGER)::BIGINT AS severe, CASE WHEN sum((psi >= 0.25)::INTEGER) <= 2 AND max(psi) FILTER (feature = 'l_extendedprice') < 0.25 THEN 'keep' ELSE 'retrain' END AS verdict FROM d")
def drf05(t):
    r = metrics.drift_report(*_halves(t), ["l_extendedprice", "l_quantity"])
    # the price stands for the score
    return metrics.drift_verdict(r, metrics.psi(*_halves(t), "l_extendedprice"))


@query("cv01_purged_folds", """WITH d AS (SELECT DISTINCT filed FROM filings), k AS (SELECT filed, ntile(6) OVER (ORDER BY filed) AS chunk FROM d), g AS (SELECT chunk, min(filed) AS lo, max(filed) AS hi FROM k GROUP BY 1),
  f AS (SELECT a.chunk::INTEGER AS fold, a.hi AS train_end, greatest(b.lo, (a.hi + 366)::DATE) AS valid_start, b.hi AS valid_end FROM g a JOIN g b ON b.chunk = a.chunk + 1)
  SELECT fold, strftime(train_end, '%Y-%m-%d') AS train_end, strftime(valid_start, '%Y-%m-%d') AS valid_start, strftime(valid_end, '%Y-%m-%d') AS valid_end FROM f WHERE valid_start <= valid_end""")
def cv01(t):
    f = metrics.purged_folds(filings(t), "filed")
    return f.select("fold", *[day_text(x).alias(x) for x in ("train_end", "valid_start", "valid_end")])


@query("sel02_spearman", """WITH r AS (SELECT rank() OVER (ORDER BY equity) + (count(*) OVER (PARTITION BY equity) - 1) / 2.0 AS a, rank() OVER (ORDER BY total_assets) + (count(*) OVER (PARTITION BY total_assets) - 1) / 2.0 AS b, rank() OVER (ORDER BY cash) + (count(*) OVER (PARTITION BY cash) - 1) / 2.0 AS c FROM sheet)
  SELECT 'equity' AS f1, 'total_assets' AS f2, round(corr(a, b), 8) AS rho FROM r UNION ALL SELECT 'equity', 'cash', round(corr(a, c), 8) FROM r UNION ALL SELECT 'total_assets', 'cash', round(corr(b, c), 8) FROM r""")
def sel02(t):
    return rounded(metrics.spearman(sheet(t), ["equity", "total_assets", "cash"]), 8, "rho")


@query("sel04_information_value", """WITH e AS (SELECT list_distinct([quantile_cont(a, 1.0 / 6), quantile_cont(a, 2.0 / 6), quantile_cont(a, 3.0 / 6), quantile_cont(a, 4.0 / 6), quantile_cont(a, 5.0 / 6)]) AS edges FROM scored),
  g AS (SELECT len(list_filter(edges, lambda x: a > x))::INTEGER AS bin, sum(1 - y)::DOUBLE AS good, sum(y)::DOUBLE AS bad FROM scored, e GROUP BY 1),
  p AS (SELECT *, (good + 0.5) / (sum(good) OVER () + 0.5) AS pg, (bad + 0.5) / (sum(bad) OVER () + 0.5) AS pb FROM g) SELECT bin, good, bad, round(ln(pg / pb), 8) AS woe, round((pg - pb) * ln(pg / pb), 8) AS iv FROM p""")
def sel04(t):
    return rounded(metrics.information_value(scored(t), "a", "y"), 8, "woe", "iv")


_PD = "least(greatest(1 / (1 + exp(-(-0.75 * (coalesce(net_income, 0) / 2000) - 2.8 * coalesce((current_assets - current_liabilities) / nullif(total_assets, 0), 0) + 1.10))), 0.001), 0.999)"


def _portfolio(t):
    s = sheet(t)
    wc = F.coalesce(F.try_divide(c("current_assets") - c("current_liabilities"), c("total_assets")), F.lit(0.0))
    dtd = F.coalesce("net_income", F.lit(0.0)) / 2000
    return s.withColumn("pd", scoring.structural_pd(dtd, wc)).withColumn("margin", scoring.structural_margin(dtd, wc))


@query("mdl11_structural_pd", f"SELECT entity, round({_PD}, 8) AS pd FROM sheet")
def mdl11(t):
    return _portfolio(t).select("entity", F.round("pd", 8).alias("pd"))


@query("mdl06_soft_vote", "SELECT event_id, round((a + b) / 2, 8) AS p FROM scored")
def mdl06(t):
    return scored(t).select("event_id", F.round((c("a") + c("b")) / 2, 8).alias("p"))


@query("str01_scenarios", f"""WITH p AS (SELECT entity, {_PD} AS pd FROM sheet), s AS (SELECT * FROM (VALUES ('base', 0.0), ('stagflation', 0.6), ('rates', 0.4), ('recession', 0.9)) x(scenario, shock))
  SELECT scenario, count(*) AS obligors, round(avg(1 / (1 + exp(-(ln(pd / (1 - pd)) + shock)))), 8) AS mean_pd, round(sum(1 / (1 + exp(-(ln(pd / (1 - pd)) + shock)))) * 6e6, 0)::DOUBLE AS expected_loss FROM p, s GROUP BY scenario""")
def str01(t):
    shocks = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(x).alias("shock")) for n, x in (("base", 0.0), ("stagflation", 0.6), ("rates", 0.4), ("recession", 0.9))])
    p = _portfolio(t).select("pd", F.inline(shocks)).withColumn("stressed", 1.0 / (1.0 + F.exp(-(F.ln(c("pd") / (1 - c("pd"))) + c("shock")))))
    return rounded(rounded(metrics.expected_loss(p, "stressed", by=["scenario"]), 8, "mean_pd"), 0, "expected_loss")


@query("str03_monte_carlo")
def str03(t):
    return metrics.monte_carlo(_portfolio(t), "entity", "margin")


@query("scr02_batch", f"""WITH p AS (SELECT entity, {_PD} AS p FROM sheet) SELECT entity, round(p, 8) AS probability, CASE WHEN p >= 0.5 THEN 'reject' ELSE 'accept' END AS decision,
  CASE WHEN p >= 0.5 THEN 'critical' WHEN p >= 0.25 THEN 'high' WHEN p >= 0.1 THEN 'moderate' ELSE 'low' END AS tier, round(CASE WHEN p >= 0.5 THEN (1 - p) * 250e3 ELSE p * 6e6 END, 2)::DOUBLE AS expected_cost FROM p""")
def scr02(t):
    s = scoring.score_batch(_portfolio(t), "pd", 0.5).select("entity", "probability", "decision", "tier", "expected_cost")
    return rounded(rounded(s, 8, "probability"), 2, "expected_cost")


@query("scr03_summary", f"WITH p AS (SELECT {_PD} AS p FROM sheet) SELECT count(*) AS rows, round(avg(p), 8) AS mean_pd, sum((p >= 0.5)::INTEGER)::BIGINT AS alerts, round(sum(CASE WHEN p >= 0.5 THEN (1 - p) * 250e3 ELSE p * 6e6 END), 0)::DOUBLE AS total_cost FROM p")
def scr03(t):
    return rounded(rounded(scoring.portfolio_summary(scoring.score_batch(_portfolio(t), "pd", 0.5)), 8, "mean_pd"), 0, "total_cost")


@query("scr06_scorecard", f"""WITH p AS (SELECT entity, 850 - 550 * ({_PD}) AS pts FROM sheet) SELECT entity, round(pts, 4)::DOUBLE AS points, CASE WHEN pts >= 750 THEN 'A' WHEN pts >= 700 THEN 'B' WHEN pts >= 650 THEN 'C' WHEN pts >= 600 THEN 'D' WHEN pts >= 550 THEN 'E' ELSE 'F' END AS band FROM p""")
def scr06(t):
    from solvara.functions import ladder

    p = _portfolio(t).select("entity", scoring.scorecard_points(c("pd")).alias("points"))
    return p.select("entity", F.round("points", 4).alias("points"), ladder("points", scoring.BANDS, "F").alias("band"))


_COEF = {"equity": 1e-5, "total_assets": -2e-7, "cash": 3e-6}


@query("xai01_attributions", "WITH m AS (SELECT avg(equity) AS e, avg(total_assets) AS t, avg(cash) AS k FROM sheet) " + " UNION ALL ".join(f"SELECT entity, '{n}' AS feature, round({w} * ({n} - {m}), 8)::DOUBLE AS phi FROM sheet, m" for (n, w), m in zip(_COEF.items(), "etk")))
def xai01(t):
    s = sheet(t)
    return rounded(scoring.attributions(s, "entity", _COEF, s.agg(*[F.avg(x).alias(x) for x in _COEF])), 8, "phi")


_PHI = "m AS (SELECT avg(equity) AS e, avg(total_assets) AS t, avg(cash) AS k FROM sheet), phi AS (" + " UNION ALL ".join(f"SELECT entity, '{n}' AS feature, {w} * ({n} - {m}) AS phi FROM sheet, m" for (n, w), m in zip(_COEF.items(), "etk")) + ")"


@query("xai02_importance", f"WITH {_PHI}, a AS (SELECT feature, avg(abs(phi)) AS v FROM phi GROUP BY 1) SELECT feature, CASE feature WHEN 'equity' THEN 'capital' WHEN 'cash' THEN 'liquidity' ELSE 'size' END AS pillar, round(v / sum(v) OVER (), 8) AS share FROM a")
def xai02(t):
    s = sheet(t)
    phi = scoring.attributions(s, "entity", _COEF, s.agg(*[F.avg(x).alias(x) for x in _COEF]))
    return rounded(scoring.global_importance(phi, {"equity": "capital", "total_assets": "size", "cash": "liquidity"}), 8, "share")


@query("xai03_top_drivers", f"WITH {_PHI}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY abs(phi) DESC, feature) AS rank FROM phi) SELECT entity, feature, round(phi, 8)::DOUBLE AS phi, rank::INTEGER AS rank, CASE WHEN phi > 0 THEN 'raises' ELSE 'lowers' END AS direction FROM r WHERE rank <= 2")
def xai03(t):
    s = sheet(t)
    return rounded(scoring.top_drivers(scoring.attributions(s, "entity", _COEF, s.agg(*[F.avg(x).alias(x) for x in _COEF])), "entity", 2), 8, "phi")


@query("scr07_freshest", """WITH r AS (SELECT user_id, CAST(ts AS DATE) AS d, CASE WHEN event_type = 'error' THEN value END AS err, CASE WHEN event_type <> 'error' THEN value END AS act, event_id FROM events), n AS (SELECT max(d) AS now FROM r)
  SELECT user_id, count(*) FILTER (err IS NOT NULL AND date_diff('day', d, now) BETWEEN 0 AND 10) > 0 AS has_err FROM r, n GROUP BY user_id""")
def scr07(t):
    e = t("events").select("user_id", "ts", F.when(c("event_type") == "error", c("value")).alias("err"))
    now = e.agg(F.max("ts").alias("now"))
    rows = e.crossJoin(F.broadcast(now)).withColumn("now", c("now"))
    return scoring.freshest([rows], "user_id", "ts", {"err": (10, None)}, c("now")).select("user_id", c("err").isNotNull().alias("has_err"))


@query("aud01_audit", "SELECT count(*) AS rows, count(*) - count(DISTINCT o_orderkey) AS duplicates, sum((o_totalprice IS NULL)::INTEGER)::BIGINT AS nulls, sum((o_totalprice <= 0)::INTEGER)::BIGINT AS not_positive, min(year(o_orderdate))::INTEGER AS first_year, max(year(o_orderdate))::INTEGER AS last_year FROM orders")
def aud01(t):
    o = t("orders")
    return o.agg(
        F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count_distinct("o_orderkey")).alias("duplicates"), F.sum(c("o_totalprice").isNull().cast("long")).alias("nulls"),
        F.sum((c("o_totalprice") <= 0).cast("long")).alias("not_positive"), F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year"),
    )
