"""Evaluation, significance, drift and risk, all from one table of counts per distinct score.

``score_counts`` reduces any number of rows to one row per group and score; ranks, curves and
thresholds come from running sums over these counts, dealt to ranges of scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvara.functions import chi2_tail, ks_tail, normal_tail, softplus
from solvara.operators.ordered import quantiles, running_sums
from solvara.operators.resampling import bootstrap  # noqa: F401
from solvara.sources import saved


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., score, pos, neg)."""
    y = F.col(label)
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(y.cast("long")).alias("pos"), F.sum((1 - y).cast("long")).alias("neg"))


def _ranked(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Positives and negatives at or above each score, and in all."""
    r = running_sums(counts, [F.desc("score")], ["pos", "neg"], by)
    return r.withColumnsRenamed({"pos_upto": "tp", "neg_upto": "fp", "pos_all": "P", "neg_all": "N"})


def _curve(ranked: DataFrame) -> DataFrame:
    """Precision and recall at each score, and before it (1 and 0 at the start)."""
    c = F.col
    tp, fp = c("tp") - c("pos"), c("fp") - c("neg")
    return ranked.where("pos + neg > 0").withColumns(
        {
            "precision": c("tp") / (c("tp") + c("fp")),
            "recall": F.try_divide(c("tp").cast("double"), c("P")),
            "p0": F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(1.0)),
            "r0": F.coalesce(F.try_divide(tp.cast("double"), c("P")), F.lit(0.0)),
        }
    )


def roc_auc(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., roc_auc): the share of positive-negative pairs in order, ties half; null without a class."""
    r = _ranked(counts, by)
    above = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return r.groupBy(*by).agg(F.try_divide(above, (F.max("P") * F.max("N")).cast("double")).alias("roc_auc"))


def pr_auc(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., pr_auc, average_precision): the trapezoid rule and the step rule over the same curve.

    The curve starts at recall 0 with precision 1.
    """
    r = _curve(_ranked(counts, by))
    step = F.col("recall") - F.col("r0")
    return r.groupBy(*by).agg(F.sum(step * (F.col("precision") + F.col("p0")) / 2.0).alias("pr_auc"), F.sum(step * F.col("precision")).alias("average_precision"))


def confusion(df: DataFrame, score: str, label: str, tau: float, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts at ``score >= tau`` with recall, precision, specificity and F1 (0 where undefined)."""
    hit, y = F.col(score) >= tau, F.col(label) == 1
    n = lambda c: F.sum(c.cast("long"))
    out = df.groupBy(*by).agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"), n(~hit & ~y).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = F.col
    return out.withColumns(
        {
            "recall": div(c("tp"), c("tp") + c("fn")),
            "precision": div(c("tp"), c("tp") + c("fp")),
            "specificity": div(c("tn"), c("tn") + c("fp")),
            "f1": div(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
        }
    )


def best_threshold(counts: DataFrame, objective: str = "cost", by: Sequence[str] = (), fn_cost: float = 6e6, fp_cost: float = 250e3) -> DataFrame:
    """The first of 0.01..0.99 with the least cost, or the largest F2: (by..., tau, value, tp, fp, fn).

    Scores are first counted by the number of grid points that they reach, so that the grid meets at
    most 100 rows of a group.
    """
    reach = F.least(F.floor(F.round(F.col("score") * 100, 9)), F.lit(99)).cast("int")
    bins = counts.groupBy(*by, reach.alias("k")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    grid = bins.withColumn("g", F.explode(F.sequence(F.lit(1), F.lit(99)))).groupBy(*by, "g").agg(
        F.sum(F.when(F.col("k") >= F.col("g"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("k") >= F.col("g"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("k") < F.col("g"), F.col("pos")).otherwise(0)).alias("fn"),
    )
    if objective == "cost":
        value = F.col("fn") * float(fn_cost) + F.col("fp") * float(fp_cost)
        order = F.struct("value", "g")
    else:
        value = F.coalesce(F.try_divide(5.0 * F.col("tp"), 5.0 * F.col("tp") + 4.0 * F.col("fn") + F.col("fp")), F.lit(0.0))
        order = F.struct(-F.col("value"), "g")
    best = grid.withColumn("value", value).groupBy(*by).agg(F.min_by(F.struct("g", "value", "tp", "fp", "fn"), order).alias("b"))
    return best.select(*by, (F.col("b.g") / 100.0).alias("tau"), "b.value", "b.tp", "b.fp", "b.fn")


def brier(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(label) - F.col(score), F.lit(2.0))).alias("brier"))


def asymmetric_loss(df: DataFrame, margin: str, label: str, weight: float = 24.0) -> DataFrame:
    """Mean of y * weight * softplus(-z) + (1 - y) * softplus(z)."""
    z, y = F.col(margin), F.col(label)
    return df.agg(F.avg(y * weight * softplus(-z) + (1 - y) * softplus(z)).alias("loss"))


def reliability(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Rows, mean score and event rate in equal-width bins of the score."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(b).agg(F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("event_rate"))


def gains_lift(counts: DataFrame, parts: int = 10) -> DataFrame:
    """Share of positives among the first floor(n * d / parts) rows by descending score, and its lift.

    Rows of one score are taken in proportion where a cut falls among them.
    """
    c = running_sums(counts.withColumn("rows", F.col("pos") + F.col("neg")), [F.desc("score")], ["rows"]).withColumnRenamed("rows_upto", "end")
    total = counts.agg(F.sum("pos").alias("P"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
    cuts = total.select("P", "n", F.explode(F.sequence(F.lit(1), F.lit(parts))).alias("part")).withColumn("k", F.floor(F.col("n") * F.col("part") / parts))
    start = F.col("end") - F.col("rows")
    share = F.least(F.greatest((F.col("k") - start) / F.col("rows"), F.lit(0.0)), F.lit(1.0))
    got = c.crossJoin(F.broadcast(cuts)).groupBy("part", "k", "P", "n").agg(F.sum(F.col("pos") * share).alias("captured"))
    gain = F.coalesce(F.try_divide(F.col("captured"), F.col("P").cast("double")), F.lit(0.0))
    return got.select("part", "k", "captured", gain.alias("gain"), F.try_divide(gain, F.col("k") / F.col("n")).alias("lift"))


def mcnemar(df: DataFrame, label: str, a: str, b: str, tau_a: float, tau_b: float) -> DataFrame:
    """Discordant counts of two classifiers, the statistic with continuity correction and its p-value."""
    ok_a, ok_b = (F.col(a) >= tau_a) == (F.col(label) == 1), (F.col(b) >= tau_b) == (F.col(label) == 1)
    n = df.agg(F.sum((ok_a & ~ok_b).cast("long")).alias("b"), F.sum((~ok_a & ok_b).cast("long")).alias("c"))
    n = n.withColumn("chi2", F.coalesce(F.try_divide(F.pow(F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)).cast("double"), F.lit(2.0)), (F.col("b") + F.col("c")).cast("double")), F.lit(0.0)))
    return n.withColumn("p_value", chi2_tail(F.col("chi2"), 1))


def delong(df: DataFrame, label: str, a: str, b: str) -> DataFrame:
    """AUCs of two scores, the variance of their difference, z and its two-sided p-value.

    Placements come from cumulative counts of each distinct score, joined back to the rows: no pairs.
    """
    rows = df.select(F.col(label).alias("y"), F.col(a).alias("a"), F.col(b).alias("b"))
    for s in ("a", "b"):
        c = _ranked(score_counts(rows, s, "y"), [])
        below_neg, above_pos = F.col("N") - F.col("fp"), F.col("tp") - F.col("pos")
        place = c.select(F.col("score").alias(s), ((below_neg + F.col("neg") / 2.0) / F.col("N")).alias(f"v{s}"), ((above_pos + F.col("pos") / 2.0) / F.col("P")).alias(f"w{s}"))
        rows = rows.join(place, s)
    one, zero = F.col("y") == 1, F.col("y") == 0
    m, n = F.sum(F.col("y").cast("double")), F.sum((1 - F.col("y")).cast("double"))
    var = lambda x, where: F.var_samp(F.when(where, x))
    diff = var(F.col("va") - F.col("vb"), one) / m + var(F.col("wa") - F.col("wb"), zero) / n
    out = rows.agg(F.avg(F.when(one, F.col("va"))).alias("auc_a"), F.avg(F.when(one, F.col("vb"))).alias("auc_b"), diff.alias("variance"))
    out = out.withColumn("z", F.coalesce(F.try_divide(F.col("auc_a") - F.col("auc_b"), F.sqrt("variance")), F.lit(0.0)))
    return out.withColumn("p_value", 2.0 * normal_tail(F.abs("z")))


def _edges(df: DataFrame, column: str, bins: int) -> DataFrame:
    """One row: the distinct inner quantile edges of a column."""
    inner = [k / bins for k in range(1, bins)]
    return quantiles(df, column, inner, out="edges").select(F.coalesce(F.array_distinct("edges"), F.array().cast("array<double>")).alias("edges"))


def hosmer_lemeshow(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """The statistic over quantile bins of the score (right-closed, equal edges merged), its degrees and p-value
    (null without a degree)."""
    b = F.size(F.filter("edges", lambda e: F.col(score) > e))
    g = df.crossJoin(F.broadcast(_edges(df, score, bins))).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("o"), F.sum(score).alias("e"))
    term = F.try_divide(F.pow(F.col("o") - F.col("e"), F.lit(2.0)), F.col("e") * (1.0 - F.col("e") / F.col("n")))
    found = g.agg(F.sum(term).alias("statistic"), (F.count(F.lit(1)) - 2).alias("df"))
    p = None
    for k in range(1, bins - 1):
        p = F.when(F.col("df") == k, chi2_tail(F.col("statistic"), k)) if p is None else p.when(F.col("df") == k, chi2_tail(F.col("statistic"), k))
    return found.withColumn("p_value", p)


def psi(ref: DataFrame, cur: DataFrame, column: str, buckets: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index over quantile buckets of the reference (right-open inner edges)."""
    b = F.size(F.filter("edges", lambda e: F.col(column) >= e))
    both = ref.select(column, F.lit(1).alias("r")).unionByName(cur.select(column, F.lit(0).alias("r"))).where(F.col(column).isNotNull())
    g = both.crossJoin(F.broadcast(_edges(ref, column, buckets))).groupBy(b.alias("bucket")).agg(F.sum("r").alias("nr"), F.sum(1 - F.col("r")).alias("nc"))
    whole = Window.partitionBy()
    p = g.withColumns({"p": F.greatest(F.col("nr") / F.sum("nr").over(whole), F.lit(eps)), "q": F.greatest(F.col("nc") / F.sum("nc").over(whole), F.lit(eps))})
    p = p.withColumns({"p": F.col("p") / F.sum("p").over(whole), "q": F.col("q") / F.sum("q").over(whole)})
    return p.agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))


def ks_2samp(ref: DataFrame, cur: DataFrame, column: str) -> DataFrame:
    """The largest gap of two empirical distributions, from counts per distinct value, and its asymptotic p-value."""
    both = ref.select(column, F.lit(1).alias("r")).unionByName(cur.select(column, F.lit(0).alias("r"))).where(F.col(column).isNotNull())
    c = both.groupBy(column).agg(F.sum("r").alias("nr"), F.sum(1 - F.col("r")).alias("nc"))
    c = running_sums(c, [column], ["nr", "nc"])
    gap = F.abs(F.try_divide(F.col("nr_upto").cast("double"), F.col("nr_all")) - F.try_divide(F.col("nc_upto").cast("double"), F.col("nc_all")))
    found = c.agg(F.max(gap).alias("ks"), F.max("nr_all").alias("n"), F.max("nc_all").alias("m"))
    size = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    return found.select("ks", ks_tail(F.col("ks"), size).alias("p_value"))


def drift_report(ref: DataFrame, cur: DataFrame, columns: Sequence[str], buckets: int = 10, eps: float = 1e-4) -> DataFrame:
    """feature, psi, ks and its p-value, means, population deviations, a band, and whether the feature drifted
    (PSI from 0.10 on, or p < 0.01 with a gap over 0.05), one row for each column.

    All columns are stacked and counted in one grouped job, however many there are.  Nulls are passed
    over; a column without any value has a row of nulls and did not drift.
    """
    side = lambda df, r: df.select(F.lit(r).alias("__r"), *[F.col(c).cast("double").alias(c) for c in columns])
    rows = side(ref, 1).unionByName(side(cur, 0)).unpivot(["__r"], list(columns), "feature", "value").where("value IS NOT NULL")
    of = lambda r, f: f(F.when(F.col("__r") == r, F.col("value")))
    stats = rows.groupBy("feature").agg(*[of(r, f).alias(f"{n}_{m}") for r, n in ((1, "ref"), (0, "cur")) for f, m in ((F.avg, "mean"), (F.stddev_pop, "std"))])
    counts = saved(rows.groupBy("feature", "value").agg(F.sum("__r").alias("nr"), F.sum(1 - F.col("__r")).alias("nc")), "drift")
    sums = running_sums(counts, ["value"], ["nr", "nc"], ["feature"])
    gap = F.abs(F.try_divide(F.col("nr_upto").cast("double"), F.col("nr_all")) - F.try_divide(F.col("nc_upto").cast("double"), F.col("nc_all")))
    ks = sums.groupBy("feature").agg(F.max(gap).alias("ks"), F.max("nr_all").alias("n"), F.max("nc_all").alias("m"))
    ks = ks.select("feature", "ks", ks_tail(F.col("ks"), F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))).alias("p_value"))
    edges = quantiles(rows.where("__r = 1"), "value", [k / buckets for k in range(1, buckets)], ["feature"], "edges")
    edges = edges.select("feature", F.array_distinct("edges").alias("edges"))
    own = F.size(F.filter(F.coalesce("edges", F.array().cast("array<double>")), lambda e: F.col("value") >= e))
    g = counts.join(F.broadcast(edges), "feature", "left").groupBy("feature", own.alias("bucket")).agg(F.sum("nr").alias("nr"), F.sum("nc").alias("nc"))
    w = Window.partitionBy("feature")  # a row for each bucket
    p = g.withColumns({"p": F.greatest(F.try_divide("nr", F.sum("nr").over(w)), F.lit(eps)), "q": F.greatest(F.try_divide("nc", F.sum("nc").over(w)), F.lit(eps))})
    p = p.withColumns({"p": F.col("p") / F.sum("p").over(w), "q": F.col("q") / F.sum("q").over(w)})
    psi_of = p.groupBy("feature").agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))
    names = ref.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("feature"))
    out = names.join(psi_of, "feature", "left").join(ks, "feature", "left").join(stats, "feature", "left")
    out = out.withColumn("band", F.when(F.col("psi") >= 0.25, "severe").when(F.col("psi") >= 0.10, "moderate").otherwise("stable"))
    return out.withColumn("drifted", F.coalesce((F.col("psi") >= 0.10) | ((F.col("p_value") < 0.01) & (F.col("ks") > 0.05)), F.lit(False)))


def drift_verdict(report: DataFrame, score_psi: DataFrame, most: int = 2) -> DataFrame:
    """features, severe ones and the verdict: keep with at most ``most`` severe features and a score PSI below 0.25."""
    n = report.agg(F.count(F.lit(1)).alias("features"), F.count_if(F.col("psi") >= 0.25).alias("severe"))
    ok = (F.col("severe") <= most) & (F.coalesce("psi", F.lit(0.0)) < 0.25)
    return n.crossJoin(F.broadcast(score_psi)).select("features", "severe", F.when(ok, "keep").otherwise("retrain").alias("verdict"))


def score_drift(ref: DataFrame, cur: DataFrame, score: str, tau: float) -> DataFrame:
    """One row: PSI, KS gap and p-value of a score, mean scores and shares of alerts (score from ``tau`` on)."""
    own = lambda df, name: df.agg(F.avg(score).alias(f"{name}_mean"), F.avg((F.col(score) >= tau).cast("double")).alias(f"{name}_alerts"))
    return psi(ref, cur, score).crossJoin(ks_2samp(ref, cur, score)).crossJoin(own(ref, "ref")).crossJoin(own(cur, "cur"))


def purged_folds(df: DataFrame, date: str, n_splits: int = 5, purge_days: int = 365) -> DataFrame:
    """(fold, train_end, valid_start, valid_end): expanding training spans over the distinct dates cut
    into ``n_splits + 1`` chunks, with a gap before each validation chunk; empty folds are left out."""
    dates = df.select(F.col(date).alias("d")).distinct()
    chunk = dates.withColumn("chunk", F.ntile(n_splits + 1).over(Window.orderBy("d"))).groupBy("chunk").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    nxt = chunk.select((F.col("chunk") - 1).alias("chunk"), F.col("lo").alias("next_lo"), F.col("hi").alias("valid_end"))
    folds = chunk.join(nxt, "chunk").withColumn("valid_start", F.greatest(F.col("next_lo"), F.date_add(F.col("hi"), purge_days + 1)))
    return folds.where("valid_start <= valid_end").select(F.col("chunk").alias("fold"), F.col("hi").alias("train_end"), "valid_start", "valid_end")


def expected_loss(df: DataFrame, pd: str, ead: float = 1e7, lgd: float = 0.6, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("obligors"), F.avg(pd).alias("mean_pd"), (F.sum(pd) * ead * lgd).alias("expected_loss"))


def monte_carlo(df: DataFrame, key: str, margin: str, n: int = 1000, seed: int = 42, ead: float = 1e7, lgd: float = 0.6, rho: float = 0.3) -> DataFrame:
    """(mean_loss, var95, var99, unexpected_99) of a portfolio whose margins share a normal shock in each simulation.

    Draws are seeded hashes of simulation and obligor, so that a task that runs again draws the same.
    """
    uniform = lambda *c: (F.pmod(F.xxhash64(*c), F.lit(2**40)) + 0.5) / float(2**40)
    shock = F.sqrt(-2.0 * F.ln(uniform("sim", F.lit(seed)))) * F.cos(6.283185307179586 * uniform("sim", F.lit(seed + 1)))
    # an obligor draws for each simulation where it lies; losses are summed on the map side
    pairs = df.select(key, margin, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("sim")).withColumn("shock", shock)
    p = 1.0 / (1.0 + F.exp(-(F.col(margin) + rho * F.col("shock"))))
    loss = pairs.withColumn("loss", F.when(uniform(key, "sim", F.lit(seed + 2)) < p, ead * lgd).otherwise(0.0)).groupBy("sim").agg(F.sum("loss").alias("loss"))
    out = loss.agg(F.avg("loss").alias("mean_loss"), F.percentile("loss", F.array(F.lit(0.95), F.lit(0.99))).alias("q"))
    return out.select("mean_loss", F.col("q")[0].alias("var95"), F.col("q")[1].alias("var99"), (F.col("q")[1] - F.col("mean_loss")).alias("unexpected_99"))


def information_value(df: DataFrame, column: str, label: str, bins: int = 6) -> DataFrame:
    """Weight of evidence of each quantile bin and its part of the information value."""
    b = F.size(F.filter("edges", lambda e: F.col(column) > e))
    g = df.crossJoin(F.broadcast(_edges(df, column, bins))).groupBy(b.alias("bin")).agg(F.sum((1 - F.col(label)).cast("double")).alias("good"), F.sum(F.col(label).cast("double")).alias("bad"))
    whole = Window.partitionBy()
    pg, pb = (F.col("good") + 0.5) / (F.sum("good").over(whole) + 0.5), (F.col("bad") + 0.5) / (F.sum("bad").over(whole) + 0.5)
    return g.select("bin", "good", "bad", F.ln(pg / pb).alias("woe"), ((pg - pb) * F.ln(pg / pb)).alias("iv"))


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(f1, f2, rho) of all column pairs: Pearson correlation of mid-ranks.

    Mid-ranks come from counts per distinct value, so only those are ordered.
    """
    ranked = df.select(*columns)
    for c in columns:
        counts = running_sums(df.groupBy(c).agg(F.count(F.lit(1)).alias("__n")), [c], ["__n"])
        ranked = ranked.join(counts.select(c, (F.col("__n_upto") - (F.col("__n") - 1) / 2.0).alias(f"__r_{c}")), c)
    pairs = [(x, y) for k, x in enumerate(columns) for y in columns[k + 1 :]]
    row = ranked.agg(*[F.corr(f"__r_{x}", f"__r_{y}").alias(f"{x}|{y}") for x, y in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("f1"), F.lit(y).alias("f2"), F.col(f"{x}|{y}").alias("rho")) for x, y in pairs])).alias("p")).select("p.*")
