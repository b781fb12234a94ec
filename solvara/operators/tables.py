"""Metric tables of models, horizons and cohorts: areas, Brier score, and counts, rates and money at each group's thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvara.operators.metrics import best_threshold, pr_auc, roc_auc, score_counts
from solvara.sources import saved

#: Cost of a missed default and of a false alarm; a good loan's margin equals the latter, a caught default saves the former.
FN_COST, FP_COST = 6e6, 250e3


def money(tp: Column, fp: Column, fn: Column, tn: Column, fn_cost: float = FN_COST, fp_cost: float = FP_COST) -> dict[str, Column]:
    """cost, and both forms of profit: ``pnl_full`` counts margins of accepted good loans and saved defaults,
    ``pnl_margin`` counts margins alone; both less the cost."""
    cost = fn * float(fn_cost) + fp * float(fp_cost)
    return {"cost": cost, "pnl_full": tn * float(fp_cost) + tp * float(fn_cost) - cost, "pnl_margin": tn * float(fp_cost) - cost}


def metric_table(df: DataFrame, score: str, label: str, by: Sequence[str], fixed: float | None = 0.5, fn_cost: float = FN_COST, fp_cost: float = FP_COST) -> DataFrame:
    """One row per group and threshold rule (``optimal``: least cost over 0.01 to 0.99; ``fixed``, unless None).

    Columns: by, rule, tau, rows, positives, roc_auc, pr_auc, average_precision, brier, tp, fp, fn, tn, recall, precision,
    specificity, f1, cost, pnl_full, pnl_margin.  Rows are reduced to counts of each score and group once; all
    columns come from these.  Areas are null without a class, rates 0 where undefined; rows without a score or
    label take no part; groups may be null.
    """
    # groups under names of their own, since the measures have columns too
    groups, by = list(by), [f"__by{k}" for k in range(len(by))]
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*[F.col(g).alias(b) for g, b in zip(groups, by)], F.col(score).alias("__s"), F.col(label).alias("__y"))
    counts = saved(score_counts(rows, "__s", "__y", by), "score-counts")
    c = F.col
    whole = counts.groupBy(*by).agg(
        F.sum(c("pos") + c("neg")).alias("rows"), F.sum("pos").alias("positives"),
        (F.sum(c("pos") * (1.0 - c("score")) * (1.0 - c("score")) + c("neg") * c("score") * c("score")) / F.sum(c("pos") + c("neg"))).alias("brier"),
    )
    same = lambda other: [c(f"l.{k}").eqNullSafe(c(f"r.{k}")) for k in by] or F.lit(True)

    def joined(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
        return left.alias("l").join(right.alias("r"), same(right), "left").select("l.*", *[f"r.{x}" for x in columns])

    out = joined(whole, roc_auc(counts, by), "roc_auc")
    out = joined(out, pr_auc(counts, by), "pr_auc", "average_precision")
    out = joined(out, best_threshold(counts, "cost", by, fn_cost, fp_cost), "tau")
    rules = [F.struct(F.lit("optimal").alias("rule"), c("tau"))] + ([F.struct(F.lit("fixed").alias("rule"), F.lit(float(fixed)).alias("tau"))] if fixed is not None else [])
    out = out.withColumn("__rule", F.explode(F.array(*rules))).drop("tau").select("*", "__rule.*").drop("__rule")
    reached = joined(counts, out.select(*by, "rule", "tau"), "rule", "tau").where(F.round(c("score") - c("tau"), 9) >= 0)
    hits = reached.groupBy(*by, "rule").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    both = [c(f"l.{k}").eqNullSafe(c(f"r.{k}")) for k in [*by, "rule"]]
    zero = lambda x: F.coalesce(c(f"r.{x}"), F.lit(0)).alias(x)
    out = out.alias("l").join(hits.alias("r"), both, "left").select("l.*", zero("tp"), zero("fp"))
    out = out.withColumns({"fn": c("positives") - c("tp"), "tn": c("rows") - c("positives") - c("fp")})
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    no_class = (c("positives") == 0) | (c("positives") == c("rows"))
    out = out.withColumns(
        {
            "pr_auc": F.when(~no_class, c("pr_auc")), "average_precision": F.when(~no_class, c("average_precision")), "recall": rate(c("tp"), c("tp") + c("fn")), "precision": rate(c("tp"), c("tp") + c("fp")),
            "specificity": rate(c("tn"), c("tn") + c("fp")), "f1": rate(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
        } | money(c("tp"), c("fp"), c("fn"), c("tn"), fn_cost, fp_cost)
    )
    return out.withColumnsRenamed(dict(zip(by, groups)))


_MEANS = ("roc_auc", "pr_auc", "average_precision", "brier", "tau", "recall", "precision", "specificity", "f1", "cost", "pnl_full", "pnl_margin")


def fold_table(df: DataFrame, score: str, label: str, by: Sequence[str], fold: str) -> DataFrame:
    """Means over folds of the optimal-threshold metrics of each group, and the number of its folds with both classes, which alone count."""
    each = metric_table(df, score, label, [*by, fold], fixed=None).where("positives > 0 AND positives < rows")
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), *[F.avg(m).alias(m) for m in _MEANS])
