"""Metric tables against counts by hand, with null groups and groups of one class."""

import math
import random

from solvara.operators import tables


def by_hand(rows, tau):
    n = lambda hit, y: sum((s >= tau - 1e-12) == hit and b == y for s, b in rows)
    return n(True, 1), n(True, 0), n(False, 1), n(False, 0)


def test_metric_table(spark):
    r = random.Random(12)
    data = [(r.choice(["m", None]), round(r.random(), 2), int(r.random() < 0.3)) for _ in range(400)]
    data += [("good", 0.2, 0)] * 5 + [("m", None, 1), ("m", 0.5, None)]
    df = spark.createDataFrame(data, "g string, s double, y int")
    got = {(x.g, x.rule): x for x in tables.metric_table(df, "s", "y", ["g"]).collect()}
    assert set(got) == {(g, rule) for g in ("m", None, "good") for rule in ("optimal", "fixed")}
    for g in ("m", None, "good"):
        rows = [(s, y) for k, s, y in data if k == g and s is not None and y is not None]
        cost = lambda tau, rows=rows: by_hand(rows, tau)[2] * 6e6 + by_hand(rows, tau)[1] * 250e3
        best = min((cost(k / 100), k / 100) for k in range(1, 100))
        assert math.isclose(got[g, "optimal"].tau, best[1]) and got[g, "optimal"].cost == best[0]
        for rule in ("optimal", "fixed"):
            x = got[g, rule]
            tp, fp, fn, tn = by_hand(rows, x.tau)
            assert (x.tp, x.fp, x.fn, x.tn, x.rows) == (tp, fp, fn, tn, len(rows))
            assert x.pnl_full == tn * 250e3 + tp * 6e6 - fn * 6e6 - fp * 250e3 and x.pnl_margin == tn * 250e3 - fn * 6e6 - fp * 250e3
            assert math.isclose(x.brier, sum((y - s) ** 2 for s, y in rows) / len(rows))
            pairs = [(p, q) for p, a in rows if a for q, b in rows if not b]
            assert math.isclose(x.roc_auc, sum((p > q) + (p == q) / 2 for p, q in pairs) / len(pairs)) if pairs else x.roc_auc is None and x.pr_auc is None and x.recall == 0
    assert tables.metric_table(df.limit(0), "s", "y", ["g"]).count() == 0


def test_fold_table_means(spark):
    r = random.Random(13)
    df = spark.createDataFrame([(k % 3, r.choice("ab"), round(r.random(), 2), int(r.random() < 0.4)) for k in range(300)] + [(9, "a", 0.1, 0)], "f int, m string, s double, y int")
    each = tables.metric_table(df, "s", "y", ["m", "f"], fixed=None).where("f < 9").collect()
    for x in tables.fold_table(df, "s", "y", ["m"], "f").collect():
        own = [e for e in each if e.m == x.m]
        assert x.folds == len(own) == 3
        assert all(math.isclose(x[c], sum(e[c] for e in own) / 3) for c in ("tau", "cost", "roc_auc", "pnl_margin", "f1"))
