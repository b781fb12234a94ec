"""Entity-separated purged folds, and the search against an exhaustive run in plain numpy."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np

from solvara.operators import folds

START = dt.date(2000, 1, 1)


def rows_of(spark, n=900, hot=0):
    r = random.Random(7)
    rows = []
    for k in range(n):
        a, b = r.gauss(0, 1), r.gauss(0, 2)
        entity = 1 if k < hot else r.choice([None, *range(2, 60)])
        rows.append((k, entity, START + dt.timedelta(days=r.randrange(4000)), a, b if k % 30 else None, int(a - 0.5 * b + r.gauss(0, 1) > 1.5), "clash"))
    return spark.createDataFrame(rows, "id long, entity int, day date, a double, b double, y int, part string")


def test_no_entity_on_both_sides(spark):
    df = rows_of(spark, hot=300)
    rows, spans = folds.grouped_folds(df, "day", "entity", "y", 4, 100)
    spans = {f.fold: f for f in spans.collect()}
    seen = defaultdict(lambda: defaultdict(set))
    for x in rows.collect():
        seen[x.fold][x.role].add(x.entity)
        f = spans[x.fold]
        assert x.day <= f.train_end if x.role == "train" else f.valid_start <= x.day <= f.valid_end
        assert (f.valid_start - f.train_end).days > 100
    assert len(seen) == 4 and all(not s["train"] & s["valid"] and s["train"] and s["valid"] for s in seen.values())
    validated = [e for s in seen.values() for e in s["valid"]]
    assert len(validated) == len(set(validated))
    summary = folds.fold_summary(rows, "day", "entity", "y").collect()
    assert all(r.shared_entities == 0 and r.gap_days > 100 for r in summary)


def test_parts_are_balanced(spark):
    parts = folds.entity_parts(rows_of(spark), "entity", "y", 5).collect()
    positives, rows = defaultdict(int), defaultdict(int)
    for p in parts:
        positives[p.part] += p.positives
        rows[p.part] += p.rows
    assert len(parts) == 59 and sum(rows.values()) == 900
    assert max(positives.values()) - min(positives.values()) <= max(p.positives for p in parts)
    assert folds.entity_parts(rows_of(spark).limit(0), "entity", "y", 5).count() == 0


def plain(rows, trials, steps):
    """Costs by trial, one model after the other."""
    by = defaultdict(lambda: defaultdict(list))
    for x in rows:
        by[x.fold][x.role].append((x.a, x.b or 0.0, x.y))
    costs = []
    for t in trials:
        own = []
        for f in sorted(by):
            train, valid = (np.array(by[f][s], float) for s in ("train", "valid"))
            m, s = train[:, :2].mean(axis=0), train[:, :2].std(axis=0)
            x, y = np.column_stack([np.ones(len(train)), (train[:, :2] - m) / s]), train[:, 2]
            w, mo, v = np.zeros(3), np.zeros(3), np.zeros(3)
            row = np.where(y > 0, t["positive_weight"], 1.0)
            for k in range(1, steps + 1):
                g = ((1 / (1 + np.exp(-x @ w)) - y) * row) @ x / row.sum() + t["l2"] * w * [0, 1, 1]
                mo, v = 0.9 * mo + 0.1 * g, 0.999 * v + 0.001 * g**2
                w = w - t["rate"] * (mo / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            p = 1 / (1 + np.exp(-np.column_stack([np.ones(len(valid)), (valid[:, :2] - m) / s]) @ w))
            cut = [g / 100 for g in range(1, 100)]
            own.append(min(6e6 * ((p < c - 1e-12) & (valid[:, 2] == 1)).sum() + 250e3 * ((p >= c - 1e-12) & (valid[:, 2] == 0)).sum() for c in cut))
        costs.append(np.mean(own))
    return costs


def test_search_equals_exhaustive_run(spark):
    rows, _ = folds.grouped_folds(rows_of(spark), "day", "entity", "y", 3, 60)
    trials = folds.drawn_trials({"l2": [0.0, 0.5], "positive_weight": [1.0, 8.0], "rate": [0.05]}, 10)
    assert len(trials) == 4
    want = plain(rows.collect(), trials, 8)
    all_of = folds.search_folds(rows, ["a", "b"], "y", trials, (8,), keep=1.0).collect()
    assert [r.trial for r in all_of] == [0, 1, 2, 3] and np.allclose([r.cost for r in all_of], want)
    best = int(np.argmin(want))
    assert [r.trial for r in all_of if r.best] == [best]
    halved = folds.search_folds(rows, ["a", "b"], "y", trials, (4, 8)).collect()
    assert [r.trial for r in halved if r.best] == [best] and [sum(x.rung == k for x in halved) for k in (0, 1)] == [4, 2]
    last = next(r for r in halved if r.best)
    assert np.isclose(last.cost, want[best]) and last.steps == 8 and sum(r.kept for r in halved) == 2


def test_search_without_classes(spark):
    rows, _ = folds.grouped_folds(rows_of(spark), "day", "entity", "y", 3, 60)
    trials = [{"l2": 0.1, "positive_weight": 1.0, "rate": 0.1}]
    for df in (rows.limit(0), rows.where("y = 0")):
        got = folds.search_folds(df, ["a"], "y", trials, (1, 2)).collect()
        assert [(r.trial, r.cost, r.best) for r in got] == [(0, None, False)]
