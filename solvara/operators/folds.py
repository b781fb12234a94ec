"""Purged folds with separated entities, and a parameter search by successive halving over them."""

from __future__ import annotations

import itertools
import random
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.operators.descent import Adam, summed
from solvara.operators.metrics import purged_folds
from solvara.operators.ordered import running_sums
from solvara.sources import saved

# ---------------------------------------------------------------- folds


def entity_parts(df: DataFrame, entity: str, label: str, parts: int) -> DataFrame:
    """(entity, part, rows, positives): whole entities dealt to parts 1.., balanced by positives and rows.

    Entities in the order of positives, rows (both falling) and id are dealt back and forth: 1 2 3 3 2 1 1
    and so on, so two parts differ in positives by no more than the largest entity has.  Rows without an entity
    are one entity (null).
    """
    totals = df.groupBy(entity).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum((F.col(label) == 1).cast("long")), F.lit(0)).alias("positives"))
    placed = running_sums(totals.withColumn("__one", F.lit(1).cast("long")), [F.desc("positives"), F.desc("rows"), entity], ["__one"])
    rank = F.col("__one_upto") - 1
    within = rank % parts
    part = F.when(F.floor(rank / parts) % 2 == 0, within).otherwise(parts - 1 - within) + 1
    return placed.select(entity, part.cast("int").alias("part"), "rows", "positives")


def grouped_folds(df: DataFrame, date: str, entity: str, label: str, n_splits: int = 5, purge_days: int = 365) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``fold`` and ``role`` (train or valid), and the table of folds.

    The folds are those of ``purged_folds``.  Each fold validates on the entities of its own part alone and
    trains on all others, so no entity is on both sides and each entity is validated in one fold at most.  A row
    stands in each fold where it has a role.  Rows without a date have none.
    """
    folds = saved(purged_folds(df, date, n_splits, purge_days), "folds")
    part = saved(entity_parts(df, entity, label, n_splits), "parts").select(F.col(entity).alias("__entity"), F.col("part").alias("__part"))
    named = folds.select("fold", *[F.col(c).alias(f"__{c}") for c in ("train_end", "valid_start", "valid_end")])
    rows = df.join(part, F.col(entity).eqNullSafe(F.col("__entity"))).join(F.broadcast(named), F.lit(True))
    own = F.col("__part") == F.col("fold")
    role = F.when(~own & (F.col(date) <= F.col("__train_end")), "train").when(own & F.col(date).between(F.col("__valid_start"), F.col("__valid_end")), "valid")
    return rows.withColumn("role", role).where("role IS NOT NULL").select(*df.columns, "fold", "role"), folds


def fold_summary(rows: DataFrame, date: str, entity: str, label: str) -> DataFrame:
    """Per fold: rows and positives of both roles, entities on both sides, and days from the last training to the first validation date."""
    train, valid, y = F.col("role") == "train", F.col("role") == "valid", F.col(label) == 1
    sides = rows.groupBy("fold", entity).agg(F.count_if(train).alias("a"), F.count_if(valid).alias("b"))
    shared = sides.groupBy("fold").agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared_entities"))
    out = rows.groupBy("fold").agg(
        F.count_if(train).alias("train_rows"), F.count_if(train & y).alias("train_positives"), F.count_if(valid).alias("valid_rows"), F.count_if(valid & y).alias("valid_positives"),
        F.datediff(F.min(F.when(valid, F.col(date))), F.max(F.when(train, F.col(date)))).alias("gap_days"),
    )
    return out.join(shared, "fold")


# ---------------------------------------------------------------- search


def drawn_trials(params: Mapping[str, Sequence[float]], tries: int, seed: int = 42) -> list[dict[str, float]]:
    """``tries`` parameter sets of the grid (all, if there are no more) in a seeded order."""
    grid = [dict(zip(params, x)) for x in itertools.product(*params.values())]
    return grid if len(grid) <= tries else random.Random(seed).sample(grid, tries)


def search_folds(
    rows: DataFrame, features: Sequence[str], label: str, trials: Sequence[Mapping[str, float]], rungs: Sequence[int] = (10, 20, 40), keep: float = 0.5,
    fn_cost: float = 6e6, fp_cost: float = 250e3,
) -> DataFrame:
    """Successive halving over purged folds: (trial, <parameters>, rung, steps, cost, kept, best) of each trial at each rung it reached.

    ``rows`` have ``fold`` and ``role``.  A trial is a logistic model with ``l2``, ``positive_weight`` and
    ``rate``; all trials of all folds are fitted together, one job a step, in which each task adds up the
    gradients of all models over its rows.  At the end of a rung one job counts the validation scores of
    all models in hundredths; a model's cost is the least over thresholds 0.01 to 0.99 of ``fn_cost * fn + fp_cost *
    fp``, a trial's the mean over folds that have both classes on both sides.  The cheapest ``keep`` of the trials go on
    to the next rung (ties by trial number); with ``keep=1`` all do, which is the exhaustive search.

    Features are standardised by each fold's training rows; nulls and NaN count as 0.  Without a usable
    fold costs are null and no trial goes beyond the first rung.
    """
    spark, features = rows.sparkSession, list(features)
    clean = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features]
    data = rows.where(F.col(label).isNotNull()).select(F.col("fold").cast("int").alias("fold"), (F.col("role") == "train").alias("train"), F.col(label).cast("double").alias("y"), *[x.alias(f"c{k}") for k, x in enumerate(clean)])
    data = saved(data, "search")
    moments = [g(F.when(F.col("train"), F.col(f"c{k}"))).alias(f"{n}{k}") for k in range(len(features)) for n, g in (("m", F.avg), ("s", F.stddev_pop))]
    classes = [F.count_if((F.col("train") == side) & (F.col("y") == y)).alias(f"n{int(side)}{y}") for side in (True, False) for y in (0, 1)]
    stats = {r.fold: r for r in data.groupBy("fold").agg(*moments, *classes).collect()}
    usable = sorted(f for f, r in stats.items() if min(r[f"n{a}{y}"] for a in (0, 1) for y in (0, 1)) > 0)
    d, place = len(features) + 1, {f: k for k, f in enumerate(usable)}
    mean = np.array([[stats[f][f"m{k}"] for k in range(len(features))] for f in usable]).reshape(len(usable), len(features))
    std = np.array([[stats[f][f"s{k}"] for k in range(len(features))] for f in usable]).reshape(len(usable), len(features))
    scale = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
    rate, l2, weight = (np.array([float(t[n]) for t in trials]) for n in ("rate", "l2", "positive_weight"))

    def parts(b: pa.RecordBatch):
        """(fold, is training, labels, features with a 1) for each usable fold of a batch."""
        fold, train, y = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        x = np.stack([b.column(k + 3).to_numpy(zero_copy_only=False) for k in range(len(features))], axis=1) if features else np.zeros((len(y), 0))
        for f, k in place.items():
            own = fold == f
            if own.any():
                yield k, train[own], y[own], np.column_stack([np.ones(own.sum()), (x[own] - mean[k]) * scale[k]])

    theta, alive, out = np.zeros((len(trials), len(usable), d)), list(range(len(trials))), []
    adam, done = Adam(0), 0
    adam.m = adam.v = np.zeros_like(theta)
    for rung, steps in enumerate(rungs):
        for _ in range(done, steps if usable else done):
            live, w = np.array(alive), theta[alive]

            def gradients(b: pa.RecordBatch, live=live, w=w) -> np.ndarray:
                total, n = np.zeros((len(live), len(usable), d)), np.zeros((len(live), len(usable)))
                for k, train, y, x in parts(b):
                    x, y = x[train], y[train]
                    own = np.where(y[:, None] > 0, weight[live], 1.0)
                    total[:, k] += ((0.5 * (1 + np.tanh(0.5 * (x @ w[:, k].T))) - y[:, None]) * own).T @ x
                    n[:, k] += own.sum(axis=0)
                return np.concatenate([total.reshape(-1), n.reshape(-1)])

            size = len(live) * len(usable) * d
            sums = summed(data, gradients, size + len(live) * len(usable))
            found = np.zeros_like(theta)
            found[live] = sums[:size].reshape(len(live), len(usable), d) / np.maximum(sums[size:], 1e-300).reshape(len(live), len(usable), 1)
            found[live, :, 1:] += l2[live, None, None] * theta[live, :, 1:]
            moved = adam.step(theta, found, rate[:, None, None])
            theta[live] = moved[live]
        done = max(done, steps)
        cost = _costs(data, parts, theta[alive], len(usable), fn_cost, fp_cost) if usable else [None] * len(alive)
        order = sorted(range(len(alive)), key=lambda k: (cost[k] if cost[k] is not None else 0.0, alive[k]))
        go_on = {alive[k] for k in order[: max(1, -(-int(len(alive) * keep * 1000) // 1000))]} if rung < len(rungs) - 1 and usable else set()
        best = alive[order[0]] if not go_on and usable else None
        out += [(t, *[float(trials[t][n]) for n in trials[t]], rung, steps, c, t in go_on, t == best) for t, c in zip(alive, cost)]
        if not go_on:
            break
        alive = sorted(go_on)
    names = ", ".join(f"{n} double" for n in (trials[0] if trials else {}))
    return spark.createDataFrame(out, f"trial int, {names + ', ' if names else ''}rung int, steps int, cost double, kept boolean, best boolean")


def _costs(data: DataFrame, parts, theta: np.ndarray, folds: int, fn_cost: float, fp_cost: float) -> list[float]:
    """The mean over folds of each trial's cost at its fold's cheapest threshold."""
    trials = len(theta)

    def counts(b: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((2, folds, trials, 100))
        for k, train, y, x in parts(b):
            x, y = x[~train], y[~train]
            reach = np.clip(np.floor(np.round(100 * 0.5 * (1 + np.tanh(0.5 * (x @ theta[:, k].T))), 9)), 0, 99).astype(int)
            for side in (0, 1):
                own = reach[y == side]
                flat = own + 100 * np.arange(trials)
                total[side, k] += np.bincount(flat.reshape(-1), minlength=100 * trials).reshape(trials, 100)
        return total.reshape(-1)

    found = summed(data, counts, 2 * folds * trials * 100).reshape(2, folds, trials, 100)
    below = np.cumsum(found, axis=3)
    fn, fp = below[1, :, :, :99], found[0].sum(axis=2, keepdims=True) - below[0, :, :, :99]
    return (fn * fn_cost + fp * fp_cost).min(axis=2).mean(axis=0).tolist()
