"""Models on feature columns: MLlib fits, calibration, selection, mixtures and anomaly scores."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.operators import metrics
from solvara.operators.descent import summed
from solvara.operators.finance import apply_median_scale, fit_median_scale, winsorise
from solvara.operators.ordered import quantiles
from solvara.sources import saved

_HIDDEN = ["__x", "__raw", "__prob", "__pred"]


def _vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep").transform(df.fillna(0.0, list(features)))


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, kind: str = "logistic", weight: str | None = None, **options) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``score``: logistic, forest, boosted or network.

    ``weight`` names a row weight (class balance or cost); the network has none, there repeat rows.
    """
    names = {"featuresCol": "__x", "labelCol": label}
    makers = {
        "logistic": lambda: LogisticRegression(**{"maxIter": 50, "regParam": 0.01} | options, **names),
        "forest": lambda: RandomForestClassifier(**{"numTrees": 50, "maxDepth": 8, "seed": 42} | options, **names),
        "boosted": lambda: GBTClassifier(**{"maxIter": 20, "maxDepth": 4, "seed": 42} | options, **names),
        "network": lambda: MultilayerPerceptronClassifier(**{"layers": [len(features), 16, 2], "maxIter": 60, "seed": 42} | options, **names),
    }
    est = makers[kind]().setRawPredictionCol("__raw").setProbabilityCol("__prob").setPredictionCol("__pred")
    if weight:
        est = est.setWeightCol(weight)
    fitted = est.fit(_vector(train.withColumn(label, F.col(label).cast("double")), features))

    def score(df: DataFrame) -> DataFrame:
        return fitted.transform(_vector(df, features)).withColumn("score", vector_to_array("__prob")[1]).drop(*_HIDDEN)

    score.model = fitted
    return score


def balanced_weight(df: DataFrame, label: str, out: str = "weight", positive: float | None = None) -> DataFrame:
    """Row weights that give both classes one half of the total, or positives a given weight."""
    n = df.agg(F.avg(F.col(label).cast("double")).alias("__p"))
    p = F.col("__p")
    w = F.when(F.col(label) == 1, F.lit(positive)).otherwise(1.0) if positive else F.when(F.col(label) == 1, 0.5 / p).otherwise(0.5 / (1 - p))
    return df.crossJoin(F.broadcast(n)).withColumn(out, F.coalesce(w, F.lit(1.0))).drop("__p")


def calibrate(train: DataFrame, score: str, label: str, method: str = "isotonic") -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``calibrated`` from a score: isotonic, or sigmoid on its logit."""
    y = train.withColumn("__y", F.col(label).cast("double"))
    if method == "isotonic":
        fitted = IsotonicRegression(featuresCol=score, labelCol="__y", predictionCol="calibrated").fit(y)
        return fitted.transform
    logit = lambda df: df.withColumn("__logit", F.ln(F.greatest(F.col(score), F.lit(1e-6)) / F.greatest(1 - F.col(score), F.lit(1e-6))))
    fitted = fit_classifier(logit(y), ["__logit"], "__y", regParam=0.0)
    return lambda df: fitted(logit(df).withColumnRenamed("score", "__kept") if "score" in df.columns else logit(df)).withColumnRenamed("score", "calibrated").withColumnRenamed("__kept", "score").drop("__logit")


def weighted_vote(df: DataFrame, scores: Mapping[str, float], out: str = "vote") -> DataFrame:
    total = sum(scores.values())
    return df.withColumn(out, sum((F.col(c) * (w / total) for c, w in scores.items()), F.lit(0.0)))


def vote_weights(df: DataFrame, scores: Sequence[str], label: str) -> dict[str, float]:
    """Each score's area under its precision-recall curve, of all scores in one grouped job (one number each)."""
    rows = df.select(F.col(label).alias("__y"), *[F.col(s).cast("double").alias(s) for s in scores]).unpivot(["__y"], list(scores), "model", "s")
    found = metrics.pr_auc(metrics.score_counts(rows.where("s IS NOT NULL"), "s", "__y", ["model"]), ["model"])
    area = {r["model"]: r["pr_auc"] for r in found.collect()}
    return {s: area.get(s) or 0.0 for s in scores}


def random_probes(df: DataFrame, features: Sequence[str], label: str, seed: int = 42) -> DataFrame:
    """(feature, importance, kept): features whose boosted-tree importance is above both random probes'."""
    key = F.xxhash64(*features, F.lit(seed))
    probed = df.withColumns({"__uniform": (F.pmod(key, F.lit(1_000_003)) / 1_000_003.0), "__normal": F.sin(F.pmod(key, F.lit(999_983)) * 12.9898)})
    names = [*features, "__uniform", "__normal"]
    weight = fit_classifier(probed, names, label, "boosted").model.featureImportances.toArray()
    found = dict(zip(names, map(float, weight)))
    bar = max(found["__uniform"], found["__normal"])
    return df.sparkSession.createDataFrame([(n, found[n], found[n] > bar) for n in features], "feature string, importance double, kept boolean")


def prune_collinear(rho: Sequence[tuple[str, str, float]], importance: Mapping[str, float], limit: float = 0.75, prefer: Sequence[str] = ()) -> list[str]:
    """Features left when, worst pair first, the less important of each pair above the limit goes.

    ``prefer`` lists features that stay against any other.  ``rho`` holds a matrix of features, not rows.
    """
    left = set(importance)
    for a, b, r in sorted(rho, key=lambda x: (-abs(x[2]), x[0], x[1])):
        if abs(r) >= limit and a in left and b in left:
            rank = lambda f: (f in prefer, importance[f], f)
            left.discard(min(a, b, key=rank))
    return [f for f in importance if f in left]


def search(params: Mapping[str, Sequence], cost: Callable[[dict], float], tries: int = 10, seed: int = 42) -> tuple[dict, float]:
    """The cheapest of ``tries`` drawn parameter sets (all, if there are no more)."""
    grid = [dict(zip(params, x)) for x in itertools.product(*params.values())]
    drawn = grid if len(grid) <= tries else random.Random(seed).sample(grid, tries)
    return min(((p, cost(p)) for p in drawn), key=lambda x: x[1])


def mixture(df: DataFrame, features: Sequence[str], k: int, order_by: str, names: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Adds ``component`` (renumbered by the components' means of ``order_by``), its name and probability."""
    data = _vector(df, features)
    fitted = GaussianMixture(featuresCol="__x", predictionCol="__pred", probabilityCol="__prob", k=k, seed=seed).fit(data)
    at = list(features).index(order_by)
    means = [float(r["mean"][at]) for r in fitted.gaussiansDF.select("mean").collect()]
    place = {old: new for new, old in enumerate(sorted(range(k), key=lambda j: (means[j], j)))}
    number = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])[F.col("__pred")]
    out = fitted.transform(data).withColumn("component", number).withColumn("probability", F.array_max(vector_to_array("__prob")))
    label = F.create_map(*[F.lit(x) for kv in enumerate(names) for x in kv])[F.col("component")] if names else F.concat(F.lit("c"), F.col("component"))
    return out.withColumn("component_name", label).drop(*_HIDDEN)


def mixture_bic(df: DataFrame, features: Sequence[str], ks: Sequence[int], seed: int = 42) -> DataFrame:
    """(k, log_likelihood, bic, aic) of full-covariance mixtures."""
    data = _vector(df, features).cache()
    n, d, rows = data.count(), len(features), []
    for k in ks:
        ll = float(GaussianMixture(featuresCol="__x", predictionCol="__pred", probabilityCol="__prob", k=k, seed=seed).fit(data).summary.logLikelihood)
        free = k * (d + d * (d + 1) / 2) + k - 1
        rows.append((k, ll, free * math.log(max(n, 1)) - 2 * ll, 2 * free - 2 * ll))
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, log_likelihood double, bic double, aic double")


def isolation_forest(df: DataFrame, key: str, features: Sequence[str], trees: int = 100, sample: int = 256, contamination: float = 0.03, seed: int = 42) -> DataFrame:
    """(key, anomaly, flagged): mean isolation depth as a score in 0..1, flagged above its quantile.

    Each tree is grown on ``sample`` rows drawn by a seeded hash, a bounded number in all; every row
    is scored where it lies.
    """
    x = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    drawn = x.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(sample * min(trees, 20)).toPandas()[list(features)].to_numpy()
    rng = np.random.default_rng(seed)

    def grow(rows: np.ndarray, depth: int, limit: int):
        n = len(rows)
        low, high = (rows.min(0), rows.max(0)) if n else (None, None)
        if n <= 1 or depth >= limit or not (high > low).any():
            return depth + _path(n)
        f = int(rng.choice(np.flatnonzero(high > low)))
        cut = float(rng.uniform(low[f], high[f]))
        return f, cut, grow(rows[rows[:, f] < cut], depth + 1, limit), grow(rows[rows[:, f] >= cut], depth + 1, limit)

    size = min(sample, len(drawn))
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    grown = [grow(drawn[rng.choice(len(drawn), size, replace=False)], 0, limit) for _ in range(trees)] if size else []
    held = df.sparkSession.sparkContext.broadcast((grown, _path(size) or 1.0))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        rows, (forest, norm) = np.stack([c.to_numpy() for c in columns], axis=1), held.value
        total = np.zeros(len(rows))

        def walk(node, at: np.ndarray) -> None:
            if not isinstance(node, tuple):
                total[at] += node
                return
            f, cut, left, right = node
            low = rows[at, f] < cut
            walk(left, at[low])
            walk(right, at[~low])

        for tree in forest:
            walk(tree, np.arange(len(rows)))
        return pd.Series(2.0 ** (-total / max(len(forest), 1) / norm))

    scored = x.select(key, score(*features).alias("anomaly"))
    edge = scored.agg(F.percentile_approx("anomaly", 1 - contamination, 10_000).alias("__edge"))
    return scored.crossJoin(F.broadcast(edge)).withColumn("flagged", F.col("anomaly") > F.col("__edge")).drop("__edge")


def _path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


# ---------------------------------------------------------------- mixtures with named components


def regime_order(rate: str, unemployment: str, growth: str) -> Callable[[list[dict[str, float]]], list[int]]:
    """Three components as expansion, tightening and crisis: tightening has the highest rate, crisis the highest
    unemployment (the lowest growth, if that is the same one), expansion is the rest."""

    def order(means: list[dict[str, float]]) -> list[int]:
        every = range(len(means))
        tight = max(every, key=lambda k: (means[k][rate], -k))
        crisis = max(every, key=lambda k: (means[k][unemployment], -k))
        if crisis == tight:
            crisis = min((k for k in every if k != tight), key=lambda k: (means[k][growth], k))
        return [*(k for k in every if k not in (tight, crisis)), tight, crisis]

    return order


def sum_order(*columns: str) -> Callable[[list[dict[str, float]]], list[int]]:
    """Components by the sum of some means, from the least."""
    return lambda means: sorted(range(len(means)), key=lambda k: (sum(means[k][c] for c in columns), k))


def normalised(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """``<s>_prob``: each score's share of their sum (equal shares of 0), ``component`` and ``component_name`` of the
    largest, the first one where they tie."""
    total = sum((F.col(s) for s in scores), F.lit(0.0))
    out = df.withColumns({f"{s}_prob": F.coalesce(F.try_divide(F.col(s).cast("double"), total), F.lit(1.0 / len(scores))) for s in scores})
    p = F.array(*[F.col(f"{s}_prob") for s in scores])
    out = out.withColumn("component", (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    return out.withColumn("component_name", F.array(*[F.lit(s) for s in scores])[F.col("component")])


_EPS = float(np.finfo(float).eps)


def _shares(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(densities, shares) of rows: weighted densities summed over the components, and each component's part of that.

    As in MLlib, directions without variance count for nothing and every density has the machine's epsilon added.
    """
    d, p = x.shape[1], np.empty((len(x), len(weights)))
    for j, (w, m, c) in enumerate(zip(weights, means, covs)):
        values, vectors = np.linalg.eigh(c)
        kept = values > _EPS * values.max() * d
        root = vectors[:, kept] / np.sqrt(values[kept])
        p[:, j] = _EPS + w * np.exp(-0.5 * (d * math.log(2 * math.pi) + np.log(values[kept]).sum()) - 0.5 * (((x - m) @ root) ** 2).sum(1))
    total = p.sum(1)
    return total, p / total[:, None]


def _likeliest_mixture(rows: DataFrame, features: Sequence[str], k: int, seeds: Sequence[int], rounds: int = 100, tolerance: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, covariances) of the likeliest of several full-covariance fits, one for each seed.

    The fits begin where MLlib's ``GaussianMixture`` does and take its steps, but a round of all of them is one job of sums
    over blocks of rows, not a job with a shuffle for each.
    """
    given, d = _vector(rows, features).select("__x"), len(features)
    given.cache()
    first = [GaussianMixture(featuresCol="__x", predictionCol="__pred", probabilityCol="__prob", k=k, seed=s, maxIter=0).fit(given) for s in seeds]
    fits = [(np.array(m.weights), *(np.array([g[c].toArray() for g in m.gaussiansDF.select(c).collect()]) for c in ("mean", "cov"))) for m in first]
    given.unpersist()
    found, x = [-math.inf] * len(fits), rows.select(*features)
    live, size = list(range(len(fits))), 1 + k * (1 + d + d * d)
    for _ in range(rounds):
        now = [fits[f] for f in live]

        def sums(b, now=now) -> np.ndarray:
            block = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(d)], axis=1)
            products, out = (block[:, :, None] * block[:, None, :]).reshape(len(block), d * d), []
            for fit in now:
                total, share = _shares(block, *fit)
                out += [[np.log(total).sum()], share.sum(0), (share.T @ block).ravel(), (share.T @ products).ravel()]
            return np.concatenate(out)

        got, moving = summed(x, sums, size * len(live)).reshape(len(live), size), []
        for f, v in zip(live, got):
            n, m, q = v[1 : k + 1], v[k + 1 : k + 1 + k * d].reshape(k, d), v[k + 1 + k * d :].reshape(k, d, d)
            m = m / n[:, None]
            fits[f] = (n / n.sum(), m, q / n[:, None, None] - m[:, :, None] * m[:, None, :])
            if abs(v[0] - found[f]) > tolerance:
                moving.append(f)
            found[f] = v[0]
        live = moving
        if not live:
            break
    return fits[max(range(len(fits)), key=lambda f: found[f])]


def named_mixture(df: DataFrame, features: Sequence[str], k: int, order: Callable[[list[dict[str, float]]], list[int]], names: Sequence[str], winsor: bool = False, seed: int = 42, starts: int = 5) -> DataFrame:
    """``df`` with a probability column for each named component, their sum being 1, and ``component`` and
    ``component_name`` of the largest.

    Missing values take the median, values beyond P1 and P99 are moved there if ``winsor`` says so, all are
    scaled, and ``order`` puts the fitted components (their means in the features' own units) in the order of names.
    Of ``starts`` fits the likeliest is taken.
    """
    data = saved(df.withColumns({f"__f_{f}": F.col(f).cast("double") for f in features}), "mixture")
    inner = [f"__f_{f}" for f in features]
    if winsor:
        data = saved(winsorise(data, inner), "winsorised")
    fitted = saved(fit_median_scale(data, inner), "scale")
    rows = saved(apply_median_scale(data, fitted, inner).fillna(0.0, inner), "scaled")
    units = fitted.first()
    weights, centres, covs = _likeliest_mixture(rows, inner, k, [seed + j for j in range(starts)])
    means = [{f: float(m[j]) * (units[f"__f_{f}__std"] or 1.0) + units[f"__f_{f}__mean"] for j, f in enumerate(features)} for m in centres]
    place = order(means)

    @F.pandas_udf("array<double>")
    def shares(*columns: pd.Series) -> pd.Series:
        return pd.Series(list(_shares(np.stack([c.to_numpy() for c in columns], axis=1), weights[place], centres[place], covs[place])[1]))

    out = rows.withColumn("__p", shares(*inner))
    out = out.withColumns({n: F.col("__p")[j] for j, n in enumerate(names)}) if not set(names) & set(df.columns) else out
    return normalised(out, names).drop("__p", *names, *inner, *_HIDDEN)


def diagonal_mixture(df: DataFrame, features: Sequence[str], k: int, rounds: int = 60, tolerance: float = 1e-3, seed: int = 42) -> tuple[float, int, int]:
    """(log-likelihood, rows, free parameters) of a mixture with diagonal covariances.

    Each round of expectation and maximisation is one aggregate of sufficient statistics over all rows.
    """
    x = saved(df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]), "mixture")
    total = x.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(f).alias(f) for f in features]).first()
    n, d = total["n"], len(features)
    start = x.distinct().orderBy(F.xxhash64(*features, F.lit(seed)), *features).limit(k).collect()
    mean = [[float(r[f]) for f in features] for r in start]
    var = [[max(total[f] or 0.0, 1e-6) for f in features] for _ in start]
    weight, last = [1.0 / len(start)] * len(start), -math.inf
    for _ in range(rounds):
        logs = [
            sum((-0.5 * (F.pow(F.col(f) - m, F.lit(2.0)) / v + math.log(2 * math.pi * v)) for f, m, v in zip(features, mean[j], var[j])), F.lit(math.log(max(weight[j], 1e-300))))
            for j in range(len(start))
        ]
        rows = x.withColumn("__l", F.array(*logs)).withColumn("__top", F.array_max("__l"))
        rows = rows.withColumn("__ll", F.col("__top") + F.ln(F.aggregate("__l", F.lit(0.0), lambda a, l: a + F.exp(l - F.col("__top")))))
        rows = rows.withColumns({f"__r{j}": F.exp(F.col("__l")[j] - F.col("__ll")) for j in range(len(start))})
        each = [e for j in range(len(start)) for e in (F.sum(f"__r{j}"), *[F.sum(F.col(f"__r{j}") * F.col(f)) for f in features], *[F.sum(F.col(f"__r{j}") * F.col(f) * F.col(f)) for f in features])]
        got = [float(v) for v in rows.agg(F.sum("__ll"), *each).first()]
        for j in range(len(start)):
            own = got[1 + j * (2 * d + 1) : 1 + (j + 1) * (2 * d + 1)]
            size = max(own[0], 1e-12)
            weight[j] = own[0] / n
            mean[j] = [s / size for s in own[1 : d + 1]]
            var[j] = [max(q / size - m * m, 1e-6) for q, m in zip(own[d + 1 :], mean[j])]
        if got[0] - last < tolerance * n:
            break
        last = got[0]
    return got[0], n, len(start) * 2 * d + len(start) - 1


def mixture_selection(df: DataFrame, features: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5), seed: int = 42) -> DataFrame:
    """(covariance, k, log_likelihood, bic, aic, best) of full and diagonal mixtures; best has the least BIC."""
    full = [("full", r["k"], r["log_likelihood"], r["bic"], r["aic"]) for r in mixture_bic(df, features, ks, seed).collect()]
    diag = []
    for k in ks:
        ll, n, free = diagonal_mixture(df, features, k, seed=seed)
        diag.append(("diag", k, ll, free * math.log(max(n, 1)) - 2 * ll, 2 * free - 2 * ll))
    rows = full + diag
    least = min(r[3] for r in rows)
    return df.sparkSession.createDataFrame([(*r, r[3] == least) for r in rows], "covariance string, k int, log_likelihood double, bic double, aic double, best boolean")


# ---------------------------------------------------------------- scorecard on weights of evidence


def merged_bins(bins: Sequence[tuple[float, int, int]], min_share: float = 0.05, most: int = 6) -> list[tuple[float, int, int]]:
    """Neighbouring bins (upper edge, good, bad) merged until each has ``min_share`` of the rows, the event rate
    is monotone, and there are at most ``most``.  Of neighbours the pair of the nearest rates is merged."""
    bins = [b for b in bins if b[1] + b[2]]
    total = sum(g + b for _, g, b in bins)
    rate = lambda x: x[2] / (x[1] + x[2])

    def join(k: int) -> None:
        a, b = bins[k], bins[k + 1]
        bins[k : k + 2] = [(b[0], a[1] + b[1], a[2] + b[2])]

    def gap(k: int) -> tuple[float, int]:
        return abs(rate(bins[k]) - rate(bins[k + 1])), k

    while len(bins) > 1:
        small = [k for k, (_, g, b) in enumerate(bins) if g + b < min_share * total]
        if small:
            k = min(small, key=lambda j: (bins[j][1] + bins[j][2], j))
            join(min((x for x in (k - 1, k) if 0 <= x < len(bins) - 1), key=gap))
            continue
        steps = [rate(b) - rate(a) for a, b in zip(bins, bins[1:])]
        turns = [k for k in range(len(steps)) if (steps[k] < 0 if rate(bins[-1]) >= rate(bins[0]) else steps[k] > 0)]
        if not turns and len(bins) <= most:
            break
        join(min(turns or range(len(bins) - 1), key=gap))
    return bins


def woe_table(df: DataFrame, feature: str, label: str, prebins: int = 20, min_share: float = 0.05, most: int = 6) -> list[dict]:
    """The bins of a feature: low (not included), high, good, bad, woe and iv; nulls have a bin of their own.

    Rows are counted in quantile bins (each of 1 / ``prebins``, 5 % by default), and only their counts
    are merged.  ``woe`` is ln((good / all good) / (bad / all bad)), with a half added to each count.
    """
    edges = quantiles(df, feature, [k / prebins for k in range(1, prebins)]).first()["q"]
    edges = sorted(set(edges or []))
    x = F.col(feature).cast("double")
    place = F.when(x.isNull(), -1).otherwise(sum(((x > e).cast("int") for e in edges), F.lit(0)))
    y = F.col(label).cast("int")
    counts = {r["b"]: (r["good"], r["bad"]) for r in df.groupBy(place.alias("b")).agg(F.sum(1 - y).alias("good"), F.sum(y).alias("bad")).collect()}
    good, bad = (sum(c[j] for c in counts.values()) for j in (0, 1))
    found = merged_bins([(e, *counts.get(k, (0, 0))) for k, e in enumerate([*edges, math.inf])], min_share, most)
    rows, low = [], -math.inf
    for high, g, b in [*found, *([(None, *counts[-1])] if -1 in counts else [])]:
        share = ((g + 0.5) / (good + 0.5), (b + 0.5) / (bad + 0.5))
        woe = math.log(share[0] / share[1])
        rows.append({"feature": feature, "low": None if high is None else low, "high": high, "good": int(g), "bad": int(b), "woe": woe, "iv": (share[0] - share[1]) * woe})
        low = high if high is not None else low
    return rows


def woe_scorecard(train: DataFrame, features: Sequence[str], label: str, low: float = 300.0, high: float = 850.0, c: float = 0.1) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``score`` (probability) and ``points``; its ``table`` has the bins with their points.

    Features become weights of evidence, a balanced logistic model is fitted to them, and points run from
    ``low`` for the worst bins together to ``high`` for the best.
    """
    tables = {f: woe_table(train, f, label) for f in features}

    def evidence(df: DataFrame) -> DataFrame:
        made = {}
        for f, bins in tables.items():
            x = F.col(f).cast("double")
            missing = next((b["woe"] for b in bins if b["high"] is None), 0.0)
            out = F.when(x.isNull(), F.lit(missing))
            for b in (b for b in bins if b["high"] is not None and b["high"] < math.inf):
                out = out.when(x <= b["high"], F.lit(b["woe"]))
            made[f"__woe_{f}"] = out.otherwise(F.lit(next((b["woe"] for b in bins if b["high"] == math.inf), 0.0)))
        return df.withColumns(made)

    names = [f"__woe_{f}" for f in features]
    rows = evidence(train)
    score = fit_classifier(balanced_weight(rows, label, "__weight"), names, label, "logistic", "__weight", maxIter=300, regParam=1.0 / (c * max(rows.count(), 1)))
    weight = dict(zip(features, map(float, score.model.coefficients)))
    ends = {f: (min(weight[f] * b["woe"] for b in tables[f]), max(weight[f] * b["woe"] for b in tables[f])) for f in features}
    best, worst = sum(e[0] for e in ends.values()), sum(e[1] for e in ends.values())
    scale = (high - low) / (worst - best) if worst > best else 0.0

    def apply(df: DataFrame) -> DataFrame:
        out = score(evidence(df))
        margin = sum((F.col(f"__woe_{f}") * weight[f] for f in features), F.lit(0.0))
        return out.withColumn("points", high - (margin - best) * scale).drop(*names)

    apply.table = [b | {"points": high / len(features) - (weight[f] * b["woe"] - best / len(features)) * scale} for f in features for b in tables[f]]
    return apply
