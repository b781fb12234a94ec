"""Batch scoring: decisions, explanations, scorecards and freshest-record assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvara.functions import inflation_level, ladder, logistic
from solvara.operators.finance import apply_median_scale
from solvara.operators.ordered import quantiles

#: Probability tiers and scorecard bands, from the highest bound down.
TIERS = ((0.50, "critical"), (0.25, "high"), (0.10, "moderate"))
BANDS = ((750, "A"), (700, "B"), (650, "C"), (600, "D"), (550, "E"))
#: Rating bands of the two scorecard services ("D" below), and decisions of the first.
RATING_BANDS = ((750, "AAA"), (700, "AA"), (650, "A"), (600, "BBB"), (550, "BB"), (500, "B"), (450, "CCC"))
SERVICE_BANDS = ((780, "AAA"), (720, "AA"), (660, "A"), (600, "BBB"), (540, "BB"), (480, "B"), (400, "CCC"))
RATING_DECISIONS = ((600, "approve"), (550, "watch"), (500, "high risk"))


def score_batch(df: DataFrame, probability: Column | str, tau: float, fn_cost: float = 6e6, fp_cost: float = 250e3) -> DataFrame:
    """probability, decision, tier and expected cost (p * FN if accepted, (1 - p) * FP if rejected)."""
    p = F.col(probability) if isinstance(probability, str) else probability
    out = df.withColumn("probability", p)
    reject = F.col("probability") >= tau
    return out.withColumns(
        {
            "decision": F.when(reject, "reject").otherwise("accept"),
            "tier": ladder("probability", TIERS, "low"),
            "expected_cost": F.when(reject, (1.0 - F.col("probability")) * fp_cost).otherwise(F.col("probability") * fn_cost),
        }
    )


def portfolio_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.avg("probability").alias("mean_pd"), F.sum((F.col("decision") == "reject").cast("long")).alias("alerts"), F.sum("expected_cost").alias("total_cost"))


def structural_margin(dtd: Column, working_capital_ratio: Column) -> Column:
    """The fallback margin: -0.75 * distance to default - 2.8 * working capital share + 1.10."""
    return -0.75 * dtd - 2.8 * working_capital_ratio + 1.10


def structural_pd(dtd: Column, working_capital_ratio: Column) -> Column:
    return F.least(F.greatest(logistic(structural_margin(dtd, working_capital_ratio)), F.lit(0.001)), F.lit(0.999))


def scorecard_points(p: Column, low: float = 300.0, high: float = 850.0) -> Column:
    return high - (high - low) * p


def rated(df: DataFrame, points: str) -> DataFrame:
    """Both rating bands, the decision and the implied probability of scorecard points kept within 300..850."""
    p = F.least(F.greatest(F.col(points), F.lit(300.0)), F.lit(850.0))
    out = df.withColumn(points, p)
    return out.withColumns(
        {
            "rating": ladder(points, RATING_BANDS, "D"),
            "service_rating": ladder(points, SERVICE_BANDS, "D"),
            "decision": ladder(points, RATING_DECISIONS, "reject"),
            "implied_pd": F.least(F.greatest((850.0 - F.col(points)) / 550.0, F.lit(0.0001)), F.lit(0.9999)),
        }
    )


def fallback_pd(df: DataFrame, out: str = "pd") -> DataFrame:
    """A probability from four flags: negative working capital, negative income, distance to default below 1
    and assets above three times the equity (2.5 times without positive equity), within 0.001..0.999."""
    c = F.col
    assets = F.coalesce(F.nullif(c("total_assets"), F.lit(0.0)), F.lit(1.0))
    equity = F.coalesce(F.nullif(c("equity"), F.lit(0.0)), F.lit(1.0))
    leverage = F.when(equity > 0, assets / F.greatest(equity, F.lit(1.0))).otherwise(2.5)
    logit = F.lit(-2.15)
    for flag, weight in ((c("working_capital") < 0, 0.85), (c("net_income") < 0, 0.64), (c("distance_to_default") < 1.0, 0.75), (leverage > 3.0, 0.55)):
        logit = logit + F.when(flag, weight).otherwise(0.0)
    return df.withColumn(out, F.least(F.greatest(logistic(logit), F.lit(0.001)), F.lit(0.999)))


def prepared_features(df: DataFrame, features: Sequence[str], defaults: Mapping[str, float], fitted: DataFrame, inflation: str | None = None) -> DataFrame:
    """Request rows as model input: absent columns and nulls get their defaults, a yearly inflation rate
    becomes an index level, then missing values get the training median and all are scaled.

    ``fitted`` is the row of ``fit_median_scale``; text that isn't a number counts as null.
    """
    have = set(df.columns)
    value = {f: F.col(f).try_cast("double") if f in have else F.lit(None).cast("double") for f in features}
    value = {f: F.when(~F.isnan(v), v) for f, v in value.items()}
    if inflation in value:
        value[inflation] = inflation_level(value[inflation], "signed")
    filled = {f: F.coalesce(v, F.lit(defaults.get(f)).cast("double")) for f, v in value.items()}
    return apply_median_scale(df.withColumns(filled), fitted, list(features))


def cohort_rows(df: DataFrame, key: str, label: str, healthy: Column, n: int, mode: str = "random", seed: int = 42, distressed: float = 0.12) -> DataFrame:
    """``n`` repeatable sample rows of a cohort: solvent (label 0, healthy ones first if there are any),
    distressed (label 1), or random, with about a share of distressed rows."""
    order = F.xxhash64(F.col(key), F.lit(seed))
    bad, good = F.col(label) == 1, F.col(label) == 0
    if mode == "distressed":
        return df.where(bad).orderBy(order, key).limit(n)
    if mode == "solvent":
        return df.where(good).orderBy(F.when(healthy, 0).otherwise(1), order, key).limit(n)
    first = round(distressed * n)
    few = df.where(bad).orderBy(order, key).limit(first)
    return few.unionByName(df.where(good).orderBy(order, key).limit(n - first))


def synthetic_rows(df: DataFrame, features: Sequence[str], n: int, positive: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """``n`` rows drawn around the medians: normal noise of a tenth of the quartile distance (at least 15 % of
    the median, and 1); ``positive`` features are at least 0.01."""
    stats = None
    for f in features:
        one = quantiles(df, f, [0.25, 0.5, 0.75], out=f)
        stats = one if stats is None else stats.crossJoin(F.broadcast(one))
    rows = df.sparkSession.range(n).crossJoin(F.broadcast(stats))
    uniform = lambda k, salt: (F.pmod(F.xxhash64("id", F.lit(k), F.lit(salt), F.lit(seed)), F.lit(2**40)) + 0.5) / float(2**40)
    made = []
    for k, f in enumerate(features):
        noise = F.sqrt(-2.0 * F.ln(uniform(k, 1))) * F.cos(6.283185307179586 * uniform(k, 2))
        q = F.col(f)
        spread = F.greatest(F.abs(q[2] - q[0]), F.abs(q[1]) * 0.15, F.lit(1.0))
        value = q[1] + 0.10 * spread * noise
        made.append(F.round(F.greatest(value, F.lit(0.01)) if f in positive else value, 2).alias(f))
    return rows.select("id", *made)


def attributions(df: DataFrame, key: str, coefficients: Mapping[str, float], means: DataFrame) -> DataFrame:
    """(key, feature, phi): exact additive parts of a linear margin, ``coef * (x - mean)``.

    ``means`` is one row with the features' background means.
    """
    rows = df.crossJoin(F.broadcast(means.select(*[F.col(c).alias(f"__m_{c}") for c in coefficients])))
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (F.col(c) - F.col(f"__m_{c}"))).alias("phi")) for c, w in coefficients.items()])
    return rows.select(key, F.inline(parts))


def global_importance(phi: DataFrame, pillars: Mapping[str, str]) -> DataFrame:
    """feature, pillar, share of the mean absolute attribution."""
    pillar = F.create_map(*[F.lit(x) for kv in pillars.items() for x in kv])[F.col("feature")]
    per = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    return per.select("feature", pillar.alias("pillar"), (F.col("mean_abs") / F.sum("mean_abs").over(Window.partitionBy())).alias("share"))


def top_drivers(phi: DataFrame, key: str, k: int = 6) -> DataFrame:
    """The ``k`` largest attributions by size of each row, with rank and direction."""
    w = Window.partitionBy(key).orderBy(F.abs("phi").desc(), "feature")
    return phi.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("direction", F.when(F.col("phi") > 0, "raises").otherwise("lowers"))


def freshest(sources: Sequence[DataFrame], key: str, ts: str, fields: Mapping[str, tuple[int, object]], now: Column) -> DataFrame:
    """For each key and field the newest non-null value younger than the field's days to live, else its default."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    age = F.datediff(now, F.col(ts))
    made = []
    for c, (ttl, default) in fields.items():
        ok = F.col(c).isNotNull() & age.between(0, ttl)
        made.append(F.coalesce(F.max_by(F.when(ok, F.col(c)), F.when(ok, F.col(ts))), F.lit(default)).alias(c))
    return rows.groupBy(key).agg(*made)


def field_values(sources: Mapping[str, DataFrame], key: str, ts: str, fields: Mapping[str, tuple[int, float]]) -> DataFrame:
    """(key, ts, source, field, value): the non-null fields of several sources, one row each; absent columns give none."""
    out = None
    for name, df in sources.items():
        own = [f for f in fields if f in df.columns]
        rows = df.select(key, ts, F.lit(name).alias("source"), *[F.col(f).cast("double").alias(f) for f in own])
        rows = rows.unpivot([key, ts, "source"], own, "field", "value").where("value IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out


def freshest_fields(rows: DataFrame, key: str, ts: str, fields: Mapping[str, tuple[int, float]], now) -> DataFrame:
    """(key, field, value, at, source) of ``field_values``: per key and field the newest value not older than the field's days to live.

    Ties of one time go to the greatest source, then the greatest value.  A key seen at all has a row for every
    field: without a fresh value the field's default, with a null time and source.  Values of the future (after
    ``now``) don't count.
    """
    age = F.datediff(F.lit(now), F.col(ts))
    lives = F.create_map(*[F.lit(x) for f, (days, _) in fields.items() for x in (f, days)])
    other = F.create_map(*[F.lit(x) for f, (_, default) in fields.items() for x in (f, float(default))])
    fresh = age.between(0, lives[F.col("field")])
    # one map-side combine a key: the newest of each field
    newest = [F.max(F.when(fresh & (F.col("field") == f), F.struct(F.col(ts).alias("at"), "source", "value"))).alias(f"__{k}") for k, f in enumerate(fields)]
    wide = rows.groupBy(key).agg(*newest)
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__{k}").alias("x")) for k, f in enumerate(fields)]))
    long = wide.select(key, parts.alias("p")).select(key, "p.field", "p.x")
    return long.select(key, "field", F.coalesce("x.value", other[F.col("field")]).alias("value"), "x.at", "x.source")
