"""Event extraction, news assembly, curves, notices and scorecard bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvara.functions import DISTRESS_TOPICS, TOPIC_WEIGHTS, intensity, phrase_any, word_pattern
from solvara.operators.finance import consolidate_events


def headline_events(news: DataFrame, entity: str, date: str, text: str, phrases: Sequence[str], source: str = "headline") -> DataFrame:
    """(entity, date, source) of the rows whose text holds a phrase."""
    return news.where(phrase_any(text, phrases)).select(F.col(entity).alias("entity"), F.col(date).alias("date"), F.lit(source).alias("source"))


def suffix_events(prices: DataFrame, ticker: str, date: str, suffix: str = "Q", shortest: int = 4) -> DataFrame:
    """(entity, date, source): first day of tickers with a delisting suffix, under the ticker without it."""
    hit = prices.where(F.col(ticker).endswith(suffix) & (F.length(ticker) >= shortest))
    return hit.groupBy(F.regexp_replace(ticker, f"{suffix}$", "").alias("entity")).agg(F.min(date).alias("date")).withColumn("source", F.lit("suffix"))


def merged_events(parts: Sequence[DataFrame], whitelist: DataFrame | None = None) -> DataFrame:
    """One row for each entity of several event tables, optionally of listed entities only."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if whitelist is not None:
        rows = rows.join(whitelist, "entity", "left_semi")
    return consolidate_events(rows, "entity", "date", "source")


def lexicon_score(df: DataFrame, text: str, good: Sequence[str], bad: Sequence[str], out: str = "sentiment") -> DataFrame:
    """(good - bad) / (good + bad) of whole words found in the text, 0 without any."""
    count = lambda words: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(word_pattern(words)))
    g, b = count(good), count(bad)
    return df.withColumn(out, F.coalesce(F.try_divide((g - b).cast("double"), (g + b).cast("double")), F.lit(0.0)))


def distress_topics(df: DataFrame, text: str, negative: Column, topics: Mapping[str, Mapping[str, float]] = DISTRESS_TOPICS) -> DataFrame:
    """An intensity column for each topic, and their composite: topic, intensity and flagged.

    The composite is the largest weighted topic, raised by 30 % of the negative share (0..1).  Below
    0.20 no topic dominates; else bankruptcy comes before default, and default before litigation,
    where their own intensities tie.  Null texts have no topic.
    """
    out = df.withColumns({name: intensity(text, found) for name, found in topics.items()})
    best = F.greatest(*[F.col(t) * TOPIC_WEIGHTS[t] for t in topics])
    share = F.least(F.greatest(F.coalesce(negative, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    out = out.withColumn("intensity", F.least(best * (1.0 + 0.30 * share), F.lit(1.0)))
    c, names = F.col, ("chapter11_bankruptcy", "default_covenants", "litigation_fraud")
    topic = F.when(c("intensity") < 0.20, "none")
    for k, name in enumerate(names):
        rest = names[k + 1 :]
        topic = topic.when(c(name) >= F.greatest(*[c(x) for x in rest]) if len(rest) > 1 else c(name) >= c(rest[0]), name) if rest else topic.otherwise(name)
    return out.withColumn("topic", topic).withColumn("flagged", (c("intensity") >= 0.25).cast("int"))


def sentiment_shares(df: DataFrame, text: str, good: Sequence[str], bad: Sequence[str]) -> DataFrame:
    """positive, negative and neutral shares of a text's words, and their index (positive - negative).

    A lexicon in the place of a language model; an empty text is neutral.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    count = lambda words: F.regexp_count(body, F.lit(word_pattern(words))).cast("double")
    total = F.greatest(F.regexp_count(body, F.lit(r"[\pL\pN_]+")), F.lit(1))
    out = df.withColumns({"positive": count(good) / total, "negative": count(bad) / total})
    return out.withColumns({"neutral": 1.0 - F.col("positive") - F.col("negative"), "index": F.col("positive") - F.col("negative")})


def composite_topic(df: DataFrame, topics: Mapping[str, float], negative: Column, boost: float = 0.30, flag_at: float = 0.25) -> DataFrame:
    """The largest weighted topic raised by the negative share and kept within 0..1, its name, and a flag."""
    best = F.greatest(*[F.col(t) * w for t, w in topics.items()])
    name = None
    for t, w in topics.items():
        hit = (F.col(t) * w == best) & (best > 0)
        name = F.when(hit, t) if name is None else name.when(hit, t)
    out = df.withColumn("topic", name.otherwise("none")).withColumn("intensity", F.least(F.greatest(best * (1.0 + boost * negative), F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("flagged", (F.col("intensity") >= flag_at).cast("int"))


def interpolate(curve: DataFrame, x: str, y: str, grid: DataFrame, at: str) -> DataFrame:
    """Linear interpolation of a curve (distinct x) at the grid's points; the ends are carried on."""
    w = Window.orderBy(x)
    spans = curve.select(F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), F.lag(x).over(w).alias("before"))
    low = F.when(F.col("before").isNull(), F.lit(float("-inf"))).otherwise(F.col("x0"))
    hit = grid.join(F.broadcast(spans.withColumn("low", low)), (F.col(at) >= F.col("low")) & (F.col("x1").isNull() | (F.col(at) < F.col("x1"))))
    share = F.greatest((F.col(at) - F.col("x0")) / (F.col("x1") - F.col("x0")), F.lit(0.0))
    return hit.select(at, F.when(F.col("x1").isNull(), F.col("y0")).otherwise(F.col("y0") + share * (F.col("y1") - F.col("y0"))).alias(y))


def adverse_notices(df: DataFrame, key: str, contributions: Sequence[str], dtd: str, z: str, k: int = 5) -> DataFrame:
    """(key, notices): names of the ``k`` largest positive contributions, then warnings of low distance
    to default (< 1.5) and Z (< 1.81)."""
    parts = F.array(*[F.struct((-F.col(c)).alias("m"), F.lit(c).alias("name")) for c in contributions])
    top = F.transform(F.slice(F.array_sort(F.filter(parts, lambda p: p["m"] < 0)), 1, k), lambda p: p["name"])
    warn = lambda c, limit, text: F.when(F.col(c) < limit, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    return df.select(key, F.concat(top, warn(dtd, 1.5, "distance to default"), warn(z, 1.81, "Z score")).alias("notices"))


def fold_audit(df: DataFrame, date: str, label: str, folds: DataFrame) -> DataFrame:
    """Rows and positives of each fold's training and validation spans, and the gap in days."""
    d = F.col(date)
    spans = df.join(F.broadcast(folds), (d <= F.col("train_end")) | d.between(F.col("valid_start"), F.col("valid_end")))
    valid = d >= F.col("valid_start")
    return spans.groupBy("fold").agg(
        F.sum((~valid).cast("long")).alias("train_rows"), F.sum(valid.cast("long")).alias("valid_rows"), F.sum(F.when(valid, F.col(label)).otherwise(0).cast("long")).alias("valid_positives"),
        F.first(F.datediff("valid_start", "train_end")).alias("gap"),
    )
