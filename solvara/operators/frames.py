"""Projections, selections and deduplication."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvara.operators.ordered import running_sums


def resolve_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each target as the first non-null of its aliases that exist; null if none exists."""
    have = set(df.columns)
    made = {t: F.coalesce(*[F.col(a) for a in names if a in have]) if have & set(names) else F.lit(None).cast("double") for t, names in aliases.items()}
    return df.withColumns(made)


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Adds columns that are absent as literals; present columns stay as they are."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def screen_features(df: DataFrame, exclude: Sequence[str], patterns: Sequence[str]) -> list[str]:
    """Numeric columns outside ``exclude`` whose names fit no pattern."""
    numeric = ("int", "bigint", "smallint", "tinyint", "float", "double")
    return [c for c, t in df.dtypes if (t in numeric or t.startswith("decimal")) and c not in exclude and not any(re.search(p, c) for p in patterns)]


def one_hot(df: DataFrame, column: str, values: Sequence[str], drop_first: bool = True) -> DataFrame:
    """0/1 columns ``column_value``; the first value in sorted order is the base."""
    kept = sorted(values)[1 if drop_first else 0 :]
    return df.withColumns({f"{column}_{re.sub('[^a-zA-Z0-9_]', '_', v)}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in kept})


def learned_one_hot(df: DataFrame, column: str, most: int = 50) -> DataFrame:
    """``one_hot`` over the categories that the column has (as text; nulls are 0 in all columns).

    More than ``most`` categories are an error: only so many values come to the driver.
    """
    found = [r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} categories")
    return one_hot(df, column, found)


def sanitised(df: DataFrame) -> DataFrame:
    """Column names with other characters than letters, digits and ``_`` replaced by ``_``."""
    return df.toDF(*[re.sub("[^a-zA-Z0-9_]", "_", c) for c in df.columns])


def first_rows(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def dedup_restated(df: DataFrame, entity: str, period: str, form: str, filed: str, lag: str, key: str, late_days: int = 180) -> DataFrame:
    """One filing for each entity, period and base form.

    Timely filings come before late amendments (lag beyond ``late_days`` or negative), then the
    newest filed, then the largest key.
    """
    late = F.when((F.col(lag) > late_days) | (F.col(lag) < 0), 2).otherwise(1)
    return first_rows(df, [entity, period, F.split(F.col(form), "/")[0]], [late, F.col(filed).desc(), F.col(key).desc()])


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` rows: those with the smallest seeded hashes."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def balanced(df: DataFrame, label: str, key: str, per_positive: float = 1.0, seed: int = 42) -> DataFrame:
    """All positives and about ``per_positive`` times as many negatives, by a seeded hash."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    share = min(1.0, per_positive * n.get(1, 0) / max(n.get(0, 0), 1))
    drawn = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.where((F.col(label) == 1) | drawn)


def lookup_priority(queries: DataFrame, df: DataFrame, rules: Sequence[tuple[Column, Column]], query: str, order: Sequence[Column]) -> DataFrame:
    """The best row of ``df`` for each query: rules are tried in order, each an equality of two columns."""
    found = None
    for priority, (left, right) in enumerate(rules, 1):
        part = queries.withColumn("__k", left).join(df.withColumn("__k", right), "__k").drop("__k").withColumn("priority", F.lit(priority))
        found = part if found is None else found.unionByName(part)
    return first_rows(found, [query], [F.col("priority"), *order])


#: Legal suffixes tried after a company's name.
SUFFIXES = ("CO", "CORP", "INC", "LTD", "COMPANY", "CORPORATION")


def lookup_entity(queries: DataFrame, df: DataFrame, query: str, names: Mapping[str, str], newest: str, tie: str) -> DataFrame:
    """For each query the best row of ``df``: by ticker (priority 1), exact name (2), name with a legal suffix (3);
    then the largest ``newest``, then the smallest ``tie``.

    ``names`` maps ticker and name of both sides: ``{"ticker": "name of the column", "name": ...}``, the same
    on either side.  Texts are trimmed and compared in capitals.  All rules share one join on (rule, text), and
    a query's best row is found by a sum on the map side.  Queries without a match are left out; nulls and
    blanks match nothing.
    """
    clean = lambda c: F.nullif(F.upper(F.trim(F.col(c))), F.lit(""))
    key = lambda kind, text, priority: F.struct(F.lit(kind).alias("__kind"), text.alias("__text"), F.lit(priority).alias("priority"))
    ticker, name = clean(names["ticker"]), clean(names["name"])
    wanted = [key("t", ticker, 1), key("n", name, 2), *[key("n", F.concat(name, F.lit(f" {s}")), 3) for s in SUFFIXES]]
    asked = queries.select(F.col(query).alias("__query"), F.inline(F.array(*wanted)))
    held = df.select(F.struct(*df.columns).alias("__row"), F.inline(F.array(key("t", ticker, 0), key("n", name, 0)))).drop("priority")
    order = F.struct("priority", F.coalesce(-F.col(f"__row.{newest}").cast("double"), F.lit(float("inf"))), F.col(f"__row.{tie}"))
    best = asked.join(held, ["__kind", "__text"]).groupBy("__query").agg(F.min_by(F.struct("priority", "__row"), order).alias("__best"))
    return best.select(F.col("__query").alias(query), "__best.priority", "__best.__row.*")


def variant_match(df: DataFrame, right: DataFrame, key: str, variants: Sequence[Column], right_key: str) -> DataFrame:
    """Rows of ``right`` under the first rewriting of each key that has any; kept under the key itself."""
    tries = F.array(*[F.struct(F.lit(k).alias("rank"), v.alias("variant")) for k, v in enumerate(variants)])
    rows = df.select("*", F.inline(tries)).join(right, F.col("variant") == F.col(right_key))
    best = F.min("rank").over(Window.partitionBy(key))
    return rows.withColumn("__best", best).where("rank = __best").drop("__best", "rank", "variant")


def time_split(df: DataFrame, date: str, last_year: int, share: float = 0.8) -> DataFrame:
    """``split``: train up to ``last_year``, test after it; where that leaves a side empty, the first ``share``
    of the rows by date (those of one day together) are train."""
    train = F.year(F.col(date)) <= last_year
    sides = df.agg(F.count_if(train).alias("a"), F.count_if(~train).alias("b")).first()
    if sides["a"] and sides["b"]:
        return df.withColumn("split", F.when(train, "train").otherwise("test"))
    days = running_sums(df.groupBy(date).agg(F.count(F.lit(1)).alias("__n")), [date], ["__n"])
    rank = F.try_divide((F.col("__n_upto") - F.col("__n")).cast("double"), F.col("__n_all") - 1)
    days = days.select(F.col(date).alias("__d"), F.coalesce(rank, F.lit(0.0)).alias("__p"))
    return df.join(days, df[date].eqNullSafe(days["__d"])).withColumn("split", F.when(F.col("__p") <= share, "train").otherwise("test")).drop("__d", "__p")


def panel_audit(df: DataFrame, key: Sequence[str], date: str, label: str) -> DataFrame:
    """One row: rows, keys that repeat, first and last year, positives and negatives."""
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_keys"))
    y = F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.year(date)).alias("first_year"), F.max(F.year(date)).alias("last_year"), F.count_if(y == 1).alias("positives"), F.count_if(y == 0).alias("negatives")
    ).crossJoin(F.broadcast(repeated))


def date_inversions(df: DataFrame, earlier: str, later: str) -> DataFrame:
    """One row: how often a date that should be later is earlier."""
    return df.agg(F.count_if(F.col(later) < F.col(earlier)).alias("inversions"))


def bad_probability_sums(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """One row: rows whose probabilities don't sum to 1."""
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    return df.agg(F.count_if(F.abs(total - 1.0) > tolerance).alias("bad_sums"))
