"""Point-in-time joins: as-of, closed month, band, calendar and forward-looking labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvara.sources import saved


def asof_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, columns: Sequence[str], hot_rows: int = 1_000_000) -> DataFrame:
    """Left rows with ``columns`` of the last right row of the same key at or before ``left_ts``.

    Both sides are put in one time line and the last right row is carried on; a right row comes
    before a left row of the same time.  Two right rows of one key and time must not differ.  A null key fits
    nothing, nor does a null time.  Keys with more than ``hot_rows`` rows of both sides (fewer keys than
    rows over ``hot_rows``) are cut into ranges of time, so that no task holds a whole one.
    """
    payload = F.struct(F.col(right_ts).alias("__rt"), *[F.col(c).alias(c) for c in columns])
    r = right.where(F.col(by).isNotNull() & F.col(right_ts).isNotNull()).select(F.col(by).alias("__by"), F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), payload.alias("__r"))
    l = left.select("*", F.col(by).alias("__by"), F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"))
    asked = F.col("__by").isNotNull() & F.col("__ts").isNotNull()
    kept = lambda df, last: df.select(*left.columns, last["__rt"].alias(f"asof_{right_ts}"), *[last[c].alias(c) for c in columns])
    nothing = F.lit(None).cast(r.schema["__r"].dataType)
    both = l.where(asked).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy("__by").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda df: kept(df.withColumn("__last", F.last("__r", ignorenulls=True).over(w)).where("__side = 1"), F.col("__last"))
    unasked = kept(l.where(~asked), nothing)
    sizes = l.where(asked).select("__by").unionByName(r.select("__by")).groupBy("__by").agg(F.count(F.lit(1)).alias("__n"))
    hot = [x[0] for x in sizes.where(F.col("__n") > hot_rows).select("__by").collect()]
    if not hot:
        return carried(both).unionByName(unasked)
    is_hot = F.col("__by").isin(hot)
    return carried(both.where(~is_hot)).unionByName(kept(*_carried_over_ranges(both.where(is_hot)))).unionByName(unasked)


def _carried_over_ranges(both: DataFrame) -> tuple[DataFrame, Column]:
    """Left rows of a time line with ``__last``: carried on within ranges of (key, time), and from range to range.

    What a range hands on is one row for each key in it, so the table of these has about as many rows as
    keys and ranges together.
    """
    order = ["__by", "__ts", "__side"]
    placed = saved(both.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "time-line")
    ends = placed.groupBy("__by", "__range").agg(F.max_by(F.when(F.col("__side") == 0, F.col("__r")), F.when(F.col("__side") == 0, F.col("__ts"))).alias("__end"))
    before = Window.partitionBy("__by").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("__by", "__range", F.last("__end", ignorenulls=True).over(before).alias("__handed"))
    own = Window.partitionBy("__range", "__by").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.join(handed, ["__range", "__by"]).withColumn("__last", F.coalesce(F.last("__r", ignorenulls=True).over(own), F.col("__handed")))
    return rows.where("__side = 1"), F.col("__last")


def series_asof(left: DataFrame, series: DataFrame, date: str, month: str, columns: Sequence[str]) -> DataFrame:
    """Left rows with the values of one monthly series that stand at their date: the last month up to it.

    The series is carried on over the months between, which is a table of months only, and joined by
    month, so that no time line of all rows is sorted.  Dates before the series have nulls.
    """
    ends = series.agg(F.min(month).alias("__a")).crossJoin(left.agg(F.max(date).alias("__b")))
    spine = ends.where("__a <= __b").select(F.explode(F.sequence(F.trunc("__a", "MM"), F.trunc("__b", "MM"), F.expr("interval 1 month"))).alias("__m"))
    w = Window.orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)
    known = spine.join(series.withColumn("__here", F.lit(1)), F.col("__m") == F.col(month), "left")
    carried = known.withColumn("__last", F.last(F.when(F.col("__here") == 1, F.struct(*columns)), ignorenulls=True).over(w)).select("__m", *[F.col(f"__last.{c}").alias(c) for c in columns])
    return left.join(carried, F.trunc(F.col(date), "MM") == F.col("__m"), "left").drop("__m")


def closed_month_join(left: DataFrame, right: DataFrame, by: str, date: str, month: str, offset: int = 1) -> DataFrame:
    """Left rows with the right row of the month that closed ``offset`` months before the date.

    ``month`` in ``right`` is a first-of-month date.
    """
    key = F.trunc(F.add_months(F.col(date), -offset), "MM")
    return left.withColumn("__m", key).join(right.withColumnRenamed(month, "__m"), [by, "__m"], "left").withColumnRenamed("__m", month)


def alternate_key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], right_key: str, date: str, month: str, defaults: dict[str, object]) -> DataFrame:
    """Left rows with the right row of the same month under the first of ``keys`` that is a column of ``left``.

    Keys are compared trimmed and in upper case; columns in ``defaults`` take theirs where nothing fits.
    """
    key = next((k for k in keys if k in left.columns), None)
    if key is None:
        raise ValueError(f"none of {list(keys)} is a column")
    same = lambda x: F.upper(F.trim(F.col(x)))
    r = right.select(same(right_key).alias("__key"), F.trunc(F.col(month), "MM").alias("__month"), *defaults)
    joined = left.join(r, (same(key) == F.col("__key")) & (F.trunc(F.col(date), "MM") == F.col("__month")), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}).drop("__key", "__month")


def densify(df: DataFrame, by: str, date: str, step: str = "1 month") -> DataFrame:
    """Each key with every period from its first to its last date."""
    unit = {"1 month": "MM", "1 day": "DD"}[step]
    start, end = (F.to_date(F.date_trunc("MM", f)) if unit == "MM" else F.to_date(f) for f in (F.min(date), F.max(date)))
    span = df.groupBy(by).agg(start.alias("__s"), end.alias("__e"))
    return span.select(by, F.explode(F.sequence("__s", "__e", F.expr(f"interval {step}"))).alias("period"))


def band_join_agg(calendar: DataFrame, events: DataFrame, by: str, end: str, event: str, days: int, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates of the events of each calendar row's key within ``[end - days, end]``, both included.

    Each event is sent to the calendar days that it reaches (``days + 1`` at most), which makes an
    equi-join of the range.  Calendar rows without events keep null aggregates.
    """
    reached = F.explode(F.sequence(F.col(event), F.date_add(F.col(event), days))).alias(end)
    hits = events.select("*", reached).join(calendar.select(by, end).distinct(), [by, end]).groupBy(by, end).agg(*aggregates)
    return calendar.join(hits, [by, end], "left")


def forward_label(df: DataFrame, entity: str, date: str, flag: str, months: int = 12, terminal: bool = True, name: str = "label") -> DataFrame:
    """1 if a later row of the entity within ``months`` has the flag, else 0.

    Rows of the same day are not later.  With ``terminal``, a flagged row without any later row is 1.
    The next flagged day is the least over a range that begins one day on: no self-join.
    """
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    ahead = Window.partitionBy(entity).orderBy("__day").rangeBetween(1, Window.unboundedFollowing)
    out = df.withColumn("__day", day).withColumn("__next", F.min(F.when(F.col(flag) == 1, F.col(date))).over(ahead)).withColumn("__any", F.min("__day").over(ahead))
    hit = F.col("__next") <= F.add_months(F.col(date), months)
    if terminal:
        hit = hit | ((F.col(flag) == 1) & F.col("__any").isNull())
    return out.withColumn(name, F.coalesce(hit, F.lit(False)).cast("int")).drop("__day", "__next", "__any")


def returns(df: DataFrame, by: str, ts: str, price: str, lags: Sequence[int] = (1, 21, 63, 252)) -> DataFrame:
    """Relative price changes over so many rows; null without such a row or with a zero price."""
    w = Window.partitionBy(by).orderBy(ts)
    return df.withColumns({f"return_{k}": F.try_divide(F.col(price), F.lag(price, k).over(w)) - 1 for k in lags})


def trailing_months(df: DataFrame, by: str, day: str, value: str, months: int = 6) -> DataFrame:
    """``df`` with <value>_avg, _max, _range and _std over a key's rows of the last ``months`` calendar months, its own included, and
    market_mean, the mean of all keys' rows of that month.

    All rows of a month see the same rows.  The deviation of one row is null, null values are passed over, and rows
    without a day have nulls.  The market's means are one row a month.
    """
    m = F.year(day) * 12 + F.month(day)
    w = Window.partitionBy(by).orderBy("__m").rangeBetween(-(months - 1), 0)
    dated = F.col("__m").isNotNull()
    rows = df.withColumn("__m", m)
    market = rows.where(dated).groupBy(F.col("__m").alias("__month")).agg(F.avg(value).alias("market_mean"))
    found = {"avg": F.avg(value), "max": F.max(value), "range": F.max(value), "std": F.stddev_samp(value)}
    out = rows.withColumns({f"{value}_{k}": F.when(dated, x.over(w) - F.min(value).over(w) if k == "range" else x.over(w)) for k, x in found.items()})
    return out.join(market, F.col("__m") == F.col("__month"), "left").drop("__m", "__month")


def rolling_volatility(df: DataFrame, by: str, ts: str, ret: str, rows: int = 21, periods: int = 252, default: float = 0.20) -> DataFrame:
    """Yearly volatility: sample deviation of the last ``rows`` returns times the root of ``periods``."""
    w = Window.partitionBy(by).orderBy(ts).rowsBetween(-(rows - 1), 0)
    return df.withColumn("volatility", F.coalesce(F.stddev_samp(ret).over(w) * float(periods) ** 0.5, F.lit(float(default))))


def deltas(df: DataFrame, by: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First differences within a key; 0 on its first row."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumns({f"delta_{c}": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for c in columns})


def silence(df: DataFrame, by: str, ts: str, count: str, flags: Sequence[int] = (3, 6), ratio_rows: int = 12) -> DataFrame:
    """Length of the run of periods without activity up to each row, flags for long runs, and the
    share of active periods among the last ``ratio_rows``."""
    w = Window.partitionBy(by).orderBy(ts)
    active = (F.coalesce(F.col(count), F.lit(0)) > 0).cast("int")
    out = df.withColumn("__island", F.sum(active).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(1 - active).over(Window.partitionBy(by, "__island").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("silent_run", run.cast("int")).drop("__island")
    out = out.withColumns({f"silent_{k}": (F.col("silent_run") >= k).cast("int") for k in flags})
    return out.withColumn("coverage", F.avg(active.cast("double")).over(w.rowsBetween(-(ratio_rows - 1), 0)))


def decay_panel(calendar: DataFrame, news: DataFrame, by: str, end: str, day: str, value: str, windows: Sequence[int] = (30, 90), half_life: float = 14.0) -> DataFrame:
    """For each calendar row and window: count, mean of ``value`` that decays by half every
    ``half_life`` days, and the sum of the decay weights."""
    age = F.datediff(F.col(end), F.col(day))
    weight = F.exp(-F.log(F.lit(2.0)) / half_life * age)
    out = calendar
    for days in windows:
        out = band_join_agg(
            out, news, by, end, day, days,
            [F.count(F.lit(1)).alias(f"count_{days}"), (F.sum(F.col(value) * weight) / F.sum(weight)).alias(f"decayed_{days}"), F.sum(weight).alias(f"volume_{days}")],
        )
        out = out.withColumns({f"count_{days}": F.coalesce(f"count_{days}", F.lit(0)), f"decayed_{days}": F.coalesce(f"decayed_{days}", F.lit(0.0)), f"volume_{days}": F.coalesce(f"volume_{days}", F.lit(0.0))})
    return out
