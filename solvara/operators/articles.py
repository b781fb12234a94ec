"""Consolidation of article sources: aligned columns, year rules, the newest of each title, and loads that only touch their buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvara.functions import parse_timestamp
from solvara.sources import saved

COLUMNS = ("ticker", "company_name", "title", "url", "time_published", "pub_year", "authors", "summary", "source_dataset")
#: How sources write times, beside what a cast to timestamp reads (a weekday name before is taken off), each with a
#: pattern that every text of that form fits: a form is only tried on such texts, since a failed try costs an exception.
FORMATS = {
    "dd MMM yyyy HH:mm:ss z": r"^\d\d \p{L}+ [+-]?\d{4,} \d\d:\d\d:\d\d .",
    "dd MMM yyyy HH:mm:ss": r"^\d\d \p{L}+ [+-]?\d{4,} \d\d:\d\d:\d\d$",
    "yyyyMMdd'T'HHmmss": r"^[+-]?\d{8,}[Tt]\d{6}$",
    "yyyy-MM-dd'T'HH:mm:ssX": r"^[+-]?\d{4,}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d.",
    "yyyy-MM-dd HH:mm:ss z": r"^[+-]?\d{4,}-\d\d-\d\d \d\d:\d\d:\d\d .",
    "yyyy-MM-dd HH:mm:ss": r"^[+-]?\d{4,}-\d\d-\d\d \d\d:\d\d:\d\d$",
}
BUCKETS = 64


def published(text: Column, formats: Sequence[str] | Mapping[str, str] = FORMATS) -> Column:
    """The time that a text states in any known form, else the date in its first ten characters, else null."""
    day = F.substring(text, 1, 10)
    by_day = F.when(day.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))
    return F.coalesce(text.try_cast("timestamp"), parse_timestamp(text, formats), by_day)


def aligned(df: DataFrame, source: str, names: Mapping[str, str], years: tuple[int | None, int | None] = (None, None), keep_undated: bool = False) -> DataFrame:
    """A source's rows in ``COLUMNS``; ``names`` gives its column for each, absent ones are null (an absent summary is the title).

    Tickers are trimmed and in upper case, titles and authors trimmed; rows without a ticker or title go.
    ``years`` bound the year of publication, both ends included; rows whose time can't be read go unless
    ``keep_undated``.
    """
    text = lambda c: F.col(names[c]).cast("string") if c in names else F.lit(None).cast("string")
    rows = df.select(
        F.upper(F.trim(text("ticker"))).alias("ticker"), text("company_name").alias("company_name"), F.trim(text("title")).alias("title"), text("url").alias("url"), text("time_published").alias("time_published"),
        F.trim(text("authors")).alias("authors"), (text("summary") if "summary" in names else F.trim(text("title"))).alias("summary"), F.lit(source).alias("source_dataset"),
    )
    # a generator's result is not computed again by the conditions on it, as a projected expression would be
    rows = rows.select("*", F.explode(F.array(F.year(published(F.col("time_published"))))).alias("pub_year")).select(*COLUMNS)
    first, last = years
    inside = F.col("pub_year").isNotNull()
    inside = inside & (F.col("pub_year") >= first) if first is not None else inside
    inside = inside & (F.col("pub_year") <= last) if last is not None else inside
    return rows.where("ticker IS NOT NULL AND ticker <> '' AND title IS NOT NULL").where(inside | F.col("pub_year").isNull() if keep_undated else inside)


def _key() -> list[Column]:
    return [F.col("ticker"), F.lower(F.trim(F.col("title"))).alias("__title"), F.col("pub_year")]


def newest(articles: DataFrame) -> DataFrame:
    """The newest row of each (ticker, title without regard to case, year) by the text of its time, nulls last.

    Ties go to the greatest source, then the greatest of the other columns, so reruns agree.  The greatest row is
    found before the shuffle, so a title of very many rows is no hot group.
    """
    own = F.struct(*COLUMNS)
    order = F.struct("time_published", "source_dataset", *[c for c in COLUMNS if c not in ("time_published", "source_dataset")])
    return articles.groupBy(*_key()).agg(F.max_by(own, order).alias("x")).select("x.*")


def consolidated(sources: Sequence[DataFrame]) -> DataFrame:
    """All ``aligned`` sources as one table, the newest row of each title."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    return newest(rows)


def _bucketed(articles: DataFrame, buckets: int) -> DataFrame:
    ticker, title, year = _key()
    return articles.withColumn("bucket", F.pmod(F.xxhash64(ticker, title, year), F.lit(buckets)).cast("int"))


def merge_articles(spark: SparkSession, path: str, load: DataFrame, buckets: int = BUCKETS) -> int:
    """Brings a load of ``aligned`` rows into the consolidated table at ``path``; returns how many buckets it rewrote.

    A row's bucket follows from its key.  Only the buckets that the load reaches are read, merged and
    written again; the files of others stay as they are.  The merged rows are written aside before any bucket is replaced,
    and merging a load again changes nothing, so a job that was stopped can be repeated.  ``buckets`` must be that of the
    first load.
    """
    fresh = saved(_bucketed(newest(load), buckets), "load")
    touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
    if not touched:
        return 0
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    rows = fresh
    if there:
        rows = rows.unionByName(spark.read.schema(fresh.schema).parquet(path).where(F.col("bucket").isin(touched)))
    merged = saved(_bucketed(newest(rows), buckets), "merged")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)
