"""Lenient readers, payload parsers and safe writers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from solvara.functions.expr import tried


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder shared by driver and executors (``spark.checkpoint.dir``)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/solvara-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and a lost executor costs no more."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "\t") -> DataFrame:
    """A delimited file with a header, all columns as strings; malformed rows are dropped."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.csv(path, sep=sep, header=True, schema=schema, mode="DROPMALFORMED")


def read_union(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> DataFrame:
    """Files with differing columns as one table by column name; absent columns are null."""
    frames = [spark.read.csv(p, sep=sep, header=True) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """String columns tried as types; what does not fit becomes null."""
    texts = {f.name for f in df.schema if isinstance(f.dataType, StringType)}
    return df.withColumns({c: tried(c, t) if c in texts else F.col(c).try_cast(t) for c, t in types.items()})


def joined_facts(header: DataFrame, values: DataFrame, key: str, types: dict[str, str], dates: dict[str, str]) -> DataFrame:
    """Values with their header by ``key``, each text column tried as its type or date; what does not fit is null.

    The key is joined as text and then tried.  Other columns are tried before the join, a header's once for the
    header and not for each of its values.
    """

    def tries(df: DataFrame, mine: Callable[[str], bool]) -> DataFrame:
        df = typed(df, {c: t for c, t in types.items() if mine(c)})
        return df.withColumns({c: F.to_date(F.try_to_timestamp(F.col(c), F.lit(f))) for c, f in dates.items() if mine(c)})

    sides = [tries(df, lambda c, own=set(df.columns) - {key}: c in own) for df in (header, values)]
    before = {*header.columns, *values.columns} - {key}
    return tries(sides[0].join(sides[1], key), lambda c: c not in before)


def annual_series(df: DataFrame, day: str, value: str) -> DataFrame:
    """(y, n, mean, volatility) of a series of texts in which "." (or anything else that is no number) is missing;
    volatility is the sample deviation, 0 of a single value."""
    v = tried(value, "double")
    return df.groupBy(F.year(day).alias("y")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("volatility"))


def explode_map(df: DataFrame, json: str, value_type: str, key: str = "key", value: str = "value") -> DataFrame:
    """One row per entry of a JSON object column."""
    parsed = F.from_json(F.col(json), f"map<string,{value_type}>")
    return df.select("*", F.explode(parsed).alias(key, value))


def explode_parallel(df: DataFrame, json: str, fields: dict[str, str]) -> DataFrame:
    """One row per position of the parallel arrays in a JSON object column."""
    schema = ", ".join(f"{c} array<{t}>" for c, t in fields.items())
    parsed = df.withColumn("__p", F.from_json(F.col(json), schema))
    zipped = F.arrays_zip(*[F.col(f"__p.{c}").alias(c) for c in fields])
    return parsed.select(*df.columns, F.inline(zipped).alias(*fields))


def earliest_events(df: DataFrame, key: str, json: str, fields: dict[str, str], keep: Callable[[Column], Column], day: str, known: dict | None = None, default: str | None = None) -> DataFrame:
    """(key, day, assumed): the earliest day among the positions of parallel JSON arrays that ``keep`` lets through.

    Keys without any take the day of ``known`` (a small map by hand), else ``default``, and are marked as
    assumed.  A null key is a key of its own; broken JSON counts as no position.
    """
    found = df.groupBy(key).agg(F.min(F.array_min(_days(json, fields, keep, day))).alias("__day"))
    by_hand = F.lit(None).cast("string")
    for k, d in (known or {}).items():
        by_hand = F.when(F.col(key) == k, d).otherwise(by_hand)
    return found.select(key, F.coalesce("__day", by_hand, F.lit(default)).alias("day"), F.col("__day").isNull().alias("assumed"))


def _days(json: str, fields: dict[str, str], keep: Callable[[Column], Column], day: str) -> Column:
    parsed = F.from_json(F.col(json), ", ".join(f"{c} array<{t}>" for c, t in fields.items()))
    zipped = F.arrays_zip(*[parsed[c].alias(c) for c in fields])
    return F.transform(F.filter(zipped, keep), lambda x: x[day])


def parse_feed(df: DataFrame, xml: str) -> DataFrame:
    """title, link, pubDate and source of the items in an XML feed column; items without a title go."""
    schema = "channel struct<item:array<struct<title:string,link:string,pubDate:string,source:string>>>"
    items = F.explode(F.from_xml(F.col(xml), schema)["channel"]["item"])
    return df.select(*df.columns, items.alias("__i")).select(*df.columns, "__i.*").where("trim(title) <> ''")


def extract_links(df: DataFrame, key: str, html: str, base: Column | str, suffix: str = "") -> DataFrame:
    """Distinct link targets of each page in order of first occurrence: key, position, link.

    Targets that start with a slash are put after ``base``; ``suffix`` keeps those that end with it.
    """
    base = F.col(base) if isinstance(base, str) else base
    found = df.select(key, base.alias("__b"), F.posexplode(F.expr(f"regexp_extract_all({html}, 'href=\"([^\"]*)\"', 1)")).alias("position", "href"))
    found = found.withColumn("link", F.when(F.col("href").startswith("/"), F.concat("__b", "href")).otherwise(F.col("href")))
    if suffix:
        found = found.where(F.col("link").endswith(suffix))
    first = F.row_number().over(Window.partitionBy(key, "link").orderBy("position"))
    return found.withColumn("__n", first).where("__n = 1").select(key, "position", "link")


def write_swap(df: DataFrame, path: str) -> str:
    """Writes beside ``path`` and then moves the result there, so that an input is never overwritten
    while it is read.  The old table is moved aside first and deleted last; a failed move raises."""
    spark = df.sparkSession
    staging = f"{path}-staging-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}-old-{uuid.uuid4().hex}")
    there = fs.exists(target)
    if there and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside; the new table is at {staging}")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        if there:
            fs.rename(aside, target)
        raise OSError(f"could not move {staging} to {path}; the old table stays")
    if there:
        fs.delete(aside, True)
    return path


def audit_log(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Appends the columns as JSON lines."""
    df.select(*columns).write.mode("append").json(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report as CSV with a header, or JSON."""
    if kind == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").json(path)


def write_nested_report(records: DataFrame, summary: DataFrame, path: str, order: Sequence[str]) -> None:
    """One JSON document of a one-row ``summary`` and the list of ``records`` (a report, not a table) in ``order``."""
    first = F.struct(*order, *[c for c in records.columns if c not in order])
    listed = records.agg(F.array_sort(F.collect_list(first)).alias("records"))
    summary.select(F.struct(*summary.columns).alias("summary")).crossJoin(listed).coalesce(1).write.mode("overwrite").json(path)


def described(df: DataFrame, name: str) -> DataFrame:
    """Registers ``df`` as a view and gives its columns: name, type and the rows of the view."""
    df.createOrReplaceTempView(name)
    spark = df.sparkSession
    n = spark.table(name).agg(F.count(F.lit(1)).alias("rows"))
    columns = spark.sql(f"DESCRIBE {name}").select(F.col("col_name").alias("name"), F.col("data_type").alias("type"))
    return columns.crossJoin(F.broadcast(n))
