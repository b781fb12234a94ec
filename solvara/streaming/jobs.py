"""Structured Streaming jobs: drop-folder ingest, sliding counts and decayed sums, and latest value by key with expiry."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from solvara.sources import shared_path


def ingest_folder(spark: SparkSession, folder: str, target: str, checkpoint: str, schema=None) -> None:
    """Appends every new Parquet file of ``folder`` to ``target`` once; ends when all are read.

    A file that can't be read is passed over and does not stop the others (``ingest_report`` names it).
    Without ``schema`` that of the readable files is taken.
    """
    schema = schema or spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", True).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("ignoreCorruptFiles", True).parquet(folder)
    query = stream.select("*", F.col("_metadata.file_path").alias("source_file")).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()


def ingest_report(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """(source_file, rows, ingested) of every file that landed: rows that reached the target, and false where none did."""
    landed = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("source_file"))
    done = spark.read.parquet(target).groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))
    name = lambda df: df.withColumn("__n", F.element_at(F.split("source_file", "/"), -1))
    both = name(landed).join(name(done).select("__n", "rows"), "__n", "left")
    return both.select("source_file", F.coalesce("rows", F.lit(0)).alias("rows"), F.col("rows").isNotNull().alias("ingested"))


def _memory_free(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a bounded stream to its end, keeping the last state of every key in a table.  States are held on disk, not in the
    heap of a task."""
    spark = stream.sparkSession
    path, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-checkpoint")

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("append").parquet(path)

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(path)


def sliding_counts(events: DataFrame, by: str, ts: str, value: str, window: str = "30 days", slide: str = "1 day", late: str = "2 days", half_life: float = 14.0) -> DataFrame:
    """Count, sum and decayed sum of ``value`` for each key and sliding window; rows later than ``late`` are dropped.

    A value counts half for every ``half_life`` days before the window's end.  Works on a stream and on a
    batch; on a stream a window is emitted once the watermark passes it.
    """
    rows = events.withWatermark(ts, late).withColumn("__w", F.window(F.col(ts), window, slide))
    age = (F.unix_micros(F.col("__w.end")) - F.unix_micros(F.col(ts))) / 86_400e6
    decayed = F.sum(F.col(value) * F.exp(-F.log(F.lit(2.0)) / half_life * age))
    made = rows.groupBy(by, "__w").agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"), decayed.alias("decayed"))
    return made.select(by, F.col("__w.end").alias("window_end"), "rows", "total", "decayed")


def sliding_totals(spark: SparkSession, folder: str, by: str, ts: str, value: str, **options) -> DataFrame:
    """The windows of ``sliding_counts`` over a folder that is read as a stream, as they stand at its end."""
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))
    states = _memory_free(sliding_counts(stream, by, ts, value, **options), "sliding", "update")
    last = F.max_by(F.struct("rows", "total", "decayed"), "__batch").alias("s")
    return states.groupBy(by, "window_end").agg(last).select(by, "window_end", "s.*")


def latest_by_key(spark: SparkSession, folder: str, key: str, ts: str, value: str, ttl: str = "90 days") -> DataFrame:
    """The newest value of each key in a folder that is read as a stream; values older than ``ttl`` expire.

    Each key's state holds its newest row and a timer; when event time passes the row's time plus ``ttl``,
    the state is dropped and the key leaves the result.  A numeric ``ts`` counts seconds.
    """
    source = spark.read.parquet(folder)
    kind = {f.name: f.dataType.simpleString() for f in source.schema}
    days, unit = ttl.split()
    alive = int(float(days) * {"days": 86_400_000, "hours": 3_600_000, "minutes": 60_000}[unit])

    def newest(keys, parts, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "at": [0], value: [None], "expired": [True]})
            return
        at, best = state.get if state.exists else (-1, None)
        for part in parts:
            k = part["__at"].to_numpy().argmax()
            if part["__at"].iloc[k] > at:
                at, best = int(part["__at"].iloc[k]), part[value].iloc[k].item()
        state.update((at, best))
        state.setTimeoutTimestamp(max(at // 1000 + alive, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [keys[0]], "at": [at], value: [best], "expired": [False]})

    stream = spark.readStream.schema(source.schema).parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))
    rows = stream.withWatermark(ts, "0 seconds").select(key, ts, value, F.unix_micros(ts).alias("__at"))
    found = rows.groupBy(key).applyInPandasWithState(newest, f"{key} {kind[key]}, at long, {value} {kind[value]}, expired boolean", f"at long, value {kind[value]}", "update", GroupStateTimeout.EventTimeTimeout)
    states = _memory_free(found, "latest", "update")
    last = states.groupBy(key).agg(F.max_by(F.struct("at", value, "expired"), "__batch").alias("s"))
    return last.where("NOT s.expired").select(key, F.timestamp_micros("s.at").cast(kind[ts]).alias(ts), f"s.{value}")


def stream_counts(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Rows of each key in a folder that is read as a stream."""
    schema = spark.read.parquet(folder).schema
    counted = spark.readStream.schema(schema).parquet(folder).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    states = _memory_free(counted, "counts", "update")
    return states.groupBy(key).agg(F.max_by("rows", "__batch").alias("rows"))


def newest_by_life(rows: DataFrame, key: str, ts: str, lives: Mapping[str, int]) -> DataFrame:
    """(key, field, at, source, value): the newest of (key, ts, source, field, value) for each key, field and stretch of time in
    which values expire; ``at`` counts microseconds.  Ties go to the greatest source, then the greatest value.

    Works on a stream and on a batch.  Event time is when a value's days to live end, so the watermark, which stays behind by
    the longest life and a day, drops a field's state after its own life and no value that is still fresh.
    """
    longest = max(lives.values())
    life = F.create_map(*[F.lit(x) for kv in lives.items() for x in kv])[F.col("field")]
    kept = rows.where(F.col("field").isin(list(lives)) & F.col("value").isNotNull()).withColumn("ends", F.col(ts) + F.make_dt_interval(life))
    newest = F.max(F.struct(F.unix_micros(ts).alias("at"), "source", F.col("value").cast("double").alias("value"))).alias("s")
    found = kept.withWatermark("ends", f"{longest + 1} days").groupBy(key, "field", F.window("ends", f"{longest} days")).agg(newest)
    return found.select(key, "field", "s.*")


def freshest_fields_stream(spark: SparkSession, folder: str, key: str, ts: str, lives: Mapping[str, int]) -> DataFrame:
    """(key, field, at, source, value) from a folder of (key, ts, source, field, value) that is read as a stream.

    The state holds the newest rows of each key and field (``newest_by_life``); it is kept and dropped by Spark's own
    aggregation, so no key costs a call into Python.  In the result a field is fresh if it is no older than its days to live
    at the newest time seen.  Fields without a life take no part.
    """
    source = spark.read.parquet(folder)
    stream = spark.readStream.schema(source.schema).parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))
    states = _memory_free(newest_by_life(stream, key, ts, lives), "freshest", "update")
    last = states.groupBy(key, "field").agg(F.max(F.struct("at", "source", "value")).alias("s"))
    now = source.where(F.col("value").isNotNull() & F.col("field").isin(list(lives))).agg(F.max(F.col(ts).cast("timestamp")).alias("now"))
    life = F.create_map(*[F.lit(x) for kv in lives.items() for x in kv])[F.col("field")]
    fresh = last.crossJoin(F.broadcast(now)).where(F.datediff("now", F.timestamp_micros("s.at")) <= life)
    return fresh.select(key, "field", F.timestamp_micros("s.at").alias("at"), "s.source", "s.value")
