"""The stream of freshest fields equals the batch form."""

import datetime as dt
import random

from solvara import streaming
from solvara.operators import scoring


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randrange(12), dt.datetime(2024, 1, 1) + dt.timedelta(days=r.randrange(60)), r.choice("abc"), r.choice(["x", "y", "other"]), r.choice([None, *map(float, range(5))])) for _ in range(300)]
    folder = f"file://{tmp_path}/rows"
    # several files, read one after the other
    df = spark.createDataFrame(rows, "k int, t timestamp, source string, field string, value double")
    df.repartition(3).write.parquet(folder)
    lives = {"x": 5, "y": 20}
    kept = df.where("value IS NOT NULL AND field <> 'other'")
    now = kept.agg({"t": "max"}).first()[0]
    batch = scoring.freshest_fields(kept, "k", "t", {f: (d, 0.0) for f, d in lives.items()}, now).where("at IS NOT NULL")
    want = {(x.k, x.field): (x.at, x.source, x.value) for x in batch.collect()}
    got = {(x.k, x.field): (x.at, x.source, x.value) for x in streaming.freshest_fields_stream(spark, folder, "k", "t", lives).collect()}
    assert got == want and {f for _, f in got} == {"x", "y"}


def test_states_are_kept_without_python(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), s, "x", float(v)) for k in (1, 2) for d, s, v in ((0, "b", 1), (0, "b", 3), (0, "a", 9))]
    rows += [(1, dt.datetime(2024, 3, 1), "a", "x", None), (1, dt.datetime(2024, 3, 1), "a", "other", 1.0)]
    df = spark.createDataFrame(rows, "k int, t timestamp, source string, field string, value double")
    found = streaming.newest_by_life(df, "k", "t", {"x": 5, "y": 20})
    assert {(r.k, r.field): (r.source, r.value) for r in found.collect()} == {(1, "x"): ("b", 3.0), (2, "x"): ("b", 3.0)}
    df.write.parquet(f"file://{tmp_path}/rows")
    stream = streaming.newest_by_life(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/rows"), "k", "t", {"x": 5, "y": 20})
    for plan in (found, stream):
        text = plan._jdf.queryExecution().analyzed().toString()
        assert "Aggregate" in text and "Python" not in text and "Pandas" not in text
