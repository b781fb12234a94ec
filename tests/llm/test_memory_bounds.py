"""What a task holds of long texts and packed arrays is bounded in bytes, not only in rows."""

import os
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from solvara.llm.common import BATCH_BYTES, GROUP_BYTES, SCAN_ROWS, materialize, small_batches

MB = 1 << 20


def test_batches_are_bounded_in_bytes(spark):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"])

    def of_group(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sizes(batches)

    small_batches(spark)
    rows = spark.range(0, 60, 1, 1).select((F.col("id") % 2).alias("k"), F.expr(f"cast(repeat('a', {MB}) AS binary)").alias("one"))
    for found in (rows.mapInArrow(sizes, "size long, n long"), rows.groupBy("k").applyInArrow(of_group, "size long, n long")):
        each = found.collect()
        assert sum(x.n for x in each) == 60 and max(x.size for x in each) <= BATCH_BYTES + 2 * MB
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == str(SCAN_ROWS)


def test_row_groups_of_intermediate_tables_are_bounded(spark):
    # texts that don't compress: 24 MB of one task
    text = F.concat(*(F.sha2(F.concat_ws(":", "id", F.lit(k)), 512) for k in range(64)))
    rows = materialize(spark.range(0, 3000, 1, 1).select("id", text.alias("text")), "row-groups")
    (path,) = (urlparse(x).path for x in rows.inputFiles())
    meta = pq.ParquetFile(os.fspath(path)).metadata
    assert meta.num_rows == 3000 and max(meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)) <= 1.5 * GROUP_BYTES
    assert rows.where(F.length("text") == 64 * 128).count() == 3000
