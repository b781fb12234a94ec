"""Shared helpers: shared-folder tables, joins that survive hot keys, connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: bound what a Python worker and its task hold of very long texts and packed arrays.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: Rows that a scan decodes at once (Spark's default of 4096 texts is an array of tens of MB in each task), and bytes
#: of a row group of intermediate tables, which its writer and each reader hold whole.
SCAN_ROWS, GROUP_BYTES = 512, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent and Spark runs locally (tests, a laptop) a new folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of Arrow batches and the rows of a scan's, since one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet under the shared folder and reads it back (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/solvara-{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_mod4(col):
    """``crc32(doc_id as text) mod 4``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 4


def text_bytes(df: DataFrame) -> int:
    """Bytes of UTF-8 in column ``text``: sizes shuffles in proportion to the input."""
    return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, parts: int = 1000) -> DataFrame:
    """Inner join of ``rows`` to one row per ``key`` in ``groups``; ``size`` counts a key's rows.

    Keys that hold more than one ``parts``-th of all rows number fewer than ``parts``, so this
    bounded set is broadcast and their rows never meet in one task; all other keys are joined
    by a shuffle in which no key is hot.
    """
    total = int(groups.agg(F.sum(size)).first()[0] or 0)
    hot_at = max(total // parts, 100)
    hot = F.broadcast(groups.where(F.col(size) > hot_at))
    heavy = rows.join(hot, key)
    light = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(size) <= hot_at), key)
    return heavy.unionByName(light)


def repeated_ids(rows: DataFrame) -> DataFrame:
    """(doc_id, times) of the ids that stand in more than one row, and of the null id."""
    return materialize(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1 OR doc_id IS NULL"), "repeated")


def rows_of_ids(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose ``key`` is one of ``ids(doc_id, times)``, a null id included; hot ids stay where they are."""
    named = ids.where("doc_id IS NOT NULL").select(F.col("doc_id").alias(key), "times")
    nulls = rows.where(F.col(key).isNull())
    found = join_groups(rows, named, key, "times").select(*rows.columns)
    return found if ids.where("doc_id IS NULL").isEmpty() else found.unionByName(nulls)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: one row (node, root) for each linked node.

    Each round sends every node to its smallest neighbour, shortens the chains by one jump and
    contracts the graph; the number of rounds is logarithmic in the longest chain.
    """
    pairs = links.where("a != b")
    graph = materialize(pairs.union(pairs.select("b", "a")).toDF("a", "b").distinct(), "links")
    roots = None
    while not graph.isEmpty():
        parent = graph.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        parent = materialize(parent, "parents")
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        step = materialize(parent.join(up, "p").select("a", F.col("pp").alias("p")), "steps")
        to_b = step.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        graph = materialize(
            graph.join(step, "a").join(to_b, "b").select(F.col("p").alias("a"), F.col("pb").alias("b")).where("a != b").distinct(),
            "links",
        )
        if roots is None:
            roots = step.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            moved = step.select(F.col("a").alias("root"), "p")
            roots = materialize(roots.join(moved, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
    if roots is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
