"""Exact deduplication over a sharded cuckoo-filter index of live digests.

The index is a table of shards.  A shard is a cuckoo filter: buckets of four slots, each slot with a
16-bit fingerprint and, beside it, the content that it stands for (the full digest, its copies and
the row that stays).  A lookup reads the fingerprints of two buckets; only where one agrees is the
slot's content read and compared.  A failed insertion doubles the filter and refills it from the
stored digests.  Insertions and deletions touch one shard each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from solvara.llm.common import join_groups, materialize, small_batches

SLOTS = 4
MAX_KICKS = 200
#: Digests of one shard, about.
SHARD_DIGESTS = 200_000


class CuckooFilter:
    """Partial-key cuckoo filter over 32-byte digests with bucketed content.

    ``tags[b]`` are the fingerprints of bucket ``b``; ``content[b]`` holds for each of them a list of
    digest, copies and keep_id, which moves with the fingerprint.  ``read`` counts the contents that
    were compared: about one for each live digest looked up and hardly any for others.
    """

    def __init__(self, capacity: int = 64):
        self.bits = max(4, int(np.ceil(np.log2(max(capacity, 1) / SLOTS / 0.8))))
        self.read = self.live = 0
        self._clear()

    def _clear(self) -> None:
        self.tags: list[list[int]] = [[] for _ in range(1 << self.bits)]
        self.content: list[list[list]] = [[] for _ in range(1 << self.bits)]
        self.turn = 0

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[8:16], "little") & ((1 << self.bits) - 1)
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ ((tag * 0x5BD1E995) & ((1 << self.bits) - 1))

    def maybe(self, digest: bytes) -> bool:
        """What the filter alone says: never false for a live digest."""
        tag, one, two = self._place(digest)
        return tag in self.tags[one] or tag in self.tags[two]

    def _find(self, digest: bytes) -> tuple[int, int] | None:
        """Bucket and slot of a live digest: fingerprints first, content where they agree."""
        tag, one, two = self._place(digest)
        for at in (one, two) if one != two else (one,):
            if tag in self.tags[at]:
                for slot, found in enumerate(self.tags[at]):
                    if found == tag:
                        self.read += 1
                        if self.content[at][slot][0] == digest:
                            return at, slot
        return None

    def _put(self, item: list) -> list | None:
        """Stores an item; the item that found no place after ``MAX_KICKS`` moves, if any."""
        tag, one, two = self._place(item[0])
        for at in (one, two):
            if len(self.tags[at]) < SLOTS:
                self.tags[at].append(tag)
                self.content[at].append(item)
                return None
        at = one
        for _ in range(MAX_KICKS):
            k = self.turn = (self.turn + 1) % SLOTS
            tag, self.tags[at][k] = self.tags[at][k], tag
            item, self.content[at][k] = self.content[at][k], item
            at = self._other(at, tag)
            if len(self.tags[at]) < SLOTS:
                self.tags[at].append(tag)
                self.content[at].append(item)
                return None
        return item

    def _grow(self, over: list) -> None:
        items = [*self.items(), over]
        while True:
            self.bits += 1
            self._clear()
            if all(self._put(x) is None for x in items):
                return

    def items(self) -> Iterator[list]:
        """digest, copies, keep_id of each live digest."""
        return (x for bucket in self.content for x in bucket)

    def insert(self, digest: bytes, copies: int = 1, keep_id: int | None = None) -> bool:
        """Adds rows of a digest; True if the digest was not live before."""
        found = self._find(digest)
        if found:
            item = self.content[found[0]][found[1]]
            item[1] += copies
            item[2] = item[2] if keep_id is None else keep_id if item[2] is None else max(item[2], keep_id)
            return False
        self.live += 1
        over = self._put([digest, copies, keep_id])
        if over is not None:
            self._grow(over)
        return True

    def delete(self, digest: bytes, copies: int | None = None) -> bool:
        """Takes ``copies`` rows of a live digest away (all, if null), and the digest with the last of them;
        False if it is not live.  keep_id stays while rows are left."""
        found = self._find(digest)
        if not found:
            return False
        at, slot = found
        item = self.content[at][slot]
        if copies is not None and copies < item[1]:
            item[1] -= copies
            return True
        for table in (self.tags, self.content):
            del table[at][slot]
        self.live -= 1
        return True

    def __contains__(self, digest: bytes) -> bool:
        return self._find(digest) is not None


def _digests(texts: list[str | None]) -> list[bytes]:
    """SHA-256 of each whole text after lower-casing A-Z; null counts as empty."""
    return [hashlib.sha256((t or b"").lower()).digest() for t in texts]


def with_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_digests(b.column(1).to_pylist()), pa.binary())], ["doc_id", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest binary")


def _sharded(digests: DataFrame, shards) -> DataFrame:
    return digests.withColumn("shard", F.conv(F.substring(F.hex("digest"), 9, 8), 16, 10).cast("long") % shards)


INDEX = "shard long, shards long, bits int, bucket long, digest binary, group_size long, keep_id long"


def _shard_rows(filt: CuckooFilter, shard: int, shards: int) -> pa.RecordBatch:
    rows = [(bucket, *item) for bucket, held in enumerate(filt.content) for item in held]
    columns = list(zip(*rows)) or [[]] * 4
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([shard] * n, pa.int64()), pa.array([shards] * n, pa.int64()), pa.array([filt.bits] * n, pa.int32()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64())))],
        [x.split()[0] for x in INDEX.split(", ")],
    )


def build_index(digests: DataFrame, shards: int) -> DataFrame:
    """The live digests of (doc_id, digest) with their copies and the largest doc_id, by shard and bucket.

    Rows of one digest are first summed on the map side, so a group of any size reaches its
    shard as one row for each input partition; the shard inserts them into its filter.  An empty
    table gives an empty index; null ids count as smallest; null digests are passed over.
    """
    partial = digests.where("digest IS NOT NULL").withColumn("part", F.spark_partition_id()).groupBy("part", "digest").agg(F.count(F.lit(1)).alias("copies"), F.max("doc_id").alias("doc_id"))
    return apply_changes(None, partial.select("digest", "copies", "doc_id", F.lit(True).alias("add")), shards)


def apply_changes(index: DataFrame | None, changes: DataFrame, shards: int | None = None) -> DataFrame:
    """A new index after ``changes(digest, copies, doc_id, add)``; rows with ``add`` false delete.

    A deletion takes ``copies`` rows of a digest away, all of them if that is null; a digest without
    rows is no longer live.  Within one call deletions come before insertions.  An index knows the
    number of its shards; with another ``shards`` all its digests are dealt anew, which is also what
    growth of the whole index asks for.  Shards are independent of each other; a lost executor only
    means that its shards are built again.
    """
    updating = index is not None
    if shards is None:
        shards = int((index.agg(F.max("shards")).first()[0] if updating else None) or 16)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of a shard stream in; only its live digests and the changes of the call are held
        filt, added = CuckooFilter(1024), []
        gone: list[tuple[bytes, int | None]] = []
        for b in batches:
            for digest, copies, doc, step in zip(*(b.column(c).to_pylist() for c in ("digest", "copies", "doc_id", "step"))):
                if step == 1:
                    gone.append((digest, copies))
                elif step == 2 and updating:
                    added.append((digest, copies, doc))
                else:
                    filt.insert(digest, copies, doc)
        for digest, copies in gone:
            filt.delete(digest, copies)
        for digest, copies, doc in added:
            filt.insert(digest, 1 if copies is None else copies, doc)
        yield _shard_rows(filt, key[0].as_py(), shards)

    step = F.when(F.col("add"), 2).otherwise(1).alias("step")
    rows = _sharded(changes.where("digest IS NOT NULL" if updating else "digest IS NOT NULL AND add"), shards).select("shard", "digest", "copies", "doc_id", step)
    if updating:
        old = _sharded(index.select("digest", "group_size", "keep_id"), shards)
        rows = old.select("shard", "digest", F.col("group_size").alias("copies"), F.col("keep_id").alias("doc_id"), F.lit(0).alias("step")).unionByName(rows)
    return rows.groupBy("shard").applyInArrow(run, INDEX)


def exact_duplicates(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of equal texts
    the row with the largest doc_id stays; null ids count as smallest, and a group of null ids
    only keeps a null keep_id with every row marked kept.  Rows that repeat the kept doc_id are
    marked kept together.  An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    digests = materialize(with_digests(docs), "digests")
    found = _looked_up(digests, shards)
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _looked_up(digests: DataFrame, shards: int | None) -> DataFrame:
    n = digests.count()
    index = materialize(build_index(digests, shards or max(16, n // SHARD_DIGESTS)), "cuckoo")
    return join_groups(digests, index.select("digest", "group_size", "keep_id"), "digest", "group_size")


def deduplicate(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """One document of each group of equal texts, all columns: a row with the largest doc_id.

    Of several such rows (one id, or no ids, and texts that differ in case only) any one stays.
    """
    small_batches(docs.sparkSession)
    own = docs.columns
    made = docs.toDF(*(f"__own_{k}" for k in range(len(own))))
    made = made.withColumns({"__id": F.col(f"__own_{own.index('doc_id')}").cast("long"), "__text": F.col(f"__own_{own.index('text')}").cast("binary")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_digests(b.column(b.schema.names.index("__text")).to_pylist()), pa.binary())], [*b.schema.names, "__digest"])

    digested = made.mapInArrow(run, StructType([*made.schema.fields, StructField("__digest", BinaryType())]))
    digests = materialize(with_digests(docs), "digests")
    kept = _looked_up(digests, shards).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    keys = materialize(kept.groupBy("digest", "doc_id", "group_size").agg(F.count(F.lit(1)).alias("rows")), "keep")
    keys = keys.select(F.col("digest").alias("__digest"), F.col("doc_id").alias("__keep"), F.col("group_size").alias("__size"), F.col("rows").alias("__rows"))
    found = join_groups(digested, keys, "__digest", "__size").where(F.col("__id").eqNullSafe(F.col("__keep")))
    out = found.where("__rows = 1")
    if not keys.where("__rows > 1").isEmpty():
        out = out.unionByName(found.where("__rows > 1").dropDuplicates(["__digest"]))
    return out.select(*(f"__own_{k}" for k in range(len(own)))).toDF(*own)
