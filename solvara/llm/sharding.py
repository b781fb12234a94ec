"""Shards by a Feistel permutation with cycle-walking over global row numbers (DataFrame functions only).

Rows are numbered in one order that doesn't depend on how the table is partitioned; a keyed
permutation gives row ``r`` of ``n`` the position ``p``, and the shard is ``p mod shards``, the slot
``p div shards``.  So shards differ by one row at most, slots have no gaps, and where a row goes can be
computed from (row, n, shards, key) alone, in both directions, without any table.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solvara.llm.common import materialize

SHARDS, KEY, ROUNDS = 16, 0x5EED, 6


def sides(n: int) -> tuple[int, int]:
    """The factors of the permuted range: ``a * b`` exceeds ``n`` by less than ``a``, about ``sqrt(n)``."""
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    return a, max(1, -(-n // a))


# ---------------------------------------------------------------- the permutation


def _round(key: int, r: int, half: Column) -> Column:
    """60 bits that depend on key, round and the other half."""
    digest = F.md5(F.concat(F.lit(f"{key}:{r}:"), half.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _once(df: DataFrame, column: str, n: int, key: int, inverse: bool = False) -> DataFrame:
    """``column`` of 0..a*b-1 permuted once; null stays null, at little cost."""
    a, b = sides(n)
    p = F.col(column)
    df = df.withColumns({"__left": p % a, "__right": F.floor(p / a) if a == 1 else F.expr(f"`{column}` div {a}")})
    for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        own, other, size = ("__left", "__right", a) if r % 2 == 0 else ("__right", "__left", b)
        shift = _round(key, r, F.col(other)) % size
        df = df.withColumn(own, (F.col(own) + (F.lit(size) - shift if inverse else shift)) % size)
    return df.withColumn(column, F.col("__right") * a + F.col("__left")).drop("__left", "__right")


def walks(spark: SparkSession, n: int, key: int = KEY, inverse: bool = False) -> int:
    """How often a value may fall outside 0..n-1 before it falls inside, over all of 0..n-1.

    Only values outside can be walked on, and they number less than ``a``.  Those that come from
    inside are followed until the last of them is inside again.
    """
    a, b = sides(n)
    if a * b == n:
        return 0
    outside = spark.range(n, a * b).withColumn("from", F.col("id"))
    found, steps = _once(outside, "from", n, key, not inverse).where(F.col("from") < n).select("id"), 0
    while not found.isEmpty():
        steps += 1
        found = materialize(_once(found, "id", n, key, inverse).where(F.col("id") >= n), "outside")
    return steps


def permuted(df: DataFrame, column: str, n: int, key: int = KEY, inverse: bool = False) -> DataFrame:
    """``df`` with ``column``, numbers of 0..n-1, replaced by their images under the permutation (or its inverse)."""
    more = walks(df.sparkSession, n, key, inverse)
    df = _once(df, column, n, key, inverse)
    for _ in range(more):
        df = df.withColumn("__walked", F.when(F.col(column) >= n, F.col(column)))
        df = _once(df, "__walked", n, key, inverse).withColumn(column, F.coalesce("__walked", column)).drop("__walked")
    return df


def place_of(row: int, n: int, shards: int = SHARDS, key: int = KEY) -> tuple[int, int]:
    """(shard, slot) of one row number."""
    p = _walk(row, n, key, False)
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, key: int = KEY) -> int:
    """The row number that stands in a slot of a shard: what a reader asks that resumes anywhere."""
    return _walk(slot * shards + shard, n, key, True)


def _walk(x: int, n: int, key: int, inverse: bool) -> int:
    a, b = sides(n)
    while True:
        left, right = x % a, x // a
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            half = right if r % 2 == 0 else left
            shift = int(hashlib.md5(f"{key}:{r}:{half}".encode()).hexdigest()[:15], 16)  # noqa: S324
            shift = -shift if inverse else shift
            left, right = ((left + shift) % a, right) if r % 2 == 0 else (left, (right + shift) % b)
        x = right * a + left
        if x < n:
            return x


# ---------------------------------------------------------------- row numbers and shards


def numbered(rows: DataFrame, order: list[str], number: str = "row") -> tuple[DataFrame, int]:
    """``rows`` with their number from 0 in ``order``, and how many they are.

    One range shuffle: rows are sorted within ranges and written, and the counts of the ranges (a table
    with as many rows as partitions, broadcast) are added up.  Rows that tie in ``order`` are told apart by where they were read, so
    that copies spread over ranges too.
    """
    placed = rows.withColumn("__read", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(*order, "__read").sortWithinPartitions(*order, "__read")
    ranged = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()).drop("__read"), "numbered")
    ranged = ranged.withColumns({"__range": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(2**33 - 1)})
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    n = int(counts.agg(F.sum("__n")).first()[0] or 0)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    found = ranged.join(F.broadcast(starts), "__range").withColumn(number, F.col("__first") + F.col("__at"))
    return found.drop("__range", "__at", "__first"), n


def sharded(docs: DataFrame, shards: int = SHARDS, key: int = KEY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, size, text_crc32, row, shard, slot, and the columns of ``docs`` named in ``keep`` as ``own_<name>``.

    size is the text's bytes in UTF-8 plus 1.  A null text has no bytes (size 1, checksum 0), null ids come
    first, rows that agree in id and text are interchangeable, an empty table gives no rows, and other
    columns are ignored.  The law is that of equal row counts; the same rows, key and number of shards
    give the same places, however the table is partitioned.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.unhex(F.md5(text)).alias("digest"),
        *[F.col(c).alias(f"own_{c}") for c in keep],
    )
    rows, n = numbered(rows, ["doc_id", "digest"])
    if not n:
        return rows.drop("digest").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    placed = permuted(rows.withColumn("place", F.col("row")), "place", n, key)
    placed = placed.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.expr(f"place div {shards}")})
    return placed.select("doc_id", "size", "text_crc32", "row", "shard", "slot", *[f"own_{c}" for c in keep])


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: int = KEY) -> None:
    """Writes all columns of ``docs`` as Parquet under ``path/shard=k``, with ``row`` and ``slot``, in the order of slots.

    A shard is dealt to ranges of slots, so no task holds a whole one.  ``path`` must not exist.
    """
    own = tuple(docs.columns)
    placed = sharded(docs, shards, key, own)
    placed = placed.select(*[F.col(f"own_{c}").alias(c) for c in own if c not in ("shard", "slot", "row")], "row", "shard", "slot")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


#: The same for DuckDB: checksums by half bytes, the permutation round by round, the walk as a recursion.
def _sql() -> str:
    bits = lambda half: f"('0x' || substr(md5('{KEY}:' || {{r}} || ':' || {half}), 1, 15))::BIGINT"
    steps, at = [], "x0"
    for r in range(ROUNDS):
        own = f"(l + {bits('rr').format(r=r)}) % a AS l, rr" if r % 2 == 0 else f"l, (rr + {bits('l').format(r=r)}) % b AS rr"
        steps.append(f"SELECT i, s, a, b, n, {own} FROM ({{}})")
    once = "SELECT i, s, a, b, n, p % a AS l, p // a AS rr FROM {}"
    for step in steps:
        once = step.format(once)
    once = f"SELECT i, s + 1 AS s, a, b, n, rr * a + l AS p FROM ({once})"
    return rf"""
WITH RECURSIVE c4 AS (SELECT list(t ORDER BY k) AS tab FROM (
  SELECT k, list_reduce(list_concat([k], [0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)::BIGINT AS t FROM (SELECT unnest(range(0, 16))::BIGINT AS k))),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) - 1 AS i FROM documents),
h AS (SELECT i, string_split(lower(hex(encode(text))), '') AS h, strlen(text) AS n FROM d),
c AS (SELECT i, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, 2 * n), lambda k: (instr('0123456789abcdef', h[k + 2 - 2 * (k % 2)]) - 1)::BIGINT)),
      lambda x, y: xor(x >> 4, tab[(xor(x, y) & 15) + 1])), 4294967295) AS crc FROM h, c4),
s AS (SELECT count(*)::BIGINT AS n, greatest(1, ceil(sqrt(count(*))))::BIGINT AS a FROM d),
w AS (SELECT i, 0 AS s, a, (n + a - 1) // a AS b, n, i::BIGINT AS p FROM d, s UNION ALL {once.format("(SELECT * FROM w WHERE s = 0 OR p >= n)")}),
f AS (SELECT i, arg_max(p, s) AS p FROM w GROUP BY i)
SELECT doc_id, (strlen(text) + 1)::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (p % {SHARDS})::INTEGER AS shard, p // {SHARDS} AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN c USING (i) JOIN f USING (i)
"""


SHARDING_SQL = _sql()
