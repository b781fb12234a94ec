"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every document has a fixed hash.  For each source the words are summed by hash bucket; the bucket
in which the running sum crosses the budget is refined by the next bits of the hash, and only its
rows are summed again.  The result is one threshold for each source, and the mix is a filter: no
documents are sorted or shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvara.llm.common import materialize
from solvara.operators.ordered import running_sums

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
LEVELS, BITS, HASH_BITS = 3, 10, 60
#: Source rows up to which the source table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 20_000


def _hash(doc_id, text):
    text = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash): words of the whole text and a 60-bit hash of id and text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _hash(F.col("doc_id"), F.col("text")).alias("hash"),
    )


def targets(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST) -> tuple[DataFrame, bool]:
    """(rank, source, source_size, target), the share of each source of all words, and whether sources are few.

    Sources by code point, null last, take the weights in turn.  A target stops at ``most`` times
    its source's size; the excess goes to the others by weight, until none is above: with sources
    ordered by ``most * size / weight`` those that stop are a prefix, and the rest share one level.
    Up to ``BROADCAST_SOURCES`` sources are ordered in one task, more by running sums over ranges.
    """
    per = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long")), "sources")
    few = per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    sums = _window_sums if few else running_sums
    per = sums(per, [F.col("source").asc_nulls_last()], ["one"]).withColumn("rank", F.col("one_upto") - 1).drop("one_upto", "one_all")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("w"))
    per = sums(per, ["fill", "rank"], ["cap", "w", "source_size", "one"])
    level = (F.col("source_size_all").cast("double") - (F.col("cap_upto") - F.col("cap"))) / (F.col("w_all") - F.col("w_upto") + F.col("w"))
    per = per.withColumn("level", level)
    free = F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct(F.col("one_upto").alias("at"), "level"))
    first = per.agg(F.coalesce(F.min(free)["level"], F.lit(float("inf"))).alias("free_level"))
    per = per.crossJoin(F.broadcast(first))
    return per.select("rank", "source", "source_size", F.least("cap", F.col("free_level") * F.col("w")).alias("target")), few


def _window_sums(df: DataFrame, order: list, values: list[str]) -> DataFrame:
    """``running_sums`` of a bounded table, in one task."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    return df.withColumns({f"{v}_upto": F.sum(v).over(w) for v in values} | {f"{v}_all": F.sum(v).over(whole) for v in values})


def thresholds(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """(rank, below): the rows of a source with ``hash >> (60 - 30) < below`` are taken once more.

    ``rows`` has rank, size and hash; ``plan`` has rank and budget, the words beyond whole repeats.
    Where sources aren't few, the state of a level is joined by a shuffle (whose skewed partitions
    are split when it runs).
    """
    state = plan.where("budget > 0").select("rank", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("rest"), F.lit(0).cast("long").alias("held"))
    for k in range(LEVELS):
        done, left = HASH_BITS - BITS * k, HASH_BITS - BITS * (k + 1)
        boundary = rows.withColumn("prefix", F.shiftright("hash", done)).join(_known(state.select("rank", "prefix"), few), ["rank", "prefix"])
        bucket = F.shiftright("hash", left).bitwiseAND(2**BITS - 1)
        sums = boundary.groupBy("rank", bucket.alias("bucket")).agg(F.sum("size").alias("held"))
        running = F.sum("held").over(Window.partitionBy("rank").orderBy("bucket"))
        crossing = (
            sums.withColumn("upto", running)
            .join(_known(state.select("rank", "prefix", "rest"), few), "rank")
            .where("upto > rest")
            .groupBy("rank")
            .agg(F.min(F.struct("bucket", "upto", "held", "prefix", "rest")).alias("x"))
        )
        found = crossing.select(
            "rank",
            (F.col("x.prefix") * 2**BITS + F.col("x.bucket")).alias("prefix"),
            (F.col("x.rest") - (F.col("x.upto") - F.col("x.held"))).alias("rest"),
            F.col("x.held").alias("held"),
        )
        state = materialize(found.coalesce(1) if few else found, "boundary")
    nearer = (F.col("held") - F.col("rest") <= F.col("rest")).cast("long")
    return state.select("rank", (F.col("prefix") + nearer).alias("below"))


def _known(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def plan(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST) -> tuple[DataFrame, bool]:
    """(source, source_size, target, whole, below) of each source of ``sized`` rows, and whether they are few.

    A document is taken ``whole`` times, and once more if its hash is below the threshold.
    """
    goal, few = targets(rows, weights, most)
    goal = materialize(goal, "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    named = _known(goal.select(F.col("source").alias("__source"), "rank"), few)
    ranked = rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    limit = thresholds(ranked, goal, few)
    return goal.join(limit, "rank", "left").select("source", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below")), few


def _times(hash_column: str):
    return F.col("whole") + (F.shiftright(hash_column, HASH_BITS - BITS * LEVELS) < F.col("below")).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, times (how often the mix has it).

    ``taken = times * size`` and ``times`` is at most ``most``.  The whole part of target over
    source size is taken of every document, the rest of those below the source's hash threshold.
    Null text has size 0, null sources are a source of their own, equal rows share one hash and so
    one decision, an empty table gives no rows, and other columns are ignored.  Reruns agree.
    """
    rows = materialize(sized(docs), "sized")
    goal, few = plan(rows, weights, most)
    found = rows.join(_known(goal.withColumnRenamed("source", "__source"), few), F.col("source").eqNullSafe(F.col("__source")))
    return found.withColumn("times", _times("hash")).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times")


def repeat_rows(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` says (0 to ``most`` times), all columns.

    A null source is a source of its own.  Null, empty and blank texts have no words: they are taken like
    others of their source, at no cost.  Rows alike in id and text are taken alike.  Own columns may have
    any names; an empty table stays empty.
    """
    rows = materialize(sized(docs), "sized")
    goal, few = plan(rows, weights, most)
    own = docs.columns
    named = docs.toDF(*(f"__own_{k}" for k in range(len(own))))
    named = named.withColumn("__hash", _hash(F.col(f"__own_{own.index('doc_id')}"), F.col(f"__own_{own.index('text')}")))
    source = F.col(f"__own_{own.index('source')}").cast("string")
    found = named.join(_known(goal.withColumnRenamed("source", "__source"), few), source.eqNullSafe(F.col("__source")))
    copies = found.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), _times("__hash").cast("int"))))
    return copies.select(*(f"__own_{k}" for k in range(len(own)))).toDF(*own)


#: The same rules for DuckDB, with one cumulative sum over the last level's buckets.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT) >> 30 AS b
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, (rk % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM s),
l AS (
  SELECT *, row_number() OVER o AS pos,
         (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM w WINDOW o AS (ORDER BY cap / w, rk)),
f AS (SELECT *, (SELECT arg_min(lev, pos) FROM l WHERE lev * w < cap) AS lv FROM l),
t AS (SELECT source, rk, source_size, least(cap, coalesce(lv, 'inf'::DOUBLE) * w) AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT *, target - whole * source_size AS budget FROM p),
h AS (SELECT q.rk, b, sum(size) AS held, any_value(budget) AS budget FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source WHERE budget > 0 GROUP BY q.rk, b),
c AS (SELECT *, sum(held) OVER (PARTITION BY rk ORDER BY b) AS upto FROM h),
x AS (SELECT rk, arg_min(b, b) AS b, arg_min(held, b) AS held, arg_min(budget - (upto - held), b) AS rest FROM c WHERE upto > budget GROUP BY rk)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN d.b < x.b + (CASE WHEN x.held - x.rest <= x.rest THEN 1 ELSE 0 END) THEN 1 ELSE 0 END) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN x ON q.rk = x.rk
"""
