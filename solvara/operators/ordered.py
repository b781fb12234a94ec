"""Running sums and exact quantiles in one order over all rows, without a task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvara.sources import saved


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"__{k}"])
    return on


def running_sums(df: DataFrame, order: Sequence[str | Column], values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``<v>_upto`` (sum of v up to and with the row in ``order``) and ``<v>_all``, within each ``by``.

    Rows are dealt to ranges of (by, order); a range's sums are carried on to the ranges after it, so
    only the table of ranges meets in one place.  Rows that tie in ``order`` come in any order.
    """
    placed = saved(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("__range", *by).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    carried = sums.select(
        F.col("__range").alias("____range"), *[F.col(k).alias(f"__{k}") for k in by],
        *[x for v in values for x in (F.sum(v).over(before).alias(f"__{v}_before"), F.sum(v).over(whole).alias(f"{v}_all"))],
    )
    own = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(carried, _same(placed, carried, ["__range", *by]))
    joined = joined.withColumns({f"{v}_upto": F.sum(v).over(own) + F.coalesce(f"__{v}_before", F.lit(0)) for v in values})
    return joined.select(*df.columns, *[c for v in values for c in (f"{v}_upto", f"{v}_all")])


def quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = (), out: str = "q") -> DataFrame:
    """(by..., out): the exact quantiles of a column, linear between neighbours, as an array; nulls are passed over.

    Values are counted first, and the counts are summed in their order.  Without any value the result
    has no row for that ``by`` (one row of a null array without ``by``).
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    c = running_sums(counts, ["__v"], ["__n"], by)
    found = []
    for k, share in enumerate(shares):
        place = F.lit(share) * (F.col("__n_all") - 1)
        low, high = F.floor(place), F.ceil(place)
        found += [
            F.min(F.when(F.col("__n_upto") > low, F.col("__v"))).alias(f"__l{k}"),
            F.min(F.when(F.col("__n_upto") > high, F.col("__v"))).alias(f"__h{k}"),
            F.max(place - low).alias(f"__s{k}"),
        ]
    ends = c.groupBy(*by).agg(*found)
    each = [F.col(f"__l{k}") + F.col(f"__s{k}") * (F.col(f"__h{k}") - F.col(f"__l{k}")) for k in range(len(shares))]
    return ends.select(*by, F.when(F.col("__l0").isNotNull(), F.array(*each)).alias(out))
