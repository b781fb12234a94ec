"""The registry of queries and the bindings of the given tables to the roles of the domain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvara.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers ``f(t)`` where ``t(name)`` reads a table; ``sql`` may use the bindings below as tables."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, folder: f(lambda x: table(spark, folder, x))
        if sql:
            used = [b for n, b in BINDINGS.items() if f" {n}" in sql.replace("(", " ").replace("\n", " ")]
            used = [b for k, b in enumerate(used) if b not in used[:k]]
            body = sql.strip()
            if used:
                head = "WITH " + ", ".join(used)
                body = head + (", " + body[5:] if body.upper().startswith("WITH ") else "\n" + body)
            ORACLES[name] = body
        return f

    return add


#: SQL of the bindings; the functions below are the same in DataFrame form.
BINDINGS = {
    "filings": "filings AS (SELECT o_orderkey AS id, o_custkey AS entity, CAST(o_orderdate AS DATE) AS filed, o_orderpriority AS form, o_totalprice AS amount, o_orderstatus AS status FROM orders)",
    "lagged": "lagged AS (SELECT o_orderkey * 10 + l_linenumber AS id, o_custkey AS entity, CAST(o_orderdate AS DATE) AS period, CAST(l_shipdate AS DATE) AS filed, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))::INTEGER AS lag, o_orderpriority AS form, l_extendedprice AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey)",
    "quotes": "quotes AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY 1, 2)",
    "scored": "scored AS (SELECT event_id, user_id, event_type, round(value / (value + 50), 2) AS a, round(value / (value + 40 + event_id % 7), 2) AS b, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events)",
    "sheet": """sheet AS (SELECT c_custkey AS entity, c_nationkey AS nation, n_regionkey AS region, c_mktsegment AS segment, c_acctbal * 10 AS equity, c_acctbal AS net_income, c_acctbal * 2 AS ebit, c_acctbal * 3 AS retained_earnings,
  coalesce(round(sum(o_totalprice), 2), 0) AS total_assets, coalesce(round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2), 0) AS current_assets,
  coalesce(round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2), 0) AS current_liabilities, coalesce(max(o_totalprice), 0) AS revenue, coalesce(min(o_totalprice), 0) AS operating_cash_flow,
  coalesce(round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2), 0) AS cash
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)""",
}


#: Rows of lineitem in one part of ``quotes`` dealt by ticker.
PART_ROWS = 250_000


def filings(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("filed"), F.col("o_orderpriority").alias("form"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))


def lagged(t) -> DataFrame:
    j = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("period"), F.to_date("l_shipdate").alias("filed"),
        F.datediff("l_shipdate", "o_orderdate").alias("lag"), F.col("o_orderpriority").alias("form"), F.col("l_extendedprice").alias("value"),
    )


def quotes(t, dealt: bool = False) -> DataFrame:
    """The largest price of each ticker and day; ``dealt`` by ticker, parts of about ``PART_ROWS`` rows, where what follows is by ticker."""
    rows = t("lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    if dealt:
        rows = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS)), "ticker")
    return rows.groupBy("ticker", "day").agg(F.max("price").alias("price"))


def scored(t) -> DataFrame:
    v, e = F.col("value"), F.col("event_id")
    return t("events").select("event_id", "user_id", "event_type", F.round(v / (v + 50), 2).alias("a"), F.round(v / (v + 40 + e % 7), 2).alias("b"), (F.col("event_type") == "error").cast("int").alias("y"))


def sheet(t) -> DataFrame:
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    held = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.round(F.sum(price), 2).alias("total_assets"),
        *[F.round(F.sum(F.when(status == s, price)), 2).alias(n) for s, n in (("O", "current_assets"), ("F", "current_liabilities"), ("P", "cash"))],
        F.max(price).alias("revenue"),
        F.min(price).alias("operating_cash_flow"),
    )
    c = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(held, "c_custkey", "left")
    b = F.col("c_acctbal")
    return c.select(
        F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("segment"),
        (b * 10).alias("equity"), b.alias("net_income"), (b * 2).alias("ebit"), (b * 3).alias("retained_earnings"),
        *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("total_assets", "current_assets", "current_liabilities", "revenue", "operating_cash_flow", "cash")],
    )


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def day_text(c: str):
    return F.date_format(c, "yyyy-MM-dd")
