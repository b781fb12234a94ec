"""Macroeconomic scenarios as shocks on the features of a portfolio, and what they do to its losses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scenario:
    """Shocks by role of a feature: value * factor + shift.

    ``loss`` is the share of the (shocked) assets by which net income falls.  Without assets, a profit is
    multiplied by ``profit`` and a loss by ``deeper``.  Inflation is a rate, which rises by ``inflation``
    points, or an index (over 50), which rises by as many per cent.
    """

    name: str
    factor: Mapping[str, float] = field(default_factory=dict)
    shift: Mapping[str, float] = field(default_factory=dict)
    loss: float = 0.0
    profit: float = 1.0
    deeper: float = 1.0
    inflation: float = 0.0

    def shocked(self, role: str, roles: Mapping[str, str]) -> Column:
        value = F.col(roles[role]).cast("double")
        if role == "net_income":
            if "assets" in roles:
                return value - self.loss * F.abs(self.shocked("assets", roles))
            return F.when(value > 0, value * self.profit).otherwise(value * self.deeper)
        if role == "inflation":
            return F.when(value > 50, value * (1 + self.inflation / 100)).otherwise(value + self.inflation)
        return value * self.factor.get(role, 1.0) + self.shift.get(role, 0.0)


BASE = Scenario("base")
#: Fixed values.
SCENARIOS = (
    Scenario("stagflation", {"working_capital": 0.75}, {"gdp_growth": -3.0, "distance": -1.0}, 0.05, 0.70, 1.30, 5.0),
    Scenario("rates", {"price": 0.80, "market_cap": 0.80}, {"interest_rate": 4.5, "distance": -2.0}, 0.03, 0.85, 1.15),
    Scenario("recession", {"working_capital": 0.50, "assets": 0.85, "market_cap": 0.60, "price": 0.60}, {"distance": -1.8, "gdp_growth": -5.0}, 0.12, -0.50, 2.0),
)


def apply_scenarios(df: DataFrame, roles: Mapping[str, str], scenarios: Sequence[Scenario] = SCENARIOS) -> DataFrame:
    """Each row once as it is (``scenario`` base) and once for each scenario with its features shocked.

    ``roles`` names the columns of working_capital, net_income, assets, distance, price, market_cap,
    inflation, gdp_growth and interest_rate, as far as there are any; others stay.  Nulls stay null, and
    net income becomes null where the assets are.  No shuffle: rows are multiplied where they lie.
    """
    each = [F.struct(F.lit(s.name).alias("scenario"), *[s.shocked(r, roles).alias(c) for r, c in roles.items()]) for s in (BASE, *scenarios)]
    shocked = set(roles.values()) | {"scenario"}
    return df.select(*[c for c in df.columns if c not in shocked], F.inline(F.array(*each)))


def scenario_losses(df: DataFrame, pd: str, tau: float = 0.5, ead: float = 1e7, lgd: float = 0.6) -> DataFrame:
    """Per scenario: obligors, mean_pd, alert_rate (PD from ``tau`` on), expected_loss, and its increment over
    the base in money and per cent (0 where the base loses nothing).  Null PDs count as obligors alone."""
    g = df.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("obligors"), F.avg(pd).alias("mean_pd"), F.avg((F.col(pd) >= tau).cast("double")).alias("alert_rate"),
        (F.coalesce(F.sum(pd), F.lit(0.0)) * ead * lgd).alias("expected_loss"),
    )
    base = g.where(F.col("scenario") == BASE.name).select(F.col("expected_loss").alias("__base"))  # one row
    found = g.crossJoin(F.broadcast(base)).withColumn("increment", F.col("expected_loss") - F.col("__base"))
    share = F.when(F.col("__base") > 0, F.col("increment") / F.col("__base") * 100.0).otherwise(0.0)
    return found.withColumn("increment_pct", share).drop("__base")
