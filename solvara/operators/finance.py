"""Accounting ratios, distress scores, market measures and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvara.functions import clip, normal_cdf, ratio
from solvara.operators.ordered import quantiles


def median(df: DataFrame, column: str, out: str) -> DataFrame:
    """One row: the median of a column over all rows."""
    return quantiles(df, column, [0.5]).select(F.col("q")[0].alias(out))


def accounting_ratios(df: DataFrame) -> DataFrame:
    """Protected ratios from the balance-sheet columns (zero or null denominators give 0)."""
    c = F.col
    debt = F.coalesce(F.nullif(c("liabilities_and_equity") - c("equity"), F.lit(0.0)), c("current_liabilities"), F.lit(0.0))
    return df.withColumn("total_liabilities", debt).withColumns(
        {
            "current_ratio": ratio("current_assets", "current_liabilities"),
            "quick_ratio": ratio(c("current_assets") - F.coalesce("inventory", F.lit(0.0)), "current_liabilities"),
            "cash_ratio": ratio("cash", "current_liabilities"),
            "debt_to_equity": ratio("total_liabilities", "equity"),
            "debt_to_assets": ratio("total_liabilities", "total_assets"),
            "roa": ratio("net_income", "total_assets"),
            "roe": ratio("net_income", "equity"),
            "net_margin": ratio("net_income", "revenue"),
            "asset_turnover": ratio("revenue", "total_assets"),
            "cash_flow_to_debt": ratio("operating_cash_flow", "total_liabilities"),
            "working_capital_ratio": ratio(c("current_assets") - c("current_liabilities"), "total_assets"),
        }
    )


def epsilon_ratios(df: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Ten ratios whose denominators are raised by ``eps``, and the five-factor score of the first five."""
    c = F.col
    over = lambda a, b: a / (c(b) + eps)
    out = df.withColumns(
        {
            "r1_wc_ta": over(c("current_assets") - c("current_liabilities"), "total_assets"),
            "r2_re_ta": over(c("retained_earnings"), "total_assets"),
            "r3_ebit_ta": over(c("ebit"), "total_assets"),
            "r4_mve_tl": over(c("market_value"), "total_liabilities"),
            "r5_sales_ta": over(c("revenue"), "total_assets"),
            "r6_current": over(c("current_assets"), "current_liabilities"),
            "r7_quick": over(c("current_assets") - c("inventory"), "current_liabilities"),
            "r8_debt_assets": over(c("total_liabilities"), "total_assets"),
            "r9_net_margin": over(c("net_income"), "revenue"),
            "r10_ebitda_margin": over(c("ebitda"), "revenue"),
        }
    )
    return out.withColumn("z", 1.2 * c("r1_wc_ta") + 1.4 * c("r2_re_ta") + 3.3 * c("r3_ebit_ta") + 0.6 * c("r4_mve_tl") + 0.999 * c("r5_sales_ta"))


def structural_proxies(df: DataFrame, entity: str, order: str, eps: float = 1e-5) -> DataFrame:
    """Firm value, default point, three-period volatility of operating return, distance to default and its
    probability, interest cover, cash flow to debt and working capital to sales.

    The volatility of an entity's first row is 0.01.
    """
    c = F.col
    w = Window.partitionBy(entity).orderBy(order).rowsBetween(-2, 0)
    roa = c("ebit") / (c("total_assets") + eps)
    out = df.withColumn("firm_value", c("market_value") + c("total_liabilities")).withColumn("default_point", c("current_liabilities") + 0.5 * c("long_term_debt"))
    out = out.withColumn("__roa", roa).withColumn("roa_volatility", F.coalesce(F.stddev_samp("__roa").over(w), F.lit(0.01))).drop("__roa")
    out = out.withColumn("dtd", F.ln((c("firm_value") + eps) / (c("default_point") + eps)) / (c("roa_volatility") + eps))
    return out.withColumns(
        {
            "pd": normal_cdf(-c("dtd")),
            "interest_cover": c("ebitda") / (c("long_term_debt") * 0.05 + eps),
            "cash_flow_to_debt": (c("net_income") + c("depreciation")) / (c("total_liabilities") + eps),
            "working_capital_to_sales": (c("current_assets") - c("current_liabilities")) / (c("revenue") + eps),
        }
    )


def request_altman(df: DataFrame, out: str = "altman_z") -> DataFrame:
    """The five-factor score of a scoring request: null and zero fields fall back to their stand-ins.

    Assets: 1; earnings before interest: net income; market value and sales: assets; liabilities: assets
    less equity, or half of the assets if that isn't positive.
    """
    set_ = lambda name: F.nullif(F.col(name).cast("double"), F.lit(0.0))
    assets = F.when(F.coalesce(set_("total_assets"), F.lit(1.0)) > 0, F.coalesce(set_("total_assets"), F.lit(1.0))).otherwise(1.0)
    d = df.withColumn("__ta", assets)
    ta = F.col("__ta")
    debt = F.coalesce(set_("total_liabilities"), ta - F.coalesce(F.col("equity").cast("double"), F.lit(0.0)))
    d = d.withColumn("__tl", F.when(debt <= 0, ta * 0.5).otherwise(debt))
    part = lambda *names: F.coalesce(*[set_(x) for x in names], F.lit(0.0)) / ta
    z = 1.2 * part("working_capital") + 1.4 * part("retained_earnings") + 3.3 * part("ebit", "net_income")
    z = z + 0.6 * F.coalesce(set_("market_value"), ta) / F.col("__tl") + 0.999 * F.coalesce(set_("revenue"), ta) / ta
    return d.withColumn(out, z).drop("__ta", "__tl")


def firm_value_and_sigma(df: DataFrame, debt: str, cap: str, assets: str, volatility: str, market: str) -> DataFrame:
    """firm_asset_value: debt and market value together, at least the assets and 10,000; sigma_asset: own
    volatility (if not 0), else the market's, else 0.35, and at least 0.05."""
    value = F.greatest(F.col(debt) + F.col(cap), F.coalesce(assets, F.lit(0.0)), F.lit(10_000.0))
    sigma = F.greatest(F.coalesce(F.nullif(F.col(volatility), F.lit(0.0)), market, F.lit(0.35)), F.lit(0.05))
    return df.withColumns({"firm_asset_value": value, "sigma_asset": sigma})


def altman_z(df: DataFrame, out: str = "altman_z") -> DataFrame:
    """The five-factor Z score (weights 1.2, 1.4, 3.3, 0.6, 0.999)."""
    wc = F.col("current_assets") - F.col("current_liabilities")
    z = 1.2 * ratio(wc, "total_assets") + 1.4 * ratio("retained_earnings", "total_assets") + 3.3 * ratio("ebit", "total_assets")
    return df.withColumn(out, z + 0.6 * ratio("equity", "total_liabilities") + 0.999 * ratio("revenue", "total_assets"))


def altman_z2(df: DataFrame, out: str = "altman_z2") -> DataFrame:
    """The four-factor Z'' score (6.56, 3.26, 6.72, 1.05), kept within -10..20, and its zone."""
    wc = F.col("current_assets") - F.col("current_liabilities")
    z = 6.56 * ratio(wc, "total_assets") + 3.26 * ratio("retained_earnings", "total_assets") + 6.72 * ratio("ebit", "total_assets") + 1.05 * ratio("equity", "total_liabilities")
    return df.withColumn(out, clip(z, -10, 20)).withColumn(f"{out}_zone", F.when(F.col(out) < 1.1, "distress").when(F.col(out) <= 2.6, "grey").otherwise("safe"))


def ohlson_o(df: DataFrame, out: str = "ohlson_o") -> DataFrame:
    """The nine-factor O score without its growth term."""
    c = F.col
    size = F.ln(F.greatest(c("total_assets"), F.lit(1.0)))
    o = -1.32 - 0.407 * size + 6.03 * ratio("total_liabilities", "total_assets") - 1.43 * ratio(c("current_assets") - c("current_liabilities"), "total_assets")
    o = o + 0.0757 * ratio("current_liabilities", "current_assets") - 1.72 * F.when(c("total_liabilities") > c("total_assets"), 1.0).otherwise(0.0)
    o = o - 2.37 * ratio("net_income", "total_assets") - 1.83 * ratio("operating_cash_flow", "total_liabilities")
    return df.withColumn(out, o + 0.285 * F.when(c("net_income") < 0, 1.0).otherwise(0.0))


def springate(df: DataFrame, out: str = "springate") -> DataFrame:
    wc = F.col("current_assets") - F.col("current_liabilities")
    return df.withColumn(out, 1.03 * ratio(wc, "total_assets") + 3.07 * ratio("ebit", "total_assets") + 0.66 * ratio("ebit", "current_liabilities") + 0.4 * ratio("revenue", "total_assets"))


def zmijewski(df: DataFrame, out: str = "zmijewski") -> DataFrame:
    return df.withColumn(out, -4.336 - 4.513 * ratio("net_income", "total_assets") + 5.679 * ratio("total_liabilities", "total_assets") + 0.004 * ratio("current_assets", "current_liabilities"))


def distress_flag(df: DataFrame, out: str = "distress") -> DataFrame:
    """1 if insolvent on the books, close to default and short of both capital and profit; nulls count as no."""
    c = F.col
    books = (c("equity") <= 0) | (c("total_liabilities") >= c("total_assets"))
    wc = c("current_assets") - c("current_liabilities")
    return df.withColumn(out, F.when(books & (c("distance_to_default") <= 0.5) & (wc < 0) & (c("net_income") < 0), 1).otherwise(0))


def distance_to_default(value, debt, sigma, mu: float = 0.05):
    """(ln(V / D) + mu - sigma^2 / 2) / sigma; null without positive value, debt and sigma."""
    ok = (value > 0) & (debt > 0) & (sigma > 0)
    return F.when(ok, (F.ln(value / debt) + mu - sigma * sigma / 2.0) / sigma)


def market_cap(price, shares, public_float):
    """Price times shares, else the public float, else 0."""
    return F.coalesce(F.nullif(price * shares, F.lit(0.0)), public_float, F.lit(0.0))


def debt_cascade(df: DataFrame, debt: str, assets: str, sector: str, out: str = "debt_face", last: float = 10_000.0) -> DataFrame:
    """A debt face value: own, else assets times the sector's median debt share (0.25 without one),
    else the sector's median debt, the market's, ``last``."""
    own = F.nullif(F.col(debt), F.lit(0.0))
    share = F.when(F.col(assets) > 0, own / F.col(assets))
    by = df.groupBy(sector).agg(F.median(own).alias("__sd"), F.median(share).alias("__ss"))
    market = median(df.withColumn("__own", own), "__own", "__md")
    joined = df.join(by.withColumnRenamed(sector, "__s"), F.col(sector).eqNullSafe(F.col("__s")), "left").crossJoin(F.broadcast(market))
    scaled = F.when(F.col(assets) > 0, F.col(assets) * F.coalesce("__ss", F.lit(0.25)))
    return joined.withColumn(out, F.coalesce(own, scaled, F.col("__sd"), F.col("__md"), F.lit(last))).drop("__s", "__sd", "__ss", "__md")


def hier_impute(df: DataFrame, column: str, levels: Sequence[Sequence[str]], default: float, out: str | None = None) -> DataFrame:
    """``column``, else its median over the first level of keys that has one, else over all rows,
    else ``default``; ``<out>_level`` tells which (0 own, 1.. levels, then all, then default).

    Each level is one aggregate; AQE broadcasts it if it is small.
    """
    out = out or f"{column}_imputed"
    parts, rows = [F.col(column)], df
    for k, keys in enumerate(levels, 1):
        med = df.groupBy(*keys).agg(F.median(column).alias(f"__m{k}")).toDF(*[f"__k{k}{i}" for i in range(len(keys))], f"__m{k}")
        on = None
        for i, key in enumerate(keys):
            same = F.col(key).eqNullSafe(F.col(f"__k{k}{i}"))
            on = same if on is None else on & same
        rows = rows.join(med, on, "left")
        parts.append(F.col(f"__m{k}"))
    rows = rows.crossJoin(F.broadcast(median(df, column, "__all")))
    parts.append(F.col("__all"))
    level = None
    for k, p in enumerate(parts):
        level = F.when(p.isNotNull(), k) if level is None else level.when(p.isNotNull(), k)
    return rows.withColumn(out, F.coalesce(*parts, F.lit(default))).withColumn(f"{out}_level", level.otherwise(len(parts))).select(*df.columns, out, f"{out}_level")


def fit_median_scale(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: median, mean and population deviation (after median imputation) of each column."""
    med = None
    for c in columns:
        one = median(train, c, f"{c}__median")
        med = one if med is None else med.crossJoin(F.broadcast(one))
    filled = train.crossJoin(F.broadcast(med)).select(*[F.coalesce(c, f"{c}__median").alias(c) for c in columns])
    scale = filled.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"))])
    return med.crossJoin(F.broadcast(scale))


def apply_median_scale(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    made = {c: F.coalesce(F.try_divide(F.coalesce(c, f"{c}__median") - F.col(f"{c}__mean"), F.col(f"{c}__std")), F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(fitted)).withColumns(made).select(*df.columns)


def winsorise(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values beyond the two quantiles are moved to them."""
    edges = None
    for c in columns:
        one = quantiles(df, c, [low, high], out=f"__{c}")
        edges = one if edges is None else edges.crossJoin(F.broadcast(one))
    made = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"__{c}")[0]), F.col(f"__{c}")[1])) for c in columns}
    return df.crossJoin(F.broadcast(edges)).withColumns(made).select(*df.columns)


def pivot_facts(df: DataFrame, key: str, tag: str, value: str, tags: Sequence[str], order: str) -> DataFrame:
    """One row for each key and one column for each tag: the value of the tag's newest fact."""
    return df.groupBy(key).pivot(tag, list(tags)).agg(F.max_by(value, order))


def combined_tags(df: DataFrame, synonyms: dict[str, Sequence[str]]) -> DataFrame:
    """``<name>_combined``: the first of some synonymous columns that has a value."""
    return df.withColumns({f"{name}_combined": F.coalesce(*found) for name, found in synonyms.items()})


def balanced_sheet(df: DataFrame, assets: str, liabilities: str, equity: str) -> DataFrame:
    """A missing one of assets, liabilities and equity as the other two give it."""
    a, b, e = (F.col(x) for x in (assets, liabilities, equity))
    return df.select("*").withColumns({assets: F.coalesce(a, b + e), liabilities: F.coalesce(b, a - e), equity: F.coalesce(e, a - b)})


def consolidate_events(df: DataFrame, entity: str, date: str, source: str) -> DataFrame:
    """Earliest event of each entity with its source, all sources and their number."""
    return df.groupBy(entity).agg(
        F.min(date).alias("first_date"),
        F.min_by(source, F.struct(date, source)).alias("first_source"),
        F.concat_ws("|", F.array_sort(F.collect_set(source))).alias("sources"),
        F.count_distinct(source).alias("n_sources"),
    )


def silent_share(df: DataFrame, by: str, column: str) -> DataFrame:
    """Rows and share of nulls of a column for each key."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(column).isNull().cast("double")).alias("null_share"))


def market_window(df: DataFrame, by: str, order: str, column: str, rows: int) -> DataFrame:
    """Mean, least, greatest and sample deviation over the last ``rows`` rows of a key."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumns({f"{column}_{n}": f(column).over(w) for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))})
