"""Statement-based scores: strength, bankruptcy risk, earnings quality, cash flow, dividends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from equiloom.functions.expressions import as_int, clamp, holds, ladder, ratio
from equiloom.functions.frames import by_symbol, latest_by, quarters_only, top_per_group
from equiloom.functions.ranking import numbered, with_percentile
from equiloom.operators.aggregates import annual_fundamentals, yearly_dividends
from equiloom.operators.filters import eligible_universe
from equiloom.operators.series import days_between, dividend_changes, dividend_streaks, year_ago
from equiloom.sources.maintenance import update_from

FSCORE_FLAGS = (
    "positive_net_income", "positive_ocf", "increasing_roa", "quality_earnings", "decreasing_leverage",
    "improving_liquidity", "no_dilution", "improving_margin", "improving_efficiency",
)


def _newest_quarter(quarters: DataFrame) -> DataFrame:
    """Newest row per symbol after the lag columns were added; the rows are already
    partitioned by symbol, so the aggregate adds no shuffle."""
    return latest_by(quarters, ["symbol"], "fiscal_date")


def piotroski(quarters: DataFrame, universe: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Nine yes/no tests of the newest quarter against the year-ago and previous quarters.

    ``prices`` adds the latest price and the market value at it.
    """
    items = ("net_income", "revenue", "total_assets", "total_debt", "shares")
    before = by_symbol("fiscal_date")
    lagged = year_ago(quarters, items).withColumns({
        "prev_assets": F.lag("total_assets").over(before), "prev_liabilities": F.lag("total_liabilities").over(before),
    })
    c = F.col

    def over(top: str, bottom: str) -> Column:
        """Ratio of the newest quarter; only a positive denominator counts."""
        return ratio(c(top), F.when(c(bottom) > 0, c(bottom)))

    listed = eligible_universe(universe, security_type=None, exclude_etf=True).select("symbol", "sector", "industry")
    rows = _newest_quarter(lagged).join(listed, "symbol")
    ratios = rows.withColumns({
        "current_roa": over("net_income", "total_assets"), "prior_roa": over("prior_net_income", "prior_total_assets"),
        "current_debt_ratio": over("total_debt", "total_assets"),
        "prior_debt_ratio": over("prior_total_debt", "prior_total_assets"),
        "current_ratio": over("total_assets", "total_liabilities"), "prev_ratio": over("prev_assets", "prev_liabilities"),
        "current_margin": over("net_income", "revenue"), "prior_margin": over("prior_net_income", "prior_revenue"),
        "current_turnover": over("revenue", "total_assets"), "prior_turnover": over("prior_revenue", "prior_total_assets"),
    })
    # A return on assets or leverage comparison needs both years, as does turnover.
    tests = {
        "positive_net_income": c("net_income") > 0,
        "positive_ocf": c("operating_cash_flow") > 0,
        "increasing_roa": c("current_roa") > c("prior_roa"),
        "quality_earnings": c("operating_cash_flow") > c("net_income"),
        "decreasing_leverage": c("current_debt_ratio") < c("prior_debt_ratio"),
        "improving_liquidity": c("current_ratio") > c("prev_ratio"),
        "no_dilution": c("shares") <= c("prior_shares") * 1.02,
        "improving_margin": c("current_margin") > c("prior_margin"),
        "improving_efficiency": c("current_turnover") > c("prior_turnover"),
    }
    flagged = ratios.withColumns({name: holds(test) for name, test in tests.items()})
    score = sum((as_int(c(f)) for f in FSCORE_FLAGS), F.lit(0))
    scored = flagged.withColumn("fscore", score)
    result = scored.select(
        "symbol", "sector", c("fiscal_date").alias("calculation_date"), *FSCORE_FLAGS, "fscore",
        ladder(c("fscore"), [(7, "STRONG"), (4, "MODERATE")], "WEAK").alias("strength_category"),
        (c("current_roa") * 100).alias("current_roa"), (c("prior_roa") * 100).alias("prior_roa"),
        "current_debt_ratio", "prior_debt_ratio", "current_ratio", (c("current_margin") * 100).alias("current_margin"),
        (c("prior_margin") * 100).alias("prior_margin"), "current_turnover", "prior_turnover", "shares",
    )
    if prices is None:
        return result
    latest = prices.groupBy("symbol").agg(F.max_by("close", "trade_date").alias("latest_price"))
    return result.join(latest, "symbol", "left").withColumn("price_market_cap", c("latest_price") * c("shares"))


MANUFACTURING = ("MANUFACTURING", "INDUSTRIALS")
CAPPED_X4 = 10.0


def altman(quarters: DataFrame, universe: DataFrame) -> DataFrame:
    """Z for manufacturers, Z' for the rest, from the newest quarter with assets."""
    c = F.col
    listed = eligible_universe(universe).select("symbol", "sector", "market_cap")
    rows = latest_by(quarters_only(quarters).where(c("total_assets") > 0), ["symbol"], "fiscal_date").join(listed, "symbol")
    assets, owed = c("total_assets"), c("total_liabilities")

    def per_asset(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0)) / assets

    working = F.coalesce(assets - owed, F.lit(0.0)) - F.coalesce(owed * 0.5, F.lit(0.0))
    parts = rows.withColumns({
        "x1": working / assets, "x2": per_asset(c("equity") * 0.3), "x3": per_asset(c("operating_income")),
        "x4": F.when(owed > 0, F.coalesce(c("market_cap"), F.lit(0.0)) / owed).otherwise(CAPPED_X4),
        "x5": per_asset(c("revenue")), "is_manufacturing": holds(F.upper("sector").isin(*MANUFACTURING)),
    })
    z = 1.2 * c("x1") + 1.4 * c("x2") + 3.3 * c("x3") + 0.6 * c("x4") + 1.0 * c("x5")
    z_prime = 6.56 * c("x1") + 3.26 * c("x2") + 6.72 * c("x3") + 1.05 * c("x4")
    scored = parts.withColumns({"z_score": z, "z_prime_score": z_prime})
    risk = F.when(
        c("is_manufacturing"), ladder(c("z_score"), [(2.99, "SAFE"), (1.81, "GREY")], "DISTRESS", by=">")
    ).otherwise(ladder(c("z_prime_score"), [(2.6, "SAFE"), (1.1, "GREY")], "DISTRESS", by=">"))
    return scored.select(
        "symbol", "sector", c("fiscal_date").alias("calculation_date"), "z_score", "z_prime_score",
        c("x1").alias("working_capital_ratio"), c("x2").alias("retained_earnings_ratio"), c("x3").alias("ebit_ratio"),
        F.least(c("x4"), F.lit(CAPPED_X4)).alias("market_to_book_liability"), c("x5").alias("sales_to_assets"),
        risk.alias("risk_category"), "is_manufacturing",
    )


def beneish(quarters: DataFrame, universe: DataFrame) -> DataFrame:
    """Eight year-over-year indices and the manipulation score built from them."""
    c = F.col
    items = ("revenue", "gross_profit", "total_assets", "total_liabilities", "cash", "capex", "operating_income")
    rows = latest_by(year_ago(quarters.where(c("total_assets") > 0), items), ["symbol"], "fiscal_date")
    rows = rows.join(eligible_universe(universe).select("symbol"), "symbol").where(
        (c("revenue") > 0) & (c("prior_revenue") > 0) & (c("prior_total_assets") > 0)
    )

    def index(top: Column, bottom: Column) -> Column:
        """Ratio of two rates; 1 when the lower one is not positive."""
        return F.when(bottom > 0, top / bottom).otherwise(1.0)

    def rate(name: str, base: str, prefix: str = "") -> Column:
        return c(prefix + name) / c(prefix + base)

    assets, before = c("total_assets"), c("prior_total_assets")
    prior_cash, prior_capex = F.coalesce("prior_cash", F.lit(0.0)), F.coalesce("prior_capex", F.lit(0.0))
    prior_operating = F.coalesce("prior_operating_income", "operating_income")
    accruals = c("net_income") - F.coalesce("operating_cash_flow", F.lit(0.0))
    indices = rows.withColumns({
        "dsri": index(rate("revenue", "total_assets") * 365, rate("revenue", "total_assets", "prior_") * 365),
        "gmi": index(rate("gross_profit", "revenue", "prior_"), rate("gross_profit", "revenue")),
        "aqi": index((assets - c("cash")) / assets, (before - prior_cash) / before),
        "sgi": c("revenue") / c("prior_revenue"),
        "depi": index(F.abs(prior_capex) / before, F.abs("capex") / assets),
        "sgai": index(1 - rate("operating_income", "revenue"), 1 - prior_operating / c("prior_revenue")),
        "lvgi": index(rate("total_liabilities", "total_assets"), rate("total_liabilities", "total_assets", "prior_")),
        "tata": accruals / assets,
    })
    m = (
        -4.84 + 0.92 * c("dsri") + 0.528 * c("gmi") + 0.404 * c("aqi") + 0.892 * c("sgi") + 0.115 * c("depi")
        - 0.172 * c("sgai") + 4.679 * c("tata") - 0.327 * c("lvgi")
    )
    risk = ladder(c("m_score"), [(-2.22, "LOW"), (-1.78, "MODERATE")], "HIGH", by="<")
    return indices.withColumn("m_score", m).select(
        "symbol", c("fiscal_date").alias("calculation_date"), "dsri", "gmi", "aqi", "sgi", "depi", "sgai", "lvgi", "tata",
        "m_score", risk.alias("manipulation_risk"), (risk == "HIGH").alias("risk_flag"),
        clamp(50 + (-2.22 - c("m_score")) * 20).alias("quality_score"), (c("sgi") - 1).alias("revenue_growth"),
    )


CASH_RATINGS = [(80, "Excellent"), (60, "Very Good"), (40, "Good"), (20, "Fair"), (0, "Poor")]


def cash_rating(pct: Column) -> Column:
    return F.coalesce(ladder(pct, CASH_RATINGS, "Warning"), F.lit("Unknown"))


def yearly_excess(quarters: DataFrame, dividends: DataFrame) -> DataFrame:
    """Cash left per share and year after dividends and capital spending."""
    c = F.col
    annual = annual_fundamentals(quarters).where(
        c("operating_cash_flow").isNotNull() & c("free_cash_flow").isNotNull() & (c("shares") > 0)
    )
    paid = yearly_dividends(dividends).select("symbol", c("year").alias("fiscal_year"), "total_dividend")
    joined = annual.join(paid, ["symbol", "fiscal_year"], "left").select(
        "symbol", "fiscal_year", "fiscal_date", (c("operating_cash_flow") / c("shares")).alias("cash_flow_per_share"),
        ((c("operating_cash_flow") - c("free_cash_flow")) / c("shares")).alias("capex_per_share"),
        F.coalesce("total_dividend", F.lit(0.0)).alias("dividends_per_share"),
    )
    excess = c("cash_flow_per_share") - c("dividends_per_share") - c("capex_per_share")
    pct = F.when(c("cash_flow_per_share") > 0, excess / c("cash_flow_per_share") * 100)
    newest = Window.partitionBy("symbol").orderBy(F.desc("fiscal_year"))
    return joined.withColumns({"excess_cash_flow": excess, "excess_cash_flow_pct": pct, "row_no": F.row_number().over(newest)})


def known_points(history: DataFrame) -> DataFrame:
    """Numbers the years that have a percentage, newest first, so a missing year leaves no hole."""
    upto = Window.partitionBy("symbol").orderBy(F.desc("fiscal_year")).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("point_no", F.count("excess_cash_flow_pct").over(upto))


def _newest(n: int) -> Column:
    return F.when(F.col("row_no") <= n, F.col("excess_cash_flow_pct"))


def slope_over(n: int) -> Column:
    """Aggregate: yearly slope of the newest ``n`` years, rising positive."""
    return F.regr_slope(_newest(n), -F.col("point_no").cast("double"))


def trend_label(slope: Column, points: Column) -> Column:
    s = F.round(slope, 9)
    label = F.when(s > 2, "Advancing").when(s < -2, "Decreasing").otherwise("Stable")
    return F.when(points < 3, "Insufficient Data").otherwise(label)


def trends(history: DataFrame, n: int = 5) -> DataFrame:
    fitted = known_points(history).groupBy("symbol").agg(
        slope_over(n).alias("slope"), F.count(_newest(n)).alias("points")
    )
    return fitted.withColumn("trend", trend_label(F.col("slope"), F.col("points")))


def excess_cash_flow(quarters: DataFrame, dividends: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    c = F.col
    history = yearly_excess(quarters, dividends)
    if universe is not None:
        listed = eligible_universe(universe, country=None, exclude_etf=True).select("symbol")
        history = history.join(listed, "symbol", "left_semi")

    def at_newest(name: str) -> Column:
        return F.max(F.when(c("row_no") == 1, c(name))).alias(name)

    def mean(n: int) -> Column:
        return F.when(F.count("*") >= n, F.avg(_newest(n)))

    facts = ("cash_flow_per_share", "dividends_per_share", "capex_per_share", "excess_cash_flow", "excess_cash_flow_pct")
    metrics = known_points(history).groupBy("symbol").agg(
        F.max("fiscal_date").alias("latest_date"), *[at_newest(f) for f in facts],
        slope_over(5).alias("_s5"), slope_over(10).alias("_s10"),
        F.count(_newest(5)).alias("_n5"), F.count(_newest(10)).alias("_n10"),
        mean(5).alias("avg_excess_cf_5y"), mean(10).alias("avg_excess_cf_10y"),
    )
    return metrics.select(
        "symbol", "latest_date", *facts, cash_rating(c("excess_cash_flow_pct")).alias("quality_rating"),
        trend_label(c("_s5"), c("_n5")).alias("trend_5y"), trend_label(c("_s10"), c("_n10")).alias("trend_10y"),
        "avg_excess_cf_5y", "avg_excess_cf_10y",
    )


def rank_excess_cash_flow(metrics: DataFrame) -> DataFrame:
    order = [F.round("excess_cash_flow_pct", 6).desc(), F.col("symbol").asc()]
    rated = metrics.where(F.col("excess_cash_flow_pct").isNotNull())
    return with_percentile(numbered(rated, order, "rank"), "rank")


def sustainability_score(payout: Column) -> Column:
    """Piecewise score of a payout ratio in percent; edges at 40, 60, 80 and 100 belong to
    the lower piece."""
    p = F.round(payout, 9)
    return (
        F.when(p.isNull(), None).when(p < 0, 0.0).when(p <= 40, 90 + (40 - p) / 4).when(p <= 60, 70 + (60 - p))
        .when(p <= 80, 50 + (80 - p)).when(p <= 100, 30 + (100 - p) * 0.5)
        .otherwise(F.greatest(F.lit(0.0), 30 - (p - 100) * 0.3))
    )


SAFETY = [(80, "Very Safe"), (60, "Safe"), (40, "Moderate"), (20, "Risky")]
QUALITY = [(80, "Dividend Aristocrat"), (60, "High Quality"), (40, "Good Quality"), (20, "Fair Quality")]


def safety_rating(score: Column) -> Column:
    return F.coalesce(ladder(score, SAFETY, "Unsustainable"), F.lit("Unknown"))


def quality_rating(score: Column) -> Column:
    return F.coalesce(ladder(score, QUALITY, "Poor Quality"), F.lit("Unknown"))


def dividend_quality(payment_streak: Column, increase_streak: Column, sustainability: Column, excess_pct: Column,
                     renormalise: bool = True) -> Column:
    """Weighted quality 0-100. A part without a value, or a streak of zero, is left out and
    the other weights are scaled up, unless ``renormalise`` is off."""
    hundred = F.lit(100.0)
    parts = [
        (0.25, F.when(payment_streak > 0, F.least(hundred, payment_streak * 4.0))),
        (0.20, F.when(increase_streak > 0, F.least(hundred, increase_streak * 5.0))),
        (0.30, sustainability), (0.25, clamp(excess_pct)),
    ]
    total = sum((F.coalesce(value * weight, F.lit(0.0)) for weight, value in parts), F.lit(0.0))
    used = sum((F.when(value.isNotNull(), weight).otherwise(0.0) for weight, value in parts), F.lit(0.0))
    return ratio(total, used) if renormalise else F.when(used > 0, total)


def dividend_sustainability(dividends: DataFrame, quarters: DataFrame, universe: DataFrame, excess: DataFrame,
                            min_years: int = 5, break_on_gap: bool = True) -> DataFrame:
    """Streaks, growth, payout and the combined dividend quality of every long-time payer."""
    c = F.col
    listed = eligible_universe(universe, country=None, exclude_etf=True).select("symbol")
    changes = dividend_changes(yearly_dividends(dividends).join(listed, "symbol", "left_semi"))
    streaks = dividend_streaks(changes, break_on_gap).where(c("total_years_paying") >= min_years)
    recent = top_per_group(changes, ["symbol"], [F.desc("year")], 10)

    def last(n: int) -> Column:
        return F.when(c("row_no") <= n, c("growth_rate"))

    growth = recent.groupBy("symbol").agg(
        F.when(F.count("*") >= 5, F.avg(last(5))).alias("avg_growth_rate_5y"),
        F.when(F.count("*") >= 10, F.avg(last(10))).alias("avg_growth_rate_10y"),
        F.when(F.count("*") >= 5, F.stddev_samp(last(5))).alias("volatility_5y"),
        F.max(F.when(c("row_no") == 1, c("total_dividend"))).alias("annual_dividend"),
    )
    annual = annual_fundamentals(quarters)
    latest = latest_by(annual, ["symbol"], "fiscal_date").select(
        "symbol", ratio(c("net_income"), F.when(c("shares") > 0, c("shares"))).alias("eps"),
        ratio(c("free_cash_flow"), F.when(c("shares") > 0, c("shares"))).alias("fcf_per_share"),
    )
    cash = excess.select("symbol", "excess_cash_flow_pct", c("quality_rating").alias("cash_flow_quality"))
    rows = streaks.join(growth, "symbol").join(latest, "symbol", "left").join(cash, "symbol", "left")

    def payout(base: str) -> Column:
        return F.when((c(base) > 0) & (c("annual_dividend") > 0), c("annual_dividend") / c(base) * 100)

    scored = rows.withColumns({"payout_ratio_earnings": payout("eps"), "payout_ratio_fcf": payout("fcf_per_share")})
    scored = scored.withColumn(
        "sustainability_score", sustainability_score(F.coalesce("payout_ratio_fcf", "payout_ratio_earnings"))
    ).withColumn("dividend_quality_score", dividend_quality(
        c("payment_streak_years"), c("increase_streak_years"), c("sustainability_score"), c("excess_cash_flow_pct")
    ))
    return scored.where(c("dividend_quality_score").isNotNull()).select(
        "symbol", "payment_streak_years", "increase_streak_years", "total_years_paying", "avg_growth_rate_5y",
        "avg_growth_rate_10y", "volatility_5y", "payout_ratio_earnings", "payout_ratio_fcf", "sustainability_score",
        safety_rating(c("sustainability_score")).alias("safety_rating"), "excess_cash_flow_pct", "cash_flow_quality",
        "dividend_quality_score", quality_rating(c("dividend_quality_score")).alias("dividend_quality_rating"),
    )


def rank_dividend_quality(scored: DataFrame) -> DataFrame:
    order = [F.round("dividend_quality_score", 6).desc(), F.col("symbol").asc()]
    return with_percentile(numbered(scored, order, "rank"), "rank")


FREQUENCIES = [(25, 35, "MONTHLY"), (80, 100, "QUARTERLY"), (170, 195, "SEMI_ANNUAL"), (350, 380, "ANNUAL")]


def dividend_frequency(dividends: DataFrame) -> DataFrame:
    """Frequency from the mean gap between ex-dates."""
    gap = F.round("avg_days_between", 9)
    label = F.when(gap.isNull(), "SPECIAL")
    for low, high, name in FREQUENCIES:
        label = label.when(gap.between(low, high), name)
    gaps = days_between(dividends).groupBy("symbol").agg(
        F.count("days_between").alias("interval_count"), F.avg("days_between").alias("avg_days_between"),
        F.stddev_samp("days_between").alias("stddev_days"),
    )
    return gaps.withColumn("frequency", label.otherwise("IRREGULAR"))


def apply_frequency(history: DataFrame, dividends: DataFrame) -> DataFrame:
    return update_from(history, dividend_frequency(dividends), ["symbol"], ["frequency"])
