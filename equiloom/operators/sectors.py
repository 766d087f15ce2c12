"""Sector series, momentum, regime and rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from equiloom.functions.expressions import change, clamp, compounded, holds, ladder, ratio
from equiloom.functions.frames import by_symbol, top_per_group, within
from equiloom.operators.filters import eligible_universe
from equiloom.operators.joins import of_symbols, star_join
from equiloom.operators.series import cross_section_volatility

# Fixed preference lists.
CYCLE_SECTORS = {
    "EARLY_RECOVERY": ("Technology", "Consumer Discretionary", "Financials"),
    "MID_CYCLE": ("Technology", "Industrials", "Materials"),
    "LATE_CYCLE": ("Energy", "Materials", "Consumer Staples"),
    "RECESSION": ("Consumer Staples", "Healthcare", "Utilities"),
}
REGIME_SECTORS = {
    "RISK_ON": ("Technology", "Consumer Discretionary", "Financials", "Industrials"),
    "RISK_OFF": ("Consumer Staples", "Healthcare", "Utilities", "Real Estate"),
}


def sector_daily(bars: DataFrame, universe: DataFrame, as_of: Column, lookback_days: int = 252) -> DataFrame:
    """Volume-weighted price per sector and day, and its daily change.

    A sector may hold most symbols; it is summed on every task before the shuffle, and the
    series left for the window has one row per day.
    """
    listed = eligible_universe(universe).where(F.col("sector").isNotNull()).select("symbol", "sector", "market_cap")
    recent = within(bars, "trade_date", lookback_days, as_of).select("symbol", "trade_date", "close", "volume")
    priced = of_symbols(recent, listed).groupBy("sector", "trade_date").agg(
        F.avg("close").alias("avg_close"),
        ratio(F.sum(F.col("volume") * F.col("close")), F.sum("volume")).alias("vwap"),
        F.count("*").alias("num_stocks"), (F.sum("market_cap") / 1e9).alias("sector_mcap_b"),
    )
    before = F.lag("vwap").over(by_symbol(key="sector"))
    return priced.withColumn("daily_return", change(F.col("vwap"), before))


def sector_momentum(daily: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Momentum over the newest 20, 60 and 120 returns of each sector."""
    c = F.col
    market = daily.groupBy("trade_date").agg(F.avg("daily_return").alias("_market"))
    returns = daily.where(c("daily_return").isNotNull()).join(F.broadcast(market), "trade_date")
    recent = top_per_group(returns, ["sector"], [F.desc("trade_date")], 120)

    def last(n: int, value: Column) -> Column:
        return F.when(c("row_no") <= n, value)

    def grown(n: int) -> Column:
        product = F.product(F.when(c("row_no") <= n, 1 + c("daily_return"))) - 1
        return F.when(F.count("*") >= n, product).otherwise(0.0)

    full = F.count("*") >= 60
    r = c("daily_return")
    facts = recent.groupBy("sector").agg(
        F.max("trade_date").alias("calculation_date"), F.count("*").alias("returns_used"),
        grown(20).alias("momentum_1m"), grown(60).alias("momentum_3m"), grown(120).alias("momentum_6m"),
        F.when(full, F.avg(last(60, r - c("_market"))) * 252).otherwise(0.0).alias("relative_strength"),
        F.when(full, F.avg(last(60, (r > 0).cast("int")))).otherwise(0.5).alias("consistency"),
        F.when(full, F.stddev_samp(last(60, r)) * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("volatility"),
    ).where(c("returns_used") >= 19)
    score = (
        c("momentum_1m") * 0.2 + c("momentum_3m") * 0.3 + c("momentum_6m") * 0.2 + c("relative_strength") * 0.2
        + c("consistency") * 0.1
    ) * 100
    scored = facts.withColumn("momentum_score", score)
    if quality is None:
        return scored.withColumn("avg_quality_score", F.lit(50.0))
    return scored.join(quality.select("sector", "avg_quality_score"), "sector", "left").withColumn(
        "avg_quality_score", F.coalesce("avg_quality_score", F.lit(50.0)))


def sector_averages(universe: DataFrame, averages: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``{name: (table, column)}`` averaged over the listed symbols of each sector; tables have one row per symbol."""
    listed = eligible_universe(universe, security_type=None).where(F.col("sector").isNotNull()).select("symbol", "sector")
    tables = [table.select("symbol", F.col(column).alias(name)) for name, (table, column) in averages.items()]
    return star_join(listed, tables).groupBy("sector").agg(*(F.avg(name).alias(name) for name in averages))


def sector_quality(universe: DataFrame, strength: DataFrame, bankruptcy: DataFrame, master: DataFrame, risk: DataFrame,
                   ownership: DataFrame) -> DataFrame:
    """Sector averages over the score tables."""
    return sector_averages(universe, {
        "avg_fscore": (strength, "fscore"), "avg_zscore": (bankruptcy, "z_score"), "avg_quality_score": (master, "composite_score"),
        "avg_sharpe": (risk, "sharpe_ratio"), "avg_inst_change": (ownership, "quarter_change_pct"),
    })


def _of_sector(sector: str, value: str) -> Column:
    return F.coalesce(F.max(F.when(F.col("sector") == sector, F.col(value))), F.lit(0.0))


def market_regime(daily: DataFrame) -> DataFrame:
    """Risk appetite from the newest sector returns and the spread between sectors."""
    c = F.col
    newest = daily.where(c("daily_return").isNotNull()).groupBy("sector").agg(
        F.max_by("daily_return", "trade_date").alias("_r"))
    appetite = newest.agg(
        ((_of_sector("Technology", "_r") + _of_sector("Consumer Discretionary", "_r")) / 2).alias("risk_on_score"),
        ((_of_sector("Consumer Staples", "_r") + _of_sector("Utilities", "_r")) / 2).alias("risk_off_score"),
    )
    spreads = daily.groupBy("trade_date").agg(F.stddev_samp("daily_return").alias("_s"))
    threshold = spreads.agg(F.percentile("_s", F.lit(0.75))).scalar()
    vol = cross_section_volatility(daily).select("market_vol").scalar()
    facts = appetite.withColumns({"market_vol": vol, "vol_threshold": threshold})
    on, off = F.round("risk_on_score", 9), F.round("risk_off_score", 9)
    volatile, limit = F.round("market_vol", 9), F.round("vol_threshold", 9)
    regime = F.when((on > off) & (volatile < limit), "RISK_ON").when((off > on) | (volatile > limit), "RISK_OFF").otherwise("NEUTRAL")
    gap = c("risk_on_score") - c("risk_off_score")
    return facts.withColumn("regime", regime).withColumn(
        "confidence",
        F.when(c("regime") == "RISK_ON", F.least(F.lit(100.0), gap * 1000))
        .when(c("regime") == "RISK_OFF", F.least(F.lit(100.0), -gap * 1000 + c("market_vol") * 100)).otherwise(50.0),
    )


CYCLE_INPUTS = {"tech": "Technology", "financials": "Financials", "staples": "Consumer Staples", "utilities": "Utilities",
                "materials": "Materials", "energy": "Energy"}


def economic_cycle(momentum: DataFrame) -> DataFrame:
    """Phase from the signs of six sectors' three-month momentum; a missing sector reads 0."""
    c = F.col
    facts = momentum.agg(*[F.round(_of_sector(s, "momentum_3m"), 9).alias(n) for n, s in CYCLE_INPUTS.items()])
    phase = (
        F.when((c("tech") > 0) & (c("financials") > 0) & (c("staples") < 0), "EARLY_RECOVERY")
        .when((c("materials") > 0) & (c("energy") > 0), "LATE_CYCLE")
        .when((c("staples") > 0) & (c("utilities") > 0) & (c("tech") < 0), "RECESSION").otherwise("MID_CYCLE")
    )
    return facts.withColumn("cycle_phase", phase)


def _listed_for(lists: dict[str, tuple], label: str) -> Column:
    test = F.lit(False)
    for name, sectors in lists.items():
        test = test | ((F.col(label) == name) & F.col("sector").isin(*sectors))
    return holds(test)


ALLOCATIONS = [(80, "OVERWEIGHT"), (60, "NEUTRAL"), (40, "UNDERWEIGHT")]
ALLOCATION_WEIGHTS = [(80, 15), (60, 10), (40, 5)]


def rotation_matrix(momentum: DataFrame, regime: DataFrame, cycle: DataFrame) -> DataFrame:
    """Sector scores adjusted for regime, cycle and quality, with normalised weights.

    Regime and phase are single values, read as scalar subqueries.
    """
    c = F.col
    rows = momentum.withColumns({
        "regime": regime.select("regime").scalar(), "cycle_phase": cycle.select("cycle_phase").scalar()
    })
    quality = F.round("avg_quality_score", 9)
    score = (
        c("momentum_score") * F.when(_listed_for(REGIME_SECTORS, "regime"), 1.2).otherwise(0.9)
        * F.when(_listed_for(CYCLE_SECTORS, "cycle_phase"), 1.15).otherwise(1.0)
        * F.when(quality > 70, 1.1).when(quality < 30, 0.8).otherwise(1.0)
    )
    scored = rows.withColumn("rotation_score", clamp(score)).withColumns({
        "allocation": ladder(c("rotation_score"), ALLOCATIONS, "AVOID"),
        "target_weight_pct": ladder(c("rotation_score"), ALLOCATION_WEIGHTS, 0),
    })
    total = scored.agg(F.sum("target_weight_pct")).scalar()
    return scored.select(
        "sector", "rotation_score", (c("momentum_1m") * 100).alias("momentum_1m"), (c("momentum_3m") * 100).alias("momentum_3m"),
        "relative_strength", c("avg_quality_score").alias("quality_score"), "allocation", "target_weight_pct", "regime",
        "cycle_phase", F.coalesce(ratio(c("target_weight_pct"), total) * 100, F.lit(0.0)).alias("normalized_weight_pct"),
    )


def sector_correlations(daily: DataFrame) -> DataFrame:
    """Correlation of every sector pair over all, the newest 90 and the newest 30 days.

    The series hold one row per (sector, day), so the self-join on the day makes
    sectors x sectors rows per day whatever the number of symbols.
    """
    # All sectors share one calendar, so a day's place is found once per day.
    days = daily.select("trade_date").distinct()
    calendar = top_per_group(days.withColumn("_all", F.lit(1)), ["_all"], [F.desc("trade_date")], 90, "age").drop("_all")
    series = daily.where(F.col("daily_return").isNotNull()).select("sector", "trade_date", "daily_return")
    aged = series.join(F.broadcast(calendar), "trade_date", "left")
    left = aged.select("trade_date", "age", F.col("sector").alias("sector1"), F.col("daily_return").alias("x"))
    right = series.select("trade_date", F.col("sector").alias("sector2"), F.col("daily_return").alias("y"))
    pairs = left.join(right, "trade_date")

    def over(n: int) -> Column:
        inside = F.col("age") <= n
        return F.corr(F.when(inside, F.col("x")), F.when(inside, F.col("y")))

    return pairs.groupBy("sector1", "sector2").agg(
        F.corr("x", "y").alias("correlation"), over(90).alias("correlation_90d"), over(30).alias("correlation_30d")
    )


def sector_growth(daily: DataFrame) -> DataFrame:
    return daily.where(F.col("daily_return").isNotNull()).groupBy("sector").agg(
        compounded(F.col("daily_return")).alias("total_return"), F.count("*").alias("days"))
