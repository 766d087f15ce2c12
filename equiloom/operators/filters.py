"""Row predicates: universe screens, bar validity, portfolio and data-quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from equiloom.functions.expressions import holds

MIN_MARKET_CAP = 2e9
EXCHANGES = ("NYSE", "NASDAQ", "AMEX")
# Fixed symbol patterns of preferred shares, warrants, units, rights and CUSIP-like fund codes.
NOT_COMMON_STOCK = r"\.PR[A-Z]?$|\.WS$|\.UN$|\.RT$|-P[A-Z]?$|^.*\d{5,}$"
FUND_SECTORS = ("N/A", "CLOSED-END FUNDS", "EXCHANGE TRADED FUND")


def eligible_universe(df: DataFrame, min_cap: float = MIN_MARKET_CAP, country: str | None = "USA",
                      security_type: str | None = "Common Stock", exclude_etf: bool = False) -> DataFrame:
    kept = df.where(F.col("market_cap") >= min_cap)
    if country:
        kept = kept.where(F.col("country") == country)
    if security_type:
        kept = kept.where(F.col("security_type") == security_type)
    return kept.where(~F.col("is_etf")) if exclude_etf else kept


def common_stock_symbols(listing: DataFrame) -> DataFrame:
    return listing.where(
        F.col("exchange").isin(*EXCHANGES) & (F.col("assetType") == "Stock") & (F.col("status") == "Active")
        & ~F.col("symbol").rlike(NOT_COMMON_STOCK)
    )


def exclude_funds(df: DataFrame, asset_type: str = "security_type") -> DataFrame:
    sector, industry = F.upper(F.coalesce("sector", F.lit(""))), F.upper(F.coalesce("industry", F.lit("")))
    kind = F.coalesce(F.col(asset_type), F.lit(""))
    fund = (
        F.coalesce("sector", F.lit("")).isin(*FUND_SECTORS) | sector.contains("REIT") | industry.contains("REIT")
        | industry.contains("FUND") | industry.contains("ETF") | ((kind != "") & (kind != "Common Stock"))
    )
    return df.where(~fund)


def valid_bars(bars: DataFrame) -> DataFrame:
    return bars.where((F.col("high") >= F.col("low")) & (F.col("close") > 0))


def candidate_rule(portfolio: str) -> Column:
    """Quality gate of a portfolio over the master score table."""
    c = F.col
    sound = c("bankruptcy_risk") != "DISTRESS"
    rules = {
        "VALUE": (c("fscore") >= 6) & sound & (c("pe_ratio") > 0) & (c("pe_ratio") < 25),
        "GROWTH": (c("fscore") >= 5) & sound & (holds(c("revenue_growth") > 5) | holds(c("eps_growth") > 5)),
        "DIVIDEND": (c("dividend_yield") > 1.5) & (c("fscore") >= 6) & (c("bankruptcy_risk") == "SAFE"),
    }
    return rules.get(portfolio, F.lit(True))


def strategy_rule(portfolio: str) -> Column:
    """Second, stricter gate used over the comprehensive score table."""
    c = F.col
    rules = {
        "VALUE": (c("pe_ratio") > 0) & (c("pe_ratio") < 15) & (c("fscore") >= 6) & (c("bankruptcy_risk") == "SAFE"),
        "GROWTH": (c("insider_score") >= 60) & (c("fscore") >= 6) & (c("bankruptcy_risk") != "DISTRESS"),
        "DIVIDEND": (c("dividend_yield") > 2) & (c("fscore") >= 7) & (c("bankruptcy_risk") == "SAFE"),
    }
    return rules[portfolio]


def portfolio_candidates(df: DataFrame, portfolio: str, strict: bool = False) -> DataFrame:
    return df.where(strategy_rule(portfolio) if strict else candidate_rule(portfolio))


def upcoming_estimates(estimates: DataFrame, universe: DataFrame, as_of: Column, min_analysts: int = 5,
                       n: int = 10) -> DataFrame:
    coming = estimates.where(
        (F.col("period_type") == "quarterly") & (F.col("fiscal_period") >= as_of)
        & (F.col("eps_num_estimates") >= min_analysts)
    )
    named = coming.join(universe.select("symbol", "name"), "symbol")
    return named.orderBy(F.desc("eps_num_estimates"), "fiscal_period", "symbol").limit(n).select(
        "symbol", "name", "fiscal_period", "eps_consensus", "eps_num_estimates", "surprise_percentage"
    )


def check_constraints(df: DataFrame, enums: dict[str, tuple], ranges: dict[str, tuple]) -> DataFrame:
    """Violations per rule, one pass over the table."""
    tests = {f"{c}_enum": ~F.col(c).isin(*allowed) for c, allowed in enums.items()}
    tests |= {f"{c}_range": ~F.col(c).between(low, high) for c, (low, high) in ranges.items()}
    counts = df.agg(F.count("*").alias("rows_checked"), *[F.count_if(t).alias(n) for n, t in tests.items()])
    return counts.unpivot(["rows_checked"], list(tests), "constraint_name", "violations")


def stale_symbols(universe: DataFrame, last_fetched: DataFrame, prices: DataFrame, as_of: Column,
                  max_age_days: int = 92, active_days: int = 30) -> DataFrame:
    """Traded recently and never fetched, or fetched too long ago; never fetched come first."""
    fetched = last_fetched.groupBy("symbol").agg(F.max("fetched_on").alias("last_fetched"))
    active = prices.groupBy("symbol").agg(F.max("trade_date").alias("last_traded")).where(
        F.col("last_traded") >= F.date_sub(as_of, active_days)
    )
    due = F.col("last_fetched").isNull() | (F.col("last_fetched") < F.date_sub(as_of, max_age_days))
    return (
        universe.join(fetched, "symbol", "left").where(due).join(active, "symbol", "left_semi")
        .orderBy(F.asc_nulls_first("last_fetched"), F.desc("market_cap"), "symbol")
    )


def pending_signals(queue: DataFrame, as_of: Column, strategy: str | None = None) -> DataFrame:
    waiting = queue.where(
        ~F.col("processed") & (F.col("expiration_date").isNull() | (F.col("expiration_date") >= as_of))
    )
    if strategy and strategy != "BALANCED":
        waiting = waiting.where(F.col("portfolio_type") == strategy)
    return waiting.orderBy(F.desc("score"), "signal_id")
