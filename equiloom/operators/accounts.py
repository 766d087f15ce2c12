"""Accounts, trade signals, sizing and position bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from equiloom.functions.expressions import compounded, ratio
from equiloom.functions.frames import top_per_group
from equiloom.operators.aggregates import share_of_total
from equiloom.operators.joins import signals_for_accounts
from equiloom.operators.series import benchmark_returns


def trading_signals(holdings: DataFrame, scores: DataFrame, queue: DataFrame, n: int = 10) -> DataFrame:
    """BUY rows for the leading holdings that have no signal waiting."""
    keys = ["symbol", "portfolio_type"]
    waiting = queue.where(~F.col("processed")).select(*keys)
    active = top_per_group(holdings.where("is_active"), ["portfolio_type"], [F.asc("selection_rank"), F.asc("symbol")], n)
    strength = F.when(F.round("composite_score", 9) > 80, "STRONG").otherwise("MODERATE")
    return active.join(waiting, keys, "left_anti").join(scores, "symbol").select(
        "portfolio_type", "symbol", F.lit("BUY").alias("signal_type"), F.col("composite_score").alias("score"),
        F.col("weight").alias("target_weight_pct"), strength.alias("signal_strength"), F.lit(False).alias("processed"),
    )


def active_accounts(clients: DataFrame, accounts: DataFrame) -> DataFrame:
    able = clients.where(F.col("automated_trading_enabled") & (F.col("account_status") == "ACTIVE"))
    live = accounts.where(F.col("automated_trading_active") & F.col("account_active"))
    return able.join(live, "client_id")


def position_sizes(accounts: DataFrame, signals: DataFrame, latest_prices: DataFrame, held: DataFrame,
                   max_signals: int = 5) -> DataFrame:
    """Whole shares to buy per account and signal, against the account's opening cash."""
    c = F.col
    leading = signals_for_accounts(accounts, signals, max_signals)
    counts = held.groupBy("account_id").agg(F.count("*").alias("_held"))
    open_ = leading.join(counts, "account_id", "left").where(
        F.coalesce("_held", F.lit(0)) < c("max_portfolio_positions"))
    priced = open_.join(latest_prices, "symbol")
    largest = c("max_position_size_pct") / 100
    total = ratio(c("cash_balance"), 1 - c("max_account_allocation_pct") / 100)
    target = F.least(F.coalesce(F.nullif(c("target_weight_pct"), F.lit(0.0)) / 100, largest), largest)
    wanted = F.floor(F.round(total * target / c("current_price"), 9))
    free = F.greatest(F.lit(0.0), c("cash_balance") - c("min_cash_balance"))
    affordable = F.floor(F.round(free / c("current_price"), 9))
    fits = wanted * c("current_price") <= c("cash_balance") - c("min_cash_balance")
    return priced.withColumn("shares", F.when(fits, wanted).otherwise(affordable)).where(c("shares") > 0).select(
        "account_id", "symbol", "portfolio_type", "score", "shares", (c("shares") * c("current_price")).alias("order_value"))


def cost_basis(trades: DataFrame, latest_prices: DataFrame) -> DataFrame:
    """Open positions with the average price of their buys, value and share of the account."""
    c = F.col
    bought = c("trade_type") == "BUY"
    signed = F.when(bought, c("quantity")).otherwise(-c("quantity"))
    positions = trades.groupBy("account_id", "symbol").agg(
        F.sum(signed).alias("quantity"),
        ratio(F.sum(F.when(bought, c("quantity") * c("price"))), F.sum(F.when(bought, c("quantity")))).alias("avg_cost"),
        F.min("trade_date").alias("opened_on"),
    ).where((c("quantity") > 0) & c("avg_cost").isNotNull())
    valued = positions.join(latest_prices, "symbol").withColumns({
        "market_value": c("quantity") * c("current_price"), "total_cost": c("quantity") * c("avg_cost"),
    })
    weighed = share_of_total(valued, ["account_id"], "market_value", "portfolio_weight")
    return weighed.withColumns({
        "unrealized_pnl": c("market_value") - c("total_cost"),
        "unrealized_pnl_pct": ratio(c("market_value") - c("total_cost"), c("total_cost")) * 100,
        "portfolio_weight_pct": c("portfolio_weight") * 100,
    }).drop("portfolio_weight")


def stop_loss_hits(holdings: DataFrame, accounts: DataFrame) -> DataFrame:
    """Holdings fallen to their account's stop; ``holdings`` carry average cost and price."""
    c = F.col
    guarded = accounts.where("stop_loss_enabled").select("account_id", "stop_loss_pct", "strategy")
    loss = ratio(c("current_price") - c("avg_cost"), c("avg_cost"))
    hit = holdings.join(guarded, "account_id").withColumn("loss_pct", loss * 100)
    return hit.where(F.round("loss_pct", 9) <= -c("stop_loss_pct")).select(
        "account_id", "symbol", F.col("strategy").alias("portfolio_type"), "avg_cost", "current_price", "loss_pct",
        F.lit("SELL").alias("signal_type"), F.lit("STRONG").alias("signal_strength"))


def portfolio_performance(returns: DataFrame, bench: DataFrame) -> DataFrame:
    """Returns of each portfolio since the start of the month, quarter and year.

    ``returns`` has one row per (portfolio, trading day); running products are sums of logs
    over windows that hold one portfolio's days.
    """
    c = F.col
    market = benchmark_returns(bench).select("trade_date", F.coalesce("market_return", F.lit(0.0)).alias("market_daily_return"))
    rows = returns.join(F.broadcast(market), "trade_date")

    def since(period: str | None, value: str) -> Column:
        keys = ["portfolio_type"] + ([F.date_trunc(period, "trade_date")] if period else [])
        window = Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
        return F.exp(F.sum(F.log1p(c(value))).over(window)) - 1

    month = Window.partitionBy("portfolio_type").orderBy("trade_date").rowsBetween(-29, 0)
    out = rows.withColumns({
        "mtd_return": since("month", "daily_return"), "qtd_return": since("quarter", "daily_return"),
        "ytd_return": since("year", "daily_return"), "total_return": since(None, "daily_return"),
        "market_ytd_return": since("year", "market_daily_return"),
        "volatility_30d": F.stddev_samp("daily_return").over(month) * F.sqrt(F.lit(252.0)),
    })
    return out.withColumn("alpha_ytd", c("ytd_return") - c("market_ytd_return"))


def period_growth(returns: DataFrame, key: str, value: str) -> DataFrame:
    return returns.groupBy(key).agg(compounded(F.col(value)).alias("growth"))
