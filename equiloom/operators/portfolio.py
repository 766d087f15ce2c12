"""Portfolio scores, capped selection, rebalancing and allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from equiloom.functions.expressions import change, clamp, holds, ratio
from equiloom.functions.frames import top_per_group
from equiloom.functions.ranking import tied_rank
from equiloom.operators.aggregates import annual_fundamentals
from equiloom.operators.filters import eligible_universe
from equiloom.operators.joins import star_join
from equiloom.session import checkpointed

PORTFOLIOS = ("VALUE", "GROWTH", "DIVIDEND")


def valuation_history(bars: DataFrame, quarters: DataFrame, as_of: Column, years: int = 10) -> DataFrame:
    """Own price/earnings history per symbol: every bar meets its quarter's earnings.

    The rows of a symbol are bounded by the calendar, so the exact percentiles are too.
    """
    c = F.col
    earnings = quarters.select("symbol", F.date_trunc("quarter", "fiscal_date").alias("_q"), ratio(c("net_income"), c("shares")).alias("_eps"))
    recent = bars.where(c("trade_date") >= F.add_months(as_of, -12 * years)).withColumn("_q", F.date_trunc("quarter", "trade_date"))
    pe = recent.join(earnings, ["symbol", "_q"]).withColumn("_pe", ratio(c("close"), c("_eps")))
    return pe.groupBy("symbol").agg(
        F.percentile("_pe", F.lit(0.5)).alias("median_pe"), F.percentile("_pe", F.lit(0.2)).alias("p20_pe"))


def portfolio_value_score(bars: DataFrame, quarters: DataFrame, overview: DataFrame, excess: DataFrame, as_of: Column,
                          years: int = 10) -> DataFrame:
    c = F.col
    price = bars.groupBy("symbol").agg(F.max_by("close", "trade_date").alias("_price"))
    shares = quarters.groupBy("symbol").agg(F.max_by("shares", "fiscal_date").alias("_shares"))
    rows = (
        overview.select("symbol", "pe_ratio").join(excess.select("symbol", "excess_cash_flow"), "symbol")
        .join(price, "symbol").join(shares, "symbol").join(valuation_history(bars, quarters, as_of, years), "symbol")
    )
    pe, median, low = F.round("pe_ratio", 9), F.round("median_pe", 9), F.round("p20_pe", 9)
    percentile = (
        F.when(pe < low, 100.0)
        .when(pe < median, 60 + ratio(c("median_pe") - c("pe_ratio"), c("median_pe") - c("p20_pe")) * 40)
        .otherwise(60 * (2 - ratio(c("pe_ratio"), c("median_pe"))))
    )
    yielded = F.when(
        (c("_shares") > 0) & (c("_price") > 0), c("excess_cash_flow") / c("_shares") / c("_price") * 100).otherwise(0.0)
    margin = F.when(
        (pe != 0) & (median != 0) & (pe < median), F.least(F.lit(100.0), (1 - ratio(c("pe_ratio"), c("median_pe"))) * 200))
    parts = rows.select(
        "symbol", F.coalesce(percentile, F.lit(0.0)).alias("valuation_percentile"),
        F.coalesce(yielded, F.lit(0.0)).alias("excess_cf_yield"), F.coalesce(margin, F.lit(0.0)).alias("margin_of_safety"),
    )
    return parts.withColumn("value_score", c("valuation_percentile") * 0.40
                            + F.least(F.lit(100.0), c("excess_cf_yield") * 10) * 0.30 + c("margin_of_safety") * 0.30)


def portfolio_growth_score(bars: DataFrame, bench: DataFrame, quarters: DataFrame, overview: DataFrame, excess: DataFrame,
                           as_of: Column, alpha_years: int = 10, growth_years: int = 5) -> DataFrame:
    """Long-run alpha, revenue growth with the cash-flow trend, and current growth."""
    c = F.col
    then = c("trade_date") <= F.add_months(as_of, -12 * alpha_years)
    picks = [F.max_by("close", "trade_date").alias("_now"),
             F.max_by(F.when(then, c("close")), F.when(then, c("trade_date"))).alias("_then")]
    market = bench.agg(*picks).select(change(c("_now"), c("_then"))).scalar()
    stock = bars.groupBy("symbol").agg(*picks).select("symbol", (change(c("_now"), c("_then")) - market).alias("_alpha"))
    before = c("fiscal_date") <= F.add_months(as_of, -12 * growth_years)
    revenue = annual_fundamentals(quarters).groupBy("symbol").agg(
        F.max_by("revenue", "fiscal_date").alias("_rev"),
        F.max_by(F.when(before, c("revenue")), F.when(before, c("fiscal_date"))).alias("_rev_then"),
    ).select("symbol", (F.pow(ratio(c("_rev"), c("_rev_then")), F.lit(1.0 / growth_years)) - 1).alias("_cagr"))
    rows = star_join(stock, [
        revenue, excess.select("symbol", "trend_5y"),
        overview.select("symbol", "quarterly_revenue_growth", "quarterly_earnings_growth"),
    ])

    def percent(name: str) -> Column:
        return F.coalesce(c(name) * 100, F.lit(0.0))

    zero, hundred = F.lit(0.0), F.lit(100.0)
    trend = F.when(c("trend_5y") == "Advancing", 100.0).when(c("trend_5y") == "Stable", 50.0).otherwise(0.0)
    forward = F.greatest(zero, percent("quarterly_revenue_growth")) + F.greatest(zero, percent("quarterly_earnings_growth"))
    parts = rows.select(
        "symbol", percent("_alpha").alias("market_alpha"),
        ((F.least(hundred, percent("_cagr") * 5) + trend) / 2).alias("fundamental_growth"),
        F.least(hundred, forward).alias("forward_growth_estimate"),
    )
    return parts.withColumn("growth_score", clamp(50 + c("market_alpha") * 2) * 0.35
                            + c("fundamental_growth") * 0.35 + c("forward_growth_estimate") * 0.30)


def portfolio_dividend_score(quality: DataFrame) -> DataFrame:
    def known(name: str, alias: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0)).alias(alias)

    streak = F.least(F.lit(100.0), F.col("payment_streak_years") * 4.0)
    return quality.select(
        "symbol", known("dividend_quality_score", "dividend_score"), known("sustainability_score", "dividend_sustainability"),
        known("avg_growth_rate_5y", "dividend_growth_rate"), F.coalesce(streak, F.lit(0.0)).alias("payment_history_score"),
    )


def portfolio_scores(universe: DataFrame, excess: DataFrame, value: DataFrame, growth: DataFrame, dividend: DataFrame,
                     ranked: bool = True) -> DataFrame:
    """The three portfolio scores of every symbol with a cash-flow figure, and their ranks."""
    listed = eligible_universe(universe, exclude_etf=True).select("symbol", "sector", "industry")
    measured = excess.where(F.col("excess_cash_flow_pct").isNotNull()).select("symbol", "excess_cash_flow_pct")
    rows = star_join(listed.join(measured, "symbol"), [value, growth, dividend])
    numbers = [n for n in rows.columns if n not in ("symbol", "sector", "industry")]
    rows = rows.withColumns({n: F.round(F.coalesce(n, F.lit(0.0)), 6) for n in numbers})
    if not ranked:
        return rows
    rows = checkpointed(rows)
    for name in PORTFOLIOS:
        rows = tied_rank(rows, f"{name.lower()}_score", "symbol", f"{name.lower()}_rank")
    return rows


def capped_selection(df: DataFrame, score: str, n: int = 10, per_sector: int = 3, per_industry: int = 2,
                     key: str = "symbol", group: str | None = None) -> DataFrame:
    """Best-first pick of ``n`` rows (per ``group``) with at most so many per sector and industry.

    Below the ``per_industry`` best of its (sector, industry) a row can never be picked: each
    better one was either picked or met a cap that is still full. So only those few rows per
    pair — a number set by the classification, not by the symbols — reach the ordered fold,
    which applies both caps exactly, also where an industry spans sectors.
    """
    if group is None:
        df, group = df.withColumn("_group", F.lit(1)), "_group"
    order = [F.round(score, 6).desc_nulls_last(), F.col(key).asc()]
    few = top_per_group(df, [group, "sector", "industry"], order, per_industry, "_place")
    fields = F.struct((-F.round(score, 6)).alias("_order"), F.col(key), "sector", "industry", F.col(score))
    candidates = few.groupBy(group).agg(F.array_sort(F.collect_list(fields)).alias("_all"))

    def pick(taken: Column, row: Column) -> Column:
        same_sector = F.size(F.filter(taken, lambda t: t["sector"].eqNullSafe(row["sector"])))
        same_industry = F.size(F.filter(taken, lambda t: t["industry"].eqNullSafe(row["industry"])))
        fits = (F.size(taken) < n) & (same_sector < per_sector) & (same_industry < per_industry)
        return F.when(fits, F.array_append(taken, row)).otherwise(taken)

    empty = F.filter("_all", lambda row: F.lit(False))
    picked = candidates.select(group, F.posexplode(F.aggregate("_all", empty, pick)).alias("_pos", "_row"))
    return picked.select(group, f"_row.{key}", "_row.sector", "_row.industry", f"_row.{score}",
                         (F.col("_pos") + 1).alias("selection_rank")).drop("_group")


MIN_EXCESS_PCT = {"VALUE": 20, "GROWTH": 40, "DIVIDEND": 30}
MIN_DIVIDEND_SCORE = 60


def select_portfolio(scores: DataFrame, portfolios: tuple[str, ...] = PORTFOLIOS, n: int = 10) -> DataFrame:
    """Capped picks of each portfolio among the symbols that pass its minimums, in one pass."""
    def entry(name: str) -> Column:
        fits = F.col("excess_cash_flow_pct") >= MIN_EXCESS_PCT[name]
        if name == "DIVIDEND":
            fits = fits & (F.col("dividend_score") >= MIN_DIVIDEND_SCORE)
        return F.when(fits, F.struct(F.lit(name).alias("portfolio_type"), F.col(f"{name.lower()}_score").alias("selection_score")))

    entered = scores.select("symbol", "sector", "industry", F.explode(F.array_compact(F.array(*map(entry, portfolios)))).alias("_e"))
    rows = entered.select("symbol", "sector", "industry", "_e.*")
    return capped_selection(rows, "selection_score", n, group="portfolio_type")


def rebalance(old: DataFrame, new: DataFrame, scores: DataFrame) -> DataFrame:
    """For each portfolio type what enters, leaves and stays, with the average score on both sides.

    The score of a type is the column named after it. A portfolio has a fixed size, so the arrays are bounded.
    """
    key = ["portfolio_type", "symbol"]
    before, after = (df.select(*key).distinct().withColumn(mark, F.lit(True)) for df, mark in ((old, "_old"), (new, "_new")))
    held = before.join(after, key, "full")
    score = F.coalesce(*(F.when(F.col("portfolio_type") == p, F.col(f"{p.lower()}_score")) for p in PORTFOLIOS))
    rated = held.join(scores.select("symbol", *(f"{p.lower()}_score" for p in PORTFOLIOS)), "symbol", "left").withColumn("_score", score)
    was, now = holds(F.col("_old")), holds(F.col("_new"))

    def symbols(of: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(of, F.col("symbol"))))

    return rated.groupBy("portfolio_type").agg(
        symbols(now & ~was).alias("stocks_added"), symbols(was & ~now).alias("stocks_removed"), symbols(was & now).alias("stocks_retained"),
        F.coalesce(F.avg(F.when(was, F.col("_score"))), F.lit(0.0)).alias("avg_score_before"), F.avg(F.when(now, F.col("_score"))).alias("avg_score_after"),
    )


def update_holdings(old: DataFrame, new: DataFrame, prices: DataFrame, as_of: Column) -> DataFrame:
    """Closes every active holding of the portfolios and opens the new ones at the latest price."""
    c = F.col
    closed = old.select(
        "portfolio_type", "symbol", "selection_date", "selection_score", "selection_rank", "entry_price",
        F.lit(10.0).alias("weight"), F.lit(False).alias("is_active"), as_of.alias("exit_date"), F.lit("Rebalance").alias("exit_reason"),
    )
    quoted = prices.join(new.select("symbol"), "symbol", "left_semi").groupBy("symbol").agg(
        F.max_by("close", "trade_date").alias("entry_price"))
    opened = new.join(quoted, "symbol", "left").select(
        "portfolio_type", "symbol", as_of.alias("selection_date"), "selection_score", c("selection_rank"), "entry_price",
        F.lit(10.0).alias("weight"), F.lit(True).alias("is_active"), F.lit(None).cast("date").alias("exit_date"),
        F.lit(None).cast("string").alias("exit_reason"),
    )
    return closed.unionByName(opened)


KELLY_MINIMUM = {"VALUE": ("value_score", 70), "GROWTH": ("growth_score", 70), "DIVIDEND": ("dividend_score", 70),
                 "BALANCED": ("composite_score", 60)}
PORTFOLIO_VALUE = 100_000


def kelly_candidates(sized: DataFrame) -> DataFrame:
    """Positions that reach the score minimum of a portfolio, one row per portfolio they reach."""
    entries = [F.when(F.col(column) >= least, F.lit(name)) for name, (column, least) in KELLY_MINIMUM.items()]
    reached = F.explode(F.array_compact(F.array(*entries))).alias("portfolio_type")
    return sized.select(reached, "symbol", "final_position_pct")


def kelly_allocation(sized: DataFrame, max_positions: int = 20) -> DataFrame:
    """Top positions of each portfolio by Kelly size. Shares above 100 % in total are scaled
    down; below that they stay and the rest is cash."""
    c = F.col
    order = [F.desc("final_position_pct"), F.asc("symbol")]
    top = top_per_group(kelly_candidates(sized), ["portfolio_type"], order, max_positions, "position_rank")
    # At most max_positions rows per portfolio from here on.
    whole = Window.partitionBy("portfolio_type")
    held = top.withColumns({"_total": F.sum("final_position_pct").over(whole), "total_positions": F.count("*").over(whole)})
    share = F.when(c("_total") > 100, c("final_position_pct") / c("_total") * 100).otherwise(c("final_position_pct"))
    return held.where(c("_total") > 0).select(
        "portfolio_type", "symbol", c("final_position_pct").alias("kelly_position_pct"), share.alias("normalized_position_pct"),
        (share / 100 * PORTFOLIO_VALUE).alias("dollar_allocation"), "total_positions",
        F.greatest(F.lit(0.0), 100 - c("_total")).alias("cash_reserve_pct"), "position_rank",
    )
