"""Insider and institutional signals, and the composite scores built over all signal tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from equiloom.functions.expressions import clamp, change, holds, ladder, points, ratio
from equiloom.functions.frames import by_symbol, top_per_group
from equiloom.operators.filters import candidate_rule, eligible_universe
from equiloom.operators.joins import star_join

LARGE_NET_VALUE = 1_000_000


def insider_signals(transactions: DataFrame, as_of: Column) -> DataFrame:
    """Insider sentiment per symbol: conditional aggregates only, so a symbol with a third
    of all transactions is summed on every task before the shuffle."""
    c, day = F.col, F.col("transaction_date")
    buy, sell = c("transaction_type") == "BUY", c("transaction_type") == "SELL"
    month, season = day > F.date_sub(as_of, 30), day > F.date_sub(as_of, 90)

    def value(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, c("total_value"))), F.lit(0.0))

    signed = F.when(buy, c("total_value")).otherwise(-c("total_value"))
    facts = transactions.groupBy("symbol").agg(
        F.count_if(buy & month).alias("buys_30d"), F.count_if(sell & month).alias("sells_30d"),
        value(buy & month).alias("buy_value_30d"), value(sell & month).alias("sell_value_30d"),
        F.count_if(buy & season).alias("buys_90d"), F.count_if(sell & season).alias("sells_90d"),
        holds(F.bool_or(c("is_ceo") & buy & season)).alias("ceo_buying"),
        holds(F.bool_or(c("is_cfo") & buy & season)).alias("cfo_buying"),
        (F.count_if(c("is_officer") & buy & month) >= 3).alias("officer_cluster_buying"),
        F.coalesce(F.sum(F.when(month, signed)), F.lit(0.0)).alias("net_insider_buying_30d"),
    )
    share = ratio(c("buys_30d"), c("buys_30d") + c("sells_30d"))
    net = c("net_insider_buying_30d")
    score = (
        50 + F.when(c("ceo_buying"), 20).otherwise(0) + F.when(c("cfo_buying"), 15).otherwise(0)
        + F.when(c("officer_cluster_buying"), 15).otherwise(0) + F.coalesce((share - 0.5) * 20, F.lit(0.0))
        + F.when(net > LARGE_NET_VALUE, 10).when(net < -LARGE_NET_VALUE, -10).otherwise(0)
    )
    return facts.withColumn("insider_score", clamp(score))


def institutional_signals(holdings: DataFrame) -> DataFrame:
    """Quarter-over-quarter change of institutional ownership and the signal it gives."""
    c = F.col
    before = F.lag("total_shares").over(by_symbol("report_date"))
    moved = holdings.withColumn("_before", before).withColumns({
        "quarter_change_pct": F.coalesce(
            change(c("total_shares"), F.when(c("_before") > 0, c("_before"))) * 100, F.lit(0.0)),
        "net_institutional_flow": F.coalesce(c("total_shares") - c("_before"), F.lit(0.0)),
    })
    pct = F.round("quarter_change_pct", 9)
    signal = (
        F.when((pct > 10) & (c("num_holders") > 100), "STRONG_BUY").when(pct > 5, "BUY").when(pct < -10, "SELL")
        .when(pct < -5, "WEAK").otherwise("NEUTRAL")
    )
    return moved.select(
        "symbol", "report_date", "total_shares", "num_holders", "quarter_change_pct", "net_institutional_flow",
        signal.alias("smart_money_signal"), clamp(50 + c("quarter_change_pct") * 2).alias("momentum_score"),
        (pct > 20).alias("heavy_accumulation"), ((pct > 5) & (pct <= 20)).alias("moderate_accumulation"),
        (pct < -5).alias("distribution"),
    )


SIGNAL_COLUMNS = (
    "pe_ratio", "pb_ratio", "ps_ratio", "dividend_yield", "profit_margin", "roe", "revenue_growth", "eps_growth",
    "analyst_target_price", "high_52w", "ceo_buying", "cfo_buying", "officer_cluster_buying", "fscore",
    "fundamental_strength", "z_score", "bankruptcy_risk", "institutional_change", "smart_money_signal", "sharpe_ratio",
    "annual_volatility", "max_drawdown", "volatility_level", "breakout_score",
)


def master_signals(universe: DataFrame, overview: DataFrame, insider: DataFrame, strength: DataFrame,
                   bankruptcy: DataFrame, ownership: DataFrame, risk: DataFrame, technical: DataFrame) -> DataFrame:
    """All signals of an eligible symbol in one row. Each input has one row per symbol."""
    c = F.col
    listed = eligible_universe(universe).select("symbol", "name", "sector", "industry", (c("market_cap") / 1e9).alias("market_cap_b"))
    tables = [
        overview, insider.select("symbol", c("insider_score").alias("_insider"), "ceo_buying", "cfo_buying", "officer_cluster_buying"),
        bankruptcy.select("symbol", "z_score", c("risk_category").alias("bankruptcy_risk")),
        ownership.select("symbol", c("quarter_change_pct").alias("institutional_change"), "smart_money_signal"),
        risk.select("symbol", "sharpe_ratio", "annual_volatility", "max_drawdown", c("risk_category").alias("volatility_level")),
        technical.select("symbol", c("composite_score").alias("breakout_score")),
    ]
    scored = strength.where(c("fscore").isNotNull()).select("symbol", "fscore", c("strength_category").alias("fundamental_strength"))
    joined = star_join(listed.join(scored, "symbol"), tables)
    upside = F.when((c("analyst_target_price") > 0) & (c("high_52w") > 0), change(c("analyst_target_price"), c("high_52w")) * 100)
    return joined.withColumns({
        "insider_score": F.coalesce("_insider", F.lit(50.0)), "analyst_upside": F.coalesce(upside, F.lit(0.0)),
    }).drop("_insider")


def _share(name: str, full: float, weight: float) -> Column:
    """A score out of ``full`` turned into its share of ``weight`` points."""
    return F.coalesce(F.col(name) / full * weight, F.lit(0.0))


def _safety(safe: float, grey: float) -> Column:
    risk = F.col("bankruptcy_risk")
    return F.when(risk == "SAFE", safe).when(risk == "GREY", grey).otherwise(0.0)


def value_score() -> Column:
    def cheap(name: str, steps: list[tuple]) -> Column:
        return points(F.when(F.col(name) > 0, F.col(name)), steps, 0.0, by="<")

    total = (
        cheap("pe_ratio", [(10, 12.0), (15, 8.0), (20, 4.0)]) + cheap("pb_ratio", [(1, 12.0), (1.5, 8.0), (2, 4.0)])
        + cheap("ps_ratio", [(1, 11.0), (2, 7.0), (3, 3.0)]) + _share("fscore", 9, 30) + _safety(20.0, 10.0)
        + _share("insider_score", 100, 10) + _share("breakout_score", 100, 5)
    )
    return F.least(F.lit(100.0), total)


def growth_score() -> Column:
    c = F.col
    money = c("smart_money_signal")
    flow = F.when(money == "STRONG_BUY", 20.0).when(money == "BUY", 15.0).when(
        F.round("institutional_change", 9) > 5, 10.0).otherwise(0.0)
    total = (
        points(c("revenue_growth"), [(10, 15.0), (5, 8.0)], 0.0, by=">")
        + points(c("eps_growth"), [(15, 15.0), (10, 8.0)], 0.0, by=">")
        + _share("breakout_score", 100, 25) + flow + _share("fscore", 9, 15)
        + points(c("sharpe_ratio"), [(1, 10.0), (0.5, 5.0)], 0.0, by=">")
    )
    return F.least(F.lit(100.0), total)


def dividend_score() -> Column:
    c = F.col
    calm = F.when(c("volatility_level") == "LOW", 10.0).when(c("volatility_level") == "MODERATE", 5.0).otherwise(0.0)
    total = (
        points(c("dividend_yield"), [(4, 30.0), (3, 25.0), (2, 20.0), (1, 10.0)], 0.0, by=">") + _safety(30.0, 15.0)
        + points(c("fscore"), [(7, 20.0), (5, 12.0), (3, 6.0)], 0.0) + calm
        + points(c("profit_margin"), [(0.1, 10.0), (0.05, 5.0)], 0.0, by=">")
    )
    return F.least(F.lit(100.0), total)


COMPOSITE_WEIGHTS = {"fundamental": 0.25, "insider": 0.15, "institutional": 0.15, "technical": 0.15, "valuation": 0.15, "risk": 0.15}
GRADES = [(80, "A+"), (70, "A"), (60, "B+"), (50, "B"), (40, "C")]


def composite_score() -> Column:
    c = F.col
    money, pe, sharpe = c("smart_money_signal"), F.round("pe_ratio", 9), F.round("sharpe_ratio", 9)
    parts = {
        "fundamental": _share("fscore", 9, 50) + _safety(50.0, 25.0),
        "insider": F.coalesce("insider_score", F.lit(0.0)),
        "institutional": F.when(money == "STRONG_BUY", 100.0).when(money == "BUY", 75.0).when(money == "SELL", 25.0).otherwise(50.0),
        "technical": F.coalesce("breakout_score", F.lit(0.0)),
        "valuation": F.when(~(pe > 0), 50.0).when(pe < 15, 80.0).when(pe < 25, 60.0).when(pe > 40, 20.0).otherwise(50.0),
        "risk": F.when(sharpe > 1, 80.0).when(sharpe > 0.5, 60.0).when(sharpe < 0, 20.0).otherwise(50.0),
    }
    return sum((parts[name] * weight for name, weight in COMPOSITE_WEIGHTS.items()), F.lit(0.0))


def portfolio_type_scores(signals: DataFrame) -> DataFrame:
    return signals.withColumns({
        "value_score": value_score(), "growth_score": growth_score(), "dividend_score": dividend_score()
    })


def best_portfolio() -> Column:
    """Label of the largest score; the first wins a tie."""
    v, g, d = (F.round(n, 9) for n in ("value_score", "growth_score", "dividend_score"))
    return F.when((v >= g) & (v >= d), "VALUE").when(g >= d, "GROWTH").otherwise("DIVIDEND")


def master_scores(signals: DataFrame) -> DataFrame:
    scored = portfolio_type_scores(signals).withColumn("composite_score", composite_score())
    return scored.withColumns({
        "best_portfolio": best_portfolio(), "investment_grade": ladder(F.col("composite_score"), GRADES, "D"),
    })


SCORE_OF = {"VALUE": "value_score", "GROWTH": "growth_score", "DIVIDEND": "dividend_score", "BALANCED": "composite_score"}


def select_holdings(scores: DataFrame, portfolios: tuple[str, ...] = ("VALUE", "GROWTH", "DIVIDEND"), n: int = 10) -> DataFrame:
    """Best ``n`` candidates of each portfolio, from one pass over the score table."""
    entries = [
        F.when(candidate_rule(p), F.struct(F.lit(p).alias("portfolio_type"), F.col(SCORE_OF[p]).alias("score")))
        for p in portfolios
    ]
    entered = scores.select("symbol", F.explode(F.array_compact(F.array(*entries))).alias("_e")).select("symbol", "_e.*")
    return top_per_group(entered, ["portfolio_type"], [F.round("score", 6).desc(), F.asc("symbol")], n, "selection_rank")


def comprehensive_score(universe: DataFrame, insider: DataFrame, strength: DataFrame, bankruptcy: DataFrame,
                        overview: DataFrame) -> DataFrame:
    c = F.col
    listed = eligible_universe(universe).select("symbol", "name", "sector")
    base = listed.join(strength.select("symbol", "fscore", "strength_category"), "symbol").join(
        bankruptcy.select("symbol", "z_score", "z_prime_score", c("risk_category").alias("bankruptcy_risk")), "symbol")
    joined = star_join(base, [
        insider.select("symbol", "insider_score", "ceo_buying", "cfo_buying", "officer_cluster_buying"),
        overview.select("symbol", "pe_ratio", "dividend_yield", "profit_margin", "roe"),
    ])
    score = (
        F.coalesce("insider_score", F.lit(50.0)) * 0.25 + c("fscore") * 11.11 * 0.35 + _safety(100.0, 50.0) * 0.40
    )
    return joined.withColumn("composite_score", score)


def investment_quality(scores: DataFrame) -> DataFrame:
    """Tier from the three signals; a missing insider score counts for none of them."""
    c, risk = F.col, F.col("bankruptcy_risk")
    insider = F.coalesce("insider_score", F.lit(0.0))
    strong = (c("fscore") >= 7).cast("int") + (risk == "SAFE").cast("int") + (insider >= 60).cast("int")
    tier = (
        F.when((c("fscore") >= 8) & (risk == "SAFE") & (insider >= 70), "TOP_TIER").when(strong >= 2, "STRONG")
        .when((risk != "DISTRESS") & (c("fscore") >= 5), "MODERATE")
        .when((risk == "DISTRESS") | (c("fscore") <= 3), "WEAK").otherwise("NEUTRAL")
    )
    return scores.withColumn("investment_quality", tier)
