"""Grouped summaries shared by reports and domain operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from equiloom.functions.expressions import as_int, ratio
from equiloom.functions.frames import quarters_only, top_per_group


def win_loss(returns: DataFrame, minimum: int = 60) -> DataFrame:
    """Win and loss statistics per symbol with enough returns."""
    r = F.col("daily_return")
    return returns.where(r.isNotNull()).groupBy("symbol").agg(
        F.count(r).alias("total_trades"), F.count_if(r > 0).alias("winning_trades"),
        F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r <= 0, F.abs(r))).alias("avg_loss"),
        F.avg(r).alias("mean_return"), F.stddev_samp(r).alias("std_dev"),
        F.max(r).alias("max_return"), F.min(r).alias("min_return"),
    ).where(F.col("total_trades") >= minimum)


def yearly_dividends(dividends: DataFrame) -> DataFrame:
    return dividends.groupBy("symbol", F.year("ex_date").alias("year")).agg(
        F.sum("dividend").alias("total_dividend"), F.count("*").alias("payment_count")
    )


FLOWS = ("revenue", "gross_profit", "operating_income", "net_income", "operating_cash_flow", "free_cash_flow", "capex")
STOCKS = ("shares", "total_assets", "total_liabilities", "equity", "total_debt", "cash")


def annual_fundamentals(statements: DataFrame) -> DataFrame:
    """Fiscal years from quarters: flows add up, balances are the year's last. Annual rows among them don't count."""
    last = [F.max_by(c, "fiscal_date").alias(c) for c in STOCKS]
    return quarters_only(statements).groupBy("symbol", F.year("fiscal_date").alias("fiscal_year")).agg(
        F.max("fiscal_date").alias("fiscal_date"), F.count("*").alias("quarters"),
        *[F.sum(c).alias(c) for c in FLOWS], *last,
    )


def share_of_total(df: DataFrame, group: Sequence[str], value: str, name: str = "weight") -> DataFrame:
    """Each row's share of its group, from a partial aggregate joined back (no window, so a
    group of any size stays spread over tasks). Rows without a group have no share and go.

    Every row left has its total; the left join says so, and readers that use no share are planned without it.
    """
    grouped = df.where(reduce(and_, (F.col(g).isNotNull() for g in group)))
    totals = grouped.groupBy(*group).agg(F.sum(value).alias("_total"))
    return grouped.join(totals, list(group), "left").withColumn(name, ratio(F.col(value), F.col("_total"))).drop("_total")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    total = df.agg(F.count("*")).scalar()
    return df.groupBy(column).agg(F.count("*").alias("count")).withColumn("pct", F.col("count") * 100 / total)


def success_rates(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Share of true per flag, one row each."""
    rates = df.agg(*[(F.avg(as_int(F.col(f))) * 100).alias(f) for f in flags])
    return rates.unpivot([], list(flags), "component", "success_pct")


def average_by_sector(scores: DataFrame, universe: DataFrame, score: str, date: str = "calculation_date") -> DataFrame:
    newest = scores.agg(F.max(date)).scalar()
    current = scores.where(F.col(date) == newest)
    return current.join(universe.select("symbol", "sector"), "symbol").groupBy("sector").agg(
        F.avg(score).alias("avg_score"), F.count("*").alias("stocks")
    )


CATEGORY_ORDER = ("FULL", "LARGE", "MEDIUM", "SMALL", "MINIMAL", "NONE")


def category_distribution(kelly: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), F.col("position_category"))
    return kelly.groupBy("position_category").agg(
        F.count("*").alias("count"), F.avg("final_position_pct").alias("avg_allocation")
    ).orderBy(place)


def newest_n(df: DataFrame, n: int, order: str, key: str = "symbol") -> DataFrame:
    return top_per_group(df, [key], [F.desc(order)], n)


def concentration(weights: DataFrame, weight: str = "weight") -> DataFrame:
    hhi = F.sum(F.col(weight) * F.col(weight))
    effective = F.coalesce(ratio(F.lit(1.0), hhi), F.lit(1.0))
    return weights.agg(hhi.alias("concentration_hhi"), effective.alias("effective_positions"))


def price_on(prices: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("symbol", "trade_date")) -> DataFrame:
    """Close at (symbol, date), 0 where the day has no bar: a join in place of one map per date,
    which would gather every symbol of a day in one row."""
    known = prices.select(*keys, F.col("close").alias("_close"))
    return wanted.join(known, list(keys), "left").withColumn("price", F.coalesce("_close", F.lit(0.0))).drop("_close")
