"""Summary tables and named screens over score tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from equiloom.operators.aggregates import value_counts


def data_freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Newest date, rows and symbols per table."""
    rows = [
        df.agg(F.max(date).cast("date").alias("latest_date"), F.count("*").alias("row_count"),
               F.countDistinct("symbol").alias("symbol_count")).withColumn("table_name", F.lit(name))
        for name, (df, date) in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def portfolio_status(holdings: DataFrame) -> DataFrame:
    return holdings.where("is_active").groupBy("portfolio_type").agg(
        F.count("*").alias("num_stocks"), F.max("selection_date").alias("last_update"))


def top(df: DataFrame, score: str, n: int, descending: bool = True) -> DataFrame:
    value = F.round(score, 6)
    return df.orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last(), F.col("symbol").asc()).limit(n)


def top_sharpe(risk: DataFrame) -> DataFrame:
    return top(risk.where(F.col("sharpe_ratio").isNotNull()), "sharpe_ratio", 10)


def low_risk(risk: DataFrame, categories: tuple[str, ...] = ("LOW",)) -> DataFrame:
    return top(risk.where(F.col("risk_category").isin(*categories) & (F.col("annual_return") > 0)), "risk_adjusted_score", 5)


def risk_distribution(risk: DataFrame) -> DataFrame:
    return value_counts(risk, "risk_category")


def new_highs(technical: DataFrame) -> DataFrame:
    return top(technical.where("new_52w_high"), "composite_score", 10)


def volume_surges(technical: DataFrame) -> DataFrame:
    return top(technical.where("volume_surge"), "volume_ratio", 10)


def sectors_with_breakouts(technical: DataFrame, labels: tuple[str, ...] = ("STRONG", "MODERATE")) -> DataFrame:
    found = technical.where(F.col("signal_strength").isin(*labels)).groupBy("sector").agg(F.count("*").alias("stocks"))
    return found.orderBy(F.desc("stocks"), "sector").limit(5)


def signal_counts(technical: DataFrame) -> DataFrame:
    return value_counts(technical, "signal_strength")


def stocks_to_avoid(scores: DataFrame) -> DataFrame:
    return top(scores.where((F.col("fscore") <= 2) | (F.col("bankruptcy_risk") == "DISTRESS")), "composite_score", 5, False)


def best_sectors(scores: DataFrame, minimum: int = 5) -> DataFrame:
    means = scores.groupBy("sector").agg(F.avg("composite_score").alias("avg_score"), F.count("*").alias("stocks"))
    return means.where(F.col("stocks") >= minimum).orderBy(F.round("avg_score", 6).desc(), "sector").limit(5)


def distressed_sectors(bankruptcy: DataFrame) -> DataFrame:
    counted = bankruptcy.where(F.col("risk_category") == "DISTRESS").groupBy("sector").agg(F.count("*").alias("stocks"))
    return counted.orderBy(F.desc("stocks"), "sector").limit(5)


def safest(bankruptcy: DataFrame) -> DataFrame:
    return top(bankruptcy.where(F.col("risk_category") == "SAFE"), "z_score", 10)


def all_positive(scores: DataFrame) -> DataFrame:
    """Stocks whose strength, safety and insider signals are all at their best."""
    best = (F.col("fscore") >= 8) & (F.col("bankruptcy_risk") == "SAFE") & (F.col("insider_score") >= 70)
    return top(scores.where(best), "composite_score", 5)


def breakout_candidates(technical: DataFrame) -> DataFrame:
    return top(technical.where(F.round("composite_score", 9) > 70), "composite_score", 15)


def likely_manipulators(quality: DataFrame) -> DataFrame:
    return top(quality.where(F.col("manipulation_risk") == "HIGH"), "m_score", 10, False)


def cleanest(quality: DataFrame) -> DataFrame:
    return top(quality, "m_score", 10, False)


def accumulation_leaders(ownership: DataFrame, n: int = 20) -> DataFrame:
    return top(ownership.where(F.col("smart_money_signal").isin("STRONG_BUY", "BUY")), "momentum_score", n)


def sector_counts(universe: DataFrame, n: int = 10) -> DataFrame:
    counted = universe.where(F.col("sector").isNotNull()).groupBy("sector").agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), "sector").limit(n)


def universe_statistics(universe: DataFrame, minimum: float = 2e9, large: float = 1e10) -> DataFrame:
    c = F.col
    cap: Column = c("market_cap")
    return universe.agg(
        F.count("*").alias("total"), F.count_if(cap >= large).alias("large_cap"),
        F.count_if((cap >= minimum) & (cap < large)).alias("mid_cap"), F.avg(F.when(cap >= minimum, cap)).alias("avg_market_cap"),
        F.count("sector").alias("has_sector"), F.countDistinct("sector").alias("unique_sectors"),
    )
