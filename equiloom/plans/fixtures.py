"""Equity-shaped views over the shared test tables (FIXTURES.md §1)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from equiloom.functions.expressions import clamp, ratio
from equiloom.functions.frames import newest_value, running, trailing_means
from equiloom.operators.joins import as_of_join, star_join
from equiloom.session import checkpointed
from equiloom.sources.tables import read_table

SECTOR_OF_REGION = {
    "AFRICA": "Industrials", "AMERICA": "Technology", "ASIA": "Energy", "EUROPE": "Consumer Staples",
}
MEAN_ROWS = 100


class Inputs:
    """Lazily built views over one data directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.directory, name)

    @cached_property
    def universe(self) -> DataFrame:
        places = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        sector = F.lit("Utilities")
        for region, label in SECTOR_OF_REGION.items():
            sector = F.when(F.col("r_name") == region, label).otherwise(sector)
        return self.table("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), sector.alias("sector"),
            F.col("n_name").alias("industry"), (F.col("s_acctbal") * 1e6).alias("market_cap"),
            F.when(F.col("s_suppkey") % 17 == 3, "CAN").otherwise("USA").alias("country"),
            F.when(F.col("s_suppkey") % 19 == 4, "Preferred Stock").otherwise("Common Stock").alias("security_type"),
            (F.col("s_suppkey") % 23 == 5).alias("is_etf"),
        )

    @cached_property
    def raw_bars(self) -> DataFrame:
        paid = F.when(F.col("l_returnflag") == "R", F.col("l_tax") * 10).otherwise(0.0)
        return self.table("lineitem").groupBy(
            F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date")
        ).agg(
            F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
            F.avg("l_tax").alias("up"), F.avg("l_discount").alias("dn"),
            F.sum("l_quantity").cast("bigint").alias("volume"), F.sum(paid).alias("dividend_amount"),
        )

    @cached_property
    def bars(self) -> DataFrame:
        """Early bars have the mean of the bars there are."""
        return (
            trailing_means(self.raw_bars, {"_mean": ("px", MEAN_ROWS)}).withColumn("close", F.col("_mean") / 49.9371)  # no short decimals, so no ties when rounded
            .select(
                "symbol", "trade_date", (F.col("close") * (1 - F.col("dn") / 2)).alias("open"),
                (F.col("close") * (1 + F.col("up"))).alias("high"),
                (F.col("close") * (1 - F.col("dn"))).alias("low"), "close", "volume", "dividend_amount",
            )
        )

    @cached_property
    def bench(self) -> DataFrame:
        """One row per trading day, so bounded by the calendar at any scale."""
        return self.bars.groupBy("trade_date").agg(F.avg("close").alias("close"))

    @cached_property
    def as_of(self) -> Column:
        """Newest day in the source: a one-column scan, without building the bars."""
        return self.table("lineitem").agg(F.max(F.to_date("l_shipdate"))).scalar()

    @cached_property
    def fundamentals_q(self) -> DataFrame:
        price = F.col("l_extendedprice")
        quarters = self.table("lineitem").groupBy(
            F.col("l_suppkey").alias("symbol"),
            F.date_trunc("quarter", "l_shipdate").cast("date").alias("fiscal_date"),
        ).agg(
            F.sum(price).alias("rev"), F.sum(price * F.col("l_discount")).alias("disc"),
            F.sum(price * F.col("l_tax")).alias("tax"), F.sum("l_quantity").alias("qty"),
            F.sum(price * F.when(F.col("l_linestatus") == "F", 0.03).otherwise(-0.02)).alias("ocf"),
        )
        so_far = running("fiscal_date")
        rev, disc, tax, ocf = (F.col(c) for c in ("rev", "disc", "tax", "ocf"))
        owed = disc * (1 + F.col("symbol") % 4) * 2.5
        return quarters.select(
            "symbol", "fiscal_date", (rev * 1e4).alias("revenue"),
            ((rev - disc * 4) * 1e4).alias("gross_profit"), ((rev * 0.3 - disc * 4) * 1e4).alias("operating_income"),
            ((rev * 0.05 - disc) * 3e4).alias("net_income"), (ocf * 1e4).alias("operating_cash_flow"),
            ((ocf - tax * 0.1) * 1e4).alias("free_cash_flow"), (tax * 1e3).alias("capex"),
            ((1000 + F.col("qty")) * 1e4).alias("shares"),
            (F.sum(rev * 0.5).over(so_far) * 1e4).alias("total_assets"),
            (F.sum(owed).over(so_far) * 1e4).alias("total_liabilities"),
            (F.sum(rev * 0.5 - owed).over(so_far) * 1e4).alias("equity"),
            (F.sum(tax * 3).over(so_far) * 1e4).alias("total_debt"), (F.sum(disc).over(so_far) * 1e4).alias("cash"),
        )

    @cached_property
    def fundamentals(self) -> DataFrame:
        """The quarters with an annual row beside each fourth one, as statement tables hold them."""
        annual = self.fundamentals_q.where(F.month("fiscal_date") == 10).withColumns({c: F.col(c) * 3 for c in ("revenue", "net_income", "operating_cash_flow", "total_assets")})
        return self.fundamentals_q.withColumn("period_type", F.lit("quarterly")).unionByName(annual.withColumn("period_type", F.lit("annual")))

    @cached_property
    def dividends(self) -> DataFrame:
        return self.raw_bars.where("dividend_amount > 0").select(
            "symbol", F.col("trade_date").alias("ex_date"), (F.col("dividend_amount") / 100).alias("dividend")
        )

    @cached_property
    def insider(self) -> DataFrame:
        kind, tenth = F.col("event_type"), F.col("event_id") % 10 == 0
        bought = kind.isin("purchase", "signup", "click")
        return self.table("events").select(
            F.col("user_id").alias("symbol"), F.to_date("ts").alias("transaction_date"),
            F.when(bought, "BUY").otherwise("SELL").alias("transaction_type"),
            (F.col("value") * 10000).alias("total_value"), ((kind == "signup") & tenth).alias("is_ceo"),
            ((kind == "purchase") & tenth).alias("is_cfo"), (F.col("event_id") % 3 == 0).alias("is_officer"),
            "event_id",
        )

    @cached_property
    def sales(self) -> DataFrame:
        """Line items with their orders, the base of ownership and trade tables."""
        return self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def institutional(self) -> DataFrame:
        return self.sales.groupBy(
            F.col("l_suppkey").alias("symbol"),
            F.date_trunc("quarter", "l_shipdate").cast("date").alias("report_date"),
        ).agg(F.sum("l_quantity").alias("total_shares"), F.countDistinct("o_custkey").alias("num_holders"))

    @cached_property
    def trades(self) -> DataFrame:
        return self.sales.select(
            F.col("o_custkey").alias("account_id"), F.col("l_suppkey").alias("symbol"),
            F.to_date("l_shipdate").alias("trade_date"),
            F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("trade_type"),
            F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity") / 50).alias("price"),
        )

    @cached_property
    def accounts(self) -> DataFrame:
        """Account settings from the customer table; strategy follows the market segment."""
        segment = F.col("c_mktsegment")
        strategy = (
            F.when(segment == "AUTOMOBILE", "VALUE").when(segment == "BUILDING", "GROWTH")
            .when(segment == "FURNITURE", "DIVIDEND").otherwise("BALANCED")
        )
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("account_id"), key.alias("client_id"), strategy.alias("strategy"),
            (F.lit(5.0) + key % 6).alias("max_position_size_pct"), (F.lit(10) + key % 11).cast("int").alias("max_portfolio_positions"),
            (F.lit(60.0) + (key % 4) * 10).alias("max_account_allocation_pct"),
            (F.lit(100.0) * (key % 5)).alias("min_cash_balance"), F.abs("c_acctbal").alias("cash_balance"),
            (key % 3 != 0).alias("stop_loss_enabled"), (F.lit(5.0) + key % 10).alias("stop_loss_pct"),
            (key % 7 != 0).alias("automated_trading_active"),
        )

    @cached_property
    def days(self) -> DataFrame:
        """The trading calendar as a stored table: one row per day, read by every calendar join."""
        return checkpointed(self.bars.select("trade_date").distinct())

    @cached_property
    def latest_prices(self) -> DataFrame:
        return self.bars.groupBy("symbol").agg(F.max_by("close", "trade_date").alias("current_price"))

    @cached_property
    def overview(self) -> DataFrame:
        """Company overview derived from the newest quarter and bar (yield scaled to straddle
        the score edges)."""
        c = F.col
        before = Window.partitionBy("symbol").orderBy("fiscal_date")
        quarters = self.fundamentals_q.withColumns({
            "_rev4": F.lag("revenue", 4).over(before), "_ni4": F.lag("net_income", 4).over(before),
        })
        newest = quarters.groupBy("symbol").agg(F.max_by(F.struct(
            "revenue", "net_income", "equity", "shares", "_rev4", "_ni4"), "fiscal_date").alias("q")).select("symbol", "q.*")
        price = self.bars.groupBy("symbol").agg(
            F.max_by("close", "trade_date").alias("_close"), F.max("high").alias("high_52w"))
        paid = self.dividends.where(c("ex_date") >= F.date_sub(newest_value(self.dividends, "ex_date"), 365)).groupBy(
            "symbol").agg(F.sum("dividend").alias("_paid"))
        rows = star_join(self.universe.select("symbol", "market_cap").join(newest, "symbol").join(price, "symbol"), [paid])
        grown = ratio(c("revenue"), c("_rev4")) - 1
        earned = F.when(c("_ni4") > 0, c("net_income") / c("_ni4") - 1)
        return rows.select(
            "symbol", ratio(c("market_cap"), c("net_income") * 4).alias("pe_ratio"),
            ratio(c("market_cap") * 20, c("equity")).alias("pb_ratio"), ratio(c("market_cap") * 4, c("revenue")).alias("ps_ratio"),
            (ratio(F.coalesce("_paid", F.lit(0.0)), c("_close")) * 1000).alias("dividend_yield"),
            ratio(c("net_income"), c("revenue")).alias("profit_margin"), ratio(c("net_income") * 4, c("equity")).alias("roe"),
            (grown * 100).alias("revenue_growth"), (earned * 100).alias("eps_growth"),
            grown.alias("quarterly_revenue_growth"), earned.alias("quarterly_earnings_growth"),
            (c("_close") * (1 + (c("symbol") % 7) / 20)).alias("analyst_target_price"), "high_52w",
        )

    @cached_property
    def score_history(self) -> DataFrame:
        """Scores per symbol and quarter, known 45 days after the quarter began."""
        c = F.col
        before = Window.partitionBy("symbol").orderBy("fiscal_date")
        known = F.date_add("fiscal_date", 45).alias("signal_date")
        prior = F.lag("revenue", 4).over(before)
        facts = self.fundamentals_q.select(
            "symbol", known, ratio(c("net_income"), c("revenue")).alias("_margin"), ratio(c("free_cash_flow"), c("revenue")).alias("_fcf"),
            (ratio(c("revenue"), prior) - 1).alias("_grown"), ratio(c("net_income"), c("shares")).alias("_eps"),
            ratio(c("equity"), c("shares")).alias("_book"),
            F.when(c("net_income") > 0, ratio(c("capex"), c("net_income"))).alias("payout_ratio"),
        )
        order = Window.partitionBy("symbol").orderBy("trade_date")
        momentum = self.bars.withColumn("_mom", ratio(c("close"), F.lag("close", 126).over(order)) - 1)
        priced = as_of_join(facts, momentum, "symbol", "signal_date", "trade_date", ["close", "_mom"])
        scored = priced.select(
            "symbol", "signal_date", clamp(50 + c("_margin") * 300).alias("value_score"),
            clamp(50 + c("_grown") * 100).alias("growth_score"), clamp(50 + c("_fcf") * 1000).alias("dividend_score"),
            clamp(50 + c("_mom") * 200).alias("momentum_score"), ratio(c("close"), c("_eps")).alias("pe_ratio"),
            ratio(c("close"), c("_book")).alias("price_to_book"), (c("_fcf") * 100).alias("dividend_yield"), "payout_ratio",
            (c("_grown") * 100).alias("revenue_growth"), (c("_margin") * 100).alias("earnings_growth"),
        )
        parts = ("value_score", "growth_score", "dividend_score", "momentum_score")
        mean = sum((F.coalesce(p, F.lit(50.0)) for p in parts), F.lit(0.0)) / len(parts)
        fscore = F.least(F.lit(9), F.floor(F.coalesce("value_score", F.lit(50.0)) / 10)).cast("int")
        return scored.withColumns({"composite_score": mean, "fscore": fscore})

    @cached_property
    def queue(self) -> DataFrame:
        """Signal queue from the newest scores; every third is done, every fifth has expired."""
        c = F.col
        newest = self.score_history.groupBy("symbol").agg(F.max_by(F.struct(
            "value_score", "growth_score", "dividend_score"), "signal_date").alias("s")).select("symbol", "s.*")
        best = F.when((c("value_score") >= c("growth_score")) & (c("value_score") >= c("dividend_score")), "VALUE").when(
            c("growth_score") >= c("dividend_score"), "GROWTH").otherwise("DIVIDEND")
        expiry = F.when(c("symbol") % 4 == 0, None).when(c("symbol") % 5 == 0, F.lit("1990-01-01")).otherwise("2030-01-01")
        score = F.greatest("value_score", "growth_score", "dividend_score")
        return newest.where(c("growth_score").isNotNull()).select(
            (c("symbol") + 1000).alias("signal_id"), "symbol", F.lit("BUY").alias("signal_type"), best.alias("portfolio_type"),
            score.alias("score"), (c("symbol") % 12).cast("double").alias("target_weight_pct"),
            F.when(score > 80, "STRONG").otherwise("MODERATE").alias("signal_strength"),
            expiry.cast("date").alias("expiration_date"), (c("symbol") % 3 == 0).alias("processed"),
        )
