"""Score tables composed from the input views with the fixtures' look-backs.

The fixture bars are sparse (about 50 per 252 calendar days), hence the long look-back and
the stretched calendar spans; see FIXTURES.md §1.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from equiloom.functions.frames import latest_by, newest_value
from equiloom.operators import accounts, evaluation, fundamental, portfolio, sectors, signals, technical
from equiloom.plans.fixtures import Inputs
from equiloom.session import checkpointed, stored

LOOKBACK_DAYS = 2500
CALENDAR_SCALE = 5


class Derived(Inputs):
    """Every step is lazy. Tables a real deployment keeps — one row per symbol, or per symbol
    and quarter — are written to the shared folder where several later steps read them."""

    @cached_property
    def stored_excess(self) -> DataFrame:
        return checkpointed(self.excess)

    @cached_property
    def stored_overview(self) -> DataFrame:
        return checkpointed(self.overview)

    @cached_property
    def stored_master(self) -> DataFrame:
        return checkpointed(self.master)

    @cached_property
    def stored_scores(self) -> DataFrame:
        return checkpointed(self.score_history)

    @cached_property
    def piotroski(self) -> DataFrame:
        return fundamental.piotroski(self.fundamentals, self.universe)

    @cached_property
    def altman(self) -> DataFrame:
        return fundamental.altman(self.fundamentals, self.universe)

    @cached_property
    def beneish(self) -> DataFrame:
        return fundamental.beneish(self.fundamentals, self.universe)

    @cached_property
    def excess(self) -> DataFrame:
        return fundamental.excess_cash_flow(self.fundamentals, self.dividends, self.universe)

    @cached_property
    def dividend_quality(self) -> DataFrame:
        return fundamental.dividend_sustainability(self.dividends, self.fundamentals, self.universe, self.stored_excess)

    @cached_property
    def breakout(self) -> DataFrame:
        return technical.breakout_score(self.bars, self.bench, self.universe, self.as_of, CALENDAR_SCALE)

    @cached_property
    def technical(self) -> DataFrame:
        return technical.technical_breakouts(self.bars, self.universe)

    @cached_property
    def risk(self) -> DataFrame:
        return technical.risk_metrics(self.bars, self.bench, self.universe, self.as_of, LOOKBACK_DAYS)

    @cached_property
    def insider_as_of(self) -> Column:
        return newest_value(self.insider, "transaction_date")

    @cached_property
    def insider_signals(self) -> DataFrame:
        return signals.insider_signals(self.insider, self.insider_as_of)

    @cached_property
    def ownership_history(self) -> DataFrame:
        return signals.institutional_signals(self.institutional)

    @cached_property
    def ownership(self) -> DataFrame:
        return latest_by(self.ownership_history, ["symbol"], "report_date")

    @cached_property
    def signals(self) -> DataFrame:
        return signals.master_signals(self.universe, self.overview, self.insider_signals, self.piotroski, self.altman,
                                      self.ownership, self.risk, self.technical)

    @cached_property
    def master(self) -> DataFrame:
        return signals.master_scores(self.signals)

    @cached_property
    def comprehensive(self) -> DataFrame:
        return signals.comprehensive_score(self.universe, self.insider_signals, self.piotroski, self.altman, self.overview)

    @cached_property
    def kelly(self) -> DataFrame:
        scores = self.master.select("symbol", "value_score", "growth_score", "dividend_score", "composite_score")
        return technical.kelly(self.bars, self.universe, self.as_of, scores, LOOKBACK_DAYS)

    @cached_property
    def value_part(self) -> DataFrame:
        return portfolio.portfolio_value_score(self.bars, self.fundamentals_q, self.stored_overview, self.stored_excess, self.as_of, years=5)

    @cached_property
    def growth_part(self) -> DataFrame:
        return portfolio.portfolio_growth_score(self.bars, self.bench, self.fundamentals_q, self.stored_overview, self.stored_excess,
                                                self.as_of, alpha_years=5, growth_years=3)

    @cached_property
    def dividend_part(self) -> DataFrame:
        return portfolio.portfolio_dividend_score(self.dividend_quality)

    @cached_property
    def portfolio_scores(self) -> DataFrame:
        return portfolio.portfolio_scores(self.universe, self.stored_excess, self.value_part, self.growth_part, self.dividend_part, ranked=False)

    @cached_property
    def sector_daily(self) -> DataFrame:
        return sectors.sector_daily(self.bars, self.universe, self.as_of, LOOKBACK_DAYS)

    @cached_property
    def sector_quality(self) -> DataFrame:
        """Preferred stocks count too, so each score comes from its own table; only the composite is of common stocks."""
        return sectors.sector_quality(self.universe, self.piotroski, self.altman, self.master, self.risk, self.ownership)

    @cached_property
    def sector_momentum(self) -> DataFrame:
        """One row per sector; stored, since rotation reads it three times."""
        quality = sectors.sector_averages(self.universe, {"avg_quality_score": (self.master, "composite_score")})
        return checkpointed(sectors.sector_momentum(self.sector_daily, quality))

    @cached_property
    def calendar(self) -> DataFrame:
        return checkpointed(evaluation.rebalance_calendar(self.days, "quarterly"))

    @cached_property
    def months(self) -> DataFrame:
        return checkpointed(evaluation.rebalance_calendar(self.days, "monthly"))

    @cached_property
    def month_scores(self) -> DataFrame:
        """Scores known at each month's rebalance, read by every strategy's search."""
        columns = [c for c in self.stored_scores.columns if c not in ("symbol", "signal_date")]
        return stored(evaluation.scores_at(self.months, self.stored_scores, columns), "month-scores")

    @cached_property
    def scores_at_rebalance(self) -> DataFrame:
        columns = ["value_score", "growth_score", "dividend_score", "composite_score"]
        return evaluation.scores_at(self.calendar, self.stored_scores, columns)

    @cached_property
    def picks(self) -> DataFrame:
        return evaluation.pick_weights(self.scores_at_rebalance)

    @cached_property
    def strategy_returns(self) -> DataFrame:
        return evaluation.strategy_returns(self.picks, self.bars, self.calendar, self.days)

    @cached_property
    def position_values(self) -> DataFrame:
        return evaluation.position_values(self.trades, self.bars, self.universe)

    @cached_property
    def positions(self) -> DataFrame:
        return evaluation.positions(self.position_values, self.bars)

    @cached_property
    def factor_positions(self) -> DataFrame:
        newest = self.score_history.groupBy("symbol").agg(F.max_by(F.struct(
            (F.col("value_score") / 100).alias("value_factor"), (F.col("growth_score") / 100).alias("growth_factor"),
            (F.col("momentum_score") / 100).alias("momentum_factor"), (F.col("composite_score") / 100).alias("quality_factor"),
        ), "signal_date").alias("f")).select("symbol", "f.*")
        return self.positions.select("symbol", "trade_date", "daily_return").join(newest, "symbol", "left")

    @cached_property
    def cost_basis(self) -> DataFrame:
        return accounts.cost_basis(self.trades, self.latest_prices)

    @cached_property
    def holdings(self) -> DataFrame:
        """Active holdings of three portfolios: the five best by composite score history."""
        parts = []
        newest = self.score_history.groupBy("symbol").agg(F.max_by(F.struct(
            "value_score", "growth_score", "dividend_score"), "signal_date").alias("s")).select("symbol", "s.*")
        for name in portfolio.PORTFOLIOS:
            score = F.col(f"{name.lower()}_score")
            best = newest.where(score.isNotNull()).orderBy(score.desc(), "symbol").limit(5).agg(
                F.array_sort(F.collect_list(F.struct((-score).alias("o"), "symbol", score.alias("selection_score")))).alias("h"))
            parts.append(best.select(F.posexplode("h").alias("pos", "r")).select(
                F.lit(name).alias("portfolio_type"), "r.symbol", F.lit("2001-01-01").cast("date").alias("selection_date"),
                "r.selection_score", (F.col("pos") + 1).alias("selection_rank"), F.lit(1.0).alias("entry_price"),
                F.lit(10.0).alias("weight"), F.lit(True).alias("is_active")))
        return parts[0].unionByName(parts[1]).unionByName(parts[2])


class Priced(Derived):
    """The same tables for queries that read no more of the bars than closes, which are written to the shared folder once and read from there."""

    @cached_property
    def bars(self) -> DataFrame:
        return stored(super().bars.select("symbol", "trade_date", "close"), "closes")


class Kept(Derived):
    """The same tables, with bars, quarters and sector days written to the shared folder once and read from there."""

    @cached_property
    def bars(self) -> DataFrame:
        return stored(super().bars, "bars")

    @cached_property
    def fundamentals_q(self) -> DataFrame:
        return stored(super().fundamentals_q, "quarters")

    @cached_property
    def dividends(self) -> DataFrame:
        return self.bars.where("dividend_amount > 0").select("symbol", F.col("trade_date").alias("ex_date"), (F.col("dividend_amount") / 100).alias("dividend"))

    @cached_property
    def as_of(self) -> Column:
        return newest_value(self.bars, "trade_date")

    @cached_property
    def sector_daily(self) -> DataFrame:
        return stored(super().sector_daily, "sector-days")
