"""Registered score queries (fundamental, technical, signal tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiloom.functions.expressions import clamp
from equiloom.operators import fundamental, signals, technical
from equiloom.plans.derived import LOOKBACK_DAYS
from equiloom.plans.registry import add

FLAGS = " ".join(fundamental.FSCORE_FLAGS)

add("g01_piotroski", f"symbol sector calculation_date {FLAGS} fscore strength_category current_roa* prior_roa* current_debt_ratio* "
    "prior_debt_ratio* current_ratio* current_margin* prior_margin* current_turnover* prior_turnover* latest_price* price_market_cap$",
    lambda v: fundamental.piotroski(v.fundamentals_q, v.universe, v.bars), "SELECT * FROM piotroski")
add("g02_altman", "symbol sector calculation_date z_score* z_prime_score* working_capital_ratio* retained_earnings_ratio* ebit_ratio* "
    "market_to_book_liability* sales_to_assets* risk_category is_manufacturing", lambda v: v.altman, "SELECT * FROM altman")
add("g03_beneish", "symbol calculation_date dsri* gmi* aqi* sgi* depi* sgai* lvgi* tata* m_score* manipulation_risk risk_flag quality_score* revenue_growth*",
    lambda v: v.beneish, "SELECT * FROM beneish")
ECF = ("symbol latest_date cash_flow_per_share* dividends_per_share* capex_per_share* excess_cash_flow* excess_cash_flow_pct* quality_rating "
       "trend_5y trend_10y avg_excess_cf_5y* avg_excess_cf_10y*")
add("g04_excess_cash_flow", ECF + " rank percentile*", lambda v: fundamental.rank_excess_cash_flow(v.excess), """
SELECT *, 100 - (rank - 1) / n * 100 AS percentile FROM (SELECT *, row_number() OVER (ORDER BY round(excess_cash_flow_pct, 6) DESC, symbol) AS rank,
  count(*) OVER () AS n FROM ecf WHERE excess_cash_flow_pct IS NOT NULL)""")
DIVQ = ("symbol payment_streak_years increase_streak_years total_years_paying avg_growth_rate_5y* avg_growth_rate_10y* volatility_5y* payout_ratio_earnings* "
        "payout_ratio_fcf* sustainability_score* safety_rating excess_cash_flow_pct* cash_flow_quality dividend_quality_score* dividend_quality_rating")
add("g05_dividend_sustainability", DIVQ + " rank percentile*", lambda v: fundamental.rank_dividend_quality(v.dividend_quality), """
SELECT *, 100 - (rank - 1) / n * 100 AS percentile FROM (SELECT *, row_number() OVER (ORDER BY round(dividend_quality_score, 6) DESC, symbol) AS rank,
  count(*) OVER () AS n FROM divq)""")
add("g06_dividend_frequency", "symbol interval_count avg_days_between* stddev_days* frequency",
    lambda v: fundamental.dividend_frequency(v.dividends), "SELECT * FROM div_freq")
add("g07_breakout_score", "symbol breakout_score*2 has_breakout current_price* high_52w* volume_surge* proximity* volume* base_quality* momentum_score* "
    "accumulation* relative_strength_score* relative_strength* accumulation_ratio* breakout_strength rank",
    lambda v: technical.rank_breakouts(v.breakout), "SELECT *, row_number() OVER (ORDER BY breakout_score DESC, symbol) AS rank FROM breakout")
add("g08_technical_breakouts", "symbol sector signal_date latest_price* price_vs_52w_high* price_vs_52w_low* above_sma_20 above_sma_50 above_sma_200 "
    "volume_ratio* volume_surge near_52w_high new_52w_high base_breakout momentum_surge rsi* breakout_strength* volume_strength* trend_strength* "
    "composite_score* signal_strength", lambda v: v.technical, "SELECT * FROM tech")
add("g09_risk_metrics", "symbol sector calculation_date annual_return* annual_volatility* skewness* kurtosis* sharpe_ratio* sortino_ratio* beta* "
    "max_drawdown* var_95* cvar_95* trading_days positive_days negative_days win_rate* risk_adjusted_score* risk_category",
    lambda v: v.risk, "SELECT * FROM risk")
add("g10_kelly", "symbol total_trades winning_trades win_probability* avg_win_pct* avg_loss_pct* win_loss_ratio* standard_kelly* continuous_kelly* "
    "raw_kelly_pct* adjusted_kelly_pct* final_position_pct* daily_volatility* annual_volatility* sharpe_ratio* quality_score* quality_multiplier* position_category",
    lambda v: v.kelly, "SELECT * FROM kelly")
add("g12_insider_signals", "symbol buys_30d sells_30d buy_value_30d* sell_value_30d* buys_90d sells_90d ceo_buying cfo_buying officer_cluster_buying "
    "net_insider_buying_30d*2 insider_score*", lambda v: v.insider_signals, "SELECT * FROM insider_sig")
add("g13_institutional_signals", "symbol report_date total_shares num_holders quarter_change_pct* net_institutional_flow smart_money_signal momentum_score* "
    "heavy_accumulation moderate_accumulation distribution", lambda v: v.ownership_history, "SELECT * FROM inst_sig")
add("g14_master_signals", "symbol name sector industry market_cap_b* pe_ratio* pb_ratio* ps_ratio* dividend_yield* profit_margin* roe* revenue_growth* eps_growth* "
    "insider_score* ceo_buying cfo_buying officer_cluster_buying fscore fundamental_strength z_score* bankruptcy_risk institutional_change* smart_money_signal "
    "sharpe_ratio* annual_volatility* max_drawdown* volatility_level breakout_score* analyst_upside*", lambda v: v.signals, "SELECT * FROM signals")
add("g15_portfolio_type_scores", "symbol value_score* growth_score* dividend_score*", lambda v: signals.portfolio_type_scores(v.signals), "SELECT * FROM type_scores")
add("g16_master_composite", "symbol sector value_score* growth_score* dividend_score* composite_score* best_portfolio investment_grade", lambda v: v.master,
    "SELECT * FROM master")


def _held(label: str, rule: str) -> str:
    score = f"{label.lower()}_score"
    return (f"(SELECT '{label}' AS portfolio_type, symbol, {score} AS score FROM master WHERE {rule} "
            f"ORDER BY round({score}, 6) DESC, symbol LIMIT 10)")


add("g17_select_holdings", "portfolio_type symbol score*", lambda v: signals.select_holdings(v.master), " UNION ALL ".join([
    _held("VALUE", "fscore >= 6 AND bankruptcy_risk <> 'DISTRESS' AND pe_ratio > 0 AND pe_ratio < 25"),
    _held("GROWTH", "fscore >= 5 AND bankruptcy_risk <> 'DISTRESS' AND (revenue_growth > 5 OR eps_growth > 5)"),
    _held("DIVIDEND", "dividend_yield > 1.5 AND fscore >= 6 AND bankruptcy_risk = 'SAFE'")]))
add("g18_comprehensive_score", "symbol name sector fscore strength_category z_score* z_prime_score* bankruptcy_risk insider_score* ceo_buying pe_ratio* "
    "dividend_yield* profit_margin* roe* composite_score*", lambda v: v.comprehensive, "SELECT * FROM comprehensive")
add("g19_investment_quality", "symbol fscore bankruptcy_risk insider_score* investment_quality", lambda v: signals.investment_quality(v.comprehensive), """
SELECT *, CASE WHEN fscore >= 8 AND bankruptcy_risk = 'SAFE' AND coalesce(insider_score, 0) >= 70 THEN 'TOP_TIER'
  WHEN (fscore >= 7)::int + (bankruptcy_risk = 'SAFE')::int + (coalesce(insider_score, 0) >= 60)::int >= 2 THEN 'STRONG'
  WHEN bankruptcy_risk <> 'DISTRESS' AND fscore >= 5 THEN 'MODERATE' WHEN bankruptcy_risk = 'DISTRESS' OR fscore <= 3 THEN 'WEAK' ELSE 'NEUTRAL' END AS investment_quality
FROM comprehensive""")
add("g33_forward_returns", "symbol trade_date return_1m* return_3m* return_6m* return_12m* volatility_1m* sharpe_1m* max_drawdown_1m* volatility_3m* sharpe_3m* max_drawdown_3m*",
    lambda v: technical.forward_returns(v.bars), """
WITH n AS (SELECT symbol, trade_date, close, row_number() OVER w AS i, close / lag(close) OVER w - 1 AS r,
    lead(close, 21) OVER w / close - 1 AS return_1m, lead(close, 63) OVER w / close - 1 AS return_3m, lead(close, 126) OVER w / close - 1 AS return_6m,
    lead(close, 252) OVER w / close - 1 AS return_12m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
 spread AS (SELECT symbol, i, stddev_samp(r) OVER m AS s1, avg(r) OVER m AS a1, stddev_samp(r) OVER q AS s3, avg(r) OVER q AS a3 FROM n
   WINDOW m AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING), q AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING)),
 ahead AS (SELECT a.symbol, a.i, b.i - a.i AS k, b.close / max(b.close) OVER (PARTITION BY a.symbol, a.i ORDER BY b.i ROWS UNBOUNDED PRECEDING) - 1 AS f
   FROM n a JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i AND a.i + 63),
 falls AS (SELECT symbol, i, min(f) FILTER (k <= 21) AS d1, min(f) AS d3 FROM ahead GROUP BY 1, 2)
SELECT n.symbol, trade_date, return_1m, return_3m, return_6m, return_12m,
  CASE WHEN return_1m IS NOT NULL THEN s1 * sqrt(252) END AS volatility_1m, CASE WHEN return_1m IS NOT NULL THEN (a1 - 0.03 / 252) / nullif(s1, 0) * sqrt(252) END AS sharpe_1m,
  CASE WHEN return_1m IS NOT NULL THEN d1 END AS max_drawdown_1m, CASE WHEN return_3m IS NOT NULL THEN s3 * sqrt(252) END AS volatility_3m,
  CASE WHEN return_3m IS NOT NULL THEN (a3 - 0.03 / 252) / nullif(s3, 0) * sqrt(252) END AS sharpe_3m, CASE WHEN return_3m IS NOT NULL THEN d3 END AS max_drawdown_3m
FROM n JOIN spread s ON n.symbol = s.symbol AND n.i = s.i JOIN falls f ON n.symbol = f.symbol AND n.i = f.i""")
MONTHS = (1, 3, 6, 12, 36)  # fixed values
_now = "arg_max(close, trade_date)"


def _then(m: int) -> str:
    return f"arg_max(close, trade_date) FILTER (trade_date <= CAST((SELECT d FROM today) - INTERVAL {m} MONTH AS date))"


_growth = ", ".join(f"{_now} / {_then(m)} - 1 AS r{m}" for m in MONTHS)
add("g34_outperformance", "symbol " + " ".join(f"stock_return_{m}m* market_return_{m}m* relative_return_{m}m*" for m in MONTHS) + " outperformance_score* rank_composite",
    lambda v: technical.rank_outperformance(technical.outperformance(v.bars, v.bench, v.universe, v.as_of)), f"""
SELECT *, rank() OVER (ORDER BY outperformance_score DESC) AS rank_composite FROM (SELECT s.symbol,
  {", ".join(f"s.r{m} AS stock_return_{m}m, m.r{m} AS market_return_{m}m, s.r{m} - m.r{m} AS relative_return_{m}m" for m in MONTHS)},
  round(({" + ".join(f"coalesce(s.r{m} - m.r{m}, 0)" for m in MONTHS)}) / nullif({" + ".join(f"(s.r{m} IS NOT NULL)::int" for m in MONTHS)}, 0), 6) AS outperformance_score
FROM (SELECT symbol, {_growth} FROM bars WHERE symbol IN (SELECT symbol FROM elig) GROUP BY 1) s, (SELECT {_growth} FROM bench) m)""")

add("c01_ladders", "symbol investment_grade position_category", lambda v: v.master.select("symbol", "investment_grade").join(
    v.kelly.select("symbol", "position_category"), "symbol"), "SELECT m.symbol, investment_grade, position_category FROM master m JOIN kelly k ON m.symbol = k.symbol")
add("c02_clamp", "symbol report_date momentum_score*", lambda v: v.ownership_history.select(
    "symbol", "report_date", clamp(50 + F.col("quarter_change_pct") * 2).alias("momentum_score")), "SELECT symbol, report_date, momentum_score FROM inst_sig")
add("c03_right_closed_bins", "symbol breakout_score*2 breakout_strength", lambda v: v.breakout, "SELECT * FROM breakout")
add("c05_best_portfolio", "symbol best_portfolio", lambda v: v.master, "SELECT * FROM master")
assert LOOKBACK_DAYS == 2500  # the look-back written into the oracle views
