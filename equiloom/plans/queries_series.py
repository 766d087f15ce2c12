"""Registered window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiloom.functions.expressions import ratio
from equiloom.functions.frames import latest_by
from equiloom.functions.ranking import numbered, tied_rank, with_percentile
from equiloom.operators import aggregates, series
from equiloom.operators.technical import stock_and_market_returns
from equiloom.plans.registry import add, view

W = "PARTITION BY symbol ORDER BY trade_date"

add("w01_moving_averages", "symbol trade_date sma_20* sma_50* sma_200*", lambda v: series.moving_averages(v.bars), f"""
SELECT symbol, trade_date, avg(close) OVER ({W} ROWS 19 PRECEDING) AS sma_20, avg(close) OVER ({W} ROWS 49 PRECEDING) AS sma_50,
  avg(close) OVER ({W} ROWS 199 PRECEDING) AS sma_200 FROM bars""")
add("w02_volume_ratio", "symbol trade_date avg_volume_20* avg_volume_50* volume_ratio*", lambda v: series.volume_ratio(v.bars), f"""
SELECT *, volume / nullif(avg_volume_20, 0) AS volume_ratio FROM (SELECT symbol, trade_date, volume, avg(volume) OVER ({W} ROWS 19 PRECEDING) AS avg_volume_20,
  avg(volume) OVER ({W} ROWS 49 PRECEDING) AS avg_volume_50 FROM bars)""")
add("w03_rolling_high_low", "symbol trade_date high_52w* low_52w*", lambda v: series.rolling_range(v.bars), f"""
SELECT symbol, trade_date, max(high) OVER ({W} ROWS 251 PRECEDING) AS high_52w, min(low) OVER ({W} ROWS 251 PRECEDING) AS low_52w FROM bars""")
add("w04_daily_returns", "symbol trade_date daily_return* market_return*", lambda v: stock_and_market_returns(v.bars, v.bench), """
SELECT b.symbol, b.trade_date, b.close / nullif(lag(b.close) OVER w, 0) - 1 AS daily_return, m.close / nullif(lag(m.close) OVER w, 0) - 1 AS market_return
FROM bars b LEFT JOIN bench m ON b.trade_date = m.trade_date WINDOW w AS (PARTITION BY b.symbol ORDER BY b.trade_date)""")
add("w05_rolling_volatility", "symbol trade_date volatility_20d* normalized_volatility*", lambda v: series.rolling_volatility(v.bars), f"""
SELECT *, volatility_20d / close AS normalized_volatility FROM (SELECT symbol, trade_date, close, stddev_samp(close) OVER ({W} ROWS 19 PRECEDING) AS volatility_20d FROM bars)""")
add("w06_forward_changes", "symbol trade_date return_5d* return_1m* return_3m* return_6m* return_12m*", lambda v: series.forward_changes(
    v.bars, {"return_5d": 5, "return_1m": 21, "return_3m": 63, "return_6m": 126, "return_12m": 252}), f"""
SELECT symbol, trade_date, lead(close, 5) OVER w / close - 1 AS return_5d, lead(close, 21) OVER w / close - 1 AS return_1m, lead(close, 63) OVER w / close - 1 AS return_3m,
  lead(close, 126) OVER w / close - 1 AS return_6m, lead(close, 252) OVER w / close - 1 AS return_12m FROM bars WINDOW w AS ({W})""")
YEAR_AGO = ("revenue", "gross_profit", "total_assets", "total_liabilities", "net_income", "operating_cash_flow")
add("w07_year_ago", "symbol fiscal_date " + " ".join(f"{c}_change*" for c in YEAR_AGO), lambda v: series.year_ago(v.fundamentals, YEAR_AGO).withColumns(
    {f"{c}_change": ratio(F.col(c), F.col(f"prior_{c}")) for c in YEAR_AGO}),
    "SELECT symbol, fiscal_date, " + ", ".join(f"{c} / nullif(lag({c}, 4) OVER (PARTITION BY symbol ORDER BY fiscal_date), 0) AS {c}_change" for c in YEAR_AGO) + " FROM fundamentals_q")
add("w08_rsi", "symbol trade_date rsi*", lambda v: series.rsi(v.bars), f"""
SELECT symbol, trade_date, CASE WHEN k >= 14 AND g + l > 0 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi
FROM (SELECT *, avg(greatest(d, 0)) OVER ({W} ROWS 13 PRECEDING) AS g, avg(greatest(-d, 0)) OVER ({W} ROWS 13 PRECEDING) AS l, row_number() OVER ({W}) AS k
  FROM (SELECT symbol, trade_date, coalesce(close - lag(close) OVER ({W}), 0) AS d FROM bars))""")
add("w09_max_drawdown", "symbol max_drawdown*", lambda v: series.max_drawdown(v.bars), f"""
SELECT symbol, min(close / m - 1) AS max_drawdown FROM (SELECT symbol, close, max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) AS m FROM returns) GROUP BY 1""")
view("div_streak_view", "SELECT symbol, payment_streak_years, increase_streak_years, total_years_paying FROM streaks")
add("w10_dividend_streaks", "symbol payment_streak_years increase_streak_years total_years_paying",
    lambda v: series.dividend_streaks(series.dividend_changes(aggregates.yearly_dividends(v.dividends))), "SELECT * FROM div_streak_view")
add("w11_dividend_changes", "symbol year total_dividend* prev_dividend* dividend_change* growth_rate* direction",
    lambda v: series.dividend_changes(aggregates.yearly_dividends(v.dividends)), "SELECT * FROM div_change")
add("w12_latest_row", "symbol fiscal_date revenue$ total_assets$", lambda v: latest_by(v.fundamentals_q, ["symbol"], "fiscal_date"),
    "SELECT symbol, fiscal_date, revenue, total_assets FROM fq_lag WHERE rn = 1")
add("w13_newest_rows", "symbol fiscal_date row_no revenue$", lambda v: series.newest_rows(v.fundamentals_q, 8, "fiscal_date"),
    "SELECT symbol, fiscal_date, rn AS row_no, revenue FROM fq_lag WHERE rn <= 8")


def three_ranks(v):
    scores = v.ownership.select("symbol", F.round("quarter_change_pct", 0).alias("score"))
    ranked = tied_rank(tied_rank(scores, "score", "symbol", "competition_rank"), "score", "symbol", "dense_rank", "dense")
    return numbered(ranked, [F.col("score").desc_nulls_last(), F.col("symbol").asc()], "ordinal_rank")


add("w14_ranks", "symbol score*2 competition_rank dense_rank ordinal_rank", three_ranks, """
SELECT symbol, score, rank() OVER (ORDER BY score DESC) AS competition_rank, dense_rank() OVER (ORDER BY score DESC) AS dense_rank,
  row_number() OVER (ORDER BY score DESC, symbol) AS ordinal_rank FROM (SELECT symbol, round(quarter_change_pct, 0) AS score FROM inst_last)""")


def percentile_rank(v):
    order = [F.round("quarter_change_pct", 6).desc(), F.col("symbol").asc()]
    return with_percentile(numbered(v.ownership.select("symbol", "quarter_change_pct"), order, "rank"), "rank")


add("w15_percentile_from_rank", "symbol rank percentile*", percentile_rank, """
SELECT symbol, rank, 100 - (rank - 1) / n * 100 AS percentile FROM (SELECT symbol, row_number() OVER (ORDER BY round(quarter_change_pct, 6) DESC, symbol) AS rank,
  count(*) OVER () AS n FROM inst_last)""")
add("w16_share_of_total", "symbol trade_date weight*", lambda v: v.positions, """
SELECT symbol, trade_date, weight FROM held""")
add("w17_days_between", "symbol ex_date days_between", lambda v: series.days_between(v.dividends), """
SELECT symbol, ex_date, ex_date - lag(ex_date) OVER (PARTITION BY symbol ORDER BY ex_date) AS days_between FROM dividends""")
add("w18_recent_range", "symbol trade_date recent_high* recent_low*", lambda v: series.recent_base(v.bars), f"""
SELECT symbol, trade_date, max(high) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS recent_high,
  min(low) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS recent_low FROM bars""")
add("w19_accumulation", "symbol accumulation_ratio*", lambda v: series.accumulation(v.bars, F.date_sub(v.as_of, 100)), f"""
SELECT symbol, sum(sign(step) * volume) / nullif(sum(abs(sign(step) * volume)), 0) AS accumulation_ratio
FROM (SELECT *, close - lag(close) OVER ({W}) AS step FROM bars) WHERE trade_date >= (SELECT d FROM today) - 100 GROUP BY 1""")


def sequence_summary(v):
    """Checks a sequence table by its parts: length, first day and sum of the closes."""
    rows = series.sequences(v.bars, ("close",), "close")
    total = F.aggregate("sequence", F.lit(0.0), lambda acc, x: acc + x["close"])
    return rows.select("symbol", "trade_date", F.size("sequence").alias("steps"), F.col("sequence")[0]["trade_date"].alias("first_day"),
                       total.alias("close_sum"), "target")


add("w20_sequences", "symbol trade_date steps first_day close_sum*3 target*", sequence_summary, f"""
SELECT symbol, trade_date, 60 AS steps, first_day, close_sum, target FROM (SELECT symbol, trade_date, close AS target, row_number() OVER ({W}) AS k,
  lag(trade_date, 60) OVER ({W}) AS first_day, sum(close) OVER ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS close_sum FROM bars) WHERE k > 60""")
add("w21_cross_section_volatility", "market_vol* days", lambda v: series.cross_section_volatility(v.sector_daily), """
SELECT avg(s) AS market_vol, count(*) AS days FROM (SELECT trade_date, stddev_samp(daily_return) AS s FROM sector_daily GROUP BY 1 HAVING s IS NOT NULL ORDER BY 1 DESC LIMIT 20)""")
