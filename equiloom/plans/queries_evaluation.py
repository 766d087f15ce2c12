"""Registered strategy, parameter search and attribution queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from equiloom.operators import evaluation as ev
from equiloom.plans.registry import add, view
from equiloom.session import checkpointed, stored

view("days", "SELECT DISTINCT trade_date FROM bars")

#: Fixed values, stated here again so that the SQL does not follow the operators.
SQL_SCORES = {"VALUE": "value_score", "GROWTH": "growth_score", "DIVIDEND": "dividend_score", "BALANCED": "composite_score"}
SQL_GRID = {
    "VALUE": {"pe_weight": [0.2, 0.3, 0.4], "pb_weight": [0.1, 0.2, 0.3], "cash_flow_weight": [0.2, 0.3, 0.4], "fscore_threshold": [5.0, 6.0, 7.0]},
    "GROWTH": {"revenue_growth_weight": [0.2, 0.3, 0.4], "earnings_growth_weight": [0.2, 0.3, 0.4], "momentum_weight": [0.1, 0.2, 0.3], "quality_threshold": [60.0, 70.0, 80.0]},
    "DIVIDEND": {"yield_weight": [0.3, 0.4, 0.5], "growth_weight": [0.2, 0.3, 0.4], "payout_ratio_max": [0.5, 0.6, 0.7], "min_years": [5.0, 10.0, 15.0]},
    "BALANCED": {"value_weight": [0.25, 0.33, 0.4], "growth_weight": [0.25, 0.33, 0.4], "quality_weight": [0.2, 0.34, 0.4], "momentum_weight": [0.0, 0.1, 0.2]},
}
SQL_FACTORS = ("value_factor", "growth_factor", "momentum_factor", "quality_factor")


def _calendar(name: str, step: str) -> None:
    view(f"{name}_dates", f"SELECT CAST(unnest(generate_series(min(trade_date)::timestamp, max(trade_date)::timestamp, INTERVAL {step})) AS date) AS rebalance_date FROM days")
    view(name, f"""
SELECT *, row_number() OVER (ORDER BY rebalance_date) - 1 AS period_no, lead(entry_day) OVER (ORDER BY rebalance_date) AS next_entry
FROM (SELECT rebalance_date, (SELECT min(trade_date) FROM days WHERE trade_date >= rebalance_date) AS entry_day FROM {name}_dates)""")


_calendar("calendar", "3 MONTH")
_calendar("months", "1 MONTH")
_calendar("weeks", "7 DAY")
_calendar("years", "1 YEAR")


def _scored(name: str, calendar: str) -> None:
    view(name, f"""
SELECT a.symbol, a.rebalance_date, h.* EXCLUDE (symbol) FROM (SELECT s.symbol, rebalance_date FROM (SELECT DISTINCT symbol FROM score_history) s, {calendar}) a
ASOF LEFT JOIN score_history h ON a.symbol = h.symbol AND a.rebalance_date >= h.signal_date""")


_scored("quarter_scores", "calendar")
_scored("month_scores", "months")
view("picks", "SELECT * FROM (" + " UNION ALL ".join(f"""
SELECT '{name}' AS strategy, rebalance_date, symbol, {column} AS score, 0.1 AS weight,
  row_number() OVER (PARTITION BY rebalance_date ORDER BY {column} DESC, symbol) AS pick_no FROM quarter_scores WHERE {column} IS NOT NULL"""
     for name, column in SQL_SCORES.items()) + ") WHERE pick_no <= 10")


def _returns(picks: str, moves: str, gross: str, daily: str) -> None:
    """Turnover, gross and net daily returns of a table of picks."""
    view(moves, f"""
SELECT strategy, period_no, sum(abs(d)) AS turnover FROM (SELECT strategy, period_no, symbol, sum(w) AS d FROM (
  SELECT strategy, period_no, symbol, weight AS w FROM {picks} p JOIN calendar c ON p.rebalance_date = c.rebalance_date UNION ALL
  SELECT strategy, period_no + 1, symbol, -weight FROM {picks} p JOIN calendar c ON p.rebalance_date = c.rebalance_date) GROUP BY 1, 2, 3)
WHERE period_no <= (SELECT max(period_no) FROM calendar) GROUP BY 1, 2""")
    view(gross, f"""
SELECT p.strategy, c.period_no, r.trade_date, sum(p.weight * r.r) AS gross_return,
  row_number() OVER (PARTITION BY p.strategy, c.period_no ORDER BY r.trade_date) AS k
FROM {picks} p JOIN calendar c ON p.rebalance_date = c.rebalance_date JOIN returns r ON r.symbol = p.symbol AND r.trade_date > c.entry_day AND r.trade_date <= c.next_entry
GROUP BY 1, 2, 3""")
    view(daily, f"""
SELECT g.*, CASE WHEN k = 1 THEN m.turnover * 0.002 ELSE 0 END AS cost, gross_return - CASE WHEN k = 1 THEN m.turnover * 0.002 ELSE 0 END AS net_return
FROM {gross} g JOIN {moves} m ON g.strategy = m.strategy AND g.period_no = m.period_no""")


_returns("picks", "pick_moves", "strategy_gross", "strategy_daily")
view("kelly_picks", """
SELECT * REPLACE (coalesce(final_position_pct / 100, 0.05) / sum(coalesce(final_position_pct / 100, 0.05)) OVER (PARTITION BY strategy, rebalance_date) AS weight)
FROM picks LEFT JOIN (SELECT symbol, final_position_pct FROM kelly) k USING (symbol)""")
_returns("kelly_picks", "kelly_moves", "kelly_gross", "kelly_daily")


def kelly_returns(v) -> DataFrame:
    """Strategy returns with each pick weighted by its Kelly position, 5 % where there is none."""
    sizes = v.kelly.select("symbol", (F.col("final_position_pct") / 100).alias("size"))
    picks = ev.pick_weights(v.scores_at_rebalance.join(sizes, "symbol", "left"), size="size")
    return ev.strategy_returns(picks, v.bars, v.calendar, v.days)


add("c08_rebalance_calendar", "rebalance_date entry_day next_entry period_no", lambda v: v.calendar, "SELECT * FROM calendar")
for _frequency, _name in (("monthly", "months"), ("weekly", "weeks"), ("annual", "years")):
    add(f"c08_rebalance_calendar_{_frequency}", "rebalance_date entry_day next_entry period_no", lambda v, f=_frequency: ev.rebalance_calendar(v.days, f), f"SELECT * FROM {_name}")
add("l02_top_per_group", "strategy rebalance_date symbol score* weight* pick_no", lambda v: v.picks, "SELECT * FROM picks")
add("g35_strategy_returns", "strategy period_no trade_date gross_return* cost* net_return*", lambda v: v.strategy_returns, "SELECT * FROM strategy_daily")
add("g35_strategy_returns_kelly", "strategy period_no trade_date gross_return* cost* net_return*", kelly_returns, "SELECT * FROM kelly_daily")
add("g36_performance_stats", "strategy total_return* annual_return* days volatility* sharpe_ratio* max_drawdown* win_rate*",
    lambda v: ev.performance_stats(v.strategy_returns), """
SELECT strategy, product(1 + net_return) - 1 AS total_return, pow(product(1 + net_return), 252 / count(*)) - 1 AS annual_return, count(*) AS days,
  stddev_pop(net_return) * sqrt(252) AS volatility, (avg(net_return) - 0.03 / 252) / nullif(stddev_pop(net_return), 0) * sqrt(252) AS sharpe_ratio,
  min(g / m - 1) AS max_drawdown, avg((net_return > 0)::int) AS win_rate
FROM (SELECT *, max(g) OVER (PARTITION BY strategy ORDER BY trade_date) AS m FROM (
  SELECT *, product(1 + net_return) OVER (PARTITION BY strategy ORDER BY trade_date) AS g FROM strategy_daily)) GROUP BY 1""")
SCORES = ["value_score", "growth_score", "dividend_score", "momentum_score", "composite_score", "pe_ratio", "price_to_book", "dividend_yield", "payout_ratio",
          "revenue_growth", "earnings_growth", "fscore"]
view("newest_scores", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY signal_date DESC) AS rn FROM score_history) WHERE rn = 1")


def _sql_combos(strategy: str) -> str:
    """The parameter grid as a SELECT: nested lists, the last parameter varying fastest."""
    grid = SQL_GRID[strategy]
    names = list(grid)
    froms = ", ".join(f"(SELECT unnest({values}) AS {name}, unnest(range({len(values)})) AS {name}_i)" for name, values in grid.items())
    number = names[0] + "_i"
    for name in names[1:]:
        number = f"({number}) * {len(grid[name])} + {name}_i"
    return f"SELECT {number} AS combo, {', '.join(names)} FROM {froms}"


GRID_SQL = {
    "VALUE": """(coalesce(CASE WHEN pe_ratio > 0 THEN least(100, 1000 / pe_ratio) END * pe_weight, 0) + coalesce(CASE WHEN price_to_book > 0 THEN least(100, 10 / price_to_book) END * pb_weight, 0)
      + coalesce(value_score * cash_flow_weight, 0)) * CASE WHEN fscore < fscore_threshold THEN 0.5 ELSE 1 END""",
    "GROWTH": """(coalesce(CASE WHEN revenue_growth IS NOT NULL THEN least(100, revenue_growth * 2) END * revenue_growth_weight, 0)
      + coalesce(CASE WHEN earnings_growth IS NOT NULL THEN least(100, earnings_growth * 2) END * earnings_growth_weight, 0)
      + coalesce(momentum_score * momentum_weight, 0)) * CASE WHEN composite_score < quality_threshold THEN 0.7 ELSE 1 END""",
    "DIVIDEND": """(coalesce(CASE WHEN dividend_yield > 0 THEN least(100, dividend_yield * 20) END * yield_weight, 0) + coalesce(dividend_score * growth_weight, 0))
      * CASE WHEN payout_ratio > payout_ratio_max THEN 0.6 ELSE 1 END""",
    "BALANCED": """coalesce(value_score * value_weight, 0) + coalesce(growth_score * growth_weight, 0) + coalesce(composite_score * quality_weight, 0)
      + coalesce(momentum_score * momentum_weight, 0)""",
}


def grid_scores(v) -> DataFrame:
    newest = v.score_history.groupBy("symbol").agg(F.max_by(F.struct(*SCORES), "signal_date").alias("s")).select("symbol", "s.*")
    parts = [ev.parameter_grid_scores(newest, s).select(F.lit(s).alias("strategy"), "combo", "symbol", "score") for s in ev.SCORE_GRID]
    return reduce(DataFrame.unionByName, parts)


add("g37_parameter_grid_scores", "strategy combo symbol score*", grid_scores, " UNION ALL ".join(
    f"SELECT '{s}' AS strategy, combo, symbol, {sql} AS score FROM newest_scores, ({_sql_combos(s)})" for s, sql in GRID_SQL.items()))


def walks(v, *strategies: str) -> dict[str, DataFrame]:
    """Each strategy's walk; scores, and returns of all their picks, are made once for all."""
    picks = {s: ev.grid_picks(ev.parameter_grid_scores(stored(ev.contenders(v.month_scores, s), "contenders"), s), s) for s in strategies}
    moved = ev.picked_returns(list(picks.values()), v.bars, v.months, v.days)
    moved = stored(moved, "picked-returns") if len(strategies) > 1 else moved
    windows = checkpointed(ev.walk_windows(v.days))
    return {s: ev.walk_forward(ev.grid_daily_returns(p, moved, v.months, s), windows, v.days, s) for s, p in picks.items()}


def walked(v, strategy: str = "VALUE") -> DataFrame:
    return walks(v, strategy)[strategy]


def of_all_walks(v, figure) -> DataFrame:
    """A figure of (walk, strategy) for every strategy, with the strategy's name."""
    found = [figure(walk, s).withColumn("strategy", F.lit(s)) for s, walk in walks(v, *ev.SCORE_GRID).items()]
    return reduce(DataFrame.unionByName, found)


view("walk_windows", """
SELECT train_start, train_end, train_end AS test_start, least(CAST(train_end + INTERVAL 3 MONTH AS date), z) AS test_end FROM (
  SELECT CAST(s AS date) AS train_start, CAST(s + INTERVAL 12 MONTH AS date) AS train_end, z FROM (
    SELECT unnest(generate_series(min(trade_date)::timestamp, max(trade_date)::timestamp, INTERVAL 3 MONTH)) AS s, max(trade_date) AS z FROM days)) WHERE train_end < z""")


#: Portfolio sizes, and months a pick is kept by frequency.
SQL_PORTFOLIOS = {"VALUE": ([8, 10, 12, 15], {"monthly": 1, "quarterly": 3}), "GROWTH": ([8, 10, 12, 15], {"monthly": 1, "quarterly": 3}),
                  "DIVIDEND": ([10, 15, 20], {"quarterly": 3, "annual": 12}), "BALANCED": ([15, 20, 25], {"monthly": 1, "quarterly": 3})}
view("month_returns", """
SELECT symbol, trade_date, period_no, r FROM returns JOIN months ON trade_date > entry_day AND trade_date <= next_entry""")


def _sharpe(daily: str, start: str, end: str, prefix: str) -> str:
    return f"""
SELECT train_start, combo, num_stocks, rebalance_freq, product(1 + daily_return) - 1 AS {prefix}_return,
  round(coalesce((pow(product(1 + daily_return), 252 / count(*)) - 1 - 0.03) / CASE WHEN round(stddev_pop(daily_return) * sqrt(252), 12) > 0 THEN stddev_pop(daily_return) * sqrt(252) END, 0), 6) AS {prefix}_sharpe
FROM {daily} JOIN walk_windows ON trade_date >= {start} AND trade_date < {end} GROUP BY 1, 2, 3, 4"""


def _walk(strategy: str, tail: str) -> None:
    """Views of one strategy's search, named with ``tail``."""
    sizes, kept = SQL_PORTFOLIOS[strategy]
    view(f"grid_picks{tail}", f"""
SELECT *, count(*) OVER (PARTITION BY rebalance_date, combo) AS picked FROM (
  SELECT *, row_number() OVER (PARTITION BY rebalance_date, combo ORDER BY round(score, 8) DESC, symbol) AS pick_no FROM (
    SELECT symbol, rebalance_date, combo, {GRID_SQL[strategy]} AS score FROM month_scores, ({_sql_combos(strategy)})) WHERE score > 0) WHERE pick_no <= {max(sizes)}""")
    view(f"grid_held{tail}", " UNION ALL ".join(f"""
SELECT combo, symbol, pick_no, picked, '{f}' AS rebalance_freq, period_no + unnest(range({m})) AS period_no FROM grid_picks{tail} p JOIN months m ON p.rebalance_date = m.rebalance_date WHERE period_no % {m} = 0"""
        for f, m in kept.items()))
    view(f"grid_daily{tail}", f"""
SELECT combo, rebalance_freq, trade_date, n AS num_stocks, coalesce(sum(r) FILTER (pick_no <= n), 0) / least(n, any_value(picked)) AS daily_return
FROM grid_held{tail} h JOIN month_returns r ON h.symbol = r.symbol AND h.period_no = r.period_no, (SELECT unnest({sizes}) AS n) GROUP BY 1, 2, 3, 4""")
    view(f"walk_train{tail}", _sharpe(f"grid_daily{tail}", "train_start", "train_end", "train"))
    view(f"walk_test{tail}", _sharpe(f"grid_daily{tail}", "test_start", "test_end", "test"))
    view(f"walk_best{tail}", f"""
SELECT w.*, b.combo, b.num_stocks, b.rebalance_freq, b.train_return, b.train_sharpe, t.test_return, coalesce(t.test_sharpe, 0) AS test_sharpe, g.* EXCLUDE (combo),
  b.train_sharpe - coalesce(t.test_sharpe, 0) AS sharpe_degradation, abs(b.train_sharpe - coalesce(t.test_sharpe, 0)) AS parameter_stability
FROM walk_windows w JOIN (SELECT *, row_number() OVER (PARTITION BY train_start ORDER BY train_sharpe DESC, combo, num_stocks, rebalance_freq) AS k FROM walk_train{tail}) b
  ON w.train_start = b.train_start AND k = 1
LEFT JOIN walk_test{tail} t ON b.train_start = t.train_start AND b.combo = t.combo AND b.num_stocks = t.num_stocks AND b.rebalance_freq = t.rebalance_freq
JOIN ({_sql_combos(strategy)}) g ON b.combo = g.combo""")


_walk("VALUE", "")
WALK = "train_start train_end test_start test_end combo num_stocks rebalance_freq {} train_return* train_sharpe* test_return* test_sharpe* sharpe_degradation* parameter_stability*"
for _strategy in ("GROWTH", "DIVIDEND", "BALANCED"):
    _walk(_strategy, f"_{_strategy.lower()}")
    add(f"g38_walk_forward_{_strategy.lower()}", WALK.format(" ".join(f"{p}*" for p in SQL_GRID[_strategy])), lambda v, s=_strategy: walked(v, s), f"SELECT * FROM walk_best_{_strategy.lower()}")
VALUE_PARAMETERS = list(SQL_GRID["VALUE"])
add("g38_walk_forward", "train_start train_end test_start test_end combo num_stocks rebalance_freq " + " ".join(f"{p}*" for p in VALUE_PARAMETERS)
    + " train_return* train_sharpe* test_return* test_sharpe* sharpe_degradation* parameter_stability*", walked, "SELECT * FROM walk_best")
TAILS = {"VALUE": "", "GROWTH": "_growth", "DIVIDEND": "_dividend", "BALANCED": "_balanced"}
view("walk_values", " UNION ALL ".join(
    f"SELECT '{s}' AS strategy, train_start, rebalance_freq, '{p}' AS parameter, CAST({p} AS double) AS v FROM walk_best{tail}" for s, tail in TAILS.items() for p in [*SQL_GRID[s], "num_stocks"]))
add("g39_parameter_stability", "strategy parameter mean* std* min_value* max_value* windows cv* stable", lambda v: of_all_walks(v, lambda walk, s: ev.parameter_stability(walk, s)[0]), """
SELECT strategy, parameter, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min_value, max(v) AS max_value, count(*) AS windows,
  coalesce(stddev_pop(v) / nullif(avg(v), 0), 0) AS cv, avg(v) <> 0 AND coalesce(stddev_pop(v) / nullif(avg(v), 0), 0) < 0.3 AS stable FROM walk_values GROUP BY 1, 2 HAVING count(*) > 1""")
add("a21_mode_and_consistency", "strategy parameter mode consistency* stable", lambda v: of_all_walks(v, lambda walk, s: ev.parameter_stability(walk, s)[1]), """
SELECT strategy, 'rebalance_freq' AS parameter, mode, n / total AS consistency, n / total > 0.6 AS stable FROM (
  SELECT strategy, rebalance_freq AS mode, count(*) AS n, sum(count(*)) OVER (PARTITION BY strategy) AS total, row_number() OVER (PARTITION BY strategy ORDER BY count(*) DESC, rebalance_freq) AS k
  FROM (SELECT DISTINCT strategy, train_start, rebalance_freq FROM walk_values) GROUP BY 1, 2) WHERE k = 1""")


def parameters_read_back(walk: DataFrame, strategy: str) -> DataFrame:
    back = ev.parameters_from_json(ev.parameters_json(walk, strategy), strategy).withColumn("num_stocks", F.col("num_stocks").cast("double"))
    return back.unpivot(["strategy", "train_start", "rebalance_freq"], [*ev.SCORE_GRID[strategy], "num_stocks"], "parameter", "v")


add("c13_parameters_json", "strategy train_start rebalance_freq parameter v*", lambda v: of_all_walks(v, parameters_read_back), "SELECT * FROM walk_values")

view("held_base", """
SELECT b.symbol, b.trade_date, sector, shares, p.close AS price, coalesce(p.r, 0) AS daily_return, shares * p.close AS market_value, market_return
FROM (SELECT trade_date, symbol, sum(quantity) AS shares FROM trades WHERE trade_type = 'BUY' GROUP BY 1, 2) b
JOIN (SELECT q.symbol, trade_date, close, u.sector, r, avg(coalesce(r, 0)) OVER (PARTITION BY trade_date) AS market_return
  FROM (SELECT symbol, trade_date, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS r FROM bars) q JOIN universe u ON q.symbol = u.symbol) p
  ON b.symbol = p.symbol AND b.trade_date = p.trade_date""")
view("held", "SELECT *, market_value / sum(market_value) OVER (PARTITION BY trade_date) AS weight FROM held_base")
view("cells", """
SELECT *, mv / sum(mv) OVER (PARTITION BY trade_date) - 1.0 / (SELECT count(DISTINCT sector) FROM held) AS active, r - avg(r) OVER () AS rel, 1.0 / (SELECT count(DISTINCT sector) FROM held) AS bw
FROM (SELECT trade_date, sector, sum(market_value) AS mv, avg(daily_return) AS r FROM held GROUP BY 1, 2)""")
view("brinson_rows", """
SELECT sector, sum(active * r) AS allocation_effect, sum(bw * rel) AS selection_effect, sum(active * rel) AS interaction_effect FROM cells GROUP BY 1 UNION ALL
SELECT 'TOTAL', sum(active * r), sum(bw * rel), sum(active * rel) FROM cells""")
add("g40_brinson", "sector allocation_effect* selection_effect* interaction_effect* total_effect*", lambda v: ev.brinson(v.position_values),
    "SELECT *, allocation_effect + selection_effect + interaction_effect AS total_effect FROM brinson_rows")
view("factor_rows", """
SELECT h.daily_return, value_score / 100 AS value_factor, growth_score / 100 AS growth_factor, momentum_score / 100 AS momentum_factor, composite_score / 100 AS quality_factor
FROM held h LEFT JOIN newest_scores s ON h.symbol = s.symbol""")
add("g41_factor_attribution", "factor exposure* factor_return* contribution*", lambda v: ev.factor_attribution(v.factor_positions),
    "SELECT *, exposure * factor_return AS contribution FROM (" + " UNION ALL ".join(f"""
SELECT '{f}' AS factor, avg({f}) AS exposure, coalesce(avg(daily_return) FILTER ({f} > (SELECT median({f}) FROM factor_rows)), 0)
  - coalesce(avg(daily_return) FILTER ({f} <= (SELECT median({f}) FROM factor_rows)), 0) AS factor_return FROM factor_rows""" for f in SQL_FACTORS) + ")")
add("g42_risk_attribution", "level name volatility* weight* risk_contribution*", lambda v: ev.risk_attribution(v.positions), """
SELECT *, coalesce(volatility * weight, 0) AS risk_contribution FROM (
  SELECT 'position' AS level, CAST(symbol AS varchar) AS name, stddev_samp(daily_return) * sqrt(252) AS volatility, avg(weight) AS weight FROM held GROUP BY symbol UNION ALL
  SELECT 'sector', sector, stddev_samp(daily_return) * sqrt(252), sum(weight) FROM held GROUP BY sector)""")
add("a20_concentration", "concentration_hhi* effective_positions*", lambda v: ev.position_concentration(v.positions), """
SELECT sum(w * w) AS concentration_hhi, 1 / sum(w * w) AS effective_positions FROM (SELECT symbol, avg(weight) AS w FROM held GROUP BY 1)""")


def periods(v) -> DataFrame:
    return v.calendar.where(F.col("next_entry").isNotNull()).select(F.col("entry_day").alias("period_start"), F.col("next_entry").alias("period_end"))


add("g43_timing_attribution", "period_start period_end buy_hold_return* actual_return* timing_effect*",
    lambda v: ev.timing_attribution(v.positions, periods(v), v.days), """
SELECT *, actual_return - buy_hold_return AS timing_effect FROM (
  SELECT period_start, period_end, exp(sum(ln(1 + m))) - 1 AS buy_hold_return, exp(sum(l)) - 1 AS actual_return FROM (
    SELECT entry_day AS period_start, next_entry AS period_end, symbol, avg(daily_return) AS m, sum(ln(1 + daily_return)) AS l
    FROM held JOIN calendar ON trade_date >= entry_day AND trade_date < next_entry GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
add("j13_interval_join", "period_start period_end rows_in_period symbols", lambda v: ev.in_period(v.positions.select("symbol", "trade_date"), periods(v), v.days).groupBy(
    "period_start", "period_end").agg(F.count("*").alias("rows_in_period"), F.countDistinct("symbol").alias("symbols")), """
SELECT entry_day AS period_start, next_entry AS period_end, count(*) AS rows_in_period, count(DISTINCT symbol) AS symbols
FROM held JOIN calendar ON trade_date >= entry_day AND trade_date < next_entry GROUP BY 1, 2""")
view("held_daily", "SELECT trade_date, sum(weight * daily_return) AS p, max(market_return) AS m FROM held GROUP BY 1")
ALPHA = """SELECT avg(p) * 252 - covar_samp(p, m) / var_samp(m) * avg(m) * 252 AS alpha, covar_samp(p, m) / var_samp(m) AS beta, pow(corr(p, m), 2) AS r_squared,
  stddev_samp(p - m) * sqrt(252) AS tracking_error, (avg(p) * 252 - covar_samp(p, m) / var_samp(m) * avg(m) * 252) / (stddev_samp(p - m) * sqrt(252)) AS information_ratio,
  product(1 + p) - 1 AS total_return, product(1 + m) - 1 AS benchmark_return, product(1 + p) - product(1 + m) AS excess_return FROM held_daily"""
add("g44_alpha_beta", "alpha* beta* r_squared* tracking_error* information_ratio*", lambda v: ev.alpha_beta(ev.portfolio_daily(v.positions)), ALPHA)
add("g45_attribution_report", "total_return* benchmark_return* excess_return* alpha* beta* r_squared* tracking_error* information_ratio* allocation_effect* selection_effect* "
    "interaction_effect* total_effect* concentration_hhi* effective_positions*", lambda v: ev.attribution_report(v.positions), f"""
SELECT a.*, b.* EXCLUDE (sector), allocation_effect + selection_effect + interaction_effect AS total_effect, c.* FROM ({ALPHA}) a, (SELECT * FROM brinson_rows WHERE sector = 'TOTAL') b,
  (SELECT sum(w * w) AS concentration_hhi, 1 / sum(w * w) AS effective_positions FROM (SELECT symbol, avg(weight) AS w FROM held GROUP BY 1)) c""")
