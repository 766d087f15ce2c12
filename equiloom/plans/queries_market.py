"""Registered sector queries and the SQL steps they share."""

from __future__ import annotations

from equiloom.operators import sectors
from equiloom.plans.registry import add, view

view("sector_daily", """
SELECT *, vwap / nullif(lag(vwap) OVER (PARTITION BY sector ORDER BY trade_date), 0) - 1 AS daily_return FROM (
  SELECT u.sector, trade_date, avg(close) AS avg_close, sum(volume * close) / nullif(sum(volume), 0) AS vwap, count(*) AS num_stocks, sum(market_cap) / 1e9 AS sector_mcap_b
  FROM recent_bars b JOIN elig u ON b.symbol = u.symbol GROUP BY 1, 2)""")
view("sector_quality", """
SELECT u.sector, avg(fscore) AS avg_fscore, avg(a.z_score) AS avg_zscore, avg(m.composite_score) AS avg_quality_score, avg(r.sharpe_ratio) AS avg_sharpe,
  avg(i.quarter_change_pct) AS avg_inst_change
FROM elig_listed u LEFT JOIN (SELECT symbol, fscore FROM piotroski) p ON u.symbol = p.symbol LEFT JOIN altman a ON u.symbol = a.symbol LEFT JOIN (SELECT symbol, composite_score FROM master) m ON u.symbol = m.symbol
LEFT JOIN risk r ON u.symbol = r.symbol LEFT JOIN inst_last i ON u.symbol = i.symbol GROUP BY 1""")
view("sector_ranked", """
SELECT s.*, daily_return - avg(daily_return) OVER (PARTITION BY trade_date) AS excess, row_number() OVER (PARTITION BY sector ORDER BY trade_date DESC) AS k
FROM sector_daily s WHERE daily_return IS NOT NULL""")
view("sector_momentum", """
SELECT *, (momentum_1m * 0.2 + momentum_3m * 0.3 + momentum_6m * 0.2 + relative_strength * 0.2 + consistency * 0.1) * 100 AS momentum_score FROM (
  SELECT r.sector, max(trade_date) AS calculation_date, coalesce(max(q.avg_quality_score), 50) AS avg_quality_score,
    CASE WHEN count(*) >= 20 THEN product(1 + daily_return) FILTER (k <= 20) - 1 ELSE 0 END AS momentum_1m,
    CASE WHEN count(*) >= 60 THEN product(1 + daily_return) FILTER (k <= 60) - 1 ELSE 0 END AS momentum_3m,
    CASE WHEN count(*) >= 120 THEN product(1 + daily_return) FILTER (k <= 120) - 1 ELSE 0 END AS momentum_6m,
    CASE WHEN count(*) >= 60 THEN avg(excess) FILTER (k <= 60) * 252 ELSE 0 END AS relative_strength,
    CASE WHEN count(*) >= 60 THEN avg((daily_return > 0)::int) FILTER (k <= 60) ELSE 0.5 END AS consistency,
    CASE WHEN count(*) >= 60 THEN stddev_samp(daily_return) FILTER (k <= 60) * sqrt(252) ELSE 0 END AS volatility
  FROM sector_ranked r LEFT JOIN sector_quality q ON r.sector = q.sector WHERE k <= 120 GROUP BY 1 HAVING count(*) >= 19)""")
view("regime_facts", """
SELECT (coalesce(max(r) FILTER (sector = 'Technology'), 0) + coalesce(max(r) FILTER (sector = 'Consumer Discretionary'), 0)) / 2 AS risk_on_score,
  (coalesce(max(r) FILTER (sector = 'Consumer Staples'), 0) + coalesce(max(r) FILTER (sector = 'Utilities'), 0)) / 2 AS risk_off_score,
  (SELECT avg(s) FROM (SELECT trade_date, stddev_samp(daily_return) AS s FROM sector_daily GROUP BY 1 HAVING s IS NOT NULL ORDER BY 1 DESC LIMIT 20)) AS market_vol,
  (SELECT quantile_cont(s, 0.75) FROM (SELECT trade_date, stddev_samp(daily_return) AS s FROM sector_daily GROUP BY 1)) AS vol_threshold
FROM (SELECT sector, arg_max(daily_return, trade_date) AS r FROM sector_daily WHERE daily_return IS NOT NULL GROUP BY 1)""")
view("regime_row", """
SELECT *, CASE regime WHEN 'RISK_ON' THEN least(100, (risk_on_score - risk_off_score) * 1000)
    WHEN 'RISK_OFF' THEN least(100, (risk_off_score - risk_on_score) * 1000 + market_vol * 100) ELSE 50 END AS confidence
FROM (SELECT *, CASE WHEN risk_on_score > risk_off_score AND market_vol < vol_threshold THEN 'RISK_ON'
    WHEN risk_off_score > risk_on_score OR market_vol > vol_threshold THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS regime FROM regime_facts)""")
view("cycle_row", """
SELECT *, CASE WHEN tech > 0 AND financials > 0 AND staples < 0 THEN 'EARLY_RECOVERY' WHEN materials > 0 AND energy > 0 THEN 'LATE_CYCLE'
  WHEN staples > 0 AND utilities > 0 AND tech < 0 THEN 'RECESSION' ELSE 'MID_CYCLE' END AS cycle_phase
FROM (SELECT """ + ", ".join(
    f"coalesce(max(momentum_3m) FILTER (sector = '{label}'), 0) AS {name}" for name, label in sectors.CYCLE_INPUTS.items()) + " FROM sector_momentum)")


def _match(lists: dict, label: str) -> str:
    return " OR ".join(f"({label} = '{name}' AND sector IN ({', '.join(repr(s) for s in members)}))" for name, members in lists.items())


add("a10_sector_vwap", "sector trade_date avg_close* vwap* num_stocks sector_mcap_b*", lambda v: v.sector_daily, "SELECT * FROM sector_daily")
add("a17_sector_quality", "sector avg_fscore* avg_zscore* avg_quality_score* avg_sharpe* avg_inst_change*", lambda v: v.sector_quality, "SELECT * FROM sector_quality")
add("a18_sector_correlations", "sector1 sector2 correlation* correlation_90d* correlation_30d*", lambda v: sectors.sector_correlations(v.sector_daily), """
WITH ages AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date DESC) AS age FROM (SELECT DISTINCT trade_date FROM sector_daily)),
 s AS (SELECT sector, d.trade_date, daily_return, age FROM sector_daily d JOIN ages a ON d.trade_date = a.trade_date WHERE daily_return IS NOT NULL)
SELECT x.sector AS sector1, y.sector AS sector2, corr(x.daily_return, y.daily_return) AS correlation, corr(x.daily_return, y.daily_return) FILTER (x.age <= 90) AS correlation_90d,
  corr(x.daily_return, y.daily_return) FILTER (x.age <= 30) AS correlation_30d FROM s x JOIN s y ON x.trade_date = y.trade_date GROUP BY 1, 2""")
add("g27_sector_daily", "sector trade_date vwap* daily_return*", lambda v: v.sector_daily, "SELECT * FROM sector_daily")
add("g28_sector_momentum", "sector calculation_date momentum_1m* momentum_3m* momentum_6m* relative_strength* consistency* volatility* momentum_score* avg_quality_score*",
    lambda v: v.sector_momentum, "SELECT * FROM sector_momentum")
add("g29_market_regime", "risk_on_score* risk_off_score* market_vol* vol_threshold* regime confidence*", lambda v: sectors.market_regime(v.sector_daily), "SELECT * FROM regime_row")
add("g30_economic_cycle", "tech* financials* staples* utilities* materials* energy* cycle_phase", lambda v: sectors.economic_cycle(v.sector_momentum), "SELECT * FROM cycle_row")
add("g31_rotation_matrix", "sector rotation_score* momentum_1m* momentum_3m* relative_strength* quality_score* allocation target_weight_pct regime cycle_phase normalized_weight_pct*",
    lambda v: sectors.rotation_matrix(v.sector_momentum, sectors.market_regime(v.sector_daily), sectors.economic_cycle(v.sector_momentum)), f"""
SELECT *, coalesce(target_weight_pct / nullif(sum(target_weight_pct) OVER (), 0) * 100, 0) AS normalized_weight_pct FROM (
  SELECT *, CASE WHEN rotation_score >= 80 THEN 'OVERWEIGHT' WHEN rotation_score >= 60 THEN 'NEUTRAL' WHEN rotation_score >= 40 THEN 'UNDERWEIGHT' ELSE 'AVOID' END AS allocation,
    CASE WHEN rotation_score >= 80 THEN 15 WHEN rotation_score >= 60 THEN 10 WHEN rotation_score >= 40 THEN 5 ELSE 0 END AS target_weight_pct
  FROM (SELECT sector, momentum_1m * 100 AS momentum_1m, momentum_3m * 100 AS momentum_3m, relative_strength, avg_quality_score AS quality_score, regime, cycle_phase,
      greatest(0, least(100, momentum_score * CASE WHEN {_match(sectors.REGIME_SECTORS, 'regime')} THEN 1.2 ELSE 0.9 END
        * CASE WHEN {_match(sectors.CYCLE_SECTORS, 'cycle_phase')} THEN 1.15 ELSE 1 END
        * CASE WHEN avg_quality_score > 70 THEN 1.1 WHEN avg_quality_score < 30 THEN 0.8 ELSE 1 END)) AS rotation_score
    FROM sector_momentum, regime_row, cycle_row))""")
add("g32_sector_correlations", "sector1 sector2 correlation*", lambda v: sectors.sector_correlations(v.sector_daily), """
SELECT x.sector AS sector1, y.sector AS sector2, corr(x.daily_return, y.daily_return) AS correlation FROM sector_daily x JOIN sector_daily y ON x.trade_date = y.trade_date GROUP BY 1, 2""")
add("a12_compounded_return", "sector total_return* days", lambda v: sectors.sector_growth(v.sector_daily),
    "SELECT sector, product(1 + daily_return) - 1 AS total_return, count(*) AS days FROM sector_daily WHERE daily_return IS NOT NULL GROUP BY 1")
