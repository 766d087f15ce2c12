"""SQL steps shared by the oracle texts: the input views of FIXTURES.md and the score tables."""

from __future__ import annotations

from equiloom.plans.registry import view

view("universe", """
SELECT s_suppkey AS symbol, s_name AS name,
  CASE r_name WHEN 'AFRICA' THEN 'Industrials' WHEN 'AMERICA' THEN 'Technology' WHEN 'ASIA' THEN 'Energy'
    WHEN 'EUROPE' THEN 'Consumer Staples' ELSE 'Utilities' END AS sector,
  n_name AS industry, s_acctbal * 1e6 AS market_cap, CASE WHEN s_suppkey % 17 = 3 THEN 'CAN' ELSE 'USA' END AS country,
  CASE WHEN s_suppkey % 19 = 4 THEN 'Preferred Stock' ELSE 'Common Stock' END AS security_type, s_suppkey % 23 = 5 AS is_etf
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
view("raw_bars", """
SELECT l_suppkey AS symbol, CAST(l_shipdate AS date) AS trade_date, avg(l_extendedprice / l_quantity) AS px,
  avg(l_tax) AS up, avg(l_discount) AS dn, CAST(sum(l_quantity) AS bigint) AS volume,
  sum(CASE WHEN l_returnflag = 'R' THEN l_tax * 10 ELSE 0 END) AS dividend_amount
FROM lineitem GROUP BY 1, 2""")
view("bars", """
SELECT symbol, trade_date, close * (1 - dn / 2) AS open, close * (1 + up) AS high, close * (1 - dn) AS low, close, volume,
  dividend_amount
FROM (SELECT *, avg(px) OVER w / 49.9371 AS close
      FROM raw_bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) b""")
view("bench", "SELECT trade_date, avg(close) AS close FROM bars GROUP BY trade_date")
view("fq", """
SELECT l_suppkey AS symbol, CAST(date_trunc('quarter', l_shipdate) AS date) AS fiscal_date,
  sum(l_extendedprice) AS rev, sum(l_extendedprice * l_discount) AS disc, sum(l_extendedprice * l_tax) AS tax,
  sum(l_quantity) AS qty, sum(l_extendedprice * CASE WHEN l_linestatus = 'F' THEN 0.03 ELSE -0.02 END) AS ocf
FROM lineitem GROUP BY 1, 2""")
view("fundamentals_q", """
SELECT symbol, fiscal_date, rev*1e4 AS revenue, (rev - disc*4)*1e4 AS gross_profit, (rev*0.3 - disc*4)*1e4 AS operating_income,
  (rev*0.05 - disc)*3e4 AS net_income, ocf*1e4 AS operating_cash_flow, (ocf - tax*0.1)*1e4 AS free_cash_flow, tax*1e3 AS capex,
  (1000 + qty)*1e4 AS shares,
  sum(rev*0.5) OVER w * 1e4 AS total_assets, sum(disc*(1 + symbol % 4)*2.5) OVER w * 1e4 AS total_liabilities,
  sum(rev*0.5 - disc*(1 + symbol % 4)*2.5) OVER w * 1e4 AS equity, sum(tax*3) OVER w * 1e4 AS total_debt, sum(disc) OVER w * 1e4 AS cash
FROM fq WINDOW w AS (PARTITION BY symbol ORDER BY fiscal_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
view("dividends", """
SELECT symbol, trade_date AS ex_date, dividend_amount / 100 AS dividend FROM raw_bars WHERE dividend_amount > 0""")
view("insider", """
SELECT user_id AS symbol, CAST(ts AS date) AS transaction_date,
  CASE WHEN event_type IN ('purchase','signup','click') THEN 'BUY' ELSE 'SELL' END AS transaction_type, value * 10000 AS total_value,
  (event_type = 'signup' AND event_id % 10 = 0) AS is_ceo, (event_type = 'purchase' AND event_id % 10 = 0) AS is_cfo,
  event_id % 3 = 0 AS is_officer, event_id FROM events""")
view("institutional", """
SELECT l_suppkey AS symbol, CAST(date_trunc('quarter', l_shipdate) AS date) AS report_date, sum(l_quantity) AS total_shares,
  count(DISTINCT o_custkey) AS num_holders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
view("trades", """
SELECT o_custkey AS account_id, l_suppkey AS symbol, CAST(l_shipdate AS date) AS trade_date,
  CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS trade_type, l_quantity AS quantity,
  l_extendedprice / l_quantity / 50 AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
view("accounts", """
SELECT c_custkey AS account_id, c_custkey AS client_id,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'VALUE' WHEN 'BUILDING' THEN 'GROWTH' WHEN 'FURNITURE' THEN 'DIVIDEND' ELSE 'BALANCED' END AS strategy,
  5.0 + c_custkey % 6 AS max_position_size_pct, CAST(10 + c_custkey % 11 AS int) AS max_portfolio_positions,
  60.0 + (c_custkey % 4) * 10 AS max_account_allocation_pct, 100.0 * (c_custkey % 5) AS min_cash_balance,
  abs(c_acctbal) AS cash_balance, c_custkey % 3 <> 0 AS stop_loss_enabled, 5.0 + c_custkey % 10 AS stop_loss_pct,
  c_custkey % 7 <> 0 AS automated_trading_active
FROM customer""")
view("today", "SELECT max(CAST(l_shipdate AS date)) AS d FROM lineitem")
view("elig", "SELECT * FROM universe WHERE market_cap >= 2e9 AND country = 'USA' AND security_type = 'Common Stock'")
view("elig_firms", "SELECT * FROM universe WHERE market_cap >= 2e9 AND country = 'USA' AND NOT is_etf")
view("elig_payers", "SELECT * FROM universe WHERE market_cap >= 2e9 AND security_type = 'Common Stock' AND NOT is_etf")
view("elig_listed", "SELECT * FROM universe WHERE market_cap >= 2e9 AND country = 'USA'")
view("last_price", "SELECT symbol, arg_max(close, trade_date) AS current_price FROM bars GROUP BY 1")
view("overview", """
SELECT u.symbol, market_cap / nullif(q.net_income * 4, 0) AS pe_ratio, market_cap * 20 / nullif(q.equity, 0) AS pb_ratio,
  market_cap * 4 / nullif(q.revenue, 0) AS ps_ratio, coalesce(p.paid, 0) / nullif(b.c, 0) * 1000 AS dividend_yield,
  q.net_income / nullif(q.revenue, 0) AS profit_margin, q.net_income * 4 / nullif(q.equity, 0) AS roe,
  (q.revenue / nullif(q.rev4, 0) - 1) * 100 AS revenue_growth,
  CASE WHEN q.ni4 > 0 THEN (q.net_income / q.ni4 - 1) * 100 END AS eps_growth,
  q.revenue / nullif(q.rev4, 0) - 1 AS quarterly_revenue_growth,
  CASE WHEN q.ni4 > 0 THEN q.net_income / q.ni4 - 1 END AS quarterly_earnings_growth,
  b.c * (1 + (u.symbol % 7) / 20) AS analyst_target_price, b.h AS high_52w
FROM universe u
JOIN (SELECT * FROM (SELECT *, lag(revenue, 4) OVER w AS rev4, lag(net_income, 4) OVER w AS ni4,
        row_number() OVER (PARTITION BY symbol ORDER BY fiscal_date DESC) AS rn
      FROM fundamentals_q WINDOW w AS (PARTITION BY symbol ORDER BY fiscal_date)) WHERE rn = 1) q ON u.symbol = q.symbol
JOIN (SELECT symbol, arg_max(close, trade_date) AS c, max(high) AS h FROM bars GROUP BY 1) b ON u.symbol = b.symbol
LEFT JOIN (SELECT symbol, sum(dividend) AS paid FROM dividends
           WHERE ex_date >= (SELECT max(ex_date) FROM dividends) - 365 GROUP BY 1) p ON u.symbol = p.symbol""")
view("momentum_bars", """
SELECT symbol, trade_date, close, close / nullif(lag(close, 126) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1 AS mom FROM bars""")
view("score_base", """
SELECT symbol, fiscal_date + 45 AS signal_date, net_income / nullif(revenue, 0) AS margin, free_cash_flow / nullif(revenue, 0) AS fcf,
  revenue / nullif(lag(revenue, 4) OVER (PARTITION BY symbol ORDER BY fiscal_date), 0) - 1 AS grown,
  net_income / nullif(shares, 0) AS eps, equity / nullif(shares, 0) AS book,
  CASE WHEN net_income > 0 THEN capex / net_income END AS payout_ratio
FROM fundamentals_q""")
view("score_parts", """
SELECT s.symbol, signal_date, greatest(0, least(100, 50 + margin * 300)) AS value_score,
  CASE WHEN grown IS NOT NULL THEN greatest(0, least(100, 50 + grown * 100)) END AS growth_score,
  greatest(0, least(100, 50 + fcf * 1000)) AS dividend_score,
  CASE WHEN mom IS NOT NULL THEN greatest(0, least(100, 50 + mom * 200)) END AS momentum_score,
  close / nullif(eps, 0) AS pe_ratio, close / nullif(book, 0) AS price_to_book, fcf * 100 AS dividend_yield, payout_ratio,
  grown * 100 AS revenue_growth, margin * 100 AS earnings_growth
FROM score_base s ASOF LEFT JOIN momentum_bars b ON s.symbol = b.symbol AND s.signal_date >= b.trade_date""")
view("score_history", """
SELECT *, (coalesce(value_score, 50) + coalesce(growth_score, 50) + coalesce(dividend_score, 50) + coalesce(momentum_score, 50)) / 4 AS composite_score,
  least(9, CAST(floor(coalesce(value_score, 50) / 10) AS int)) AS fscore
FROM score_parts""")
view("queue", """
SELECT symbol + 1000 AS signal_id, symbol, 'BUY' AS signal_type,
  CASE WHEN value_score >= growth_score AND value_score >= dividend_score THEN 'VALUE' WHEN growth_score >= dividend_score THEN 'GROWTH' ELSE 'DIVIDEND' END AS portfolio_type,
  greatest(value_score, growth_score, dividend_score) AS score, CAST(symbol % 12 AS double) AS target_weight_pct,
  CASE WHEN greatest(value_score, growth_score, dividend_score) > 80 THEN 'STRONG' ELSE 'MODERATE' END AS signal_strength,
  CASE WHEN symbol % 4 = 0 THEN NULL WHEN symbol % 5 = 0 THEN DATE '1990-01-01' ELSE DATE '2030-01-01' END AS expiration_date,
  symbol % 3 = 0 AS processed
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY signal_date DESC) AS rn FROM score_history)
WHERE rn = 1 AND growth_score IS NOT NULL""")
view("returns", """
SELECT * FROM (SELECT symbol, trade_date, close, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1 AS r FROM bars)
WHERE r IS NOT NULL""")
view("recent_bars", "SELECT b.* FROM bars b WHERE trade_date >= (SELECT d FROM today) - 2500")

# Fundamental scores.
view("fq_lag", """
SELECT *, lag(net_income, 4) OVER w AS p_ni, lag(revenue, 4) OVER w AS p_rev, lag(total_assets, 4) OVER w AS p_assets,
  lag(total_debt, 4) OVER w AS p_debt, lag(shares, 4) OVER w AS p_shares, lag(gross_profit, 4) OVER w AS p_gp,
  lag(total_liabilities, 4) OVER w AS p_liab, lag(cash, 4) OVER w AS p_cash, lag(capex, 4) OVER w AS p_capex,
  lag(operating_income, 4) OVER w AS p_oi, lag(total_assets) OVER w AS q_assets, lag(total_liabilities) OVER w AS q_liab,
  row_number() OVER (PARTITION BY symbol ORDER BY fiscal_date DESC) AS rn
FROM fundamentals_q WINDOW w AS (PARTITION BY symbol ORDER BY fiscal_date)""")
view("piotroski_flags", """
SELECT f.symbol, u.sector, f.fiscal_date AS calculation_date, net_income > 0 AS positive_net_income, operating_cash_flow > 0 AS positive_ocf,
  coalesce(net_income / total_assets > p_ni / p_assets, false) AS increasing_roa, operating_cash_flow > net_income AS quality_earnings,
  coalesce(total_debt / total_assets < p_debt / p_assets, false) AS decreasing_leverage,
  coalesce(total_assets / nullif(total_liabilities, 0) > q_assets / nullif(q_liab, 0), false) AS improving_liquidity,
  coalesce(shares <= p_shares * 1.02, false) AS no_dilution,
  coalesce(net_income / revenue > p_ni / p_rev, false) AS improving_margin,
  coalesce(revenue / total_assets > p_rev / p_assets, false) AS improving_efficiency,
  net_income / total_assets * 100 AS current_roa, p_ni / p_assets * 100 AS prior_roa, total_debt / total_assets AS current_debt_ratio,
  p_debt / p_assets AS prior_debt_ratio, total_assets / nullif(total_liabilities, 0) AS current_ratio,
  net_income / revenue * 100 AS current_margin, p_ni / p_rev * 100 AS prior_margin, revenue / total_assets AS current_turnover,
  p_rev / p_assets AS prior_turnover, p.current_price AS latest_price, p.current_price * shares AS price_market_cap
FROM fq_lag f JOIN elig_firms u ON f.symbol = u.symbol LEFT JOIN last_price p ON f.symbol = p.symbol WHERE rn = 1""")
view("piotroski", """
SELECT *, CASE WHEN fscore >= 7 THEN 'STRONG' WHEN fscore >= 4 THEN 'MODERATE' ELSE 'WEAK' END AS strength_category
FROM (SELECT *, positive_net_income::int + positive_ocf::int + increasing_roa::int + quality_earnings::int + decreasing_leverage::int
        + improving_liquidity::int + no_dilution::int + improving_margin::int + improving_efficiency::int AS fscore FROM piotroski_flags)""")
view("altman_parts", """
SELECT f.symbol, u.sector, fiscal_date AS calculation_date, (total_assets - total_liabilities - 0.5 * total_liabilities) / total_assets AS x1,
  equity * 0.3 / total_assets AS x2, operating_income / total_assets AS x3,
  CASE WHEN total_liabilities > 0 THEN market_cap / total_liabilities ELSE 10 END AS x4, revenue / total_assets AS x5,
  upper(u.sector) IN ('MANUFACTURING', 'INDUSTRIALS') AS is_manufacturing
FROM fq_lag f JOIN elig u ON f.symbol = u.symbol WHERE rn = 1 AND total_assets > 0""")
view("altman", """
SELECT symbol, sector, calculation_date, z_score, z_prime_score, x1 AS working_capital_ratio, x2 AS retained_earnings_ratio, x3 AS ebit_ratio,
  least(x4, 10) AS market_to_book_liability, x5 AS sales_to_assets, is_manufacturing,
  CASE WHEN is_manufacturing THEN CASE WHEN z_score > 2.99 THEN 'SAFE' WHEN z_score > 1.81 THEN 'GREY' ELSE 'DISTRESS' END
       WHEN z_prime_score > 2.6 THEN 'SAFE' WHEN z_prime_score > 1.1 THEN 'GREY' ELSE 'DISTRESS' END AS risk_category
FROM (SELECT *, 1.2*x1 + 1.4*x2 + 3.3*x3 + 0.6*x4 + x5 AS z_score, 6.56*x1 + 3.26*x2 + 6.72*x3 + 1.05*x4 AS z_prime_score FROM altman_parts)""")
view("beneish_parts", """
SELECT f.symbol, fiscal_date AS calculation_date, (revenue / total_assets) / (p_rev / p_assets) AS dsri,
  CASE WHEN gross_profit > 0 THEN (p_gp / p_rev) / (gross_profit / revenue) ELSE 1 END AS gmi,
  CASE WHEN p_assets - coalesce(p_cash, 0) > 0 THEN ((total_assets - cash) / total_assets) / ((p_assets - coalesce(p_cash, 0)) / p_assets) ELSE 1 END AS aqi,
  revenue / p_rev AS sgi,
  CASE WHEN capex <> 0 THEN (abs(coalesce(p_capex, 0)) / p_assets) / (abs(capex) / total_assets) ELSE 1 END AS depi,
  CASE WHEN 1 - coalesce(p_oi, operating_income) / p_rev > 0 THEN (1 - operating_income / revenue) / (1 - coalesce(p_oi, operating_income) / p_rev) ELSE 1 END AS sgai,
  CASE WHEN p_liab > 0 THEN (total_liabilities / total_assets) / (p_liab / p_assets) ELSE 1 END AS lvgi,
  (net_income - coalesce(operating_cash_flow, 0)) / total_assets AS tata
FROM fq_lag f JOIN elig u ON f.symbol = u.symbol WHERE rn = 1 AND total_assets > 0 AND p_rev > 0 AND revenue > 0 AND p_assets > 0""")
view("beneish", """
SELECT *, CASE WHEN m_score < -2.22 THEN 'LOW' WHEN m_score < -1.78 THEN 'MODERATE' ELSE 'HIGH' END AS manipulation_risk,
  m_score >= -1.78 AS risk_flag, greatest(0, least(100, 50 + (-2.22 - m_score) * 20)) AS quality_score, sgi - 1 AS revenue_growth
FROM (SELECT *, -4.84 + 0.92*dsri + 0.528*gmi + 0.404*aqi + 0.892*sgi + 0.115*depi - 0.172*sgai + 4.679*tata - 0.327*lvgi AS m_score FROM beneish_parts)""")
view("annual", """
SELECT symbol, year(fiscal_date) AS fiscal_year, max(fiscal_date) AS fiscal_date, count(*) AS quarters, sum(revenue) AS revenue,
  sum(net_income) AS net_income, sum(operating_cash_flow) AS operating_cash_flow, sum(free_cash_flow) AS free_cash_flow,
  sum(capex) AS capex, arg_max(shares, fiscal_date) AS shares, arg_max(total_assets, fiscal_date) AS total_assets
FROM fundamentals_q GROUP BY 1, 2""")
view("div_year", """
SELECT symbol, year(ex_date) AS year, sum(dividend) AS total_dividend, count(*) AS payment_count FROM dividends GROUP BY 1, 2""")
view("ecf_base", """
SELECT a.symbol, fiscal_year, fiscal_date, operating_cash_flow / shares AS cash_flow_per_share,
  (operating_cash_flow - free_cash_flow) / shares AS capex_per_share, coalesce(total_dividend, 0) AS dividends_per_share
FROM annual a LEFT JOIN div_year d ON a.symbol = d.symbol AND a.fiscal_year = d.year WHERE shares > 0""")
view("ecf_hist", """
SELECT *, count(excess_cash_flow_pct) OVER (PARTITION BY symbol ORDER BY fiscal_year DESC ROWS UNBOUNDED PRECEDING) AS point_no
FROM (SELECT *, cash_flow_per_share - dividends_per_share - capex_per_share AS excess_cash_flow,
        CASE WHEN cash_flow_per_share > 0 THEN (cash_flow_per_share - dividends_per_share - capex_per_share) / cash_flow_per_share * 100 END AS excess_cash_flow_pct,
        row_number() OVER (PARTITION BY symbol ORDER BY fiscal_year DESC) AS row_no FROM ecf_base)""")
view("ecf_fit", """
SELECT symbol, max(fiscal_date) AS latest_date, regr_slope(excess_cash_flow_pct, -point_no) FILTER (row_no <= 5) AS s5,
  regr_slope(excess_cash_flow_pct, -point_no) FILTER (row_no <= 10) AS s10, count(excess_cash_flow_pct) FILTER (row_no <= 5) AS n5,
  count(excess_cash_flow_pct) FILTER (row_no <= 10) AS n10, avg(excess_cash_flow_pct) FILTER (row_no <= 5) AS a5,
  avg(excess_cash_flow_pct) FILTER (row_no <= 10) AS a10, count(*) AS years
FROM ecf_hist GROUP BY 1""")
view("ecf", """
SELECT h.symbol, latest_date, cash_flow_per_share, dividends_per_share, capex_per_share, excess_cash_flow, excess_cash_flow_pct,
  CASE WHEN excess_cash_flow_pct IS NULL THEN 'Unknown' WHEN round(excess_cash_flow_pct, 9) >= 80 THEN 'Excellent' WHEN round(excess_cash_flow_pct, 9) >= 60 THEN 'Very Good'
    WHEN round(excess_cash_flow_pct, 9) >= 40 THEN 'Good' WHEN round(excess_cash_flow_pct, 9) >= 20 THEN 'Fair' WHEN round(excess_cash_flow_pct, 9) >= 0 THEN 'Poor' ELSE 'Warning' END AS quality_rating,
  CASE WHEN n5 < 3 THEN 'Insufficient Data' WHEN s5 > 2 THEN 'Advancing' WHEN s5 < -2 THEN 'Decreasing' ELSE 'Stable' END AS trend_5y,
  CASE WHEN n10 < 3 THEN 'Insufficient Data' WHEN s10 > 2 THEN 'Advancing' WHEN s10 < -2 THEN 'Decreasing' ELSE 'Stable' END AS trend_10y,
  CASE WHEN years >= 5 THEN a5 END AS avg_excess_cf_5y, CASE WHEN years >= 10 THEN a10 END AS avg_excess_cf_10y
FROM ecf_hist h JOIN ecf_fit f ON h.symbol = f.symbol WHERE row_no = 1 AND h.symbol IN (SELECT symbol FROM elig_payers)""")
view("div_change", """
SELECT *, total_dividend - prev_dividend AS dividend_change, (total_dividend - prev_dividend) / nullif(prev_dividend, 0) * 100 AS growth_rate,
  CASE WHEN round(total_dividend - prev_dividend, 9) > 0 THEN 1 WHEN round(total_dividend - prev_dividend, 9) = 0 THEN 0 ELSE -1 END AS direction,
  row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS rn, max(year) OVER (PARTITION BY symbol) AS newest
FROM (SELECT *, lag(total_dividend) OVER (PARTITION BY symbol ORDER BY year) AS prev_dividend FROM div_year)""")
view("streaks", """
SELECT symbol, count(*) FILTER (year = newest - rn + 1) AS payment_streak_years,
  coalesce(min(rn) FILTER (direction <> 1) - 1, count(*)) AS increase_streak_years, count(*) AS total_years_paying
FROM div_change GROUP BY 1""")
view("divq_base", """
SELECT s.*, g.avg_growth_rate_5y, g.avg_growth_rate_10y, g.volatility_5y, e.excess_cash_flow_pct, e.quality_rating AS cash_flow_quality,
  CASE WHEN a.net_income / a.shares > 0 THEN g.annual_dividend / (a.net_income / a.shares) * 100 END AS payout_ratio_earnings,
  CASE WHEN a.free_cash_flow / a.shares > 0 THEN g.annual_dividend / (a.free_cash_flow / a.shares) * 100 END AS payout_ratio_fcf
FROM streaks s JOIN (SELECT symbol, CASE WHEN count(*) >= 5 THEN avg(growth_rate) FILTER (rn <= 5) END AS avg_growth_rate_5y,
    CASE WHEN count(*) >= 10 THEN avg(growth_rate) FILTER (rn <= 10) END AS avg_growth_rate_10y,
    CASE WHEN count(*) >= 5 THEN stddev_samp(growth_rate) FILTER (rn <= 5) END AS volatility_5y,
    max(total_dividend) FILTER (rn = 1) AS annual_dividend FROM div_change GROUP BY 1) g ON s.symbol = g.symbol
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fiscal_date DESC) AS rn FROM annual) a ON s.symbol = a.symbol AND a.rn = 1
LEFT JOIN ecf e ON s.symbol = e.symbol
WHERE s.total_years_paying >= 5 AND s.symbol IN (SELECT symbol FROM elig_payers)""")
view("divq_score", """
SELECT *, CASE WHEN p IS NULL THEN NULL WHEN p < 0 THEN 0 WHEN p <= 40 THEN 90 + (40 - p) / 4 WHEN p <= 60 THEN 130 - p WHEN p <= 80 THEN 130 - p
    WHEN p <= 100 THEN 80 - p * 0.5 ELSE greatest(0, 60 - p * 0.3) END AS sustainability_score
FROM (SELECT *, round(coalesce(payout_ratio_fcf, payout_ratio_earnings), 9) AS p FROM divq_base)""")
view("divq", """
SELECT *, CASE WHEN sustainability_score IS NULL THEN 'Unknown' WHEN sustainability_score >= 80 THEN 'Very Safe' WHEN sustainability_score >= 60 THEN 'Safe'
    WHEN sustainability_score >= 40 THEN 'Moderate' WHEN sustainability_score >= 20 THEN 'Risky' ELSE 'Unsustainable' END AS safety_rating,
  CASE WHEN dividend_quality_score >= 80 THEN 'Dividend Aristocrat' WHEN dividend_quality_score >= 60 THEN 'High Quality'
    WHEN dividend_quality_score >= 40 THEN 'Good Quality' WHEN dividend_quality_score >= 20 THEN 'Fair Quality' ELSE 'Poor Quality' END AS dividend_quality_rating
FROM (SELECT *, (CASE WHEN payment_streak_years > 0 THEN least(100, payment_streak_years * 4) * 0.25 ELSE 0 END
    + CASE WHEN increase_streak_years > 0 THEN least(100, increase_streak_years * 5) * 0.2 ELSE 0 END + coalesce(sustainability_score * 0.3, 0)
    + CASE WHEN excess_cash_flow_pct IS NOT NULL THEN greatest(0, least(100, excess_cash_flow_pct)) * 0.25 ELSE 0 END)
  / nullif(CASE WHEN payment_streak_years > 0 THEN 0.25 ELSE 0 END + CASE WHEN increase_streak_years > 0 THEN 0.2 ELSE 0 END
    + CASE WHEN sustainability_score IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN excess_cash_flow_pct IS NOT NULL THEN 0.25 ELSE 0 END, 0) AS dividend_quality_score
  FROM divq_score)
WHERE dividend_quality_score IS NOT NULL""")
view("div_freq", """
SELECT symbol, count(gap) AS interval_count, avg(gap) AS avg_days_between, stddev_samp(gap) AS stddev_days,
  CASE WHEN avg(gap) IS NULL THEN 'SPECIAL' WHEN avg(gap) BETWEEN 25 AND 35 THEN 'MONTHLY' WHEN avg(gap) BETWEEN 80 AND 100 THEN 'QUARTERLY'
    WHEN avg(gap) BETWEEN 170 AND 195 THEN 'SEMI_ANNUAL' WHEN avg(gap) BETWEEN 350 AND 380 THEN 'ANNUAL' ELSE 'IRREGULAR' END AS frequency
FROM (SELECT symbol, ex_date, ex_date - lag(ex_date) OVER (PARTITION BY symbol ORDER BY ex_date) AS gap FROM dividends) GROUP BY 1""")

# Price-based scores.
view("framed", """
SELECT b.*, u.sector, avg(close) OVER w20 AS sma_20, avg(close) OVER w50 AS sma_50, avg(close) OVER w200 AS sma_200,
  volume / nullif(avg(volume) OVER w20, 0) AS volume_ratio, max(high) OVER wy AS high_52w, min(low) OVER wy AS low_52w,
  close - lag(close) OVER w AS step, row_number() OVER (PARTITION BY b.symbol ORDER BY trade_date DESC) AS rn,
  max(high) OVER w1 AS recent_high, min(low) OVER w1 AS recent_low
FROM bars b JOIN elig u ON b.symbol = u.symbol
WINDOW w AS (PARTITION BY b.symbol ORDER BY trade_date), w20 AS (PARTITION BY b.symbol ORDER BY trade_date ROWS 19 PRECEDING),
  w50 AS (PARTITION BY b.symbol ORDER BY trade_date ROWS 49 PRECEDING), w200 AS (PARTITION BY b.symbol ORDER BY trade_date ROWS 199 PRECEDING),
  wy AS (PARTITION BY b.symbol ORDER BY trade_date ROWS 251 PRECEDING),
  w1 AS (PARTITION BY b.symbol ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
view("breakout_facts", """
SELECT symbol, arg_max(close, trade_date) AS close, arg_max(high_52w, trade_date) AS high_52w, arg_max(sma_50, trade_date) AS sma_50,
  arg_max(sma_200, trade_date) AS sma_200, arg_max(volume_ratio, trade_date) AS volume_ratio,
  stddev_samp(close) FILTER (trade_date >= d - 450) / avg(close) FILTER (trade_date >= d - 450) AS base_volatility,
  count(*) FILTER (step > 0 AND trade_date >= d - 50) AS up_days,
  sum(sign(step) * volume) FILTER (trade_date >= d - 100) / nullif(sum(abs(sign(step) * volume)) FILTER (trade_date >= d - 100), 0) AS accumulation_ratio,
  arg_max(close, trade_date) / arg_max(close, trade_date) FILTER (trade_date <= d - 100)
    - (SELECT arg_max(close, trade_date) / arg_max(close, trade_date) FILTER (trade_date <= (SELECT d FROM today) - 100) FROM bench) AS relative_strength
FROM framed, today GROUP BY symbol, d HAVING max(trade_date) >= d - 365""")
view("breakout_parts", """
SELECT *, CASE WHEN pct >= 0.98 THEN 100 WHEN pct >= 0.95 THEN 80 WHEN pct >= 0.90 THEN 60 ELSE greatest(0, pct * 100 - 40) END AS proximity,
  CASE WHEN volume_ratio >= 2 THEN 100 WHEN volume_ratio >= 1.5 THEN 80 WHEN volume_ratio >= 1.2 THEN 60 ELSE volume_ratio * 50 END AS volume,
  CASE WHEN base_volatility <= 0.15 THEN 100 WHEN base_volatility <= 0.25 THEN 80 WHEN base_volatility <= 0.35 THEN 60
    WHEN base_volatility IS NULL THEN 0 ELSE greatest(0, 100 - base_volatility * 200) END AS base_quality,
  least(100, up_days * 15) AS momentum_score, coalesce(50 + accumulation_ratio * 50, 50) AS accumulation,
  50 + CASE WHEN relative_strength IS NULL THEN 0 ELSE least(50, greatest(-50, relative_strength * 500)) END AS relative_strength_score
FROM (SELECT *, close / nullif(high_52w, 0) AS pct FROM breakout_facts WHERE symbol IN (SELECT symbol FROM elig WHERE NOT is_etf))""")
view("breakout", """
SELECT *, CASE WHEN breakout_score <= 40 THEN 'Weak' WHEN breakout_score <= 60 THEN 'Moderate' WHEN breakout_score <= 80 THEN 'Strong' ELSE 'Very Strong' END AS breakout_strength
FROM (SELECT symbol, round(proximity*0.25 + volume*0.25 + base_quality*0.15 + momentum_score*0.15 + accumulation*0.1 + relative_strength_score*0.1, 2) AS breakout_score,
    pct >= 0.98 AND volume_ratio >= 1.5 AND pct <= 1.10 AND close > sma_50 AND close > sma_200 AS has_breakout, close AS current_price, high_52w,
    volume_ratio AS volume_surge, proximity, volume, base_quality, momentum_score, accumulation, relative_strength_score, relative_strength, accumulation_ratio
  FROM breakout_parts) WHERE breakout_score > 0""")
view("rsi_recent", """
SELECT *, avg(greatest(chg, 0)) OVER w AS gain, avg(greatest(-chg, 0)) OVER w AS loss, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS k,
  count(*) OVER (PARTITION BY symbol) AS n
FROM (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), 0) AS chg FROM framed WHERE rn <= 60)
WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS 13 PRECEDING)""")
view("tech_flags", """
SELECT symbol, sector, trade_date AS signal_date, close AS latest_price, close / high_52w AS price_vs_52w_high, close / low_52w AS price_vs_52w_low,
  close > sma_20 AS above_sma_20, close > sma_50 AS above_sma_50, close > sma_200 AS above_sma_200, volume_ratio, volume_ratio > 1.5 AS volume_surge,
  close / high_52w >= 0.98 AS near_52w_high, close / high_52w >= 1 AS new_52w_high,
  recent_high > recent_low AND (recent_high - recent_low) / recent_high < 0.15 AND close > recent_high AS base_breakout,
  CASE WHEN k >= 14 THEN 100 * gain / nullif(gain + loss, 0) END AS rsi, sma_20 > sma_50 AS rising
FROM rsi_recent WHERE rn = 1 AND n >= 20""")
view("tech_parts", """
SELECT *, coalesce(rsi > 70, false) AS momentum_surge,
  CAST(CASE WHEN new_52w_high THEN 30 WHEN near_52w_high THEN 20 ELSE 0 END + CASE WHEN volume_surge THEN CASE WHEN volume_ratio > 2 THEN 25 ELSE 15 END ELSE 0 END
   + above_sma_20::int * 5 + above_sma_50::int * 7 + above_sma_200::int * 8 + base_breakout::int * 15 + coalesce(rsi > 70, false)::int * 10 AS double) AS breakout_strength,
  CASE WHEN volume_ratio > 1 THEN least(100, volume_ratio * 25) ELSE volume_ratio * 50 END AS volume_strength,
  CAST(above_sma_200::int * 40 + above_sma_50::int * 30 + above_sma_20::int * 20 + rising::int * 10 AS double) AS trend_strength
FROM tech_flags""")
view("tech", """
SELECT *, CASE WHEN composite_score >= 80 THEN 'STRONG' WHEN composite_score >= 60 THEN 'MODERATE' WHEN composite_score >= 40 THEN 'WEAK' ELSE 'NONE' END AS signal_strength
FROM (SELECT *, breakout_strength * 0.4 + volume_strength * 0.3 + trend_strength * 0.3 AS composite_score FROM tech_parts)""")
view("risk_rows", """
SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1 AS dd, quantile_cont(r, 0.05) OVER (PARTITION BY symbol) AS q
FROM (SELECT b.symbol, u.sector, b.trade_date, b.close, b.close / lag(b.close) OVER w - 1 AS r, m.close / lag(m.close) OVER w - 1 AS mr
      FROM recent_bars b JOIN elig u ON b.symbol = u.symbol LEFT JOIN bench m ON b.trade_date = m.trade_date
      WINDOW w AS (PARTITION BY b.symbol ORDER BY b.trade_date)) WHERE r IS NOT NULL""")
view("risk_stats", """
SELECT symbol, sector, max(trade_date) AS calculation_date, avg(r) * 252 AS annual_return, stddev_samp(r) * sqrt(252) AS annual_volatility,
  skewness(r) AS skewness, kurtosis(r) AS kurtosis, (avg(r) - 0.03 / 252) / nullif(stddev_samp(r), 0) * sqrt(252) AS sharpe_ratio,
  (avg(r) - 0.03 / 252) * 252 / nullif(stddev_samp(r) FILTER (r < 0) * sqrt(252), 0) AS sortino_ratio, covar_samp(r, mr) / nullif(var_samp(mr), 0) AS beta,
  min(dd) AS max_drawdown, max(q) AS var_95, avg(r) FILTER (r <= q) AS cvar_95, count(*) AS trading_days, count(*) FILTER (r > 0) AS positive_days,
  count(*) FILTER (r < 0) AS negative_days, count(*) FILTER (r > 0) / count(*) AS win_rate
FROM risk_rows GROUP BY 1, 2 HAVING count(*) >= 20""")
view("risk", """
SELECT *, greatest(0, least(100, 50 + CASE WHEN sharpe_ratio > 0 THEN least(25, sharpe_ratio * 10) ELSE 0 END
    + CASE WHEN annual_volatility < 0.2 THEN 10 WHEN annual_volatility > 0.4 THEN -10 ELSE 0 END
    + CASE WHEN max_drawdown = 0 THEN 0 WHEN max_drawdown > -0.1 THEN 10 WHEN max_drawdown < -0.3 THEN -15 ELSE 0 END
    + CASE WHEN win_rate > 0.55 THEN 5 WHEN win_rate < 0.45 THEN -5 ELSE 0 END)) AS risk_adjusted_score,
  CASE WHEN annual_volatility < 0.15 THEN 'LOW' WHEN annual_volatility < 0.25 THEN 'MODERATE' WHEN annual_volatility < 0.35 THEN 'HIGH' ELSE 'VERY_HIGH' END AS risk_category
FROM risk_stats""")
view("insider_facts", """
SELECT symbol, count(*) FILTER (b AND m) AS buys_30d, count(*) FILTER (NOT b AND m) AS sells_30d, coalesce(sum(total_value) FILTER (b AND m), 0) AS buy_value_30d,
  coalesce(sum(total_value) FILTER (NOT b AND m), 0) AS sell_value_30d, count(*) FILTER (b AND s) AS buys_90d, count(*) FILTER (NOT b AND s) AS sells_90d,
  bool_or(is_ceo AND b AND s) AS ceo_buying, bool_or(is_cfo AND b AND s) AS cfo_buying, count(*) FILTER (is_officer AND b AND m) >= 3 AS officer_cluster_buying,
  coalesce(sum(CASE WHEN b THEN total_value ELSE -total_value END) FILTER (m), 0) AS net_insider_buying_30d
FROM (SELECT *, transaction_type = 'BUY' AS b, transaction_date > mx - 30 AS m, transaction_date > mx - 90 AS s
      FROM insider, (SELECT max(transaction_date) AS mx FROM insider)) GROUP BY 1""")
view("insider_sig", """
SELECT *, greatest(0, least(100, 50 + ceo_buying::int * 20 + cfo_buying::int * 15 + officer_cluster_buying::int * 15
  + CASE WHEN buys_30d + sells_30d > 0 THEN (buys_30d / (buys_30d + sells_30d) - 0.5) * 20 ELSE 0 END
  + CASE WHEN net_insider_buying_30d > 1000000 THEN 10 WHEN net_insider_buying_30d < -1000000 THEN -10 ELSE 0 END)) AS insider_score FROM insider_facts""")
view("inst_sig", """
SELECT *, CASE WHEN quarter_change_pct > 10 AND num_holders > 100 THEN 'STRONG_BUY' WHEN quarter_change_pct > 5 THEN 'BUY' WHEN quarter_change_pct < -10 THEN 'SELL'
    WHEN quarter_change_pct < -5 THEN 'WEAK' ELSE 'NEUTRAL' END AS smart_money_signal, greatest(0, least(100, 50 + quarter_change_pct * 2)) AS momentum_score,
  quarter_change_pct > 20 AS heavy_accumulation, quarter_change_pct > 5 AND quarter_change_pct <= 20 AS moderate_accumulation, quarter_change_pct < -5 AS distribution
FROM (SELECT *, coalesce(round((total_shares / nullif(prev, 0) - 1) * 100, 9), 0) AS quarter_change_pct, coalesce(total_shares - prev, 0) AS net_institutional_flow
      FROM (SELECT *, lag(total_shares) OVER (PARTITION BY symbol ORDER BY report_date) AS prev FROM institutional))""")
view("inst_last", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY report_date DESC) AS rn FROM inst_sig) WHERE rn = 1""")
view("signals", """
SELECT u.symbol, u.name, u.sector, u.industry, u.market_cap / 1e9 AS market_cap_b, o.pe_ratio, o.pb_ratio, o.ps_ratio, o.dividend_yield, o.profit_margin, o.roe,
  o.revenue_growth, o.eps_growth, coalesce(i.insider_score, 50) AS insider_score, i.ceo_buying, i.cfo_buying, i.officer_cluster_buying, p.fscore,
  p.strength_category AS fundamental_strength, a.z_score, a.risk_category AS bankruptcy_risk, n.quarter_change_pct AS institutional_change, n.smart_money_signal,
  r.sharpe_ratio, r.annual_volatility, r.max_drawdown, r.risk_category AS volatility_level, t.composite_score AS breakout_score,
  CASE WHEN o.analyst_target_price > 0 AND o.high_52w > 0 THEN (o.analyst_target_price / o.high_52w - 1) * 100 ELSE 0 END AS analyst_upside
FROM elig u JOIN piotroski p ON u.symbol = p.symbol LEFT JOIN overview o ON u.symbol = o.symbol LEFT JOIN insider_sig i ON u.symbol = i.symbol
LEFT JOIN altman a ON u.symbol = a.symbol LEFT JOIN inst_last n ON u.symbol = n.symbol LEFT JOIN risk r ON u.symbol = r.symbol LEFT JOIN tech t ON u.symbol = t.symbol""")
view("type_scores", """
SELECT *, least(100, CASE WHEN pe_ratio <= 0 OR pe_ratio IS NULL THEN 0 WHEN pe_ratio < 10 THEN 12 WHEN pe_ratio < 15 THEN 8 WHEN pe_ratio < 20 THEN 4 ELSE 0 END
    + CASE WHEN pb_ratio <= 0 OR pb_ratio IS NULL THEN 0 WHEN pb_ratio < 1 THEN 12 WHEN pb_ratio < 1.5 THEN 8 WHEN pb_ratio < 2 THEN 4 ELSE 0 END
    + CASE WHEN ps_ratio <= 0 OR ps_ratio IS NULL THEN 0 WHEN ps_ratio < 1 THEN 11 WHEN ps_ratio < 2 THEN 7 WHEN ps_ratio < 3 THEN 3 ELSE 0 END
    + coalesce(fscore / 9 * 30, 0) + CASE bankruptcy_risk WHEN 'SAFE' THEN 20 WHEN 'GREY' THEN 10 ELSE 0 END + coalesce(insider_score / 10, 0)
    + coalesce(breakout_score / 20, 0)) AS value_score,
  least(100, CASE WHEN revenue_growth > 10 THEN 15 WHEN revenue_growth > 5 THEN 8 ELSE 0 END + CASE WHEN eps_growth > 15 THEN 15 WHEN eps_growth > 10 THEN 8 ELSE 0 END
    + coalesce(breakout_score / 4, 0) + CASE WHEN smart_money_signal = 'STRONG_BUY' THEN 20 WHEN smart_money_signal = 'BUY' THEN 15 WHEN institutional_change > 5 THEN 10 ELSE 0 END
    + coalesce(fscore / 9 * 15, 0) + CASE WHEN sharpe_ratio > 1 THEN 10 WHEN sharpe_ratio > 0.5 THEN 5 ELSE 0 END) AS growth_score,
  least(100, CASE WHEN dividend_yield > 4 THEN 30 WHEN dividend_yield > 3 THEN 25 WHEN dividend_yield > 2 THEN 20 WHEN dividend_yield > 1 THEN 10 ELSE 0 END
    + CASE bankruptcy_risk WHEN 'SAFE' THEN 30 WHEN 'GREY' THEN 15 ELSE 0 END + CASE WHEN fscore >= 7 THEN 20 WHEN fscore >= 5 THEN 12 WHEN fscore >= 3 THEN 6 ELSE 0 END
    + CASE volatility_level WHEN 'LOW' THEN 10 WHEN 'MODERATE' THEN 5 ELSE 0 END + CASE WHEN profit_margin > 0.1 THEN 10 WHEN profit_margin > 0.05 THEN 5 ELSE 0 END) AS dividend_score
FROM signals""")
view("master_base", """
SELECT *, (coalesce(fscore / 9 * 50, 0) + CASE bankruptcy_risk WHEN 'SAFE' THEN 50 WHEN 'GREY' THEN 25 ELSE 0 END) * 0.25 + coalesce(insider_score, 0) * 0.15
  + CASE smart_money_signal WHEN 'STRONG_BUY' THEN 100 WHEN 'BUY' THEN 75 WHEN 'SELL' THEN 25 ELSE 50 END * 0.15 + coalesce(breakout_score, 0) * 0.15
  + CASE WHEN pe_ratio IS NULL OR pe_ratio <= 0 THEN 50 WHEN pe_ratio < 15 THEN 80 WHEN pe_ratio < 25 THEN 60 WHEN pe_ratio > 40 THEN 20 ELSE 50 END * 0.15
  + CASE WHEN sharpe_ratio > 1 THEN 80 WHEN sharpe_ratio > 0.5 THEN 60 WHEN sharpe_ratio < 0 THEN 20 ELSE 50 END * 0.15 AS composite_score FROM type_scores""")
view("master", """
SELECT *, CASE WHEN round(value_score, 9) >= round(growth_score, 9) AND round(value_score, 9) >= round(dividend_score, 9) THEN 'VALUE'
    WHEN round(growth_score, 9) >= round(dividend_score, 9) THEN 'GROWTH' ELSE 'DIVIDEND' END AS best_portfolio,
  CASE WHEN round(composite_score, 9) >= 80 THEN 'A+' WHEN round(composite_score, 9) >= 70 THEN 'A' WHEN round(composite_score, 9) >= 60 THEN 'B+'
    WHEN round(composite_score, 9) >= 50 THEN 'B' WHEN round(composite_score, 9) >= 40 THEN 'C' ELSE 'D' END AS investment_grade
FROM master_base""")
view("comprehensive", """
SELECT u.symbol, u.name, u.sector, p.fscore, p.strength_category, a.z_score, a.z_prime_score, a.risk_category AS bankruptcy_risk, i.insider_score, i.ceo_buying,
  o.pe_ratio, o.dividend_yield, o.profit_margin, o.roe, coalesce(i.insider_score, 50) * 0.25 + p.fscore * 11.11 * 0.35
    + CASE a.risk_category WHEN 'SAFE' THEN 40.0 WHEN 'GREY' THEN 20.0 ELSE 0.0 END AS composite_score
FROM elig u JOIN piotroski p ON u.symbol = p.symbol JOIN altman a ON u.symbol = a.symbol LEFT JOIN insider_sig i ON u.symbol = i.symbol LEFT JOIN overview o ON u.symbol = o.symbol""")
view("win_loss", """
SELECT b.symbol, count(*) AS total_trades, count(*) FILTER (r > 0) AS winning_trades, avg(r) FILTER (r > 0) AS avg_win, avg(abs(r)) FILTER (r <= 0) AS avg_loss,
  avg(r) AS mean_return, stddev_samp(r) AS std_dev, max(r) AS max_return, min(r) AS min_return
FROM (SELECT symbol, trade_date, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS r FROM recent_bars) b JOIN elig u ON b.symbol = u.symbol
WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) >= 60""")
view("kelly_raw", """
SELECT w.*, s.value_score, s.growth_score, s.dividend_score, s.composite_score, winning_trades / total_trades AS p, coalesce(avg_win / nullif(avg_loss, 0), 0) AS o,
  mean_return - 0.03 / 252 AS excess,
  CASE WHEN s.composite_score IS NULL THEN 1.0 WHEN round(s.composite_score, 9) >= 80 THEN 1.2 WHEN round(s.composite_score, 9) >= 60 THEN 1.0 WHEN round(s.composite_score, 9) >= 40 THEN 0.8 ELSE 0.5 END AS quality_multiplier
FROM win_loss w LEFT JOIN master s ON w.symbol = s.symbol""")
view("kelly_sized", """
SELECT *, least(0.1, adjusted) AS final FROM (SELECT *, greatest(0, least(0.25, least(sk, ck))) * quality_multiplier AS adjusted
  FROM (SELECT *, CASE WHEN o > 0 THEN (p * o - (1 - p)) / o ELSE 0 END AS sk, coalesce(excess / nullif(std_dev * std_dev, 0), 0) AS ck FROM kelly_raw))""")
view("kelly", """
SELECT symbol, total_trades, winning_trades, round(p, 4) AS win_probability, round(coalesce(avg_win * 100, 0), 4) AS avg_win_pct, round(coalesce(avg_loss * 100, 0), 4) AS avg_loss_pct,
  round(o, 4) AS win_loss_ratio, round(sk, 4) AS standard_kelly, round(ck, 4) AS continuous_kelly, round(least(sk, ck) * 100, 2) AS raw_kelly_pct,
  round(adjusted * 100, 2) AS adjusted_kelly_pct, round(final * 100, 2) AS final_position_pct, round(std_dev, 6) AS daily_volatility,
  round(std_dev * sqrt(252), 4) AS annual_volatility, round(coalesce(excess / nullif(std_dev, 0), 0) * sqrt(252), 4) AS sharpe_ratio,
  CASE WHEN composite_score <> 0 THEN composite_score ELSE 50 END AS quality_score, quality_multiplier, value_score, growth_score, dividend_score, composite_score,
  CASE WHEN round(final, 9) >= 0.08 THEN 'FULL' WHEN round(final, 9) >= 0.05 THEN 'LARGE' WHEN round(final, 9) >= 0.03 THEN 'MEDIUM' WHEN round(final, 9) >= 0.01 THEN 'SMALL'
    WHEN final > 0 THEN 'MINIMAL' ELSE 'NONE' END AS position_category
FROM kelly_sized""")
