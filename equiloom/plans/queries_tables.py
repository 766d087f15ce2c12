"""Registered source, sink, filter, join, aggregate and scalar queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from equiloom import schemas
from equiloom.functions.expressions import change, iso_date, number, ratio
from equiloom.functions.frames import within
from equiloom.operators import aggregates, filters, fundamental, joins, learning, series, technical
from equiloom.operators.fundamental import FSCORE_FLAGS
from equiloom.plans import payload_fixtures as pf
from equiloom.plans.registry import add, view
from equiloom.session import scratch
from equiloom.sources import maintenance, payloads, tables
from equiloom.streaming import ingest

CUT = "DATE '1999-06-30'"


def _cut():
    return F.lit("1999-06-30").cast("date")


# Sources and sinks.
add("k00_read_table", "l_orderkey l_suppkey l_quantity l_extendedprice l_shipdate", lambda v: v.table("lineitem"), "SELECT * FROM lineitem")


def merged(v) -> DataFrame:
    old = v.bars.where(F.col("trade_date") <= _cut())
    new = v.bars.where(F.col("trade_date") > F.date_sub(_cut(), 30)).withColumn("close", F.col("close") * 1.01)
    return maintenance.merge_latest(old, new.unionByName(new), schemas.KEYS["prices"], ["close"])


add("k01_merge_latest", "symbol trade_date close*", merged, f"SELECT symbol, trade_date, CASE WHEN trade_date > {CUT} - 30 THEN close * 1.01 ELSE close END AS close FROM bars")


def stamped(v) -> DataFrame:
    """The overlap of 30 days comes again, every third row with another close, and later days are new."""
    old = v.bars.where(F.col("trade_date") <= _cut()).select("symbol", "trade_date", "close", "volume", F.to_timestamp(F.lit("1999-07-01 00:00:00")).alias("updated_at"))
    close = F.when(F.col("volume") % 3 == 0, F.col("close") * 1.01).otherwise(F.col("close"))
    new = v.bars.where(F.col("trade_date") > F.date_sub(_cut(), 30)).select("symbol", "trade_date", close.alias("close"), "volume")
    rows = maintenance.merge_stamped(old, new, schemas.KEYS["prices"], ["close"], "updated_at", F.to_timestamp(F.lit("1999-08-01 00:00:00")))
    return rows.withColumn("updated_on", F.to_date("updated_at"))


add("k01_updated_at", "symbol trade_date close* volume updated_on", stamped, f"""
SELECT symbol, trade_date, CASE WHEN trade_date > {CUT} - 30 AND volume % 3 = 0 THEN close * 1.01 ELSE close END AS close, volume,
  CASE WHEN trade_date > {CUT} OR (trade_date > {CUT} - 30 AND volume % 3 = 0) THEN DATE '1999-08-01' ELSE DATE '1999-07-01' END AS updated_on FROM bars""")
add("k02_update_from", "symbol ex_date dividend* frequency", lambda v: fundamental.apply_frequency(v.dividends.withColumn("frequency", F.lit(None).cast("string")), v.dividends),
    "SELECT d.symbol, ex_date, dividend, frequency FROM dividends d JOIN div_freq f ON d.symbol = f.symbol")


def written(v) -> DataFrame:
    path, late = scratch(v.spark, "dividends"), F.col("ex_date") > _cut()
    table = tables.for_sink(v.dividends.withColumn("year", F.year("ex_date")), {"dividend": schemas.PRICE})
    tables.replace_table(table.where(late), path, "year")
    tables.replace_table(table.where(~late), path, "year")
    return tables.append_table(table.where(late), path, "year").select("symbol", "ex_date", F.col("dividend").cast("double").alias("dividend"), "year")


add("k03_sinks", "symbol ex_date dividend year", written, "SELECT symbol, ex_date, round(dividend, 4) AS dividend, year(ex_date) AS year FROM dividends")


def listed(v) -> DataFrame:
    path = scratch(v.spark, "listing")
    pf.listing(v).write.option("header", True).csv(path)
    return tables.read_listing_csv(v.spark, path)


view("listing", """
SELECT 'S' || symbol || 'X' || CASE symbol % 7 WHEN 0 THEN '.PRA' WHEN 1 THEN '.WS' WHEN 2 THEN '-PB' WHEN 3 THEN '12345' ELSE '' END AS symbol,
  CASE symbol % 3 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'NASDAQ' ELSE 'OTC' END AS exchange, CASE WHEN symbol % 11 = 0 THEN 'ETF' ELSE 'Stock' END AS assetType,
  CASE WHEN symbol % 13 = 0 THEN 'Delisted' ELSE 'Active' END AS status FROM universe""")
add("k04_listing_csv", "symbol exchange assetType status", listed, "SELECT * FROM listing")
add("k05_price_payload", "symbol trade_date open* high* low* close* adjusted_close* volume dividend_amount* split_coefficient",
    lambda v: payloads.explode_price_payload(pf.price_payloads(v)), "SELECT *, close * 0.5 AS adjusted_close, 1.0 AS split_coefficient FROM bars")
add("k06_benchmark_payload", "symbol trade_date close* adjusted_close*", lambda v: payloads.explode_benchmark_payload(pf.benchmark_payloads(v)),
    "SELECT 'INDEX' AS symbol, trade_date, close, CASE WHEN day(trade_date) % 4 = 2 THEN close * 1.1 ELSE close END AS adjusted_close FROM bench")
STATEMENT = ("symbol fiscal_date period_type revenue$ ebitda_margin* total_debt_share* eps* book_value_per_share* current_ratio* quick_ratio* fcf_margin* debt_to_equity* gross_margin* "
             "operating_margin* net_margin* return_on_equity* return_on_assets*")


def statements(v) -> DataFrame:
    rows = payloads.combine_statements(pf.statement_payloads(v))
    return rows.withColumns({"ebitda_margin": ratio(F.col("ebitda"), F.col("revenue")), "fcf_margin": ratio(F.col("free_cash_flow"), F.col("revenue")),
                             "total_debt_share": ratio(F.col("total_debt"), F.col("total_assets"))})


view("statement_base", """
SELECT *, month(fiscal_date) <> 7 AS b, CASE WHEN month(fiscal_date) <> 7 THEN CASE WHEN symbol % 2 = 0 THEN total_debt * 0.75 ELSE total_debt / 2 END END AS debt,
  CASE WHEN symbol % 3 <> 0 THEN free_cash_flow ELSE operating_cash_flow - abs(capex) END AS fcf FROM fundamentals_q""")
add("k07_combine_statements", STATEMENT, statements, """
SELECT symbol, fiscal_date, 'quarterly' AS period_type, revenue, (operating_income + (gross_profit - operating_income) * 0.1) / revenue AS ebitda_margin,
  CASE WHEN debt > 0 THEN debt / total_assets END AS total_debt_share, CASE WHEN b THEN net_income / shares END AS eps, CASE WHEN b THEN equity / shares END AS book_value_per_share,
  CASE WHEN b AND total_liabilities > 0 THEN (total_assets / 3) / (total_liabilities / 4) END AS current_ratio,
  CASE WHEN b AND total_liabilities > 0 THEN (total_assets / 3) / (total_liabilities / 4) * 0.85 END AS quick_ratio, fcf / revenue AS fcf_margin,
  CASE WHEN debt > 0 AND equity > 0 THEN debt / equity END AS debt_to_equity, gross_profit / revenue * 100 AS gross_margin, operating_income / revenue * 100 AS operating_margin,
  net_income / revenue * 100 AS net_margin, CASE WHEN b AND equity > 0 THEN net_income * 4 / equity * 100 END AS return_on_equity, CASE WHEN b THEN net_income * 4 / total_assets * 100 END AS return_on_assets
FROM statement_base""")
add("k08_parse_overview", "symbol sector industry description_sha256 market_cap$ pe_ratio* price_to_book* dividend_yield* profit_margin* quarterly_earnings_growth* shares_outstanding high_52w* latest_quarter",
    lambda v: payloads.parse_overview(pf.overview_payloads(v)).withColumn("description_sha256", F.sha2("description", 256)), """
SELECT o.symbol, sector, industry, sha256(repeat(name, 80)) AS description_sha256, market_cap, CASE WHEN pe_ratio > 0 THEN pe_ratio END AS pe_ratio, pb_ratio AS price_to_book, dividend_yield,
  CASE WHEN o.symbol % 5 <> 0 THEN profit_margin END AS profit_margin, quarterly_earnings_growth, o.symbol * 1234567 AS shares_outstanding, high_52w,
  CASE WHEN o.symbol % 4 <> 0 THEN DATE '2001-09-30' END AS latest_quarter FROM overview o JOIN universe u ON o.symbol = u.symbol""")
add("k09_parse_insider", "symbol transaction_date owner_name owner_title transaction_type shares price_per_share total_value is_ceo is_cfo is_director is_officer",
    lambda v: payloads.parse_insider(pf.insider_payloads(v)), """
SELECT symbol, transaction_date, 'Owner ' || (event_id % 50) AS owner_name, title AS owner_title, transaction_type, shares, CASE WHEN t <> 4 THEN t + 1.0 END AS price_per_share,
  CASE WHEN t <> 4 THEN shares * (t + 1.0) ELSE 0 END AS total_value, is_ceo, is_cfo, title = 'DIRECTOR' AS is_director, is_ceo OR is_cfo OR title LIKE '%OFFICER%' AS is_officer
FROM (SELECT *, event_id % 6 AS t, CASE WHEN event_id % 6 = 5 THEN 0 ELSE floor(total_value) END AS shares, CASE WHEN is_ceo THEN 'CHIEF EXECUTIVE OFFICER' WHEN is_cfo THEN 'CFO'
  WHEN event_id % 6 = 0 THEN 'DIRECTOR' WHEN is_officer THEN 'OFFICER, SALES' ELSE '10% OWNER' END AS title FROM insider)""")
view("estimates", """
SELECT symbol, fiscal_date AS fiscal_period, p AS period_type, net_income / shares * s AS eps_consensus, net_income / shares * s * 1.2 AS eps_high, net_income / shares * s * 0.8 AS eps_low,
  CAST(symbol % 9 AS int) AS eps_num_estimates, CASE WHEN symbol % 2 = 0 THEN revenue * s END AS revenue_consensus, net_income / shares AS reported_eps, fiscal_date + 30 AS reported_date,
  net_income / shares * (s - 1) AS surprise_amount, (symbol % 20 - 10) / 4 AS surprise_percentage
FROM fundamentals_q, (VALUES ('quarterly', 1.5), ('annual', 4.0)) k(p, s) WHERE p = 'quarterly' OR month(fiscal_date) = 10""")
add("k10_parse_estimates", "symbol fiscal_period period_type eps_consensus* eps_high* eps_low* eps_num_estimates revenue_consensus$ reported_eps* reported_date surprise_amount* surprise_percentage",
    lambda v: payloads.parse_estimates(pf.estimate_payloads(v)), "SELECT * FROM estimates")


def stored(v) -> DataFrame:
    """What an earlier load left: a different last day per symbol, and some symbols missing."""
    return v.bars.where((F.col("symbol") % 10 != 0) & (F.col("trade_date") <= F.date_add(_cut(), (F.col("symbol") % 100).cast("int"))))


add("k11_incremental_new_rows", "symbol trade_date close*", lambda v: maintenance.incremental_new_rows(v.bars, stored(v), "symbol", "trade_date"),
    f"SELECT symbol, trade_date, close FROM bars WHERE symbol % 10 = 0 OR trade_date > {CUT} + CAST(symbol % 100 AS int)")
add("k11_incremental_global", "symbol trade_date close*", lambda v: maintenance.incremental_new_rows(v.bars, stored(v), None, "trade_date"), f"""
SELECT symbol, trade_date, close FROM bars WHERE trade_date > (SELECT max(trade_date) FROM bars WHERE symbol % 10 <> 0 AND trade_date <= {CUT} + CAST(symbol % 100 AS int))""")
DIVIDEND_ROW = "symbol ex_date payment_date record_date declaration_date dividend* adjusted_dividend* currency frequency"
view("paid", """
SELECT symbol, trade_date AS ex_date, trade_date + 14 AS payment_date, trade_date + 2 AS record_date, trade_date - 21 AS declaration_date, dividend_amount AS dividend,
  dividend_amount AS adjusted_dividend, 'USD' AS currency, CASE WHEN round(dividend_amount, 9) < 0.5 THEN 'QUARTERLY' WHEN round(dividend_amount, 9) < 1 THEN 'SEMI_ANNUAL' ELSE 'ANNUAL' END AS frequency
FROM bars WHERE dividend_amount > 0""")
add("k12_dividends_from_prices", DIVIDEND_ROW, lambda v: maintenance.dividends_from_prices(v.bars, v.universe), "SELECT * FROM paid")


def with_gaps(v) -> DataFrame:
    odd = F.dayofmonth("ex_date") % 2 == 1
    full = maintenance.dividends_from_prices(v.bars, v.universe)
    return full.withColumns({c: F.when(~odd, F.col(c)) for c in ("payment_date", "record_date", "declaration_date", "adjusted_dividend")})


add("k13_fill_dividend_dates", DIVIDEND_ROW, lambda v: maintenance.fill_dividend_dates(with_gaps(v)), """
SELECT * REPLACE (CASE WHEN day(ex_date) % 2 = 1 THEN ex_date + 21 ELSE payment_date END AS payment_date, CASE WHEN day(ex_date) % 2 = 1 THEN ex_date - 28 ELSE declaration_date END AS declaration_date) FROM paid""")
add("k14_dedupe_on_key", "symbol transaction_date transaction_type total_value event_id",
    lambda v: maintenance.dedupe_on_key(v.insider, ["symbol", "transaction_date", "transaction_type"], ["total_value", "event_id"]), """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, transaction_date, transaction_type ORDER BY total_value DESC, event_id DESC) AS k FROM insider) WHERE k = 1""")


def streamed(v, files_per_batch: int = 100) -> DataFrame:
    """Drains the line items as a stream into a keyed table of newest ship dates."""
    root = scratch(v.spark, "stream")
    source = ingest.price_stream(v.spark, f"{v.directory}/lineitem.parquet", schemas.SOURCE_TABLES["lineitem"], files_per_batch)
    bars = source.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), F.col("l_extendedprice").alias("high"),
                         F.lit(0.0).alias("low"), F.col("l_extendedprice").alias("close"))
    table = ingest.MergedTable(v.spark, f"{root}/table", bars.schema, ["symbol", "trade_date"])
    return ingest.newest_day(ingest.run_ingest(bars, table, f"{root}/checkpoint"))


add("s01_incremental_ingest", "symbol last_date bars", streamed, """
SELECT l_suppkey AS symbol, CAST(max(l_shipdate) AS date) AS last_date, count(DISTINCT CAST(l_shipdate AS date)) AS bars FROM lineitem GROUP BY 1""")


ARRIVALS, DELAY_DAYS = 4, 5


def arrived(v) -> DataFrame:
    """Events as they come in, a span of time after another; every seventh event again with the next span, and every eleventh two spans late."""
    events = v.table("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    span = events.agg(F.struct(F.min("ts").alias("a"), F.max("ts").alias("z"))).scalar()
    share = (F.unix_micros("ts") - F.unix_micros(span["a"])) / (F.unix_micros(span["z"]) - F.unix_micros(span["a"]) + 1)
    first = F.floor(share * ARRIVALS) + F.when(F.col("event_id") % 11 == 0, 2).otherwise(0)
    again = F.when(F.col("event_id") % 7 == 0, F.array(first, first + 1)).otherwise(F.array(first))
    return events.withColumn("arrival", F.explode(again.cast("array<int>")))


def deduplicated(v) -> DataFrame:
    """The arrivals one after another, each drained as it is there, with the keys of the last days remembered from run to run."""
    root, rows = scratch(v.spark, "arrivals"), arrived(v)
    schema = rows.drop("arrival").schema
    for number in range(ARRIVALS + 3):
        rows.where(F.col("arrival") == number).drop("arrival").write.mode("append").parquet(f"{root}/in")
        source = v.spark.readStream.schema(schema).parquet(f"{root}/in")
        ingest.run_append(ingest.deduplicated(source, ["event_id"], "ts", f"{DELAY_DAYS} days"), f"{root}/out", f"{root}/checkpoint")
    return v.spark.read.schema(schema).parquet(f"{root}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


add("s01_deduplicated", "event_id user_id ts", deduplicated, f"""
WITH span AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS z FROM events),
first AS (SELECT event_id, user_id, ts, CAST(floor((epoch_us(ts) - a) / (z - a + 1) * {ARRIVALS}) AS int) + CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END AS arrival FROM events, span),
newest AS (SELECT arrival, max(ts) AS ts FROM (SELECT arrival, ts FROM first UNION ALL SELECT arrival + 1, ts FROM first WHERE event_id % 7 = 0) GROUP BY 1),
marks AS (SELECT a.arrival, date_trunc('millisecond', max(b.ts)) - INTERVAL {DELAY_DAYS} DAY AS mark FROM newest a LEFT JOIN newest b ON b.arrival < a.arrival GROUP BY 1)
SELECT event_id, user_id, ts FROM first f JOIN marks m ON f.arrival = m.arrival WHERE mark IS NULL OR ts > mark""")

# Filters.
add("f01_eligible_universe", "symbol sector industry market_cap$", lambda v: filters.eligible_universe(v.universe, exclude_etf=True), "SELECT * FROM elig WHERE NOT is_etf")
add("f02_common_stock_symbols", "symbol exchange", lambda v: filters.common_stock_symbols(pf.listing(v)), r"""
SELECT * FROM listing WHERE exchange IN ('NYSE', 'NASDAQ', 'AMEX') AND assetType = 'Stock' AND status = 'Active' AND symbol NOT LIKE '%.PRA' AND symbol NOT LIKE '%.WS' AND symbol NOT LIKE '%-PB'
  AND NOT regexp_matches(symbol, '[0-9]{5}$')""")


def mixed_funds(v) -> DataFrame:
    turn = F.col("symbol") % 10
    return v.universe.withColumns({
        "industry": F.when(turn == 0, "Reit - Retail").when(turn == 1, "Closed Fund").when(turn == 2, "etf provider").when(turn == 3, None).otherwise(F.col("industry")),
        "sector": F.when(turn == 4, "N/A").otherwise(F.col("sector")), "security_type": F.when(turn == 5, "Preferred").otherwise(F.col("security_type")),
    })


add("f03_exclude_funds", "symbol sector industry", lambda v: filters.exclude_funds(mixed_funds(v)),
    "SELECT symbol, sector, CASE WHEN symbol % 10 <> 3 THEN industry END AS industry FROM universe WHERE symbol % 10 NOT IN (0, 1, 2, 4, 5) AND security_type = 'Common Stock'")
add("f04_valid_bars", "symbol trade_date close*", lambda v: filters.valid_bars(v.bars.withColumn("high", F.when(F.col("volume") % 3 == 0, F.col("low") - 1).otherwise(F.col("high")))),
    "SELECT * FROM bars WHERE volume % 3 <> 0")
add("f05_lookback", "symbol trade_date close*", lambda v: within(v.bars, "trade_date", 365, v.as_of), "SELECT * FROM bars WHERE trade_date >= (SELECT d FROM today) - 365")
RULES = {
    "VALUE": ("fscore >= 6 AND bankruptcy_risk <> 'DISTRESS' AND pe_ratio > 0 AND pe_ratio < 25", "pe_ratio > 0 AND pe_ratio < 15 AND fscore >= 6 AND bankruptcy_risk = 'SAFE'"),
    "GROWTH": ("fscore >= 5 AND bankruptcy_risk <> 'DISTRESS' AND (revenue_growth > 5 OR eps_growth > 5)", "insider_score >= 60 AND fscore >= 6 AND bankruptcy_risk <> 'DISTRESS'"),
    "DIVIDEND": ("dividend_yield > 1.5 AND fscore >= 6 AND bankruptcy_risk = 'SAFE'", "dividend_yield > 2 AND fscore >= 7 AND bankruptcy_risk = 'SAFE'"),
}
add("f06_portfolio_candidates", "symbol value growth dividend strict_value strict_growth strict_dividend", lambda v: v.signals.select("symbol", *[
    F.coalesce(rule(p), F.lit(False)).alias(prefix + p.lower()) for prefix, rule in (("", filters.candidate_rule), ("strict_", filters.strategy_rule)) for p in RULES]),
    "SELECT symbol, " + ", ".join(f"coalesce({r[0]}, false) AS {p.lower()}, coalesce({r[1]}, false) AS strict_{p.lower()}" for p, r in RULES.items()) + " FROM signals")
add("f07_upcoming_estimates", "symbol name fiscal_period eps_consensus* eps_num_estimates surprise_percentage",
    lambda v: filters.upcoming_estimates(payloads.parse_estimates(pf.estimate_payloads(v)), v.universe, F.date_sub(v.as_of, 200)), """
SELECT e.symbol, name, fiscal_period, eps_consensus, eps_num_estimates, surprise_percentage FROM estimates e JOIN universe u ON e.symbol = u.symbol
WHERE period_type = 'quarterly' AND fiscal_period >= (SELECT d FROM today) - 200 AND eps_num_estimates >= 5 ORDER BY eps_num_estimates DESC, fiscal_period, e.symbol LIMIT 10""")
add("f08_check_constraints", "rows_checked constraint_name violations", lambda v: filters.check_constraints(
    v.piotroski, {"strength_category": ("STRONG", "WEAK")}, {"fscore": (2, 8), "current_roa": (-1, 1)}), """
SELECT (SELECT count(*) FROM piotroski) AS rows_checked, * FROM (SELECT 'strength_category_enum' AS constraint_name, count(*) FILTER (strength_category NOT IN ('STRONG', 'WEAK')) AS violations FROM piotroski
UNION ALL SELECT 'fscore_range', count(*) FILTER (fscore NOT BETWEEN 2 AND 8) FROM piotroski UNION ALL SELECT 'current_roa_range', count(*) FILTER (current_roa NOT BETWEEN -1 AND 1) FROM piotroski)""")
add("f09_stale_symbols", "symbol last_fetched", lambda v: filters.stale_symbols(
    v.universe, v.fundamentals_q.select(F.when(F.col("symbol") % 4 == 0, -F.col("symbol")).otherwise(F.col("symbol")).alias("symbol"), F.date_add("fiscal_date", (F.col("symbol") % 90).cast("int")).alias("fetched_on")), v.bars, v.as_of, 92, 60), """
SELECT u.symbol, last_fetched FROM universe u LEFT JOIN (SELECT CASE WHEN symbol % 4 = 0 THEN -symbol ELSE symbol END AS symbol, max(fiscal_date + CAST(symbol % 90 AS int)) AS last_fetched FROM fundamentals_q GROUP BY 1) f ON u.symbol = f.symbol
WHERE (last_fetched IS NULL OR last_fetched < (SELECT d FROM today) - 92) AND u.symbol IN (SELECT symbol FROM bars GROUP BY 1 HAVING max(trade_date) >= (SELECT d FROM today) - 60)""")
add("l03_ordered_work_list", "symbol last_fetched market_cap$", lambda v: v.universe.join(v.bars.groupBy(F.when(F.col("symbol") % 3 == 0, F.col("symbol")).otherwise(-F.col("symbol")).alias("symbol")).agg(F.max("trade_date").alias("last_fetched")), "symbol", "left").orderBy(
    F.asc_nulls_first("last_fetched"), F.when(F.col("sector") == "Energy", 0).otherwise(1), F.desc_nulls_last("market_cap"), "symbol"), """
SELECT u.*, last_fetched FROM universe u LEFT JOIN (SELECT CASE WHEN symbol % 3 = 0 THEN symbol ELSE -symbol END AS symbol, max(trade_date) AS last_fetched FROM bars GROUP BY 1) f ON u.symbol = f.symbol
ORDER BY last_fetched NULLS FIRST, CASE WHEN sector = 'Energy' THEN 0 ELSE 1 END, market_cap DESC NULLS LAST, u.symbol""")
add("f10_pending_signals", "signal_id symbol portfolio_type score*", lambda v: filters.pending_signals(v.queue, v.as_of, "VALUE"), """
SELECT * FROM queue WHERE NOT processed AND (expiration_date IS NULL OR expiration_date >= (SELECT d FROM today)) AND portfolio_type = 'VALUE'""")

# Joins.
add("j01_fact_universe", "symbol trade_date close* sector", lambda v: v.bars.join(filters.eligible_universe(v.universe).select("symbol", "sector"), "symbol"),
    "SELECT b.symbol, trade_date, close, sector FROM bars b JOIN elig u ON b.symbol = u.symbol")
add("j02_star_join", "symbol fscore bankruptcy_risk insider_score* smart_money_signal volatility_level breakout_score*", lambda v: v.signals, "SELECT * FROM signals")
add("j03_left_join_benchmark", "symbol trade_date close* market_close*", lambda v: technical.stock_and_market_returns(v.bars, v.bench.withColumn("trade_date", F.when(F.col("trade_date") > F.lit("1998-01-01").cast("date"), F.col("trade_date")).otherwise(F.add_months("trade_date", -600)))), """
SELECT b.symbol, b.trade_date, b.close, m.close AS market_close FROM bars b LEFT JOIN (SELECT CASE WHEN trade_date > DATE '1998-01-01' THEN trade_date ELSE CAST(trade_date - INTERVAL 600 MONTH AS date) END AS trade_date, close FROM bench) m ON b.trade_date = m.trade_date""")
add("j04_trades_prices", "account_id symbol trade_date quantity close*", lambda v: v.trades.join(v.bars.select("symbol", "trade_date", "close"), ["symbol", "trade_date"]), """
SELECT account_id, t.symbol, t.trade_date, quantity, close FROM trades t JOIN bars b ON t.symbol = b.symbol AND t.trade_date = b.trade_date""")


def one_row(v) -> DataFrame:
    """Single values meet without a join: the second relation is read as a scalar subquery."""
    stock = v.bars.agg(F.avg("close").alias("average_close"), F.count("*").alias("bars"))
    return stock.withColumn("benchmark_days", v.bench.agg(F.count("*")).scalar())


add("j05_one_row_relations", "average_close* bars benchmark_days", one_row, "SELECT avg(close) AS average_close, count(*) AS bars, (SELECT count(*) FROM bench) AS benchmark_days FROM bars")
add("j06_expression_key", "symbol trade_date eps*", lambda v: v.bars.withColumn("q", F.date_trunc("quarter", "trade_date")).join(
    v.fundamentals_q.select("symbol", F.date_trunc("quarter", "fiscal_date").alias("q"), ratio(F.col("net_income"), F.col("shares")).alias("eps")), ["symbol", "q"]), """
SELECT b.symbol, trade_date, net_income / shares AS eps FROM bars b JOIN fundamentals_q f ON b.symbol = f.symbol AND date_trunc('quarter', trade_date) = date_trunc('quarter', fiscal_date)""")
add("j07_as_of_join", "account_id symbol trade_date quantity close*", lambda v: joins.as_of_join(v.trades, v.bars, "symbol", "trade_date", "trade_date", ["close"]), """
SELECT account_id, t.symbol, t.trade_date, quantity, close FROM trades t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.trade_date >= b.trade_date""")


def purchases_after_clicks(v) -> DataFrame:
    """Each purchase with its user's newest click until then; a third of the users are one."""
    events = v.table("events").withColumn("user_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("ts").alias("clicked_at"), F.col("value").alias("click_value"))
    return joins.as_of_join(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "ts",
                            ["clicked_at", "click_value"], bucket=F.to_date)


view("few_users", "SELECT * REPLACE (CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS user_id) FROM events")
add("j07_events", "event_id user_id ts clicked_at click_value", purchases_after_clicks, """
SELECT p.event_id, p.user_id, p.ts, c.ts AS clicked_at, click_value FROM (SELECT * FROM few_users WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS click_value FROM few_users WHERE event_type = 'click' GROUP BY 1, 2) c ON p.user_id = c.user_id AND p.ts >= c.ts""")


def offsets(v) -> DataFrame:
    lagged = series.year_ago(v.fundamentals_q, ("revenue",))
    before = F.lag("revenue").over(series.by_symbol("fiscal_date"))
    return lagged.select("symbol", "fiscal_date", ratio(F.col("revenue"), F.col("prior_revenue")).alias("to_year_ago"), ratio(F.col("revenue"), before).alias("to_previous"))


add("j08_rank_offset_join", "symbol fiscal_date to_year_ago* to_previous*", offsets, """
SELECT c.symbol, c.fiscal_date, c.revenue / y.revenue AS to_year_ago, c.revenue / q.revenue AS to_previous FROM fq_lag c
LEFT JOIN fq_lag y ON c.symbol = y.symbol AND y.rn = c.rn + 4 LEFT JOIN fq_lag q ON c.symbol = q.symbol AND q.rn = c.rn + 1""")
add("j09_bounded_forward_lookup", "trade_date return_1m* return_3m* return_6m* return_1y*", lambda v: technical.benchmark_forward_returns(v.bench),
    "SELECT trade_date, " + ", ".join(f"CASE WHEN lead(trade_date, {n}) OVER w <= trade_date + {d} THEN (lead(close, {n}) OVER w - close) / close * 100 END AS {name}"
                                      for name, n, d in (("return_1m", 21, 35), ("return_3m", 63, 100), ("return_6m", 126, 200), ("return_1y", 252, 380))) + " FROM bench WINDOW w AS (ORDER BY trade_date)")
add("j10_semi_join", "symbol trade_date close*", lambda v: v.bars.join(
    v.bars.groupBy("symbol").agg(F.max("trade_date").alias("trade_date")), ["symbol", "trade_date"], "left_semi"),
    "SELECT * FROM bars WHERE (symbol, trade_date) IN (SELECT (symbol, max(trade_date)) FROM bars GROUP BY symbol)")
add("j12_merge", "symbol sector trade_date weight* daily_return*", lambda v: v.positions, "SELECT * FROM held")


def campaigns(v) -> DataFrame:
    """Ten days long, one begun every third day, so that each moment lies in three or four."""
    span = v.table("events").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("z"))
    starts = span.select(F.explode(F.sequence("a", "z", F.expr("INTERVAL 3 DAYS"))).alias("day"))
    return starts.select(F.col("day").cast("timestamp_ntz").alias("period_start"), F.date_add("day", 10).cast("timestamp_ntz").alias("period_end"))


add("j13_events", "period_start period_end event_type events users total*3", lambda v: joins.interval_join(
    v.table("events"), campaigns(v), "ts", "period_start", "period_end", 10 * 86400).groupBy("period_start", "period_end", "event_type").agg(
    F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.sum("value").alias("total")), """
SELECT s AS period_start, s + INTERVAL 10 DAY AS period_end, event_type, count(*) AS events, count(DISTINCT user_id) AS users, sum(value) AS total
FROM events JOIN (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 3 DAY)) AS s FROM events) ON ts >= s AND ts < s + INTERVAL 10 DAY GROUP BY 1, 2, 3""")

# Aggregates.
WIN = "symbol total_trades winning_trades avg_win* avg_loss* mean_return* std_dev* max_return* min_return*"


def eligible_returns(v) -> DataFrame:
    recent = within(v.bars, "trade_date", 2500, v.as_of).join(filters.eligible_universe(v.universe).select("symbol"), "symbol")
    return series.daily_returns(recent)


add("a01_group_statistics", WIN, lambda v: aggregates.win_loss(eligible_returns(v)), "SELECT * FROM win_loss")
add("a02_conditional_aggregates", "account_id buys sells bought_quantity sold_quantity", lambda v: v.trades.groupBy("account_id").agg(
    F.count_if(F.col("trade_type") == "BUY").alias("buys"), F.count_if(F.col("trade_type") == "SELL").alias("sells"),
    F.sum(F.when(F.col("trade_type") == "BUY", F.col("quantity"))).alias("bought_quantity"), F.sum(F.when(F.col("trade_type") == "SELL", F.col("quantity"))).alias("sold_quantity")), """
SELECT account_id, count(*) FILTER (trade_type = 'BUY') AS buys, count(*) FILTER (trade_type = 'SELL') AS sells, sum(quantity) FILTER (trade_type = 'BUY') AS bought_quantity,
  sum(quantity) FILTER (trade_type = 'SELL') AS sold_quantity FROM trades GROUP BY 1""")
add("a03_having", "symbol total_trades", lambda v: aggregates.win_loss(eligible_returns(v), 440), """
SELECT symbol, count(*) AS total_trades FROM (SELECT b.symbol, lag(close) OVER (PARTITION BY b.symbol ORDER BY trade_date) AS p FROM recent_bars b JOIN elig u ON b.symbol = u.symbol)
WHERE p IS NOT NULL GROUP BY 1 HAVING count(*) >= 440""")
add("a04_distinct_counts", "frequency num_stocks num_dividends", lambda v: fundamental.apply_frequency(v.dividends, v.dividends).groupBy("frequency").agg(
    F.countDistinct("symbol").alias("num_stocks"), F.count("*").alias("num_dividends")), """
SELECT frequency, count(DISTINCT d.symbol) AS num_stocks, count(*) AS num_dividends FROM dividends d JOIN div_freq f ON d.symbol = f.symbol GROUP BY 1""")
add("a05_percentiles", "symbol p05* p20* p50* p75* p90*", lambda v: series.daily_returns(v.bars).groupBy("symbol").agg(
    *[F.percentile("daily_return", F.lit(q)).alias(n) for n, q in (("p05", 0.05), ("p20", 0.2), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9))]),
    "SELECT symbol, quantile_cont(r, 0.05) AS p05, quantile_cont(r, 0.2) AS p20, median(r) AS p50, quantile_cont(r, 0.75) AS p75, quantile_cont(r, 0.9) AS p90 FROM returns GROUP BY 1")
add("a06_sample_moments", "symbol skewness* kurtosis*", lambda v: v.risk, "SELECT * FROM risk")
add("a07_expected_shortfall", "symbol var_95* cvar_95*", lambda v: v.risk, "SELECT * FROM risk")
add("a08_beta", "symbol beta*", lambda v: v.risk, "SELECT * FROM risk")
add("a09_yearly_roll_up", "symbol fiscal_year fiscal_date quarters revenue$ net_margin* fcf_margin*", lambda v: aggregates.annual_fundamentals(v.fundamentals).withColumns(
    {"net_margin": ratio(F.col("net_income"), F.col("revenue")), "fcf_margin": ratio(F.col("free_cash_flow"), F.col("revenue"))}),
    "SELECT *, net_income / revenue AS net_margin, free_cash_flow / revenue AS fcf_margin FROM annual")
add("a11_first_last", "symbol first_close* last_close* change*", lambda v: v.bars.groupBy("symbol").agg(
    F.min_by("close", "trade_date").alias("first_close"), F.max_by("close", "trade_date").alias("last_close")).withColumn("change", change(F.col("last_close"), F.col("first_close"))), """
SELECT *, last_close / first_close - 1 AS change FROM (SELECT symbol, arg_min(close, trade_date) AS first_close, arg_max(close, trade_date) AS last_close FROM bars GROUP BY 1)""")
add("a13_value_counts", "risk_category count pct*", lambda v: aggregates.value_counts(v.altman, "risk_category"),
    "SELECT risk_category, count(*) AS count, count(*) * 100 / (SELECT count(*) FROM altman) AS pct FROM altman GROUP BY 1")
add("a14_success_rates", "component success_pct*", lambda v: aggregates.success_rates(v.piotroski, FSCORE_FLAGS),
    " UNION ALL ".join(f"SELECT '{f}' AS component, avg({f}::int) * 100 AS success_pct FROM piotroski" for f in FSCORE_FLAGS))
add("a15_average_by_sector", "sector avg_score* stocks", lambda v: aggregates.average_by_sector(v.piotroski.drop("sector"), v.universe, "fscore"), """
SELECT sector, avg(fscore) AS avg_score, count(*) AS stocks FROM piotroski WHERE calculation_date = (SELECT max(calculation_date) FROM piotroski) GROUP BY 1""")
add("a19_trend", "symbol slope* points trend", lambda v: fundamental.trends(fundamental.yearly_excess(v.fundamentals, v.dividends)), """
SELECT symbol, s5 AS slope, n5 AS points, CASE WHEN n5 < 3 THEN 'Insufficient Data' WHEN s5 > 2 THEN 'Advancing' WHEN s5 < -2 THEN 'Decreasing' ELSE 'Stable' END AS trend FROM ecf_fit""")

# Scalars.
add("c04_safe_division", "symbol transaction_date share*", lambda v: v.insider.groupBy("symbol", "transaction_date").agg(
    F.count_if(F.col("is_ceo")).alias("a"), F.count_if(F.col("is_cfo")).alias("b")).withColumn("share", F.coalesce(ratio(F.col("a"), F.col("b")), F.lit(-1.0))), """
SELECT symbol, transaction_date, coalesce(count(*) FILTER (is_ceo) / nullif(count(*) FILTER (is_cfo), 0), -1) AS share FROM insider GROUP BY 1, 2""")
add("c06_arithmetic", "symbol root* growth* magnitude* whole", lambda v: v.overview.join(v.universe.select("symbol", "market_cap"), "symbol").select(
    "symbol", F.sqrt(F.abs("pe_ratio")).alias("root"), (F.pow(F.abs("pb_ratio"), F.lit(0.2)) - 1).alias("growth"), F.log10(F.abs("market_cap")).alias("magnitude"),
    F.col("dividend_yield").cast("int").alias("whole")), """
SELECT o.symbol, sqrt(abs(pe_ratio)) AS root, pow(abs(pb_ratio), 0.2) - 1 AS growth, log10(abs(market_cap)) AS magnitude, CAST(trunc(dividend_yield) AS int) AS whole FROM overview o JOIN universe u ON o.symbol = u.symbol""")
add("c07_date_parts", "symbol trade_date year quarter_start month_start", lambda v: v.bars.select(
    "symbol", "trade_date", F.year("trade_date").alias("year"), F.date_trunc("quarter", "trade_date").cast("date").alias("quarter_start"), F.trunc("trade_date", "month").alias("month_start")), """
SELECT symbol, trade_date, year(trade_date) AS year, CAST(date_trunc('quarter', trade_date) AS date) AS quarter_start, CAST(date_trunc('month', trade_date) AS date) AS month_start FROM bars""")
add("c09_validated_date", "event_id day", lambda v: v.table("events").select("event_id", iso_date(F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(
    F.col("event_id") % 3 == 1, F.date_format("ts", "dd/MM/yyyy")).otherwise("2024-02-31")).alias("day")),
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS date) END AS day FROM events")
add("c10_text", "symbol shout numbered bare head", lambda v: v.universe.select("symbol", F.upper("name").alias("shout"), F.col("name").contains("#0000").alias("numbered"),
    F.regexp_replace("name", "[^0-9]", "").alias("bare"), F.substring("name", 1, 8).alias("head")), """
SELECT symbol, upper(name) AS shout, contains(name, '#0000') AS numbered, regexp_replace(name, '[^0-9]', '', 'g') AS bare, substring(name, 1, 8) AS head FROM universe""")
add("c11_tolerant_number", "event_id amount", lambda v: v.table("events").select("event_id", number(F.element_at(F.array(
    F.concat(F.lit("$"), F.format_number(F.floor(F.col("value") * 1000), 0)), F.lit("None"), F.lit("N/A"), F.lit("-"), F.concat(F.floor("value").cast("string"), F.lit("%"))),
    (F.col("event_id") % 5 + 1).cast("int"))).alias("amount")), """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN floor(value * 1000) WHEN 4 THEN floor(value) END AS amount FROM events""")
add("c12_encodings", "symbol risk_code sector_technology sector_energy sector_missing", lambda v: v.signals.select(
    "symbol", F.when(F.col("symbol") % 6 != 0, F.col("sector")).alias("sector"), "bankruptcy_risk").withColumns(
    learning.one_hot("sector", learning.SECTORS, "sector")).withColumn("risk_code", learning.ordinal("bankruptcy_risk", learning.RISK_CODES)), """
SELECT symbol, CASE bankruptcy_risk WHEN 'SAFE' THEN 0 WHEN 'DISTRESS' THEN 2 ELSE 1 END AS risk_code, (symbol % 6 <> 0 AND sector = 'Technology')::int AS sector_technology,
  (symbol % 6 <> 0 AND sector = 'Energy')::int AS sector_energy, (symbol % 6 = 0)::int AS sector_missing FROM signals""")
add("c14_array_columns", "portfolio_type symbols", lambda v: v.holdings.groupBy("portfolio_type").agg(
    F.array_join(F.array_sort(F.collect_set(F.col("symbol").cast("string"))), ",").alias("symbols")),
    "SELECT portfolio_type, string_agg(CAST(symbol AS varchar), ',' ORDER BY CAST(symbol AS varchar)) AS symbols FROM holdings GROUP BY 1")
