"""API-shaped text payloads built by Spark from the input views, to be parsed back.

Payloads are cut by symbol and year (or one event each), so no row gathers more than a
year of one symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from equiloom.plans.derived import Derived
from equiloom.sources.payloads import BAR_KEYS


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def _fields(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[part for name, value in pairs.items() for part in (F.lit(name), _text(value))])


def price_payloads(v: Derived) -> DataFrame:
    c = F.col
    values = {
        "open": c("open"), "high": c("high"), "low": c("low"), "close": c("close"), "adjusted_close": c("close") * 0.5,
        "volume": c("volume"), "dividend_amount": c("dividend_amount"), "split_coefficient": F.lit(1.0),
    }
    bar = _fields({BAR_KEYS[name]: value for name, value in values.items()})
    series = F.map_from_entries(F.collect_list(F.struct(c("trade_date").cast("string"), bar)))
    payload = F.to_json(F.create_map(F.lit("Time Series (Daily)"), series))
    return v.bars.groupBy("symbol", F.year("trade_date").alias("year")).agg(payload.alias("payload")).select("symbol", "payload")


def benchmark_payloads(v: Derived) -> DataFrame:
    """Adjusted closes that are missing, far off or fine, by the day of the month."""
    c, turn = F.col, F.dayofmonth("trade_date") % 4
    adjusted = F.when(turn == 0, 0.0).when(turn == 1, c("close") * 0.3).when(turn == 2, c("close") * 1.1).otherwise(c("close") * 2.5)
    bar = _fields({BAR_KEYS["close"]: c("close"), BAR_KEYS["adjusted_close"]: adjusted, BAR_KEYS["volume"]: F.lit(1)})
    series = F.map_from_entries(F.collect_list(F.struct(c("trade_date").cast("string"), bar)))
    payload = F.to_json(F.create_map(F.lit("Time Series (Daily)"), series))
    return v.bench.groupBy(F.year("trade_date").alias("year")).agg(payload.alias("payload")).select(F.lit("INDEX").alias("symbol"), "payload")


def statement_payloads(v: Derived) -> DataFrame:
    """Income, balance and cash reports; cash reports lack free cash flow in odd months' years."""
    c = F.col
    date = c("fiscal_date")
    income = _fields({
        "fiscalDateEnding": date, "totalRevenue": c("revenue"), "costOfRevenue": c("revenue") - c("gross_profit"), "grossProfit": c("gross_profit"),
        "operatingExpenses": c("gross_profit") - c("operating_income"), "operatingIncome": c("operating_income"), "netIncome": c("net_income"),
    })
    balance = _fields({
        "fiscalDateEnding": date, "totalAssets": c("total_assets"), "totalLiabilities": c("total_liabilities"), "totalShareholderEquity": c("equity"),
        "cashAndCashEquivalentsAtCarryingValue": c("cash"), "shortTermDebt": F.when(c("symbol") % 2 == 0, c("total_debt") / 4),
        "longTermDebt": c("total_debt") / 2, "totalCurrentAssets": c("total_assets") / 3, "totalCurrentLiabilities": c("total_liabilities") / 4,
        "commonStockSharesOutstanding": c("shares"),
    })
    cash = _fields({
        "fiscalDateEnding": date, "operatingCashflow": c("operating_cash_flow"), "capitalExpenditures": c("capex"),
        "freeCashFlow": F.when(c("symbol") % 3 != 0, c("free_cash_flow")),
    })

    def reports(value: Column, keep: Column, name: str) -> Column:
        rows = F.collect_list(F.when(keep, value))
        return F.to_json(F.create_map(F.lit("quarterlyReports"), rows)).alias(name)

    always = F.lit(True)
    return v.fundamentals_q.groupBy("symbol", F.year("fiscal_date").alias("year")).agg(
        reports(income, always, "income"), reports(balance, F.month("fiscal_date") != 7, "balance"), reports(cash, always, "cash"),
    ).drop("year")


def overview_payloads(v: Derived) -> DataFrame:
    c = F.col
    o = v.overview.join(v.universe.select("symbol", "sector", "industry", "market_cap", "name"), "symbol")
    payload = F.to_json(_fields({
        "Sector": c("sector"), "Industry": c("industry"), "Description": F.repeat("name", 80), "MarketCapitalization": c("market_cap"),
        "PERatio": F.when(c("pe_ratio") > 0, c("pe_ratio")), "PriceToBookRatio": c("pb_ratio"), "DividendYield": c("dividend_yield"),
        "ProfitMargin": F.when(c("symbol") % 5 == 0, F.lit("-")).otherwise(_text(c("profit_margin"))),
        "QuarterlyEarningsGrowthYOY": c("quarterly_earnings_growth"), "SharesOutstanding": F.format_number(c("symbol") * 1234567, 0),
        "52WeekHigh": c("high_52w"), "LatestQuarter": F.when(c("symbol") % 4 == 0, F.lit("N/A")).otherwise(F.lit("2001-09-30")),
    }))
    return o.select("symbol", payload.alias("payload"))


def insider_payloads(v: Derived) -> DataFrame:
    """One transaction per payload."""
    c, turn = F.col, F.col("event_id") % 6
    title = F.when(c("is_ceo"), "Chief Executive Officer").when(c("is_cfo"), "cfo").when(turn == 0, "Director").when(
        c("is_officer"), "Officer, Sales").otherwise("10% owner")
    code = F.when(c("transaction_type") == "BUY", F.when(turn < 3, "A").otherwise("p")).otherwise("D")
    entry = _fields({
        "transaction_date": c("transaction_date"), "executive": F.concat(F.lit("Owner "), c("event_id") % 50), "executive_title": title,
        "acquisition_or_disposal": code, "shares": F.when(turn == 5, F.lit("")).otherwise(F.format_number(F.floor(c("total_value")), 0)),
        "share_price": F.when(turn == 4, F.lit("")).otherwise(F.concat(F.lit("$"), _text(turn + 1))),
    })
    return v.insider.select("symbol", "event_id", F.to_json(F.create_map(F.lit("data"), F.array(entry))).alias("payload"))


def estimate_payloads(v: Derived) -> DataFrame:
    c = F.col
    eps = c("net_income") / c("shares")

    def entry(scale: float) -> Column:
        return _fields({
            "fiscalDateEnding": c("fiscal_date"), "consensusEPS": eps * scale, "highEstimate": eps * scale * 1.2, "lowEstimate": eps * scale * 0.8,
            "numberOfEstimates": c("symbol") % 9, "consensusRevenue": F.when(c("symbol") % 2 == 0, c("revenue") * scale),
            "reportedEPS": eps, "reportedDate": F.date_add("fiscal_date", 30), "surpriseAmount": eps * (scale - 1),
            "surprisePercentage": F.concat(_text((c("symbol") % 20 - 10) / 4), F.lit("%")),
        })

    yearly = F.when(F.month("fiscal_date") == 10, entry(4.0))
    payload = F.to_json(F.create_map(
        F.lit("quarterlyEarningsEstimates"), F.collect_list(entry(1.5)), F.lit("annualEarningsEstimates"), F.collect_list(yearly)))
    return v.fundamentals_q.groupBy("symbol", F.year("fiscal_date").alias("year")).agg(payload.alias("payload")).drop("year")


def listing(v: Derived) -> DataFrame:
    """Exchange listing with preferred shares, warrants and inactive names among the common ones."""
    c = F.col
    turn = c("symbol") % 7
    suffix = F.when(turn == 0, ".PRA").when(turn == 1, ".WS").when(turn == 2, "-PB").when(turn == 3, "12345").otherwise("")
    return v.universe.select(
        F.concat(F.lit("S"), c("symbol").cast("string"), F.lit("X"), suffix).alias("symbol"),
        F.when(c("symbol") % 3 == 0, "NYSE").when(c("symbol") % 3 == 1, "NASDAQ").otherwise("OTC").alias("exchange"),
        F.when(c("symbol") % 11 == 0, "ETF").otherwise("Stock").alias("assetType"),
        F.when(c("symbol") % 13 == 0, "Delisted").otherwise("Active").alias("status"),
    )
