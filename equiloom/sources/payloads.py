"""Landed API payloads (JSON text) turned into typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from equiloom.functions.expressions import iso_date, number, ratio

TEXT_MAP = "map<string,string>"
BAR_KEYS = {  # fixed field names of the daily series
    "open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close",
    "adjusted_close": "5. adjusted close", "volume": "6. volume",
    "dividend_amount": "7. dividend amount", "split_coefficient": "8. split coefficient",
}


def _series(df: DataFrame) -> DataFrame:
    parsed = F.from_json("payload", "struct<`Time Series (Daily)`:map<string,map<string,string>>>")
    rows = df.select("symbol", F.explode(parsed["Time Series (Daily)"]).alias("day", "bar"))
    day = iso_date(F.col("day")).alias("trade_date")
    fields = []
    for name, key in BAR_KEYS.items():
        missing = 1.0 if name == "split_coefficient" else 0.0
        value = F.coalesce(number(F.col("bar")[key]), F.lit(missing))
        fields.append((value.cast("bigint") if name == "volume" else value).alias(name))
    return rows.select("symbol", day, *fields).where(F.col("trade_date").isNotNull())


def explode_price_payload(df: DataFrame) -> DataFrame:
    return _series(df)


def explode_benchmark_payload(df: DataFrame) -> DataFrame:
    """An adjusted close of zero, or far from the close, gives way to the close."""
    share = ratio(F.col("adjusted_close"), F.col("close"))
    wrong = (F.col("adjusted_close") == 0) | ((F.col("close") > 0) & ((share < 0.5) | (share > 2.0)))
    return _series(df).withColumn("adjusted_close", F.when(wrong, F.col("close")).otherwise(F.col("adjusted_close")))


def _reports(df: DataFrame, column: str, fields: dict[str, str], absent: dict[str, str] | None = None) -> DataFrame:
    """One row per quarterly report; the first report of a repeated fiscal date stands.

    ``absent`` gives the text an absent or empty field stands for.
    """
    absent = absent or {}

    def read(name: str, key: str) -> Column:
        raw = F.col("r")[key]
        if name in absent:
            raw = F.coalesce(F.nullif(raw, F.lit("")), F.lit(absent[name]))
        return number(raw).alias(name)

    parsed = F.from_json(column, f"struct<quarterlyReports:array<{TEXT_MAP}>>")
    rows = df.select("symbol", F.posexplode(parsed["quarterlyReports"]).alias("pos", "r"))
    wanted = rows.select(
        "symbol", "pos", iso_date(F.col("r")["fiscalDateEnding"]).alias("fiscal_date"),
        *[read(name, key) for name, key in fields.items()],
    ).where(F.col("fiscal_date").isNotNull())
    first = F.min_by(F.struct(*fields), "pos").alias("f")
    return wanted.groupBy("symbol", "fiscal_date").agg(first).select("symbol", "fiscal_date", "f.*")


INCOME = {"revenue": "totalRevenue", "cost_of_revenue": "costOfRevenue", "gross_profit": "grossProfit",
          "operating_expenses": "operatingExpenses", "operating_income": "operatingIncome", "net_income": "netIncome"}
BALANCE = {"total_assets": "totalAssets", "total_liabilities": "totalLiabilities", "equity": "totalShareholderEquity",
           "cash": "cashAndCashEquivalentsAtCarryingValue", "short_debt": "shortTermDebt", "long_debt": "longTermDebt",
           "current_assets": "totalCurrentAssets", "current_liabilities": "totalCurrentLiabilities",
           "shares": "commonStockSharesOutstanding"}
CASH = {"operating_cash_flow": "operatingCashflow", "capex": "capitalExpenditures", "reported_fcf": "freeCashFlow"}


def combine_statements(df: DataFrame) -> DataFrame:
    """Income, balance and cash reports of a quarter in one row, with derived ratios."""
    keys = ["symbol", "fiscal_date"]
    joined = (
        _reports(df, "income", INCOME)
        .join(_reports(df, "balance", BALANCE), keys, "left")
        .join(_reports(df, "cash", CASH, {"capex": "0"}), keys, "left")
    )
    c = F.col

    def positive(name: str) -> Column:
        return F.when(c(name) > 0, c(name))

    debt = F.coalesce(c("short_debt"), F.lit(0.0)) + F.coalesce(c("long_debt"), F.lit(0.0))
    eps = ratio(c("net_income"), positive("shares"))
    current = ratio(F.when(c("current_assets") != 0, c("current_assets")), positive("current_liabilities"))
    derived = joined.withColumn("total_debt", F.when(debt > 0, debt))
    return derived.select(
        *keys, F.lit("quarterly").alias("period_type"), *INCOME,
        (c("operating_income") + F.coalesce(c("operating_expenses") * 0.1, F.lit(0.0))).alias("ebitda"),
        "total_assets", "total_liabilities", "equity", "cash", "total_debt", "shares",
        eps.alias("eps"), ratio(c("equity"), positive("shares")).alias("book_value_per_share"),
        current.alias("current_ratio"), (current * 0.85).alias("quick_ratio"), "operating_cash_flow",
        F.coalesce(c("reported_fcf"), c("operating_cash_flow") - F.abs("capex")).alias("free_cash_flow"), "capex",
        ratio(c("total_debt"), positive("equity")).alias("debt_to_equity"),
        (ratio(c("gross_profit"), positive("revenue")) * 100).alias("gross_margin"),
        (ratio(c("operating_income"), positive("revenue")) * 100).alias("operating_margin"),
        (ratio(c("net_income"), positive("revenue")) * 100).alias("net_margin"),
        (ratio(c("net_income") * 4, positive("equity")) * 100).alias("return_on_equity"),
        (ratio(c("net_income") * 4, positive("total_assets")) * 100).alias("return_on_assets"),
    )


OVERVIEW_NUMBERS = {
    "market_cap": "MarketCapitalization", "pe_ratio": "PERatio", "peg_ratio": "PEGRatio", "book_value": "BookValue",
    "price_to_book": "PriceToBookRatio", "price_to_sales": "PriceToSalesRatioTTM", "ev_to_revenue": "EVToRevenue",
    "ev_to_ebitda": "EVToEBITDA", "profit_margin": "ProfitMargin", "operating_margin": "OperatingMarginTTM",
    "return_on_assets": "ReturnOnAssetsTTM", "return_on_equity": "ReturnOnEquityTTM", "revenue_ttm": "RevenueTTM",
    "revenue_per_share": "RevenuePerShareTTM", "quarterly_revenue_growth": "QuarterlyRevenueGrowthYOY",
    "gross_profit_ttm": "GrossProfitTTM", "ebitda": "EBITDA", "eps": "EPS",
    "quarterly_earnings_growth": "QuarterlyEarningsGrowthYOY", "dividend_per_share": "DividendPerShare",
    "dividend_yield": "DividendYield", "beta": "Beta", "forward_pe": "ForwardPE", "trailing_pe": "TrailingPE",
    "analyst_target_price": "AnalystTargetPrice", "high_52w": "52WeekHigh", "low_52w": "52WeekLow",
}
OVERVIEW_COUNTS = {
    "shares_outstanding": "SharesOutstanding", "shares_float": "SharesFloat",
    "analyst_rating_strong_buy": "AnalystRatingStrongBuy", "analyst_rating_buy": "AnalystRatingBuy",
    "analyst_rating_hold": "AnalystRatingHold", "analyst_rating_sell": "AnalystRatingSell",
    "analyst_rating_strong_sell": "AnalystRatingStrongSell",
}
OVERVIEW_DATES = {"dividend_date": "DividendDate", "ex_dividend_date": "ExDividendDate", "latest_quarter": "LatestQuarter"}


def parse_overview(df: DataFrame) -> DataFrame:
    """One flat JSON object per symbol; placeholders become NULL."""
    rows = df.select("symbol", F.from_json("payload", TEXT_MAP).alias("o"))
    o = F.col("o")
    return rows.select(
        "symbol", F.nullif(o["Sector"], F.lit("")).alias("sector"),
        F.nullif(o["Industry"], F.lit("")).alias("industry"),
        F.coalesce(o["Description"], F.lit("")).alias("description"),
        *[number(o[key]).alias(name) for name, key in OVERVIEW_NUMBERS.items()],
        *[number(o[key]).cast("bigint").alias(name) for name, key in OVERVIEW_COUNTS.items()],
        *[iso_date(o[key]).alias(name) for name, key in OVERVIEW_DATES.items()],
        o["FiscalYearEnd"].alias("fiscal_year_end"),
    )


PURCHASE_CODES = ("A", "ACQUISITION", "BUY", "P")


def parse_insider(df: DataFrame, since: Column | None = None) -> DataFrame:
    """Insider transactions. ``since`` drops older ones; by default all are kept."""
    parsed = F.from_json("payload", f"struct<data:array<{TEXT_MAP}>>")
    t = F.col("t")
    rows = df.select("symbol", F.explode(parsed["data"]).alias("t")).select(
        "symbol", iso_date(F.substring(t["transaction_date"], 1, 10)).alias("transaction_date"),
        F.coalesce(t["executive"], F.lit("")).alias("owner_name"),
        F.upper(F.coalesce(t["executive_title"], F.lit(""))).alias("owner_title"),
        F.coalesce(t["security_type"], F.lit("Common Stock")).alias("owner_type"),
        F.upper(F.coalesce(t["acquisition_or_disposal"], F.lit(""))).isin(*PURCHASE_CODES).alias("bought"),
        F.abs(F.coalesce(number(t["shares"]), F.lit(0.0))).alias("shares"),
        F.coalesce(number(t["share_price"]), F.lit(0.0)).alias("price"),
    ).where(F.col("transaction_date").isNotNull())
    if since is not None:
        rows = rows.where(F.col("transaction_date") >= since)
    title = F.col("owner_title")
    ceo = title.contains("CEO") | title.contains("CHIEF EXECUTIVE")
    cfo = title.contains("CFO") | title.contains("CHIEF FINANCIAL")
    price = F.when(F.col("price") > 0, F.col("price"))
    return rows.select(
        "symbol", "transaction_date", "owner_name", "owner_title", "owner_type",
        F.when(F.col("bought"), "BUY").otherwise("SELL").alias("transaction_type"), "shares",
        price.alias("price_per_share"), F.coalesce(F.col("shares") * price, F.lit(0.0)).alias("total_value"),
        ceo.alias("is_ceo"), cfo.alias("is_cfo"), title.contains("DIRECTOR").alias("is_director"),
        (title.contains("OFFICER") | ceo | cfo).alias("is_officer"),
    )


ESTIMATE_NUMBERS = {
    "eps_consensus": "consensusEPS", "eps_high": "highEstimate", "eps_low": "lowEstimate",
    "revenue_consensus": "consensusRevenue", "revenue_high": "revenueHighEstimate", "revenue_low": "revenueLowEstimate",
    "reported_eps": "reportedEPS", "surprise_amount": "surpriseAmount", "surprise_percentage": "surprisePercentage",
}


def parse_estimates(df: DataFrame) -> DataFrame:
    """Quarterly and annual estimate arrays as one table."""
    shape = f"struct<quarterlyEarningsEstimates:array<{TEXT_MAP}>,annualEarningsEstimates:array<{TEXT_MAP}>>"
    parsed = df.select("symbol", F.from_json("payload", shape).alias("p"))

    def side(array: str, label: str) -> DataFrame:
        e = F.col("e")
        return parsed.select("symbol", F.explode(F.col("p")[array]).alias("e")).select(
            "symbol", iso_date(e["fiscalDateEnding"]).alias("fiscal_period"), F.lit(label).alias("period_type"),
            *[number(e[key]).alias(name) for name, key in ESTIMATE_NUMBERS.items()],
            number(e["numberOfEstimates"]).cast("int").alias("eps_num_estimates"),
            iso_date(e["reportedDate"]).alias("reported_date"),
        )

    both = side("quarterlyEarningsEstimates", "quarterly").unionByName(side("annualEarningsEstimates", "annual"))
    return both.where(F.col("fiscal_period").isNotNull())
