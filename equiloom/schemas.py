"""Declared table schemas. Money and ratios are doubles in plans; sinks cast to decimals."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(text: str) -> T.StructType:
    """``name type`` pairs; unlike the DDL parser this needs no running session."""
    fields = (pair.split() for pair in text.split(","))
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in fields])


SOURCE_TABLES = {
    "region": _schema("r_regionkey int, r_name string"),
    "nation": _schema("n_nationkey int, n_name string, n_regionkey int"),
    "supplier": _schema("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    "customer": _schema("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    "orders": _schema("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                      "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": _schema("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                        "l_linestatus string, l_shipdate timestamp_ntz"),
    "events": _schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"),
}

UNIVERSE = _schema("symbol string, name string, exchange string, security_type string, is_etf boolean, sector string, "
                   "industry string, market_cap double, country string, currency string, shares_outstanding bigint, "
                   "delisted_date date")
PRICES = _schema("symbol string, trade_date date, open double, high double, low double, close double, "
                 "adjusted_close double, volume bigint, dividend_amount double, split_coefficient double")
LISTING = _schema("symbol string, exchange string, assetType string, status string")
PRICE_PAYLOAD = _schema("symbol string, payload string")
DIVIDENDS = _schema("symbol string, ex_date date, payment_date date, record_date date, declaration_date date, "
                    "dividend double, adjusted_dividend double, currency string, frequency string")

KEYS = {
    "universe": ("symbol",),
    "prices": ("symbol", "trade_date"),
    "benchmark": ("trade_date",),
    "fundamentals": ("symbol", "fiscal_date", "period_type"),
    "dividends": ("symbol", "ex_date"),
    "overview": ("symbol",),
    "earnings_estimates": ("symbol", "fiscal_period", "period_type"),
    "insider_transactions": ("symbol", "transaction_date", "owner_name", "transaction_type", "shares"),
    "scores": ("symbol", "calculation_date"),
    "signals": ("symbol", "signal_date"),
    "holdings": ("portfolio_type", "symbol", "selection_date"),
    "sector_rotation": ("sector", "calculation_date"),
}

MONEY = T.DecimalType(20, 2)
PRICE = T.DecimalType(12, 4)
RATIO = T.DecimalType(10, 4)
SCORE = T.DecimalType(6, 2)
