"""Registered queries against their SQL on DuckDB.

A spread of queries runs by default; EQUILOOM_ALL=1 runs every one, and
EQUILOOM_SF_DIR picks another data directory.
"""

import os

import pytest
from compare import differences, duck

from equiloom.plans import catalog

DIRECTORY = os.environ.get("EQUILOOM_SF_DIR", "/root/testdata/sf0.001")
SPREAD = """
k01_merge_latest k03_sinks k05_price_payload k07_combine_statements k09_parse_insider k11_incremental_new_rows s01_incremental_ingest
f02_common_stock_symbols f09_stale_symbols j07_as_of_join j13_interval_join a13_value_counts a18_sector_correlations a19_trend w01_moving_averages
w08_rsi w14_ranks w20_sequences l04_capped_selection u01_holding_sets c11_tolerant_number g01_piotroski g05_dividend_sustainability
g08_technical_breakouts g09_risk_metrics g11_kelly_allocation g12_insider_signals g13_institutional_signals g17_select_holdings g23_portfolio_scores
g31_rotation_matrix g35_strategy_returns g36_performance_stats g41_factor_attribution g46_ml_features g48_evaluate_predictions g53_position_sizes
g58_cost_basis f03_exclude_funds c12_encodings a17_sector_quality
""".split()
NAMES = list(catalog.QUERIES) if os.environ.get("EQUILOOM_ALL") else SPREAD


@pytest.fixture(scope="module")
def connection():
    return duck(DIRECTORY)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, connection, name):
    found = catalog.run(name, spark, DIRECTORY).toPandas()
    text = catalog.oracle(name)
    if text is None:
        assert len(found) > 0
    else:
        assert differences(found, connection.sql(text).df()) is None


def test_every_query_has_sql():
    assert [n for n in catalog.QUERIES if catalog.oracle(n) is None] == []


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert catalog.QUERIES.keys() <= entry.queries().keys()
    assert entry.entry(spark).columns == ["portfolio_type", "symbol", "score"]


def test_same_result_with_one_partition(spark):
    name, key = "g09_risk_metrics", "spark.sql.shuffle.partitions"
    wide, before = catalog.run(name, spark, DIRECTORY).toPandas(), spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        assert differences(wide, catalog.run(name, spark, DIRECTORY).toPandas()) is None
    finally:
        spark.conf.set(key, before)
