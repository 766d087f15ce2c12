"""Worked examples, edge cases and properties of single operators."""

import re
from datetime import date, datetime, timedelta
from random import Random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from equiloom.functions.expressions import clamp, iso_date, ladder, number, ratio, sample_kurtosis, sample_skew
from equiloom.functions.frames import latest_by, trailing_means
from equiloom.functions.ranking import exact_quantiles, levels, numbered, tied_rank
from equiloom.operators import aggregates, evaluation, filters, fundamental, joins, learning, portfolio, reports, series, signals, technical
from equiloom.plans.catalog import QUERIES
from equiloom.plans.queries_portfolio import SCREENS
from equiloom.plans.registry import COMPOSED
from equiloom.sources import maintenance, payloads
from equiloom.streaming import ingest

START = date(2024, 1, 1)
START_TIME = datetime(2024, 1, 1)


def day(n):
    return START + timedelta(days=n)


def bars(spark, closes, symbol="A"):
    rows = [(symbol, day(i), float(c), float(c) * 1.01, float(c) * 0.99, float(c), 1000 + i) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, volume bigint")


def listing(spark, symbols=("A",), sector="Technology"):
    rows = [(s, s, sector, "Software", 5e9, "USA", "Common Stock", False) for s in symbols]
    return spark.createDataFrame(rows, "symbol string, name string, sector string, industry string, market_cap double, country string, security_type string, is_etf boolean")


@pytest.mark.parametrize("flow, paid, capex, shares, pct, rating", [
    (100000, 20000, 25000, 7500, 55, "Good"), (25000, 12000, 3000, 2700, 40, "Good"), (10000, 3000, 8000, 1000, -10, "Warning"),
    (50000, 0, 45000, 3000, 10, "Poor"), (5000, 2000, 4000, 500, -20, "Warning")])
def test_excess_cash_flow_examples(spark, flow, paid, capex, shares, pct, rating):
    quarter = spark.createDataFrame([("A", day(0), *[float(x) for x in (1, 1, 1, 1, flow, flow - capex, capex, shares, 1, 1, 1, 1, 1)])],
        "symbol string, fiscal_date date, revenue double, gross_profit double, operating_income double, net_income double, operating_cash_flow double, "
        "free_cash_flow double, capex double, shares double, total_assets double, total_liabilities double, equity double, total_debt double, cash double")
    dividends = spark.createDataFrame([("A", day(5), paid / shares)], "symbol string, ex_date date, dividend double")
    row = fundamental.excess_cash_flow(quarter, dividends).first()
    assert row.excess_cash_flow_pct == pytest.approx(pct) and row.quality_rating == rating
    assert row.trend_5y == "Insufficient Data" and row.avg_excess_cf_5y is None


@pytest.mark.parametrize("paid, raised, dividend, fcf, pct, score, safety, quality, rating", [
    (60, 40, 4.20, 7.50, 75, 74.0, "Safe", 85.95, "Dividend Aristocrat"), (100, 61, 1.84, 2.30, 60, 50.0, "Moderate", 75.0, "High Quality"),
    (15, 8, 5.00, 5.50, 20, 34.545, "Risky", 38.364, "Fair Quality"), (20, 18, 2.80, 10.0, 85, 93.0, "Very Safe", 87.15, "Dividend Aristocrat"),
    (25, 0, 1.00, 1.20, 10, 38.333, "Risky", 39.0, "Fair Quality"), (5, 5, 0.60, 3.80, 70, 96.053, "Very Safe", 56.316, "Good Quality")])
def test_dividend_quality_examples(spark, paid, raised, dividend, fcf, pct, score, safety, quality, rating):
    c = F.col
    rows = spark.createDataFrame([(paid, raised, dividend, fcf, float(pct))], "paid int, raised int, dividend double, fcf double, pct double")
    rows = rows.withColumn("s", fundamental.sustainability_score(c("dividend") / c("fcf") * 100))
    fixed = fundamental.dividend_quality(c("paid"), c("raised"), c("s"), c("pct"), renormalise=False)
    scaled = fundamental.dividend_quality(c("paid"), c("raised"), c("s"), c("pct"))
    row = rows.select("s", fundamental.safety_rating(c("s")).alias("safety"), fixed.alias("q"), fundamental.quality_rating(fixed).alias("r"), scaled.alias("n")).first()
    assert (row.s, row.q) == (pytest.approx(score, abs=1e-3), pytest.approx(quality, abs=1e-3))
    assert (row.safety, row.r) == (safety, rating)
    assert row.n == pytest.approx(quality / (0.8 if raised == 0 else 1.0), abs=1e-3)


def test_expression_edges(spark):
    c = F.col
    row = spark.createDataFrame([(0.1 + 0.2, 0.0, None)], "a double, zero double, missing double").select(
        ladder(c("a"), [(0.3, "yes")], "no").alias("edge"), ladder(c("missing"), [(1, "x")], "y").alias("null_ladder"), ratio(c("a"), c("zero")).alias("by_zero"),
        clamp(c("missing")).alias("null_clamp"), clamp(F.lit(140.0)).alias("high"), number(F.lit("1,234")).alias("n"), number(F.lit("")).alias("empty"),
        number(F.lit("$5.50")).alias("money"), number(F.lit("-4.5%")).alias("pct"), number(F.lit("N/A")).alias("na"), number(F.lit("-")).alias("dash"),
        iso_date(F.lit("2024-02-30")).alias("bad_day"), iso_date(F.lit("2024-02-29")).alias("leap")).first()
    assert (row.edge, row.null_ladder, row.by_zero, row.null_clamp, row.high) == ("yes", None, None, None, 100.0)
    assert (row.n, row.empty, row.money, row.pct, row.na, row.dash) == (1234.0, None, 5.5, -4.5, None, None)
    assert row.bad_day is None and row.leap == date(2024, 2, 29)


def test_sample_moments_match_pandas(spark):
    values = pd.Series([1.0, 2.0, 4.0, 9.0, 30.0])
    row = spark.createDataFrame(values.to_frame("x")).agg(sample_skew(F.col("x")).alias("s"), sample_kurtosis(F.col("x")).alias("k")).first()
    assert (row.s, row.k) == (pytest.approx(values.skew()), pytest.approx(values.kurt()))


def test_trailing_means_match_pandas(spark):
    rng = Random(3)
    closes = [rng.uniform(10, 20) for _ in range(120)]
    found = trailing_means(bars(spark, closes), {"m": ("close", 20)}).orderBy("trade_date").toPandas()["m"]
    assert np.allclose(found, pd.Series(closes).rolling(20, min_periods=1).mean())


def test_rsi_flat_rising_and_warm_up(spark):
    assert series.rsi(bars(spark, [5] * 20)).where("rsi is not null").count() == 0
    rising = series.rsi(bars(spark, range(1, 21))).orderBy("trade_date").toPandas()["rsi"]
    assert rising[:13].isna().all() and (rising[13:] == 100).all()


def test_drawdown_peak_starts_at_second_bar(spark):
    assert series.max_drawdown(bars(spark, [100, 50, 60, 54])).first().max_drawdown == pytest.approx(-0.1)


@pytest.mark.parametrize("break_on_gap, streak", [(True, 2), (False, 4)])
def test_gap_year_breaks_the_payment_streak(spark, break_on_gap, streak):
    years = spark.createDataFrame([("A", y, float(y), 4) for y in (2018, 2019, 2021, 2022)], "symbol string, year int, total_dividend double, payment_count int")
    row = series.dividend_streaks(series.dividend_changes(years), break_on_gap).first()
    assert (row.payment_streak_years, row.increase_streak_years) == (streak, 3)


def test_risk_needs_twenty_returns_and_classes_calm_series(spark):
    rng = Random(1)
    calm = [100 * (1 + 0.001 * rng.uniform(-1, 1)) for _ in range(21)]
    both = bars(spark, calm, "A").union(bars(spark, calm[:20], "B"))
    bench = bars(spark, calm).select("trade_date", "close")
    rows = technical.risk_metrics(both, bench, listing(spark, "AB"), F.lit(day(20)), 252).collect()
    assert [(r.symbol, r.risk_category, r.trading_days) for r in rows] == [("A", "LOW", 20)]
    returns = pd.Series(calm).pct_change().dropna()
    assert rows[0].beta == pytest.approx(1.0) and rows[0].var_95 == pytest.approx(returns.quantile(0.05))
    assert rows[0].cvar_95 == pytest.approx(returns[returns <= returns.quantile(0.05)].mean())


def test_flat_prices_have_no_ratio(spark):
    flat = bars(spark, [10] * 25)
    row = technical.risk_metrics(flat, flat.select("trade_date", "close"), listing(spark), F.lit(day(24)), 252).first()
    assert (row.sharpe_ratio, row.beta, row.sortino_ratio, row.max_drawdown) == (0.0, None, None, 0.0)


def test_ranks_with_heavy_ties_match_pandas(spark):
    rng = Random(5)
    frame = pd.DataFrame({"symbol": range(3000), "score": [rng.choice([50.0] * 5 + [rng.uniform(0, 100)]) for _ in range(3000)]})
    df = spark.createDataFrame(frame).repartition(8)
    place = numbered(df, [F.desc("score"), F.asc("symbol")], "n").toPandas().sort_values("n")
    wanted = frame.sort_values(["score", "symbol"], ascending=[False, True])
    assert list(place["n"]) == list(range(1, 3001)) and list(place["symbol"]) == list(wanted["symbol"])
    for method in ("min", "dense"):
        found = tied_rank(df, "score", "symbol", "r", method).toPandas().set_index("symbol").sort_index()["r"]
        assert (found.to_numpy() == frame["score"].rank(ascending=False, method=method).to_numpy()).all()


def test_exact_quantiles_match_numpy(spark):
    rng = Random(8)
    values = [rng.gauss(0, 1) for _ in range(1001)] + [0.5] * 500
    row = exact_quantiles(spark.createDataFrame([(v,) for v in values], "x double").repartition(8), "x", {"m": 0.5, "p90": 0.9}).first()
    assert (row.m, row.p90) == (pytest.approx(np.median(values)), pytest.approx(np.percentile(values, 90)))


def greedy(rows, n=10, per_sector=3, per_industry=2):
    taken, sectors, industries = [], {}, {}
    for symbol, sector, industry, score in sorted(rows, key=lambda r: (-r[3], r[0])):
        if len(taken) < n and sectors.get(sector, 0) < per_sector and industries.get(industry, 0) < per_industry:
            taken.append(symbol)
            sectors[sector], industries[industry] = sectors.get(sector, 0) + 1, industries.get(industry, 0) + 1
    return taken


def test_capped_selection_equals_greedy_also_with_shared_industries(spark):
    rng, rows = Random(11), []
    for case in range(40):
        rows += [(case, s, f"S{rng.randint(0, 3)}", f"I{rng.randint(0, 6)}", float(rng.randint(0, 30))) for s in range(rng.randint(0, 40))]
    df = spark.createDataFrame(rows, "c int, symbol int, sector string, industry string, score double")
    picked = portfolio.capped_selection(df, "score", group="c").orderBy("c", "selection_rank").toPandas()
    for case in range(40):
        assert list(picked[picked.c == case].symbol) == greedy([r[1:] for r in rows if r[0] == case])


def test_as_of_join_equals_brute_force(spark):
    rng = Random(4)
    right = sorted({(rng.choice("AB"), day(rng.randint(0, 60))) for _ in range(40)})
    right = [(s, d, float(i)) for i, (s, d) in enumerate(right)]
    left = [(i, rng.choice("AAAAAC"), day(rng.randint(-5, 70))) for i in range(200)]
    found = joins.as_of_join(spark.createDataFrame(left, "id int, symbol string, t date"), spark.createDataFrame(right, "symbol string, d date, v double"),
                             "symbol", "t", "d", ["v"]).collect()
    wanted = {i: max(((d, v) for s2, d, v in right if s2 == s and d <= t), default=(None, None))[1] for i, s, t in left}
    assert len(found) == len(left) and {r.id: r.v for r in found} == wanted


def test_merge_is_idempotent_and_later_rows_win(spark):
    schema = "symbol string, trade_date date, close double"
    old = spark.createDataFrame([("A", day(0), 1.0), ("A", day(1), 2.0)], schema)
    new = spark.createDataFrame([("A", day(1), 3.0), ("A", day(1), 4.0), ("B", day(1), 5.0)], schema)
    once = maintenance.merge_latest(old, new, ["symbol", "trade_date"], ["close"])
    twice = maintenance.merge_latest(once, new, ["symbol", "trade_date"], ["close"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [("A", day(0), 1.0), ("A", day(1), 4.0), ("B", day(1), 5.0)]


def test_hot_key_upsert_keeps_one_row(spark):
    hot = spark.range(0, 5000).select(F.lit("A").alias("symbol"), F.lit(day(1)).alias("trade_date"), F.col("id").cast("double").alias("close"))
    assert maintenance.dedupe_on_key(hot, ["symbol", "trade_date"], ["close"]).collect() == [("A", day(1), 4999.0)]


def test_incremental_rows(spark):
    schema = "symbol string, trade_date date"
    source = spark.createDataFrame([("A", day(0)), ("A", day(2)), ("B", day(1))], schema)
    target = spark.createDataFrame([("A", day(1))], schema)
    assert sorted(maintenance.incremental_new_rows(source, target, "symbol", "trade_date").collect()) == [("A", day(2)), ("B", day(1))]
    empty = spark.createDataFrame([], schema)
    assert maintenance.incremental_new_rows(source, empty, None, "trade_date").count() == 3


def test_listing_filter(spark):
    rows = [(s, "NYSE", "Stock", "Active") for s in ("IBM", "BAC.PRE", "XYZ.WS", "ABC12345", "X-PB", "U.UN", "R.RT", "BRK.A")] + [("OTCX", "OTC", "Stock", "Active")]
    found = filters.common_stock_symbols(spark.createDataFrame(rows, "symbol string, exchange string, assetType string, status string"))
    assert sorted(r.symbol for r in found.collect()) == ["BRK.A", "IBM"]


def test_insider_payload_text_numbers(spark):
    text = ('{"data": [{"transaction_date": "2024-01-05", "executive": "Jo", "executive_title": "Chief Financial Officer", "acquisition_or_disposal": "a", '
            '"shares": "1,234", "share_price": "$2.5"}, {"transaction_date": "2024-01-06", "shares": "", "share_price": ""}, {"transaction_date": null}]}')
    rows = payloads.parse_insider(spark.createDataFrame([("A", text)], "symbol string, payload string")).orderBy("transaction_date").collect()
    assert [(r.transaction_type, r.total_value, r.is_cfo, r.is_officer, r.price_per_share) for r in rows] == [("BUY", 3085.0, True, True, 2.5), ("SELL", 0.0, False, False, None)]


def test_free_cash_flow_fallback(spark):
    def cash(capex):
        return '{"quarterlyReports": [{"fiscalDateEnding": "2024-03-31", "operatingCashflow": "100", "capitalExpenditures": %s}]}' % capex
    income = '{"quarterlyReports": [{"fiscalDateEnding": "2024-03-31", "totalRevenue": "0", "netIncome": "7"}]}'
    rows = [(n, income, None, cash(c)) for n, c in (("A", '"-30"'), ("B", "null"), ("C", '"None"'))]
    found = payloads.combine_statements(spark.createDataFrame(rows, "symbol string, income string, balance string, cash string")).orderBy("symbol").collect()
    assert [r.free_cash_flow for r in found] == [70.0, 100.0, None] and found[0].net_margin is None


def test_one_row_per_symbol_with_two_score_dates(spark):
    scores = spark.createDataFrame([("A", day(0), 1), ("A", day(9), 2), ("B", day(3), 3)], "symbol string, d date, score int")
    assert sorted(latest_by(scores, ["symbol"], "d").collect()) == [("A", day(9), 2), ("B", day(3), 3)]


def test_rebalance_enters_on_the_next_trading_day(spark):
    days = spark.createDataFrame([(day(n),) for n in (0, 10, 33, 40, 65)], "trade_date date")
    rows = evaluation.rebalance_calendar(days, "monthly").orderBy("rebalance_date").collect()
    assert [(r.rebalance_date, r.entry_day, r.next_entry) for r in rows] == [
        (date(2024, 1, 1), day(0), day(33)), (date(2024, 2, 1), day(33), day(65)), (date(2024, 3, 1), day(65), None)]


def test_turnover_and_cost(spark):
    calendar = spark.createDataFrame([(day(0), day(0), 0, day(2)), (day(2), day(2), 1, day(4))], "rebalance_date date, entry_day date, period_no int, next_entry date")
    picks = spark.createDataFrame([("V", day(0), "A", 0.5), ("V", day(0), "B", 0.5), ("V", day(2), "A", 1.0)], "strategy string, rebalance_date date, symbol string, weight double")
    moved = {r.period_no: r.turnover for r in evaluation.turnover(picks, calendar).collect()}
    assert moved == {0: 1.0, 1: 1.0}
    prices = bars(spark, [10, 11, 12.1, 13.31, 14.641], "A").union(bars(spark, [10] * 5, "B"))
    rows = evaluation.strategy_returns(picks, prices, calendar, prices.select("trade_date").distinct()).orderBy("trade_date").collect()
    assert [round(r.gross_return, 9) for r in rows] == [0.05, 0.05, 0.1, 0.1] and [r.cost for r in rows] == [0.002, 0.0, 0.002, 0.0]


def test_best_portfolio_takes_the_first_on_ties(spark):
    row = spark.createDataFrame([(50.0, 50.0, 50.0)], "value_score double, growth_score double, dividend_score double").select(signals.best_portfolio().alias("b")).first()
    assert row.b == "VALUE"


def test_shares_of_a_hot_group_sum_to_one(spark):
    rows = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.lit(2.0).alias("v"))
    sums = aggregates.share_of_total(rows, ["g"], "v").groupBy("g").agg(F.sum("weight").alias("s")).where(F.abs(F.col("s") - 1) > 1e-9)
    assert sums.count() == 0


@pytest.mark.parametrize("files_per_batch", [1, 7, 100])
def test_stream_result_does_not_follow_the_files(spark, tmp_path, files_per_batch):
    schema = bars(spark, [1]).schema
    source, root = str(tmp_path / "in"), str(tmp_path / "out")

    def drain():
        stream = ingest.price_stream(spark, source, schema, files_per_batch)
        return ingest.run_ingest(stream, ingest.MergedTable(spark, root, schema, ["symbol", "trade_date"]), str(tmp_path / "cp"))

    days = list(range(1, 21))
    late_first = bars(spark, days).orderBy(F.desc("trade_date"))
    late_first.repartitionByRange(10, F.desc("trade_date")).write.parquet(source)
    expected = sorted(map(tuple, bars(spark, days).collect()))
    assert sorted(map(tuple, drain().collect())) == expected
    bars(spark, days[:5]).coalesce(1).write.mode("append").parquet(source)  # a repeat of old days
    bars(spark, [*days, 21, 22]).coalesce(1).write.mode("append").parquet(source)
    assert sorted(map(tuple, drain().collect())) == sorted(map(tuple, bars(spark, [*days, 21, 22]).collect()))
    assert drain().count() == 22
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["table"]


def test_merge_writes_only_months_with_new_rows(spark, tmp_path):
    def price(day, close):
        return (day, close + 1, close - 1, close)

    def frame(*rows):
        return spark.createDataFrame([("A", date.fromisoformat(d), *rest) for d, *rest in rows], "symbol string, trade_date date, high double, low double, close double")

    first = frame(price("2024-01-05", 1.0), price("2024-02-05", 2.0), price("2024-03-05", 3.0))
    table = ingest.MergedTable(spark, str(tmp_path / "t"), first.schema, ["symbol", "trade_date"])
    table.keep(first, 0)
    table.merge()

    def files():
        return {p.parent.name: p.name for p in (tmp_path / "t" / "table").rglob("part-*.parquet")}

    before = files()
    table.keep(frame(price("2024-02-05", 9.0), price("2024-04-01", 4.0)), 0)
    rows = {str(r.trade_date): r.close for r in table.merge().collect()}
    assert rows == {"2024-01-05": 1.0, "2024-02-05": 9.0, "2024-03-05": 3.0, "2024-04-01": 4.0}
    after = files()
    assert {m for m in after if before.get(m) != after[m]} == {"month__=2024-02", "month__=2024-04"}


def test_merge_broken_off_is_done_again(spark, tmp_path, monkeypatch):
    first, more = bars(spark, [1, 2, 3]), bars(spark, [1, 2, 3, 7, 8])
    table = ingest.MergedTable(spark, str(tmp_path), first.schema, ["symbol", "trade_date"])
    table.keep(first, 0)
    table.merge()
    table.keep(more, 0)
    with monkeypatch.context() as broken:
        broken.setattr(ingest.MergedTable, "_put_in_place", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.merge()
    again = ingest.MergedTable(spark, str(tmp_path), first.schema, ["symbol", "trade_date"])
    assert sorted(map(tuple, again.rows().collect())) == sorted(map(tuple, more.collect()))
    assert again.merge().count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["table"]


def test_stream_forgets_keys_behind_the_watermark(spark, tmp_path):
    start = datetime(2024, 1, 1)

    def arrive(rows):
        frame = spark.createDataFrame([(k, start + timedelta(days=d)) for k, d in rows], "k long, ts timestamp")
        frame.write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.deduplicated(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), ["k"], "ts", "3 days")
        query = ingest.run_append(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        return query.recentProgress[-1].stateOperators[0].numRowsTotal

    # A key is kept until its time and the delay lie behind the newest time less the delay: six days.
    assert arrive([(n, n % 10) for n in range(100)]) == 60
    arrive([(5, 5), (8, 8), (200, 1), (201, 9), (201, 9)])  # too late, a repeat, too late, new, its repeat
    assert arrive([(n, n) for n in range(300, 330)]) == 6
    rows = [r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(rows) == [*range(100), 201, *range(300, 330)]


def test_stamps_change_with_values_only(spark):
    old = spark.createDataFrame([(1, 5, None, 10), (2, 6, "b", 10), (3, 7, "c", 10), (4, 8, "d", None)], "k int, v int, w string, at int")
    new = spark.createDataFrame([(1, 5, None), (2, 6, "x"), (4, 8, "d"), (5, 1, "e"), (5, 2, "f")], "k int, v int, w string")
    rows = maintenance.merge_stamped(old, new, ["k"], ["v"], "at", F.lit(20))
    assert rows.columns == old.columns
    assert sorted(map(tuple, rows.collect())) == [(1, 5, None, 10), (2, 6, "x", 20), (3, 7, "c", 10), (4, 8, "d", 20), (5, 2, "f", 20)]


def test_stream_reads_a_table_of_many_files(spark, tmp_path):
    from equiloom.plans import queries_tables
    from equiloom.plans.derived import Derived

    whole = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    whole.repartition(50).write.parquet(str(tmp_path / "lineitem.parquet"))
    one = sorted(map(tuple, queries_tables.streamed(Derived(spark, "/root/testdata/sf0.001")).collect()))
    for files_per_batch in (7, 100):
        assert sorted(map(tuple, queries_tables.streamed(Derived(spark, str(tmp_path)), files_per_batch).collect())) == one


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), 1e17])
def test_means_recover_from_an_odd_value(spark, odd):
    rows = trailing_means(bars(spark, [1.0] * 5 + [odd] + [1.0] * 20), {"m": ("close", 5)}).orderBy("trade_date").collect()
    assert [r.m for r in rows][:5] + [r.m for r in rows][10:] == [1.0] * 21


@pytest.mark.parametrize("odd", [None, float("nan"), float("inf"), 1e17])
def test_wide_means_come_from_sums_of_tens_and_fifties(spark, odd):
    rng = Random(4)
    closes = [odd if n in (7, 130) else rng.uniform(10, 20) for n in range(400)]
    rows = spark.createDataFrame([(s, day(n), x) for s in "AB" for n, x in enumerate(closes if s == "A" else [None, None, *closes[200:270]])], "symbol string, trade_date date, close double")
    spans = (1, 5, 20, 30, 50, 55, 100, 120, 200, 230)
    means = trailing_means(rows, {f"m{n}": ("close", n) for n in spans})
    assert means.columns == [*rows.columns, *(f"m{n}" for n in spans)]
    frames = [int(n) for n in re.findall(r"specifiedwindowframe\(RowFrame, -(\d+), currentrow", means._jdf.queryExecution().optimizedPlan().toString())]
    assert max(frames) == 54  # a span no sums of ten make up
    for symbol, part in means.toPandas().sort_values("trade_date").groupby("symbol"):
        values = part["close"].tolist()
        for n in spans:
            for at, found in enumerate(part[f"m{n}"]):
                seen = [x for x in values[max(0, at - n + 1):at + 1] if x is not None and not (odd is None and np.isnan(x))]
                if not seen:
                    assert pd.isna(found)
                elif not any(x == odd or (x != x) for x in seen):
                    assert found == pytest.approx(np.mean(seen), rel=1e-12)


def test_quantiles_and_ranks_of_a_hot_value(spark):
    rows = spark.range(0, 20000).select(F.when(F.col("id") % 10 < 9, 0.0).otherwise(F.col("id") / 7).alias("v"), "id")
    values = sorted(r.v for r in rows.collect())
    found = exact_quantiles(rows, "v", {"a": 0.25, "b": 0.5, "c": 0.95, "d": 1.0, "e": 0.0}).first()
    assert [round(found[c], 6) for c in "abcde"] == [round(float(np.quantile(values, q)), 6) for q in (0.25, 0.5, 0.95, 1, 0)]
    placed = levels(rows, "v", F.col("v").asc())
    assert placed.count() == 2001  # what is sorted has one row for each different value
    ranks = {r.id: r.rank for r in tied_rank(rows, "v", "id", "rank").collect()}
    assert ranks[19999] == 1 and ranks[0] == 2001 and ranks[9] == 2000


def test_cluster_without_checkpoint_setting_is_refused():
    from equiloom.session import shared_dir

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        shared_dir(Session())


def brute_falls(closes, n):
    out = []
    for i in range(len(closes) - n):
        peak, low = closes[i], 0.0
        for x in closes[i + 1:i + n + 1]:
            peak = max(peak, x)
            low = min(low, x / peak - 1)
        out.append(round(low, 12))
    return out


@pytest.mark.parametrize("spans", [{"a": 1, "b": 5}, {"a": 21, "b": 63}, {"a": 2, "b": 12}])
def test_forward_falls(spark, spans):
    rng = Random(3)
    closes = [rng.uniform(5, 9) for _ in range(150)]
    rows = technical.forward_falls(bars(spark, closes), spans, series.by_symbol()).orderBy("trade_date").collect()
    for name, n in spans.items():
        assert [round(r[name], 12) for r in rows][:len(closes) - n] == brute_falls(closes, n)
    assert rows[-1]["a"] == 0.0


def test_forward_falls_hold_no_lists(spark):
    plan = technical.forward_returns(bars(spark, [1.0] * 5))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Sort [") == 1


@pytest.mark.parametrize("segments", [1, 2, 50])
def test_drawdown_of_a_long_series_in_segments(spark, segments):
    rng = Random(segments)
    closes = [100.0]  # the first bar is the highest, and does not count
    for _ in range(399):
        closes.append(rng.uniform(1, 50))
    prices = bars(spark, closes, "A").union(bars(spark, [3.0], "B")).union(bars(spark, [9.0, 3.0, 2.0, 6.0], "C"))
    part = F.floor(F.datediff("trade_date", F.lit(START)) * segments / 400)
    found = {r.symbol: round(r.max_drawdown, 12) for r in series.max_drawdown(prices, part).collect()}
    peak, worst = 0.0, 0.0
    for x in closes[1:]:
        peak = max(peak, x)
        worst = min(worst, x / peak - 1)
    assert found == {"A": round(worst, 12), "C": round(2 / 3 - 1, 12)}


def test_as_of_join_of_events_splits_a_hot_key(spark):
    rng = Random(9)
    right = [(0 if n % 10 else n, START_TIME + timedelta(minutes=rng.randrange(50_000)), n) for n in range(4000)]
    left = [(rng.choice([0, 0, 10, 20, 99999]), START_TIME + timedelta(minutes=rng.randrange(-100, 51_000))) for _ in range(500)] + [(None, START_TIME), (0, None)]
    known = spark.createDataFrame(right + [(None, START_TIME, 1), (0, None, 2)], "k int, at timestamp, v int")
    asked = spark.createDataFrame(left, "k int, ts timestamp")
    rows = joins.as_of_join(asked, known, "k", "ts", "at", ["v"], bucket=F.to_date).collect()

    def answer(k, ts):
        if k is None or ts is None:
            return None
        return max(((t, v) for q, t, v in right if q == k and t <= ts), default=(None, None))[1]

    assert sorted(map(str, ((r.k, r.ts, r.v) for r in rows))) == sorted(map(str, ((k, ts, answer(k, ts)) for k, ts in left)))
    # What one window holds of the key with nine tenths of the rows, dealt to eight tasks.
    marks = joins.bucketed(known.select("k", F.col("at").alias("_t")), F.to_date).where("k is not null").repartition(8, "k", "_bucket")
    tasks = [r["count"] for r in marks.groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) <= 2 * sum(tasks) / 8


def test_interval_join_of_overlapping_periods(spark):
    rng = Random(2)
    facts = [(n, n % 3, START_TIME + timedelta(seconds=rng.randrange(900_000))) for n in range(400)] + [(-1, 0, None), (-2, 0, START_TIME)]
    periods = [(n % 3, START_TIME + timedelta(seconds=a), START_TIME + timedelta(seconds=a + rng.choice([-5, 0, 1, 4000, 90_000, 700_000]))) for n, a in enumerate(rng.sample(range(900_000), 60))]
    periods += [(0, START_TIME, START_TIME + timedelta(seconds=1)), (0, None, START_TIME), (0, START_TIME, None)]
    f, p = spark.createDataFrame(facts, "n int, k int, ts timestamp"), spark.createDataFrame(periods, "k int, a timestamp, z timestamp")
    inside = sorted((n, a, z) for n, k, t in facts for q, a, z in periods if k == q and t and a and z and a <= t < z)
    for seconds in (600, 86_400, 10**7):
        met = joins.interval_join(f, p, "ts", "a", "z", seconds, ["k"])
        assert sorted((r.n, r.a, r.z) for r in met.collect()) == inside
        assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()


def test_entry_days_without_a_nested_loop(spark):
    days = spark.createDataFrame([(day(n),) for n in (0, 1, 4, 5, 9, 9)], "trade_date date")
    dates = spark.createDataFrame([(day(n),) for n in (-3, 0, 2, 4, 6, 9, 10)], "rebalance_date date")
    found = evaluation.as_of_entry(dates, days)
    assert {(r.rebalance_date - START).days: (r.entry_day - START).days for r in found.collect()} == {-3: 0, 0: 0, 2: 4, 4: 4, 6: 9, 9: 9}
    periods = spark.createDataFrame([(day(0), day(5)), (day(3), day(9)), (day(4), day(4))], "period_start date, period_end date")
    for open_start, expected in ((False, [(0, 0), (0, 1), (0, 4), (3, 4), (3, 5)]), (True, [(0, 1), (0, 4), (0, 5), (3, 4), (3, 5), (3, 9)])):
        mapped = joins.day_periods(days, periods, open_start)
        assert sorted(((r.period_start - START).days, (r.trade_date - START).days) for r in mapped.collect()) == expected
        assert "NestedLoop" not in mapped._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk", [1, 4, 7, 240])
def test_sequences_are_slices_of_chunks(spark, chunk):
    prices = bars(spark, range(1, 41), "A").union(bars(spark, range(100, 105), "B")).union(bars(spark, range(200, 206), "C"))
    rows = series.sequences(prices, ("close",), "volume", length=5, chunk=chunk).collect()
    found = {(r.symbol, (r.trade_date - START).days): ([(x.close, (x.trade_date - START).days) for x in r.sequence], r.target) for r in rows}
    expected = {("A", n): ([(float(m + 1), m) for m in range(n - 5, n)], 1000 + n) for n in range(5, 40)}
    assert found == expected | {("C", 5): ([(200.0 + m, m) for m in range(5)], 1005)} and len(rows) == 36


def test_as_of_series_joins_nothing_back(spark):
    left = [(1, "A", day(0)), (2, "A", day(5)), (2, "A", day(5)), (3, "A", None), (4, None, day(5)), (5, "B", day(9)), (6, "C", day(9))]
    right = [("A", day(1), 1.0), ("A", day(5), None), ("A", None, 3.0), (None, day(2), 4.0), ("B", day(9), 5.0), ("B", day(10), 6.0)]
    asked, known = spark.createDataFrame(left, "id int, symbol string, t date"), spark.createDataFrame(right, "symbol string, d date, v double")
    found = joins.as_of_series(asked, known, "symbol", "t", "d", ["v"])
    assert sorted(map(str, found.collect())) == sorted(map(str, joins.as_of_join(asked, known, "symbol", "t", "d", ["v"]).collect()))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    targets = asked.select("symbol", F.col("t").alias("trade_date"), F.lit(0.1).alias("target"))
    scores = known.select("symbol", F.col("d").alias("signal_date"), "v")
    features = learning.ml_features(targets, scores, ["v"], listing(spark, ("A", "B", "C")))
    plan = features._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and len(features.collect()) == 6


def test_parts_are_cut_at_days_known_beforehand(spark):
    rows = spark.createDataFrame([(day(n), float(n)) for n in range(100) for _ in range(1 + n % 3)] + [(None, 0.0)], "trade_date date, target double")
    parts = learning.split_by_date(rows)
    days = sorted((name, r.a, r.z) for name, df in parts.items() for r in df.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("z")).collect())
    assert days == [("test", day(80), day(99)), ("train", day(0), day(63)), ("validation", day(64), day(79))]
    assert not any("ubquery" in df._jdf.queryExecution().optimizedPlan().toString() for df in parts.values())


def test_a_rare_indicator_counts_and_scaled_rows_are_stored(spark):
    """A flag of a tenth of the rows has equal quartiles; scaled by their distance it would be zero in all rows."""
    rng = Random(5)
    rows = spark.createDataFrame([(rng.gauss(0, 1), int(n % 10 == 0), (0.2 if n % 10 == 0 else -0.1) + rng.gauss(0, 0.01)) for n in range(600)], "score double, rare int, target double")
    model = learning.train_return_model(rows, ["rare", "score"], rows, trees=4, indicators=["rare"])
    assert {r.feature: r.importance > 0.5 for r in learning.importances(model, ["rare", "score"]).collect()} == {"rare": True, "score": False}
    seen = {r.rare: r.p for r in learning.predict(model, rows).groupBy("rare").agg(F.avg("predicted").alias("p")).collect()}
    assert seen[1] == pytest.approx(0.2, abs=0.02) and seen[0] == pytest.approx(-0.1, abs=0.02)
    assert learning.predict(model, rows).columns == ["score", "rare", "target", "predicted"]
    plan = learning._scaled(model.__class__(model.stages[:-1]), rows)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "UDF" not in plan


def test_training_reads_closes_stored_once(spark):
    from equiloom.plans.derived import Priced

    v = Priced(spark, "/root/testdata/sf0.001")
    assert v.bars.columns == ["symbol", "trade_date", "close"] and v.bars is v.bars
    assert "lineitem" not in v.bars._jdf.queryExecution().executedPlan().toString()


def test_window_sharpe_from_pieces(spark):
    rng = Random(1)
    returns = [(c, day(n), rng.gauss(0, 0.02) if c else 0.001) for c in (0, 1, 2) for n in range(0, 900, 2)]
    days = spark.createDataFrame([(day(n),) for n in range(900)], "trade_date date")
    windows = evaluation.walk_windows(days, train_months=7, test_months=2, step_months=3)
    table = spark.createDataFrame(returns, "combo int, trade_date date, daily_return double")
    moments = evaluation.return_moments(table, windows, days, ["combo"])
    for start, end in (("train_start", "train_end"), ("test_start", "test_end")):
        found = {(r.combo, r.train_start): (r.x_return, r.x_sharpe) for r in evaluation._window_sharpe(moments, windows, start, end, ["combo"], "x").collect()}
        expected = {}
        for w in windows.collect():
            for c in (0, 1, 2):
                r = np.array([x for q, d, x in returns if q == c and w[start] <= d < w[end]])
                if len(r):
                    total, vol = np.prod(1 + r) - 1, np.std(r) * np.sqrt(252)
                    expected[c, w.train_start] = (total, ((1 + total) ** (252 / len(r)) - 1 - 0.03) / vol if vol > 1e-12 else 0.0)
        assert found.keys() == expected.keys()
        assert all(np.allclose(found[k], expected[k], atol=2e-6) for k in expected)


def test_low_risk_screen_takes_all_categories(spark):
    rows = [(1, "HIGH", 5.0, 0.1), (2, "VERY_HIGH", 4.0, 0.1), (3, "LOW", 3.0, 0.1), (4, "MODERATE", 2.0, 0.1), (5, "LOW", 9.0, -0.1)]
    risk = spark.createDataFrame(rows, "symbol int, risk_category string, risk_adjusted_score double, annual_return double")
    assert [r.symbol for r in SCREENS["low_risk"][0](SimpleNamespace(risk=risk)).collect()] == [1, 2, 3, 4]
    assert [r.symbol for r in reports.low_risk(risk).collect()] == [3]


@pytest.mark.parametrize("strategy", evaluation.SCORE_GRID)
def test_grid_picks_among_many_ties(spark, strategy):
    rng = Random(strategy)
    columns = ["value_score", "growth_score", "dividend_score", "momentum_score", "composite_score", "pe_ratio", "price_to_book", "dividend_yield", "payout_ratio", "revenue_growth", "earnings_growth"]

    def row(symbol, date_no):
        # Some dates have few symbols, and one of them only rows without a positive score.
        values = [None if date_no == 2 else rng.choice([None, -10.0, 0.0, 0.55, 12.0, 60.0, 65.0, 80.0, 100.0, rng.uniform(-10, 100)]) for _ in columns]
        return (symbol, day(date_no), *values, rng.choice([None, 4, 5, 6, 9]))

    rows = [row(s, n) for n, symbols in enumerate((400, 9, 30)) for s in range(symbols)]
    table = spark.createDataFrame(rows, "symbol int, rebalance_date date, " + ", ".join(f"{c} double" for c in columns) + ", fscore int")
    every = evaluation.parameter_grid_scores(table, strategy)
    few = evaluation.contenders(table, strategy)
    n = max(evaluation.PORTFOLIO_GRID[strategy][0])
    expected, found = {}, {}
    for r in every.where("score > 0").select("rebalance_date", "combo", "symbol", F.round("score", 8).alias("s")).collect():
        expected.setdefault((r.rebalance_date, r.combo), []).append((-r.s, r.symbol))
    for r in evaluation.grid_picks(evaluation.parameter_grid_scores(few, strategy), strategy).collect():
        found.setdefault((r.rebalance_date, r.combo), {})[r.pick_no] = r.symbol
    assert found == {k: {i + 1: s for i, (_, s) in enumerate(sorted(v)[:n])} for k, v in expected.items()}
    assert few.count() <= table.count() and every.count() == 81 * len(rows)


def test_walks_trim_tied_rows(spark):
    rows = [(s, day(0), 50.0, 50.0, 50.0, 50.0) for s in range(200)]
    table = spark.createDataFrame(rows, "symbol int, rebalance_date date, value_score double, growth_score double, composite_score double, momentum_score double")
    assert sorted(r.symbol for r in evaluation.contenders(table, "BALANCED").collect()) == list(range(25))


@pytest.mark.parametrize("name", ["a17_sector_quality", "c01_ladders", "g07_breakout_score", "g26_update_holdings", "g36_performance_stats", "g38_walk_forward", "k01_merge_latest", "u01_holding_sets", "u02_union_of_portfolios"])
def test_queries_with_many_readers_store_their_bars(name):
    assert name in QUERIES and name.startswith(COMPOSED)


def test_numbers_without_patterns(spark):
    texts = [" $1,234.5% ", "%$,", "NONE", "n/a", "-", "-3", "1e3", "x1", None, ",N,ULL$", "$-0.5"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", number(F.col("t")).alias("n"))
    assert "regexp_replace" not in rows._jdf.queryExecution().toString()
    assert [r.n for r in rows.orderBy("i").collect()] == [1234.5, None, None, None, None, -3.0, 1000.0, None, None, None, -0.5]


def test_accounts_meet_signals_without_a_sort_of_the_pairs(spark, capsys):
    rng = Random(8)
    kinds = ["BALANCED", "VALUE", "GROWTH", "DIVIDEND", "OTHER", None]
    accounts = [(i, rng.choice(kinds)) for i in range(60)] + [(7, "VALUE"), (7, "BALANCED"), (None, "GROWTH"), (None, "DIVIDEND")]
    queue = [(s, rng.choice([*kinds[1:], "BALANCED"]), float(rng.randrange(6))) for s in range(80)]
    left = spark.createDataFrame(accounts, "account_id long, strategy string")
    found = joins.signals_for_accounts(left, spark.createDataFrame(queue, "symbol long, portfolio_type string, score double"), 5)
    assert found.columns == ["portfolio_type", "account_id", "strategy", "symbol", "score", "row_no"]
    expected = {}
    for account, strategy in accounts:
        meets = joins.TYPES if strategy == "BALANCED" else [strategy]
        expected.setdefault(account, []).extend((-v, s, k) for s, k, v in queue if k is not None and k in meets)
    expected = sorted(((a, n, *row) for a, rows in expected.items() for n, row in enumerate(sorted(rows)[:5], 1)), key=str)
    assert sorted(((r["account_id"], r["row_no"], -r["score"], r["symbol"], r["portfolio_type"]) for r in found.collect()), key=str) == expected
    joins.signals_for_accounts(left, spark.createDataFrame(queue, "symbol long, portfolio_type string, score double"), 5).explain()
    once = capsys.readouterr().out.split("(_rows")[0]  # the branch of ids that stand once
    assert "row_number() windowspecdefinition(account_id" not in once


def test_shares_that_are_not_read_cost_no_join(spark, capsys):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), (None, 5.0)], "g string, v double")
    shared = aggregates.share_of_total(rows, ["g"], "v")
    assert sorted((r["g"], r["v"], r["weight"]) for r in shared.collect()) == [("a", 1.0, 0.25), ("a", 3.0, 0.75), ("b", 2.0, 1.0)]
    shared.groupBy("g").count().explain()
    assert "Join" not in capsys.readouterr().out
